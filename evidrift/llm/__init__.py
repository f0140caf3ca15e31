"""Training-data pipeline operators over document corpora."""
