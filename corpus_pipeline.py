"""Corpus cleaning pipeline: each stage works on what its predecessor kept, and writes it for the next.

Toxic documents go, one document of each near-duplicate class stays, contaminated documents go, the sources are mixed to
their target weights (documents are repeated or left out as the mix takes them), and the mix is written as compacted shards.
All stages but the last return the columns of documents; the last adds each row's shard.

Every stage gives these cases a result: null and empty texts are no evidence of toxicity, copies of nothing, clean, of size 0 (so the mix leaves them out), and kept as they are by the shards; null ids stand for themselves;
rows that repeat an id are judged each by its own text; equal texts are one class, of which one row stays; very long texts are worked through whole; extra columns, whatever their names, are kept
(the last stage's own get an underscore where they clash); an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidrift.llm import decontaminate, jaccard, mixing, toxicity
from evidrift.llm.common import crc_fold, shared_dir, stored, table
from evidrift.llm.sharding import ShardStore


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows outside the held-out fold; rows that score 0.3 or more go. Rows without a text, or without words, have the score of no evidence."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_fold("doc_id", 4) != 2))
    return toxicity.keep(docs, model, 0.3)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the first row stays; rows without words are classes of their own."""
    return jaccard.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least one in twenty stands in a benchmark window go; rows without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times; a source without words is not taken."""
    return mixing.materialise(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, appended and compacted in a new store, with shard and shard_bytes; no row is lost or added."""
    store = ShardStore(spark, f"{shared_dir(spark)}/evidrift/store-{uuid.uuid4().hex}", target=64 << 20)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store.read(place=True)


STAGES = [
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing_sources", mix_sources),
    ("sharding", write_shards),
]

#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
