"""Sinks: raw texts, structured documents, reports, evaluation artifacts, and appended records with a count to resume from. Spark commits each write as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_texts(docs: DataFrame, path: str) -> None:
    """document_id and text, partitioned by the first two digits of the id, so that a document is read back without a scan of all."""
    docs.select("document_id", "text", F.substring("document_id", 1, 2).alias("part")).write.mode("overwrite").partitionBy("part").parquet(path)


def raw_text(spark: SparkSession, path: str, document_id: str) -> str | None:
    row = spark.read.parquet(path).where((F.col("part") == document_id[:2]) & (F.col("document_id") == document_id)).select("text").first()
    return row.text if row else None


def structured(docs: DataFrame, path: str) -> None:
    """A JSON object a line, columns in order of their names, nulls kept."""
    docs.select(*sorted(docs.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_records(rows: DataFrame, path: str) -> int:
    """Appends rows as JSON lines; returns how many the folder holds, from which a run may resume."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    return resume_count(rows.sparkSession, path)


def resume_count(spark: SparkSession, path: str) -> int:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return 0
    return spark.read.text(path).count()


def evaluation_artifact(run_id: str, cases: DataFrame, metrics: DataFrame, failures: DataFrame, path: str, endpoint: str | None = None) -> None:
    """The case results, metrics and failures of a run under its id, and with an endpoint a manifest of its traces."""
    cases.write.mode("overwrite").json(f"{path}/{run_id}/cases")
    metrics.write.mode("overwrite").json(f"{path}/{run_id}/metrics")
    failures.write.mode("overwrite").json(f"{path}/{run_id}/failures")
    if endpoint:
        cases.select(F.lit(run_id).alias("run_id"), F.lit(endpoint).alias("endpoint"), "eval_case_id", "trace_id").write.mode("overwrite").json(f"{path}/{run_id}/traces")


def report(rows: DataFrame, path: str, name: str, at: str) -> str:
    """Rows of a benchmark as one JSON folder with the time in its name."""
    out = f"{path}/{name}-{at}"
    rows.coalesce(1).write.mode("errorifexists").json(out)
    return out
