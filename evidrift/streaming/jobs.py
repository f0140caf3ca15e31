"""Structured Streaming: incremental ingestion, per-client rate limits, windows of telemetry, review decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import evidence, ingest


def ingest_stream(spark: SparkSession, landing: str, state: str, checkpoint: str, size: int = 800, overlap: int = 120, every: str | None = None) -> StreamingQuery:
    """JSON-lines files (project_id, source_uri, title, text) of a landing folder, once each: new and changed documents are chunked and appended
    to `state`/chunks, their hashes to `state`/documents; unchanged ones are skipped. A batch that is run again writes the same folder anew. Without a period, what has landed is worked off and the query ends; the
    checkpoint takes the place of a queue with leases: a file is claimed by one batch, and a batch that was lost is run again."""
    stream = spark.readStream.schema("project_id string, source_uri string, title string, text string").json(landing)

    def batch(df: DataFrame, epoch: int) -> None:
        own = df.sparkSession
        docs = ingest.canonical(df.dropDuplicates(["project_id", "source_uri"]))
        try:
            known = own.read.parquet(f"{state}/documents").where(F.col("epoch") < epoch)
            latest = known.groupBy("project_id", "source_uri").agg(F.max_by("content_hash", "epoch").alias("content_hash"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            latest = docs.select("project_id", "source_uri", "content_hash").limit(0)
        todo = ingest.classify_incoming(docs, latest).where("action <> 'skip'")
        ingest.chunks(todo, size, overlap).write.mode("overwrite").parquet(f"{state}/chunks/epoch={epoch}")
        todo.select("project_id", "source_uri", "document_id", "content_hash").write.mode("overwrite").parquet(f"{state}/documents/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rate_limit(requests: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """requests: client, at (timestamp). Sliding log a client: a request is allowed if fewer than limit allowed ones lie in the window before it. Rows later than the watermark are
    dropped; a row that is late but not so late is judged by the allowed ones before it in time. A client's log goes once the watermark has passed its window."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("at")
        out = []
        for at in rows["at"]:
            now = at.timestamp()
            ok = sum(now - seconds < t <= now for t in log) < limit
            if ok:
                log.append(now)
            out.append((key[0], at, ok))
        behind = state.getCurrentWatermarkMs() / 1000
        log = sorted(t for t in log if t > behind - seconds)
        state.update((log,))
        last = max([behind, *(x.timestamp() for x in rows["at"])])
        state.setTimeoutTimestamp(int((last + seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["client", "at", "allowed"])

    own = requests.withWatermark("at", late)
    return own.groupBy("client").applyInPandasWithState(step, "client string, at timestamp, allowed boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def memory_stream(spark: SparkSession, landing: str, state: str, checkpoint: str) -> StreamingQuery:
    """JSON-lines files of turns (session_id, turn, role, text): each batch appends its turns to `state`/turns and writes the memory of the sessions it touches, from all their
    turns so far, to `state`/memory by epoch; the last epoch of a session is its memory."""
    stream = spark.readStream.schema("session_id string, turn int, role string, text string").json(landing)

    def batch(df: DataFrame, epoch: int) -> None:
        own = df.sparkSession
        df.write.mode("overwrite").parquet(f"{state}/turns/epoch={epoch}")
        turns = own.read.parquet(f"{state}/turns").where(F.col("epoch") <= epoch).drop("epoch")
        touched = turns.join(df.select("session_id").distinct(), "session_id", "left_semi").dropDuplicates(["session_id", "turn"])
        evidence.memory(touched).write.mode("overwrite").parquet(f"{state}/memory/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def soak(telemetry: DataFrame, every: str = "5 seconds") -> DataFrame:
    """telemetry: ts, metric, value. What a soak run looks at: last, highest and mean value of each metric by period, late rows dropped after the watermark."""
    return telemetry.withWatermark("ts", every).groupBy(F.window("ts", every), "metric").agg(F.max_by("value", "ts").alias("last"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events: ts, event_type, value. Counts and sums by tumbling event-time window, late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
