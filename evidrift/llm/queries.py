"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licences, linededup, mixing, mixing_lm, substrings, topk, toxicity
from .common import crc_fold, shared_dir, table
from .sharding import ShardStore


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 7) == 2, F.lit(False))
    model, counts = mixing_lm.train(docs, ~held_out)
    out = mixing_lm.score(docs, model, counts)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents as small shards, compacts them, and reads back every row with its shard."""
    store = ShardStore(spark, f"{shared_dir(spark)}/evidrift/store-{uuid.uuid4().hex}", target=64 << 20)
    store.append(table(spark, sf_dir, "documents"), rows=4096)
    store.compact()
    store.vacuum()
    return store.read(place=True).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_bytes")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", "families", "n_notices")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    ids = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "n_dropped")


_WORDS = "regexp_extract_all(regexp_replace(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("lower_az", _AZ.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.replace("lower_az", _AZ.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_SIZE = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM s),
lv AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
       FROM r WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, coalesce((SELECT max(lev) FROM lv WHERE lev <= most / weight) * weight, most)) AS target FROM lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
g AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
c AS (SELECT source, place, sum(words) OVER (PARTITION BY source ORDER BY place) - words / 2.0 AS mid FROM g)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST((p.passes + CASE WHEN p.target - p.passes * p.source_size > 0 AND c.mid <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op8_mixing": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL}
