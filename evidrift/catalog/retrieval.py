"""Queries of retrieval: the benchmark items are the questions, the documents the chunks, their source the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from . import query, table, texts


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _chunks(spark, d):
    return texts(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("source").alias("title"), "text")


_EMBED = """SELECT {key}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (SELECT {key}, slot, sum(n * w) AS v FROM (
  SELECT {key}, n, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 64 AS INTEGER) AS slot, CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (0.5::DOUBLE + CAST(('0x' || substr(h, 11, 2)) AS INTEGER) / 255.0::DOUBLE) AS w
  FROM (SELECT {key}, sha256(t) AS h, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {table}) GROUP BY {key}, t)) GROUP BY {key}, slot)"""
_SPARSE = """SELECT item_id AS qid, doc_id AS chunk_id, sum((length(h) - length(replace(h, t, ''))) // length(t))::DOUBLE AS score
  FROM (SELECT item_id, unnest(list_slice(regexp_extract_all(lower(text), '\\S+'), 1, 64)) AS t FROM benchmark), (SELECT doc_id, lower(source || ' ' || text) AS h FROM documents) GROUP BY ALL HAVING score > 0"""
_RANKED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ({0})) WHERE rank <= {1}"
_DENSE = f"SELECT q.item_id AS qid, c.doc_id AS chunk_id, sum(q.value * c.value) AS score FROM ({_EMBED.format(key='item_id', table='benchmark')}) q JOIN ({_EMBED.format(key='doc_id', table='documents')}) c USING (slot) GROUP BY ALL HAVING score > 0"
_FUSED = f"""WITH dn AS MATERIALIZED ({_RANKED.format(_DENSE, 12)}), sp AS MATERIALIZED ({_RANKED.format(_SPARSE, 12)}),
f AS (SELECT qid, chunk_id, dn.score AS ds, dn.rank AS dr, sp.score AS ss, sp.rank AS sr FROM dn FULL JOIN sp USING (qid, chunk_id)),
n AS (SELECT *, coalesce(ds, 0) / greatest(coalesce(max(ds) OVER (PARTITION BY qid), 1), 1e-9) AS dnorm, coalesce(ss, 0) / greatest(coalesce(max(ss) OVER (PARTITION BY qid), 1), 1e-9) AS snorm FROM f),
g AS (SELECT *, CASE WHEN sr IS NULL THEN dnorm ELSE 0.6 * dnorm + 0.4 * snorm + coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + sr), 0) END AS fused FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, dr IS NULL, dr, sr, chunk_id) AS base_rank FROM g)"""
_FINAL = """,
x AS (SELECT o.*, d.source AS document_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, regexp_extract_all(lower(d.source || ' ' || d.text), '[a-z0-9]+') AS body, regexp_extract_all(lower(d.source), '[a-z0-9]+') AS ti, contains(lower(d.source || ' ' || d.text), lower(b.text)) AS ph, length(d.text) AS n
 FROM o JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = chunk_id),
y AS (SELECT *, CASE WHEN base_rank <= 8 THEN {quality} END AS rerank_score FROM x),
y2 AS (SELECT *, CASE WHEN base_rank <= 8 THEN {weight} * base + (1 - {weight}) * rerank_score ELSE base END AS score FROM y),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_rank <= 8 DESC, CASE WHEN base_rank <= 8 THEN round(score, 9) END DESC NULLS LAST, base_rank) AS final_rank FROM y2),
w AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY final_rank) AS own FROM z),
f5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_rank) AS position FROM w WHERE own <= 2)"""
_QUALITY = "len(list_intersect(q, body)) / greatest(len(q), 1) + CASE WHEN ph THEN 0.25 ELSE 0 END + 0.2 * len(list_intersect(q, ti)) / greatest(len(q), 1)"
_HYBRID = _FUSED.replace("o AS (SELECT *, row_number()", "o AS (SELECT *, fused AS base, row_number()") + _FINAL.format(quality=_QUALITY, weight=0.7)
_PARTS = """SELECT item_id, n, CASE WHEN len(p) > 1 THEN list_concat([n], list_slice(p, 1, 3)) ELSE [n] END AS parts FROM (SELECT item_id, n, list_filter(list_transform(string_split_regex(n, '(?i)\\s+(?:and|also|then|versus|vs\\.?|compared with|compare with)\\s+|[;?]\\s+'), lambda x: regexp_replace(x, '^[ ,]+|[ ,]+$', '', 'g')), lambda x: x <> '') AS p
FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM benchmark))"""


@query("x06_decompose", f"SELECT item_id AS qid, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS query FROM ({_PARTS})")
def x06(spark, d):
    return R.decompose(_queries(spark, d))


@query("x29_embedding", f"SELECT item_id AS qid, slot, round(value, 9) AS value FROM ({_EMBED.format(key='item_id', table='benchmark')})")
def x29(spark, d):
    return R.embed(_queries(spark, d).withColumnRenamed("query", "text"), "qid").select("qid", "slot", F.round("value", 9).alias("value"))


@query("r01_dense", f"SELECT qid, chunk_id, round(score, 9) AS score FROM ({_RANKED.format(_DENSE, 12)})")
def r01(spark, d):
    q = R.vectors(_queries(spark, d).withColumnRenamed("query", "text"), "qid")
    return R.dense(q, R.vectors(_chunks(spark, d), "chunk_id"), 12).select("qid", "chunk_id", F.round("score", 9).alias("score"))


@query("r02_dense_vectors", "SELECT q.vec_id AS qid, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) <= 5")
def r02(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "v")
    return R.dense_arrays(asked, v, 5).select("qid", "vec_id", F.round("score", 9).alias("score"))


@query("r04_sparse", f"SELECT qid, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format(_SPARSE, 10)})")
def r04(spark, d):
    return R.sparse(_queries(spark, d), _chunks(spark, d), 10).select("qid", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


def _fused(spark, d):
    q, c = _queries(spark, d), _chunks(spark, d)
    dense = R.dense(R.vectors(q.withColumnRenamed("query", "text"), "qid"), R.vectors(c, "chunk_id"), 12)
    return R.in_order(R.fuse(dense, R.sparse(q, c, 12)), "fused")


@query("r05_fusion", f"{_FUSED} SELECT qid, chunk_id, round(fused, 9) AS fused, CAST(base_rank AS INTEGER) AS base_rank FROM o")
def r05_fusion(spark, d):
    return _fused(spark, d).select("qid", "chunk_id", F.round("fused", 9).alias("fused"), F.col("base_rank").cast("int").alias("base_rank"))


def _ranked(out):
    return out.select("qid", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), F.round("score", 9).alias("score"), F.col("final_rank").cast("int").alias("final_rank"))


@query("r06_rerank", f"{_HYBRID} SELECT qid, chunk_id, round(rerank_score, 9)::DOUBLE AS rerank_score, round(score, 9)::DOUBLE AS score, CAST(final_rank AS INTEGER) AS final_rank FROM z")
def r06(spark, d):
    return _ranked(R.rerank(_fused(spark, d), _queries(spark, d), _chunks(spark, d)))


@query("r07_cross_encoder", _HYBRID.replace(_QUALITY, "(n % 7) / 7.0").replace("0.7 * base + (1 - 0.7)", "0.5 * base + (1 - 0.5)") + " SELECT qid, chunk_id, round(rerank_score, 9)::DOUBLE AS rerank_score, round(score, 9)::DOUBLE AS score, CAST(final_rank AS INTEGER) AS final_rank FROM z")
def r07(spark, d):
    """The scorer here is a rule on the text's length, so that SQL can follow; a model's pandas UDF goes in its place."""
    return _ranked(R.rerank(_fused(spark, d), _queries(spark, d), _chunks(spark, d), scorer=lambda q, t: (F.length(t) % 7) / 7.0))


@query("r05_hybrid_search", f"{_HYBRID} SELECT qid, document_id, chunk_id, CAST(position AS INTEGER) AS position FROM f5 WHERE position <= 5")
def r05(spark, d):
    out = R.hybrid(_queries(spark, d), _chunks(spark, d), 5, 12)
    return out.select("qid", "document_id", "chunk_id", F.col("position").cast("int").alias("position"))


@query("r11_explain", f"{_HYBRID} SELECT qid, chunk_id, CAST(dr AS INTEGER) AS dense_rank, CAST(sr AS INTEGER) AS sparse_rank, CASE WHEN sr IS NOT NULL THEN 'weighted_rrf' END AS fusion_method, CASE WHEN base_rank <= 8 THEN 'heuristic' END AS reranker FROM f5 WHERE position <= 5")
def r11(spark, d):
    out = R.search(_queries(spark, d), _chunks(spark, d))
    return out.select("qid", "chunk_id", "explain.dense_rank", "explain.sparse_rank", "explain.fusion_method", "explain.reranker")


_LIST_ONLY = "WITH l AS MATERIALIZED ({0}), o AS (SELECT qid, chunk_id, score AS base, rank AS base_rank FROM l)" + _FINAL.format(quality=_QUALITY, weight=0.7) + " SELECT qid, chunk_id, round(score, 9)::DOUBLE AS score, CAST(position AS INTEGER) AS position FROM f5 WHERE position <= 5"


def _listed(out):
    return out.select("qid", "chunk_id", F.round("score", 9).alias("score"), F.col("position").cast("int").alias("position"))


@query("r14_dense_search", _LIST_ONLY.replace("{0}", _RANKED.format(_DENSE, 12)))
def r14_dense(spark, d):
    return _listed(R.search(_queries(spark, d), _chunks(spark, d), 5, "dense"))


@query("r14_sparse_search", _LIST_ONLY.replace("{0}", _RANKED.format(_SPARSE, 5)))
def r14_sparse(spark, d):
    return _listed(R.search(_queries(spark, d), _chunks(spark, d), 5, "sparse"))


@query("r13_decomposed_search", f"""WITH pp AS MATERIALIZED (SELECT item_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS text FROM ({_PARTS})), benchmark AS MATERIALIZED (SELECT part || '#' || item_id AS item_id, text FROM pp), {_HYBRID[len('WITH '):]},
h AS (SELECT CAST(split_part(qid, '#', 2) AS BIGINT) AS qid, CAST(split_part(qid, '#', 1) AS INTEGER) AS part, chunk_id, score, position FROM f5 WHERE position <= 5),
m AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY round(score, 9) DESC, part, position) AS best, min((part, position)) OVER (PARTITION BY qid, chunk_id) AS first FROM h)
SELECT qid, chunk_id, part, round(score, 9)::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first) AS INTEGER) AS rank FROM m WHERE best = 1""")
def r13(spark, d):
    out = R.decomposed_search(_queries(spark, d), _chunks(spark, d))
    return out.select("qid", "chunk_id", "part", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("r03_full_text")
def r03(spark, d):
    """Matches of two words of each question, or its first four as a phrase, by cover density."""
    from ..operators import fulltext

    w = T.words(F.regexp_replace("query", r"[^\p{L}\p{N}\s]", ""))
    asked = _queries(spark, d).select("qid", w.alias("w")).where("size(w) > 8")
    asked = asked.select("qid", F.concat(F.col("w")[0], F.lit(" "), F.col("w")[5], F.lit(" or \""), F.array_join(F.slice("w", 1, 4), " "), F.lit("\" -zz")).alias("query"))
    return fulltext.search(asked, fulltext.postings(_chunks(spark, d)), 10).select("qid", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("r09_siblings", "WITH s AS (SELECT o_orderkey, o_custkey, 'order ' || o_orderkey AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), t AS (SELECT a.o_orderkey, b.text, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.n) AS k FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) SELECT s.o_orderkey AS chunk_id, s.text || coalesce((SELECT string_agg(chr(10) || chr(10) || t.text, '' ORDER BY k) FROM t WHERE t.o_orderkey = s.o_orderkey AND k <= 2), '') AS context FROM s")
def r09(spark, d):
    o = table(spark, d, "orders")
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("parent_chunk_id"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    out = R.expand(chunks.select(F.lit(1).alias("qid"), "chunk_id"), chunks.withColumn("sibling_type", F.lit(None)))
    return out.select("chunk_id", "context")


@query("v01_retrieval_metrics", f"""WITH h AS MATERIALIZED ({_RANKED.format(_SPARSE, 10)}), e AS (SELECT item_id AS qid, 'document' AS kind, source AS v FROM benchmark JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 5 = 0 AND doc_id < 40) ON true UNION ALL SELECT item_id, 'chunk', CAST(item_id * 3 AS VARCHAR) FROM benchmark),
m AS (SELECT h.qid, h.rank, e.kind || ':' || e.v AS unit FROM h JOIN documents d ON d.doc_id = h.chunk_id JOIN e ON e.qid = h.qid AND ((e.kind = 'document' AND e.v = d.source) OR (e.kind = 'chunk' AND e.v = CAST(h.chunk_id AS VARCHAR)))),
r AS (SELECT h.qid, h.rank, EXISTS (SELECT 1 FROM m WHERE m.qid = h.qid AND m.rank = h.rank) AS rel FROM h), n AS (SELECT qid, count(*) AS n FROM e GROUP BY qid), u AS (SELECT qid, count(DISTINCT unit) AS u FROM m GROUP BY qid),
g AS (SELECT n.qid, n.n AS expected, count(r.qid) AS k, count(*) FILTER (WHERE rel) AS good, min(rank) FILTER (WHERE rel) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel), 0) AS dcg FROM n LEFT JOIN r USING (qid) GROUP BY n.qid, n.n)
SELECT g.qid AS case_id, CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_k, coalesce(1.0 / first, 0)::DOUBLE AS mrr_at_k, coalesce(good / nullif(k, 0), 0)::DOUBLE AS context_precision, coalesce(u, 0) / expected AS context_recall,
coalesce(dcg / nullif((SELECT sum(1 / log2(i + 1)) FROM range(1, 100) t(i) WHERE i <= least(expected, k)), 0), 0)::DOUBLE AS ndcg_at_k FROM g LEFT JOIN u USING (qid)""")
def v01(spark, d):
    """Every question expects the documents (sources) of a few chunks, and one chunk by its id."""
    from ..operators import analysis as A

    q = _queries(spark, d)
    chunks = _chunks(spark, d)
    sources = table(spark, d, "documents").where("doc_id % 5 = 0 and doc_id < 40").select(F.lit("document").alias("kind"), F.col("source").alias("value")).distinct()
    expected = q.select(F.col("qid").alias("case_id")).join(F.broadcast(sources)).unionByName(q.select(F.col("qid").alias("case_id"), F.lit("chunk").alias("kind"), (F.col("qid") * 3).cast("string").alias("value")))
    hits = R.sparse(q, chunks, 10).join(chunks.select("chunk_id", "document_id"), "chunk_id").select(F.col("qid").alias("case_id"), "rank", "chunk_id", "document_id", F.lit("http://none").alias("source_uri"))
    n = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected"))
    return A.retrieval_metrics(A.relevance(hits, expected), n)


@query("f15_request_validation", "SELECT event_id AS qid, CASE WHEN event_id % 5 = 0 THEN 'query must have 1 to 2000 characters' WHEN user_id % 60 = 0 OR user_id > 50 THEN 'top_k must be 1 to 50' WHEN event_type = 'click' THEN 'strategy must be sparse, dense or hybrid' WHEN event_type = 'view' THEN 'index_target must be auto, vectors or local' END AS error FROM events")
def f15(spark, d):
    e = table(spark, d, "events")
    return R.validate(e.select(F.col("event_id").alias("qid"), F.when(F.col("event_id") % 5 == 0, "").otherwise("q").alias("query"), F.when(F.col("user_id") % 60 == 0, 0).otherwise(F.col("user_id")).alias("top_k"), F.when(F.col("event_type") == "click", "magic").alias("strategy"), F.when(F.col("event_type") == "view", "moon").alias("index_target")))


@query("f18_flat_results", f"SELECT qid, chunk_id, 'uri' || chunk_id AS source_uri, lang AS access_policy, false AS explained FROM ({_RANKED.format(_SPARSE, 5)}) JOIN documents ON doc_id = chunk_id")
def f18(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("uri"), "doc_id").alias("source_uri"), "text", F.col("lang").alias("access_policy"))
    hits = R.sparse(_queries(spark, d), _chunks(spark, d), 5).withColumn("explain", F.lit("x"))
    out = R.results(hits, chunks)
    return out.select("qid", "chunk_id", "source_uri", F.col("metadata.access_policy").alias("access_policy"), F.lit("explain" in out.columns).alias("explained"))
