"""Queries of joins, set operations, aggregates and lists over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest, retrieval
from . import query, table


@query("j01_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j01(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("j05_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS customers FROM (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def j05(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full_outer")


@query("j12_left_outer", "SELECT c_custkey, o_orderkey IS NOT NULL AS linked, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def j12(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").isNotNull().alias("linked"), "o_totalprice")


@query("j22_known_anchors", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def j22(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("u05_except", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u05(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u01_union_best", "SELECT l_partkey AS chunk_id, max(s) AS score, arg_min(b, (-s, b)) AS batch FROM (SELECT l_partkey, l_quantity AS s, l_linenumber AS b FROM lineitem UNION ALL SELECT l_partkey, l_tax * 100, l_linenumber + 10 FROM lineitem) GROUP BY l_partkey")
def u01(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    both = l.select("l_partkey", F.col("l_quantity").alias("s"), F.col("l_linenumber").alias("b")).unionByName(l.select("l_partkey", (F.col("l_tax") * 100).alias("s"), (F.col("l_linenumber") + 10).alias("b")))
    return both.groupBy(F.col("l_partkey").alias("chunk_id")).agg(F.max("s").alias("score"), F.min_by("b", F.struct(-F.col("s"), F.col("b"))).alias("batch"))


@query("w03_per_document_cap", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def w03(spark, d):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", k).where("k <= 2").select("o_custkey", "o_orderkey")


@query("a07_collected_methods", "SELECT o_custkey, min(o_totalprice) AS least, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '+') AS methods, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def a07(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "+").alias("methods"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("t09_latest_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def t09(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("t10_oldest_queued", "SELECT o_orderpriority AS queue, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def t10(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("job_id"))


@query("k02_embedding_upsert", "SELECT vec_id, label, version FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS k FROM (SELECT vec_id, label, 1 AS version FROM embeddings UNION ALL SELECT vec_id, label + 100, 2 FROM embeddings WHERE label = 3)) WHERE k = 1")
def k02(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("label = 3").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"), F.lit(2).alias("updated_at"))
    old = e.select("vec_id", "label", F.lit(1).alias("version"), F.lit(1).alias("updated_at"))
    return ingest.upsert(old, new, ["vec_id"]).select("vec_id", "label", "version")


@query("k16_backfill", "SELECT doc_id, CASE WHEN source IS NULL OR source = 'src0' THEN 'sample' ELSE source END AS project_id FROM documents")
def k16(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.when(s.isNull() | (s == "src0"), "sample").otherwise(s).alias("project_id"))


@query("f02_filters", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def f02(spark, d):
    return retrieval.filtered(table(spark, d, "documents"), source=["src1", "src2"], lang=["en"], doc_id=[]).select("doc_id")


@query("a01_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS jobs, (SELECT count(DISTINCT source) FROM documents) AS projects")
def a01(spark, d):
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("projects"))
    return docs.crossJoin(table(spark, d, "events").agg(F.count(F.lit(1)).alias("jobs"))).select("documents", "jobs", "projects")


@query("x38_json_fields", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), 'none') AS field FROM events")
def x38(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k"), F.lit("none")).alias("field"))


@query("a02_chunk_counts", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_name")
def a02(spark, d):
    own = table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("customers"))


@query("j16_missing_fields", "SELECT p_partkey, f.name AS field FROM part, (VALUES ('brass'), ('steel'), ('small')) f(name) WHERE NOT contains(lower(p_type || ' ' || p_name), f.name)")
def j16(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    every = part.select("p_partkey", "t", F.explode(F.array(F.lit("brass"), F.lit("steel"), F.lit("small"))).alias("field"))
    return every.where(~F.col("t").contains(F.col("field"))).select("p_partkey", "field")


@query("w06_reading_order_jumps", "SELECT user_id, count(*) FILTER (WHERE value > b + 1) AS jumps FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id")
def w06(spark, d):
    b = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("b", b).groupBy("user_id").agg(F.count_if(F.col("value") > F.col("b") + 1).alias("jumps"))


@query("j07_documents_with_counts", "SELECT o_orderkey, o_custkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, o_custkey")
def j07(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey", "left").fillna(0)


@query("j02_embeddings_with_documents", "SELECT e.vec_id, d.source, l.quality FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = d.doc_id")
def j02(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "embeddings").select("vec_id").join(docs, F.col("vec_id") == F.col("doc_id")).join(labels, "doc_id").select("vec_id", "source", "quality")


@query("u07_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def u07(spark, d):
    kinds = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("x37_map_merge", "SELECT event_id, 'a' || user_id || ',b' || (event_id % 3) AS merged FROM events")
def x37(spark, d):
    """Entries of a later map replace those of an earlier one."""
    first, second = F.create_map(F.lit("x"), F.lit("old"), F.lit("y"), F.concat(F.lit("b"), F.col("event_id") % 3)), F.create_map(F.lit("x"), F.concat(F.lit("a"), "user_id"))
    merged = F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)
    return table(spark, d, "events").select("event_id", F.concat_ws(",", merged["x"], merged["y"]).alias("merged"))


@query("x31_cosine_distance", "SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x31(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(retrieval.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("u02_context_union", "SELECT 'internal' AS kind, item_id AS id FROM benchmark UNION ALL SELECT 'web', page_id FROM pages UNION ALL SELECT 'analysis', vec_id FROM embeddings")
def u02(spark, d):
    part = lambda name, key, kind: table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("benchmark", "item_id", "internal").unionByName(part("pages", "page_id", "web")).unionByName(part("embeddings", "vec_id", "analysis"))
