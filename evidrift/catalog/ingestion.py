"""Queries of the text functions and of ingestion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest
from ..sources import loaders
from . import query, sql, table, texts

_NORMAL = sql.NORMAL.format("text")
_SENTENCES = sql.SENTENCES.format("text")
_UUID = sql.UUID


@query("x01_tokens", "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def x01(spark, d):
    t = T.tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query("x03_normalise", f"SELECT doc_id, length({_NORMAL}) AS n_chars, sha256({_NORMAL}) AS content_hash FROM documents")
def x03(spark, d):
    own = texts(spark, d).select("doc_id", T.normalise(F.col("text")).alias("n"))  # once, below what uses it twice
    return own.select("doc_id", F.length("n").cast("bigint").alias("n_chars"), F.sha2("n", 256).alias("content_hash"))


@query("x07_sentences", f"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS n_sentences, list_aggregate(list_transform({_SENTENCES}, lambda x: length(x)), 'max') AS longest FROM documents WHERE trim(text) <> ''")
def x07(spark, d):
    s = T.sentences(F.col("text"))
    return texts(spark, d).where("trim(text) <> ''").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("bigint").alias("longest"))


@query("x08_numbers", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b\\d+(?:[.,]\\d+)?%?\\b'))), ',') AS numbers, regexp_matches(lower(text), '\\b(?:not|no|never|without|cannot|can''t)\\b') AS negated FROM conversations")
def x08(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.numbers(F.col("text"))), ",").alias("numbers"), T.negated(F.col("text")).alias("negated"))


@query("x14_truncate", f"SELECT doc_id, {sql.truncated('text', 180)} AS short FROM documents")
def x14(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 180).alias("short"))


@query("x15_slugs", "SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, CASE WHEN b = '' THEN 'project' ELSE b END AS s FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 255) AS b FROM part)))")
def x15(spark, d):
    named = table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_type", "p_brand")).alias("s"))
    n = F.row_number().over(W.partitionBy("s").orderBy("p_partkey"))
    return named.select("p_partkey", F.when(n == 1, F.col("s")).otherwise(F.concat_ws("-", "s", n)).alias("slug"))


@query("x16_file_names", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def x16(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_name(F.regexp_extract("url", r"([^/]*)$", 1)).alias("name"))


@query("x22_token_estimate", "SELECT conv_id, role, CAST(sum(CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, length(text) // 4) END) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, role")
def x22(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("x26_text_hash", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS folded FROM documents")
def x26(spark, d):
    return texts(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("h"), T.text_hash(F.col("text"), True).alias("folded"))


@query("x05_headings", "SELECT doc_id, CAST(count(*) FILTER (WHERE length(l) <= 120 AND ((upper(l) = l AND lower(l) <> l) OR regexp_matches(substr(l, 1, 2), '^[0-9]{1,2}$'))) AS BIGINT) AS headings FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) GROUP BY doc_id")
def x05(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(T.heading(F.col("l"))).alias("headings"))


_I01 = f"SELECT source || ':' || lang AS project_id, 'doc/' || doc_id AS source_uri, {_NORMAL} AS text FROM documents"


def _canonical(spark, d):
    docs = texts(spark, d).select(F.concat_ws(":", "source", "lang").alias("project_id"), F.concat(F.lit("doc/"), "doc_id").alias("source_uri"), F.lit("").alias("title"), "text")
    return ingest.canonical(docs)


@query("i01_canonical", f"SELECT project_id, source_uri, source_uri AS title, length(text) AS n, {_UUID.format("project_id || ':' || source_uri")} AS document_id, sha256(text) AS content_hash FROM ({_I01})")
def i01(spark, d):
    return _canonical(spark, d).select("project_id", "source_uri", "title", F.length("text").cast("bigint").alias("n"), "document_id", "content_hash")


@query(
    "i03_chunks",
    f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS content_hash, regexp_extract_all(text, '\\S+\\s*') AS p, length(regexp_extract(text, '^\\s*')) AS lead FROM documents),
    s AS (SELECT *, unnest(range(0, len(p), 160)) AS s FROM p WHERE len(p) > 0),
    k AS (SELECT *, CAST(s / 160 AS INTEGER) AS ordinal FROM s WHERE s = 0 OR s - 160 + 200 < len(p)),
    b AS (SELECT *, regexp_replace(array_to_string(list_slice(p, s + 1, s + 200), ''), '\\s+$', '') AS body, lead + length(array_to_string(list_slice(p, 1, s), '')) AS char_start FROM k),
    e AS (SELECT *, char_start + length(body) AS char_end FROM b)
    SELECT document_id, ordinal, CAST(least(200, len(p) - s) AS BIGINT) AS token_count, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, sha256(body) AS text_hash,
    {_UUID.format("document_id || ':' || content_hash || ':' || char_start || ':' || char_end || ':v2'")} AS chunk_id FROM e""",
)
def i03(spark, d):
    docs = texts(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_hash"), "text")
    out = ingest.chunks(docs, 200, 40)
    return out.select("document_id", "ordinal", F.col("token_count").cast("bigint").alias("token_count"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.sha2("text", 256).alias("text_hash"), "chunk_id")


@query(
    "j09_provenance",
    """WITH l AS (SELECT o_custkey AS g, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(floor(o_totalprice) AS BIGINT) + 20000 AS e, o_orderpriority AS m FROM orders),
    c AS (SELECT o_custkey AS g, o_orderkey AS chunk_id, CAST(floor(o_totalprice) AS BIGINT) + 5000 AS cs, CAST(floor(o_totalprice) AS BIGINT) + 30000 AS ce FROM orders WHERE o_orderstatus = 'F')
    SELECT chunk_id, array_to_string(list(l.o_orderkey ORDER BY s, CAST(l.o_orderkey AS VARCHAR)), ',') AS element_ids, CAST(min(s) AS DOUBLE) AS min_confidence, array_to_string(list_sort(list(DISTINCT m)), '+') AS extraction_method
    FROM c JOIN l ON c.g = l.g AND l.e > cs AND l.s < ce GROUP BY chunk_id""",
)
def j09(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.expr("cast(floor(o_totalprice) as bigint)"))
    elements = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("string").alias("element_id"), F.col("p").alias("start"), (F.col("p") + 20000).alias("end"), F.col("o_orderpriority").alias("method"), F.col("p").cast("double").alias("confidence"), F.lit(1).alias("page"))
    parts = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("p") + 5000).alias("char_start"), (F.col("p") + 30000).alias("char_end"))
    return ingest.provenance(elements, parts).select("chunk_id", F.array_join("element_ids", ",").alias("element_ids"), "min_confidence", "extraction_method")


@query(
    "j10_as_of",
    "SELECT a.event_id, b.last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN LATERAL (SELECT arg_max(value, ts) AS last_value FROM events e WHERE e.event_type = 'click' AND e.user_id = a.user_id AND e.ts <= a.ts AND e.value IS NOT NULL) b ON true",
)
def j10(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("at_ts"))
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("right_ts"), F.col("value").alias("last_value"))
    return ingest.as_of(left, right, ["user_id"], "at_ts", "right_ts", "last_value").select("event_id", "last_value")


_PAGES = """p AS (SELECT page_id, regexp_replace(html, '^\\s+|\\s+$', '', 'g') AS t, CAST(len(regexp_extract_all(html, '<table')) AS BIGINT) AS n, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS k FROM pages),
q AS (SELECT page_id, least(1.0, length(t) / 100)::DOUBLE AS coverage, ((length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1))::DOUBLE AS replacement_rate, length(t) = 0 AS image_only, least(1.0, n / 8)::DOUBLE AS table_likelihood,
least(1.0, greatest(0, len(list_distinct(list_transform(range(1, k + 1), lambda i: i % 4))) - 1) / 3)::DOUBLE AS column_likelihood, (len(list_filter(range(2, k + 1), lambda i: i + (i % 3) > i - 1 + ((i - 1) % 3) + 1)) / greatest(k - 1, 1))::DOUBLE AS discontinuity FROM p),
r AS (SELECT *, CASE WHEN image_only OR coverage < 0.6 THEN 'ocr' WHEN replacement_rate > 0.01 OR table_likelihood >= 0.5 OR column_likelihood >= 0.67 THEN 'layout' ELSE 'native' END AS route FROM q)"""


@query("x33_page_quality", f"WITH {_PAGES} SELECT page_id, coverage, replacement_rate, image_only, table_likelihood, column_likelihood, discontinuity, route FROM r")
def x33(spark, d):
    p = table(spark, d, "pages")
    k = F.regexp_count("html", F.lit("<p>"))
    each = lambda f, kind: F.when(k > 0, F.transform(F.sequence(F.lit(1), k), f)).otherwise(F.array().cast(f"array<{kind}>"))
    pages = p.select("page_id", F.col("html").alias("text"), F.regexp_count("html", F.lit("<table")).alias("n_tables"), each(lambda i: (i % 4) * 20.0, "double").alias("lefts"), each(lambda i: i + i % 3, "int").alias("orders"))
    return ingest.page_quality(pages)


@query(
    "i09_classify_incoming",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'index' WHEN l.quality = 1 THEN 'skip' ELSE 'reindex' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def i09(spark, d):
    """The stored state holds the labelled documents, those of low quality with another hash."""
    docs = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("source_uri"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id")
    state = labelled.withColumn("content_hash", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.sha2("content_hash", 256)))
    return ingest.classify_incoming(docs, state).select("doc_id", "action")


@query("k01_upsert", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn = 1 UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def k01(spark, d):
    new = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderdate").alias("updated_at"), "o_totalprice", "o_orderkey")
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.col("c_acctbal").alias("o_totalprice"), F.lit(0).cast("bigint").alias("o_orderkey"))
    return ingest.upsert(old, new, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "i11_versions",
    """WITH e AS (SELECT o_orderpriority AS p, o_custkey AS doc, o_orderstatus AS h, o_orderdate AS t, o_orderkey FROM orders),
    c AS (SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY p, doc ORDER BY t, h) AS b FROM e) WHERE b IS NULL OR b <> h)
    SELECT doc, p, sha256(p || ':' || h) AS version_id, lag(sha256(p || ':' || h)) OVER w AS predecessor, lead(t) OVER w AS superseded_at, lead(t) OVER w IS NULL AS is_current FROM c WINDOW w AS (PARTITION BY p, doc ORDER BY t, h)""",
)
def i11(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderpriority").alias("project_id"), F.col("o_custkey").alias("document"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderdate").alias("created_at"))
    return ingest.versions(e).select(F.col("document").alias("doc"), F.col("project_id").alias("p"), "version_id", "predecessor", "superseded_at", "is_current")


@query("k07_stale", "SELECT doc_id FROM documents WHERE (source = 'src1' OR 'doc/' || doc_id LIKE 'doc/1%') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def k07(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("source") == "src1", "arXiv").alias("publisher"), F.concat(F.lit("doc/"), "doc_id").alias("source_uri"))
    return ingest.stale(docs.withColumn("publisher", F.coalesce("publisher", F.lit(""))), table(spark, d, "labels").select(F.col("doc_id").alias("document_id")), "doc/1").select(F.col("document_id").alias("doc_id"))


@query("s17_merge_corpora", "SELECT sha256(source_uri) AS uri, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY f, doc_id) AS rn FROM (SELECT CASE WHEN lang = 'es' THEN '' ELSE text END AS source_uri, source AS f, doc_id FROM documents)) WHERE source_uri = '' OR rn = 1")
def s17(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "es", "").otherwise(F.col("text")).alias("source_uri"), F.col("source").alias("file"), F.col("doc_id").alias("line"))
    return ingest.merge_corpora(docs).select(F.sha2("source_uri", 256).alias("uri"), F.col("line").alias("doc_id"))


@query("s05_jsonl_records", "SELECT CASE WHEN lang = 'en' THEN 'u' || doc_id ELSE 'f' || doc_id || '#1' END AS source_uri, length(text) AS n_chars, sha256(text) AS digest, 'internal' AS access_policy FROM documents")
def s05(spark, d):
    docs = table(spark, d, "documents")
    record = F.to_json(F.struct(F.when(F.col("lang") == "en", F.concat(F.lit("u"), "doc_id")).otherwise("").alias("source_uri"), F.col("text").alias("content")))
    body = docs.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.concat(F.lit("\n"), record, F.lit("\n\n")).alias("body"))
    return loaders.jsonl_records(body).select("source_uri", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"), "access_policy")


@query("s16_inverted_abstract", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM benchmark")
def s16(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("p", "w"))
    index = w.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("item_id", loaders.inverted_abstract(F.col("m")).alias("abstract"))


@query("i04_table_rows", "SELECT p_partkey, 'Table ' || p_brand || '; columns: Name | Size; row: ' || p_name || ' | ' || p_size AS text FROM part")
def i04(spark, d):
    tables = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("table_id"), F.array(F.lit("Name"), F.lit("Size")).alias("headers"), F.array(F.array("p_name", F.col("p_size").cast("string"))).alias("rows"))
    return ingest.table_rows(tables).select("p_partkey", "text")


_GRID = "SELECT p_partkey, 'doc' || p_partkey AS document_id, 'h' || p_size AS content_hash, 'intro text ' || upper(p_name) || ' | ' || p_size || ' end' AS body FROM part"


@query("i04_row_chunks", f"""WITH t AS ({_GRID}), r AS (SELECT t.*, i, CASE i WHEN 1 THEN p.p_name ELSE p.p_type END AS a, CASE i WHEN 1 THEN CAST(p.p_size AS VARCHAR) ELSE p.p_brand END AS b FROM t JOIN part p USING (p_partkey), (VALUES (1), (2)) x(i)),
k AS (SELECT *, 'Table t1; columns: Name | Size; row: ' || a || ' | ' || b AS text, greatest(instr(lower(body), lower(a || ' | ' || b)) - 1, 0) AS s FROM r)
SELECT document_id, i AS row_index, s AS char_start, s + length(text) AS char_end, len(regexp_extract_all(text, '\\S+')) AS token_count, 'e' || (2 * i) || ',e' || (2 * i + 1) AS elements, {_UUID.format("document_id || ':' || content_hash || ':t1:row:' || i || ':v2'")} AS chunk_id,
{_UUID.format("document_id || ':table:t1:v2'")} AS parent_chunk_id, 'table t1, row ' || i AS location_marker, i - 1 AS ordinal FROM k""")
def i04b(spark, d):
    p = table(spark, d, "part")
    rows = F.array(F.array("p_name", F.col("p_size").cast("string")), F.array("p_type", "p_brand"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("e"), i.cast("string")))
    doc = F.concat(F.lit("doc"), "p_partkey")
    tables = p.select(doc.alias("document_id"), F.concat(F.lit("h"), "p_size").alias("content_hash"), F.lit("t1").alias("table_id"), F.array(F.lit("Name"), F.lit("Size")).alias("headers"), rows.alias("rows"), F.lit(None).cast("string").alias("caption"), F.array(F.lit(3)).alias("pages"), ids.alias("element_ids"), F.lit(1.0).alias("confidence"))
    docs = p.select(doc.alias("document_id"), F.concat(F.lit("intro text "), F.upper("p_name"), F.lit(" | "), "p_size", F.lit(" end")).alias("text"))
    out = ingest.table_rows(tables, docs)
    big = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]
    return out.select("document_id", *big("row_index", "char_start", "char_end", "token_count"), F.array_join("element_ids", ",").alias("elements"), "chunk_id", "parent_chunk_id", "location_marker", *big("ordinal"))


@query("x19_markdown", "SELECT p_partkey, 'Table ' || p_brand || chr(10) || '| Name | Size |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' | x |' || chr(10) || '| ' || p_type || ' |  |  |' AS md FROM part")
def x19(spark, d):
    rows = F.array(F.array("p_name", F.col("p_size").cast("string"), F.lit("x")), F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", ingest.markdown(F.col("p_brand"), F.array(F.lit("Name"), F.lit("Size")), rows).alias("md"))


@query("x23_iso_dates", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'spring ' || o_orderkey ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T00:00:00+00:00' END AS iso FROM orders")
def x23(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "").when(k == 1, F.concat(F.lit("spring "), "o_orderkey")).when(k == 2, day).when(k == 3, F.concat(day, F.lit("T00:00:00Z"))).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    return table(spark, d, "orders").select("o_orderkey", T.iso_date(raw).alias("iso"))


@query("x17_source_uris", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/data/a b/' || page_id || '+x.txt' ELSE 'docs/sub/' || page_id END AS uri FROM pages")
def x17(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("file:///data/a%20b/"), "page_id", F.lit("+x.txt?q=1"))).otherwise(F.concat(F.lit("docs//./sub/"), "page_id", F.lit("/")))
    return table(spark, d, "pages").select("page_id", T.source_uri(raw).alias("uri"))


@query("x18_location_markers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'page ' || (o_orderkey % 7) || ', ' ELSE '' END || 'chars ' || o_custkey || '-' || (o_custkey + 10) AS marker FROM orders")
def x18(spark, d):
    page = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7)
    return table(spark, d, "orders").select("o_orderkey", T.location_marker(page, F.col("o_custkey"), F.col("o_custkey") + 10).alias("marker"))


@query("x40_boxes", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN array_to_string([l_quantity, l_tax, l_discount, 9.0], ',') ELSE array_to_string([least(l_quantity, 5.0, 7.0, 1.0), least(l_tax, 2.0, 8.0), greatest(l_quantity, 5.0, 7.0, 1.0), greatest(l_tax, 2.0, 8.0)], ',') END AS box FROM lineitem")
def x40(spark, d):
    point = lambda x, y: F.array(F.col(x) if isinstance(x, str) else F.lit(x), F.col(y) if isinstance(y, str) else F.lit(y))
    k = F.col("l_linenumber") % 3
    points = F.when(k == 0, F.array(point(1.0, 2.0))).when(k == 1, F.array(point("l_quantity", "l_tax"), point("l_discount", 9.0))).otherwise(F.array(point("l_quantity", "l_tax"), point(5.0, 2.0), point(7.0, 8.0), point(1.0, 2.0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.box(points).cast("array<string>"), ",").alias("box"))


@query("x41_any_score", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN (user_id % 3)::DOUBLE WHEN user_id % 2 <> 0 THEN 0.5 ELSE value END AS score FROM events")
def x41(spark, d):
    fused, dense = F.when(F.col("user_id") % 3 == 0, F.lit(0.0)).otherwise((F.col("user_id") % 3).cast("double")), F.when(F.col("user_id") % 2 != 0, 0.5)
    return table(spark, d, "events").select("event_id", T.any_score(fused, dense, F.col("value")).alias("score"))


@query("x44_trait_coverage", "SELECT item_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zz') THEN 1 ELSE 0 END + 1) / 3 AS coverage FROM benchmark")
def x44(spark, d):
    traits = F.array(F.lit("The"), F.lit("ZZ"), F.lit("limited"))
    return table(spark, d, "benchmark").select("item_id", T.trait_coverage(traits, F.col("text"), F.array(F.lit("evidence")), F.lit("Limited.")).alias("coverage"))


def _headed(spark, d):
    """Documents with every third line as a heading, canonical."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return texts(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), T.normalise(F.array_join(lines, "\n")).alias("text")).withColumn("content_hash", F.sha2("text", 256))


_HEADED = f"""h AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {sql.NORMAL.format("array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 THEN '## ' || x ELSE x END), chr(10))")} AS text FROM documents),
hl AS (SELECT document_id, i, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM h)),
hd AS (SELECT document_id, start, trim(regexp_extract(l, '^#{{1,6}}\\s+(.+)$', 1)) AS heading FROM hl WHERE regexp_matches(l, '^#{{1,6}}\\s+.+$')),
hp AS (SELECT document_id, sha256(text) AS content_hash, regexp_extract_all(text, '\\S+\\s*') AS p FROM h), hs AS (SELECT *, unnest(range(0, len(p), 50)) AS s FROM hp WHERE len(p) > 0),
hc AS (SELECT document_id, content_hash, CAST(s // 50 AS INTEGER) AS ordinal, length(array_to_string(list_slice(p, 1, s), '')) AS char_start, regexp_replace(array_to_string(list_slice(p, s + 1, s + 60), ''), '\\s+$', '') AS body FROM hs WHERE s = 0 OR s - 50 + 60 < len(p))"""


@query("x04_headings", f"WITH {_HEADED} SELECT document_id, count(*) AS n, string_agg(heading, '|' ORDER BY start) AS headings FROM hd GROUP BY document_id")
def x04(spark, d):
    h = T.markdown_headings(F.col("text"))
    return _headed(spark, d).select("document_id", F.size(h).cast("bigint").alias("n"), F.array_join(h, "|").alias("headings")).where("n > 0")


@query("i07_sections", f"WITH {_HEADED}, x AS (SELECT hc.*, hd.heading AS section FROM hc ASOF LEFT JOIN hd ON hc.document_id = hd.document_id AND hc.char_start >= hd.start) SELECT document_id, ordinal, section, CASE WHEN section <> '' THEN {_UUID.format("document_id || ':section:' || section || ':v2'")} END AS parent_chunk_id, coalesce(section, '') AS path FROM x")
def i07(spark, d):
    docs = _headed(spark, d)
    return ingest.with_sections(ingest.chunks(docs, 60, 10), docs).select("document_id", "ordinal", "section", "parent_chunk_id", F.array_join("heading_path", "/").alias("path"))


@query("w15_aligned_elements", f"WITH l AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {sql.LIST.format('string_split(replace(text, chr(0), {0}), chr(10))'.format(chr(39) * 2))} AS t FROM documents)), s AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM l) SELECT doc_id, 'e' || i AS element_id, b AS char_start, b + length(t) AS char_end FROM s")
def w15(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), T.normalise(F.col("text")).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    elements = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.posexplode(lines).alias("position", "text")).withColumn("element_id", F.concat(F.lit("e"), (F.col("position") + 1).cast("string"))).withColumn("text", F.concat(F.lit("  "), "text"))
    return ingest.align(elements, docs).select(F.col("document_id").alias("doc_id"), "element_id", F.col("start").cast("bigint").alias("char_start"), F.col("end").cast("bigint").alias("char_end"))


@query("i12_anchors", """WITH e AS (SELECT l_suppkey, l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS e FROM lineitem GROUP BY ALL), x AS (SELECT l_suppkey, l_orderkey, unnest(e) AS element_id, generate_subscripts(e, 1) AS i FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, element_id ORDER BY l_orderkey, i) AS k FROM x) SELECT sha256('p:s' || l_suppkey) || ':' || element_id AS anchor_id, element_id, l_orderkey AS chunk_id, sha256('text ' || l_orderkey) AS text_hash, i AS box FROM r WHERE k = 1""")
def i12(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("element_ids"))
    none = F.lit(None)
    parts = e.select(F.lit("p").alias("project_id"), F.concat(F.lit("s"), "l_suppkey").alias("content_hash"), F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("ordinal"), "element_ids", F.transform("element_ids", lambda x, i: (i + 1).cast("bigint")).alias("bbox_refs"), none.cast("int").alias("page"), none.cast("int").alias("char_start"), none.cast("int").alias("char_end"), F.concat(F.lit(" text  "), "l_orderkey").alias("text"), F.lit("m").alias("extraction_method"), F.lit(1.0).alias("min_confidence"))
    return ingest.anchors(parts).select("anchor_id", "element_id", "chunk_id", "text_hash", F.col("bbox").alias("box"))


@query("s07_table_cells", "SELECT p_partkey, 'p' || p_size || '-table-' || p_partkey AS table_id, 'Name,Size' AS headers, p_name || ',;' || p_type || ',' || p_brand AS rows, array_to_string(list_transform(['r0-c0', 'r0-c1', 'r1-c0', 'r2-c0', 'r2-c1'], lambda x: 'p' || p_size || '-table-' || p_partkey || '-' || x), ',') AS elements FROM part")
def s07(spark, d):
    p = table(spark, d, "part")
    grid = F.array(F.array(F.lit(" "), F.lit("")), F.array(F.lit("Name"), F.lit(" Size ")), F.array("p_name", F.lit(None).cast("string")), F.array("p_type", "p_brand"))
    out = ingest.cells_of(p.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("table_no"), grid.alias("grid")))
    return out.select(F.regexp_extract("table_id", r"-(\d+)$", 1).cast("bigint").alias("p_partkey"), "table_id", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), F.array_join("element_ids", ",").alias("elements"))


@query("s08_blocks", "WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i FROM b) SELECT doc_id, 'p' || doc_id || '-native-' || i AS element_id, CASE WHEN length(t) <= 120 AND ((upper(t) = t AND lower(t) <> t) OR regexp_matches(substr(t, 1, 2), '^[0-9]{1,2}$')) THEN 'heading' ELSE 'paragraph' END AS element_type, length(t) AS n FROM u")
def s08(spark, d):
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.array(F.lit(0.0)).alias("box")))
    out = ingest.blocks_of(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text", blocks.alias("blocks")))
    return out.select(F.col("page").alias("doc_id"), "element_id", "element_type", F.length("text").cast("bigint").alias("n"))


_OCR = "SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<p>([^<]*)<', 1), lambda x: true) AS t FROM pages)"


@query("s12_ocr_elements", f"SELECT page_id, 'p' || page_id || '-ocr-' || (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1) AS element_id, trim(t) AS text, CASE WHEN i <= 3 THEN i / 10 END AS confidence FROM ({_OCR}) WHERE trim(t) <> ''")
def s12(spark, d):
    t = F.regexp_extract_all("html", F.lit("<p>([^<]*)<"), F.lit(1))
    payload = F.to_json(F.struct(F.transform(t, lambda x: F.concat(F.lit(" "), x)).alias("texts"), F.array(*[F.lit(x / 10) for x in (1, 2, 3)]).alias("scores")))
    return ingest.ocr_elements(table(spark, d, "pages").select(F.col("page_id").alias("page"), payload.alias("payload"))).select(F.col("page").alias("page_id"), "element_id", "text", "confidence")


@query("s11_ocr_choice", "WITH p AS (SELECT user_id AS page, event_id, value / 100 AS confidence, event_type FROM events), a AS (SELECT * FROM p WHERE event_type = 'click'), f AS (SELECT * FROM p WHERE event_type = 'view'), o AS (SELECT page FROM f GROUP BY page HAVING coalesce((SELECT min(confidence) FROM a WHERE a.page = f.page), 0) < 0.01) SELECT page, event_id FROM a WHERE page NOT IN (SELECT page FROM o) UNION ALL SELECT page, event_id FROM f WHERE page IN (SELECT page FROM o)")
def s11(spark, d):
    p = table(spark, d, "events").select(F.col("user_id").alias("page"), "event_id", (F.col("value") / 100).alias("confidence"), "event_type")
    return ingest.ocr_choice(p.where("event_type = 'click'"), p.where("event_type = 'view'"), 0.01).select("page", "event_id")


@query("a24_quality_summary", "SELECT o_custkey AS document_id, count(*) AS page_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS table_count, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS ocr_pages FROM orders GROUP BY o_custkey")
def a24(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderpriority") == "5-LOW", "ocr").otherwise("native").alias("method"), "o_orderstatus")
    return ingest.quality_summary(o, o.where("o_orderstatus = 'P'"))


@query("i15_parser_router", "SELECT doc_id, CASE lang WHEN 'en' THEN 'layout' WHEN 'de' THEN 'native' END AS parser, CASE WHEN lang IN ('en', 'de') THEN NULL ELSE 'No parser can handle media type: ' || lang END AS error, least(1.0, length(trim(text)) / 100)::DOUBLE AS coverage FROM documents WHERE text = trim(text)")
def i15(spark, d):
    docs = table(spark, d, "documents").where("text = trim(text)").withColumn("media_type", F.col("lang"))
    return ingest.choose_parser(docs, [("layout", "v2", ["en"]), ("native", "v1", ["en", "de"])]).select("doc_id", F.col("parser.name").alias("parser"), "error", "coverage")


@query("i13_job_counters", "SELECT d.source AS project_id, count(*) AS seen, count(*) FILTER (WHERE l.quality IS DISTINCT FROM 1) AS indexed, count(*) FILTER (WHERE l.quality = 1) AS skipped, CAST(coalesce(sum(CASE WHEN l.quality IS DISTINCT FROM 1 THEN len(regexp_extract_all(text, '\n')) END), 0) AS BIGINT) AS chunks FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def i13(spark, d):
    docs = table(spark, d, "documents")
    classified = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select(F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "skip").otherwise("index").alias("action"))
    parts = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.regexp_extract_all("text", F.lit("\n"), F.lit(0))))
    return ingest.job_counters(classified, parts).select("project_id", "seen", "indexed", "skipped", F.col("chunks").cast("bigint").alias("chunks"))


@query("i10_supersede", "WITH new AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 1) SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey NOT IN (SELECT l_orderkey FROM new) AS is_current FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) o WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM new) UNION ALL SELECT l_orderkey, l_orderkey * 10 + l_linenumber, true FROM new")
def i10(spark, d):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")
    every = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), key, F.lit(True).alias("is_current"), "l_returnflag", "l_linenumber")
    old, new = every.drop("l_returnflag", "l_linenumber").distinct(), every.where("l_returnflag = 'R' and l_linenumber > 1").drop("l_returnflag", "l_linenumber").distinct()
    return ingest.supersede(old, new)


@query("i16_prune", "SELECT 'chunk' AS kind, l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY ALL UNION ALL SELECT 'anchor', o_orderkey, 1 FROM orders WHERE o_orderkey % 7 <> 0")
def i16(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") + 1).alias("version_id"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    out = ingest.prune(o.where("document_id % 7 = 0"), versions=o, chunks=chunks, anchors=o.select("version_id"))
    kinds = out["chunks"].groupBy(F.lit("chunk").alias("kind"), F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(out["anchors"].select(F.lit("anchor").alias("kind"), (F.col("version_id") - 1).alias("id"), F.lit(1).cast("bigint").alias("n")))
