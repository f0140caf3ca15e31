"""Queries of sources: staged records of literature services, uploads, remote results, evaluation sets, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources import loaders
from . import query, sql, table


def _files(spark, d, suffix, body):
    return table(spark, d, "documents").select(F.concat(F.lit("/c/my_note_"), "doc_id", F.lit(f".{suffix}")).alias("path"), F.lit(suffix).alias("suffix"), body.alias("body"))


@query("s03_text_files", "SELECT '/c/my_note_' || doc_id || '.md' AS source_uri, 'my note ' || doc_id AS title, sha256(text) AS digest, 'internal' AS access_policy FROM documents")
def s03(spark, d):
    files = _files(spark, d, "md", F.col("text")).withColumn("content", F.encode("body", "UTF-8"))
    return loaders.text_files(files).select("source_uri", "title", F.sha2("text", 256).alias("digest"), "access_policy")


@query("s04_json_files", "SELECT '/c/my_note_' || doc_id || '.json#0' AS source_uri, 'my note ' || doc_id || '-0' AS title, sha256(text) AS digest FROM documents UNION ALL SELECT 'u' || doc_id, source, sha256(lang) FROM documents")
def s04(spark, d):
    body = F.to_json(F.array(F.struct(F.col("text").alias("text"), F.lit("").alias("title"), F.lit("").alias("source_uri")), F.struct(F.col("lang").alias("text"), F.col("source").alias("title"), F.concat(F.lit("u"), "doc_id").alias("source_uri"))))
    return loaders.json_records(_files(spark, d, "json", body)).select("source_uri", "title", F.sha2("text", 256).alias("digest"))


@query("s14_arxiv", f"SELECT 'https://arxiv.org/abs/' || item_id AS source_uri, 'Item ' || item_id AS title, {sql.COLLAPSE.format('text')} AS text, '2023-02-0' || (1 + item_id % 9) || 'T00:00:00+00:00' AS published_at FROM benchmark WHERE item_id % 4 <> 3")
def s14(spark, d):
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>'), "item_id", F.lit("</id><title> Item \n "), F.when(F.col("item_id") % 4 != 3, F.col("item_id").cast("string")).otherwise(""), F.lit("</title><summary>"), F.when(F.col("item_id") % 4 != 3, F.col("text")).otherwise(" "), F.lit("</summary><published>2023-02-0"), 1 + F.col("item_id") % 9, F.lit("</published></entry></feed>"))
    return loaders.arxiv(table(spark, d, "benchmark").select(entry.alias("body"))).select("source_uri", "title", "text", "published_at")


@query("s15_semantic_scholar", "SELECT CASE WHEN item_id % 2 = 0 THEN 'https://arxiv.org/abs/a' || item_id ELSE 'https://www.semanticscholar.org/paper/p' || item_id END AS source_uri, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, (2018 + item_id % 8) || '-01-01T00:00:00+00:00' AS published_at, CASE WHEN item_id % 3 = 0 THEN 'public' ELSE 'internal' END AS access_policy, 'Semantic Scholar' AS publisher FROM benchmark WHERE item_id % 8 >= 4")
def s15(spark, d):
    b = table(spark, d, "benchmark")
    body = F.to_json(F.struct(
        F.concat(F.lit("p"), "item_id").alias("paperId"), F.lit(" T ").alias("title"), F.col("text").alias("abstract"), (2018 + F.col("item_id") % 8).alias("year"), F.struct(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a"), "item_id")).alias("ArXiv")).alias("externalIds"),
        F.when(F.col("item_id") % 3 == 0, F.struct(F.lit("http://x").alias("url"))).alias("openAccessPdf"), F.lit("").alias("venue"),
    ))
    return loaders.semantic_scholar(b.select(body.alias("body")), "2022-01-01").select("source_uri", "text", "published_at", "access_policy", "publisher")


@query("s16_openalex", f"SELECT CASE WHEN item_id % 2 = 0 THEN 'https://doi.org/' || item_id ELSE 'https://openalex.org/W' || item_id END AS source_uri, {sql.COLLAPSE.format('text')} AS text, 'OpenAlex' AS publisher FROM benchmark")
def s16(spark, d):
    from ..functions import text as T

    w = table(spark, d, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("p", "w"))
    index = w.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    body = F.to_json(F.struct(F.concat(F.lit("W"), "item_id").alias("id"), F.lit(" t").alias("title"), F.col("m").alias("abstract_inverted_index"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://doi.org/"), "item_id")).alias("doi")))
    return loaders.openalex(index.select(body.alias("body"))).select("source_uri", "text", "publisher")


@query("s13_markdown_elements", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM (SELECT doc_id, '# ' || text AS text FROM documents)) SELECT doc_id AS document_id, 'docling-' || i AS element_id, CASE WHEN t LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS element_type, sha256(regexp_replace(t, '^[# ]+', '')) AS digest FROM (SELECT *, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS t FROM l) WHERE t <> ''")
def s13(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("# "), "text").alias("markdown"))
    return loaders.markdown_elements(docs, "docling").select("document_id", "element_id", "element_type", F.sha2("text", 256).alias("digest"))


@query("s19_uploads", "SELECT page_id, regexp_replace(n, '[^A-Za-z0-9._-]+', '_', 'g') AS kept_as, CASE page_id % 4 WHEN 0 THEN 'Unsupported file type' WHEN 1 THEN 'Empty file' WHEN 2 THEN CASE WHEN strlen(html) > 5000 THEN 'File is too large' END END AS error FROM (SELECT *, 'up load ' || page_id || CASE page_id % 4 WHEN 0 THEN '.exe' ELSE '.PDF' END AS n FROM pages) WHERE page_id % 4 < 3")
def s19(spark, d):
    k = F.col("page_id") % 4
    rows = table(spark, d, "pages").where(k < 3).select("page_id", F.concat(F.lit("/tmp/up load "), "page_id", F.when(k == 0, ".exe").otherwise(".PDF")).alias("name"), F.when(k == 1, "").otherwise(F.col("html")).cast("binary").alias("content"))
    out = loaders.uploads(rows, largest=5000)
    return out.select(F.regexp_extract("name", r"(\d+)\.", 1).cast("bigint").alias("page_id"), "kept_as", "error")


@query("s20_web_contexts", "SELECT item_id AS qid, 'web:' || item_id || ':1' AS chunk_id, 'http://x/' || item_id AS title, CASE WHEN item_id % 3 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM benchmark WHERE item_id % 5 <> 0")
def s20(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit(1).alias("rank"), F.lit("").alias("title"), F.concat(F.lit("http://x/"), "item_id").alias("url"), F.when(F.col("item_id") % 5 != 0, F.col("text")).otherwise(" ").alias("content"), F.when(F.col("item_id") % 3 != 0, 0.5).alias("score"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return loaders.web_contexts(b).select("qid", "chunk_id", "title", "score")


@query("s21_evaluation_cases", "SELECT 'set' AS dataset_name, 'case ' || item_id AS eval_case_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 7 ELSE 5 END AS top_k, item_id % 3 = 0 AS requires_review FROM benchmark")
def s21(spark, d):
    case = F.struct(F.concat(F.lit("case "), "item_id").alias("eval_case_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, 7).alias("top_k"), F.when(F.col("item_id") % 3 == 0, True).alias("requires_review"))
    body = table(spark, d, "benchmark").select(F.to_json(F.struct(F.lit("set").alias("dataset_name"), F.lit("v1").alias("dataset_version"), F.array(case).alias("cases"))).alias("body"))
    return loaders.evaluation_cases(body).select("dataset_name", "eval_case_id", "question", "top_k", "requires_review")


@query("s18_chunk_scan", "SELECT doc_id AS chunk_id, name FROM documents JOIN (SELECT DISTINCT source, 'name of ' || source AS name FROM documents) USING (source) WHERE source <> 'src0' AND lang IN ('en', 'de') AND doc_id % 3 <> 0 AND doc_id % 2 = 0")
def s18(spark, d):
    """Chunks with their documents' names, under project, list, version and currency filters; an empty list filters nothing."""
    docs = table(spark, d, "documents")
    names = docs.where("source <> 'src0'").select("source").distinct().withColumn("name", F.concat(F.lit("name of "), "source"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "source", "lang", F.lit("p").alias("project_id"), (F.col("doc_id") % 3 != 0).alias("is_current"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("index_version"))
    return R.filtered(chunks.join(names, "source"), "p", index_version="v2", lang=["en", "de"], chunk_id=[]).select("chunk_id", "name")


@query("f17_published_after", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def f17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("published_at"))
    return R.filtered(o, published_after="1997-01-01").select("o_orderkey")
