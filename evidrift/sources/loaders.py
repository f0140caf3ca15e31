"""Sources: files of a corpus directory as documents (source_uri, title, text, publisher, published_at, access_policy)."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: suffixes that the directory scan takes.
SUFFIXES = ["txt", "md", "json", "jsonl", "docx", "pdf", "png", "jpg", "jpeg", "tif", "tiff"]
_RECORD = "text string, content string, source_uri string, title string, publisher string, published_at string, access_policy string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, length and content of supported files, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "length", "content").where(F.col("suffix").isin(SUFFIXES))


def within_budget(files: DataFrame, most_files: int = 600, most_bytes: int = 512 << 20, largest: int = 25 << 20) -> DataFrame:
    """files as they are, or an error: the limits concern a run as a whole, so sums are taken, not windows over all files."""
    n, total, top = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    for name, value, limit in (("INGESTION_MAX_DOCUMENTS", n, most_files), ("INGESTION_MAX_BYTES", total, most_bytes), ("INGESTION_MAX_FILE_BYTES", top, largest)):
        if value > limit:
            raise ValueError(f"{name}: {value} is over {limit}")
    return files


def _stem(path: Column) -> Column:
    return F.replace(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.lit("_"), F.lit(" "))


def _fields(r: Column, uri: Column, title: Column) -> list[Column]:
    full = lambda c: F.nullif(c, F.lit(""))
    return [
        F.coalesce(full(r["source_uri"]), uri).alias("source_uri"), F.coalesce(full(r["title"]), title).alias("title"), F.coalesce(full(r["text"]), full(r["content"]), F.lit("")).alias("text"),
        r["publisher"].alias("publisher"), F.try_to_timestamp(r["published_at"]).alias("published_at"), F.coalesce(full(r["access_policy"]), F.lit("internal")).alias("access_policy"),
    ]


def text_files(files: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return files.where(F.col("suffix").isin("txt", "md")).select(F.col("path").alias("source_uri"), _stem(F.col("path")).alias("title"), F.decode("content", "UTF-8").alias("text"), none.alias("publisher"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("internal").alias("access_policy"))


def json_records(rows: DataFrame) -> DataFrame:
    """rows: path, body (a JSON object or array). A document an object; where it names no uri or title, path and index do."""
    body = F.when(F.col("body").rlike(r"^\s*\["), F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    got = rows.select("path", F.posexplode(F.from_json(body, f"array<struct<{_RECORD.replace(' string', ':string')}>>")).alias("i", "r"))
    return got.select(*_fields(F.col("r"), F.concat_ws("#", "path", "i"), F.concat_ws("-", _stem(F.col("path")), "i")))


def jsonl_records(rows: DataFrame) -> DataFrame:
    """rows: path, body. A document a line that is not blank; the index is the line's number in the file, blank lines counted. Lines that are no JSON drop out."""
    lines = rows.select("path", F.posexplode(F.split("body", "\n")).alias("i", "line")).where(F.trim("line") != "")
    got = lines.select("path", "i", F.from_json("line", _RECORD).alias("r")).where("r is not null")
    return got.select(*_fields(F.col("r"), F.concat_ws("#", "path", "i"), F.concat_ws("-", _stem(F.col("path")), "i")))


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor file, blank ones dropped."""
    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
    paragraphs = ("".join(re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", p, re.S)) for p in re.findall(r"<w:p[\s>].*?</w:p>", xml, re.S))
    return "\n\n".join(p.strip() for p in paragraphs if p.strip())


def docx_files(files: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(docx_text)

    own = files.where(F.col("suffix") == "docx")
    return own.select(F.col("path").alias("source_uri"), _stem(F.col("path")).alias("title"), read("content").alias("text"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("internal").alias("access_policy"))


def load(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """All documents of a directory or file that need no reader of their own; PDF files and images go through parsed_files."""
    files = within_budget(scan(spark, path), **limits)
    body = files.select("path", "suffix", F.decode("content", "UTF-8").alias("body"))
    parts = [text_files(files), json_records(body.where("suffix = 'json'")), jsonl_records(body.where("suffix = 'jsonl'")), docx_files(files)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def inverted_abstract(index: Column) -> Column:
    """The text whose words stand at the given positions: map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def line_numbers(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_no", F.row_number().over(W.partitionBy("file").orderBy("offset")))


# Records of literature services, one JSON or XML body a row

_DOCUMENT = "source_uri string, title string, text string, publisher string, published_at string, access_policy string, metadata string"


def arxiv(responses: DataFrame) -> DataFrame:
    """responses: body (an Atom feed). A document an entry that has a title and an abstract."""
    from xml.etree import ElementTree

    ns = {"a": "http://www.w3.org/2005/Atom"}

    def parse(batches):
        for batch in batches:
            out = []
            for body in batch["body"]:
                for e in ElementTree.fromstring(body).findall("a:entry", ns):
                    text = lambda tag: " ".join((e.findtext(f"a:{tag}", "", ns) or "").split())
                    if not text("title") or not text("summary"):
                        continue
                    uri = text("id")
                    doi = next((x.get("href") for x in e.findall("a:link", ns) if x.get("title") == "doi"), None)
                    more = {"authors": [" ".join(x.findtext("a:name", "", ns).split()) for x in e.findall("a:author", ns)], "categories": [x.get("term", "") for x in e.findall("a:category", ns)], "doi": doi, "source": "arxiv"}
                    out.append((uri if "abs/" in uri else f"https://arxiv.org/abs/{uri}", text("title"), text("summary"), "arXiv", text("published"), "public", json.dumps(more, sort_keys=True)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _DOCUMENT.split(", ")])

    found = responses.select("body").mapInPandas(parse, _DOCUMENT)
    return found.withColumn("published_at", T.iso_date(F.col("published_at")))


_PAPER = "paperId string, title string, abstract string, publicationDate string, year int, externalIds struct<ArXiv:string,DOI:string>, authors array<struct<name:string>>, venue string, publicationVenue struct<name:string>, openAccessPdf struct<url:string>, citationCount int, s2FieldsOfStudy array<struct<category:string>>"


def semantic_scholar(papers: DataFrame, after: str | None = None) -> DataFrame:
    """papers: body (JSON of a paper). Papers with title and abstract, published no earlier than the date; papers without a date are kept."""
    full = lambda c: F.nullif(T.strip(c), F.lit(""))
    p = papers.select(F.from_json("body", _PAPER).alias("p")).select("p.*")
    p = p.withColumn("title", full(F.col("title"))).withColumn("abstract", full(F.col("abstract"))).where("title is not null and abstract is not null")
    day = F.coalesce(F.nullif("publicationDate", F.lit("")), F.concat(F.col("year").cast("string"), F.lit("-01-01")))
    p = p.withColumn("day", day)
    if after is not None:
        p = p.where(F.coalesce(F.try_to_date(F.substring("day", 1, 10), "yyyy-MM-dd") >= F.lit(after).cast("date"), F.lit(True)))
    uri = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), "externalIds.ArXiv"), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.coalesce("paperId", F.lit(""))))
    open_ = F.col("openAccessPdf.url")
    more = F.to_json(F.struct(F.col("authors.name").alias("authors"), F.col("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("citationCount").alias("citation_count"), open_.alias("open_access_pdf"), F.col("s2FieldsOfStudy.category").alias("fields_of_study")))
    venue = F.coalesce(F.nullif("venue", F.lit("")), F.nullif("publicationVenue.name", F.lit("")), F.lit("Semantic Scholar"))
    return p.select(uri.alias("source_uri"), "title", F.col("abstract").alias("text"), venue.alias("publisher"), T.iso_date(F.col("day")).alias("published_at"), F.when(open_.isNotNull(), "public").otherwise("internal").alias("access_policy"), more.alias("metadata"))


_WORK = "id string, title string, abstract_inverted_index map<string,array<int>>, doi string, open_access struct<oa_url:string>, publication_date string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, concepts array<struct<display_name:string>>, cited_by_count int"


def openalex(works: DataFrame) -> DataFrame:
    """works: body (JSON of a work). Works with a title and an abstract, which is put together from its inverted index."""
    full = lambda c: F.nullif(c, F.lit(""))
    w = works.select(F.from_json("body", _WORK).alias("w")).select("w.*")
    w = w.withColumn("text", inverted_abstract(F.col("abstract_inverted_index"))).withColumn("title", T.strip(F.col("title"))).where("title <> '' and text <> ''")
    more = F.to_json(F.struct(F.col("authorships.author.display_name").alias("authors"), F.col("doi"), F.slice(F.col("concepts.display_name"), 1, 10).alias("concepts"), F.col("cited_by_count").alias("citation_count")))
    uri = F.coalesce(full(F.col("doi")), F.concat(F.lit("https://openalex.org/"), F.coalesce("id", F.lit(""))))
    venue = F.coalesce(full(F.col("primary_location.source.display_name")), F.lit("OpenAlex"))
    return w.select(uri.alias("source_uri"), "title", "text", venue.alias("publisher"), T.iso_date(F.col("publication_date")).alias("published_at"), F.when(full(F.col("open_access.oa_url")).isNotNull(), "public").otherwise("internal").alias("access_policy"), more.alias("metadata"))


# Uploads, remote results, evaluation sets, parsers

#: What may be uploaded.
UPLOADS = ["txt", "md", "json", "jsonl", "pdf", "docx", "png", "jpg", "jpeg", "tif", "tiff"]


def uploads(rows: DataFrame, allowed: list[str] = UPLOADS, largest: int = 25 << 20) -> DataFrame:
    """rows: name, content. The name under which each upload is kept, its size, and why it is refused: its kind, no content, or too much; null where it is not."""
    kind = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    why = F.when(~kind.isin(allowed), "Unsupported file type").when(size == 0, "Empty file").when(size > largest, "File is too large")
    return rows.select("name", T.file_name(F.regexp_extract("name", r"([^/\\]*)$", 1)).alias("kept_as"), size.alias("size_bytes"), why.alias("error"))


def web_contexts(results: DataFrame) -> DataFrame:
    """results: qid, rank, title, url, content, score, fetched_at, as a remote search gives them. Contexts of those that have content, without a score 0."""
    name = F.concat(F.lit("web:"), F.col("qid").cast("string"), F.lit(":"), F.col("rank").cast("string"))
    kept = results.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    return kept.select("qid", "rank", name.alias("chunk_id"), name.alias("document_id"), F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), F.col("url").alias("source_uri"), T.strip(F.col("content")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit("web").alias("source_type"), "fetched_at")


_CASES = """dataset_name string, dataset_version string, cases array<struct<eval_case_id:string,question:string,expected_answer_traits:array<string>,reference_answer:string,expected_document_ids:array<string>,expected_chunk_ids:array<string>,
expected_source_uris:array<string>,expected_claim_verdicts:map<string,string>,expected_anchor_ids:array<string>,expected_diff_operations:map<string,int>,requires_abstention:boolean,requires_review:boolean,tags:array<string>,top_k:int>>"""


def evaluation_cases(rows: DataFrame) -> DataFrame:
    """rows: body (JSON of a dataset). dataset_name, dataset_version and a row a case; without a number five results are asked for."""
    got = rows.select(F.from_json("body", _CASES).alias("d")).select("d.dataset_name", "d.dataset_version", F.explode("d.cases").alias("c")).select("dataset_name", "dataset_version", "c.*")
    return got.withColumn("top_k", F.coalesce("top_k", F.lit(5))).withColumn("requires_abstention", F.coalesce("requires_abstention", F.lit(False))).withColumn("requires_review", F.coalesce("requires_review", F.lit(False)))


def expectations(cases: DataFrame) -> DataFrame:
    """case_id, kind (chunk, document, source) and value: what retrieval should find for each case."""
    kinds = F.create_map(F.lit("chunk"), F.col("expected_chunk_ids"), F.lit("document"), F.col("expected_document_ids"), F.lit("source"), F.col("expected_source_uris"))
    return cases.select(F.col("eval_case_id").alias("case_id"), F.explode(kinds).alias("kind", "values")).select("case_id", "kind", F.explode("values").alias("value"))


def parsed_files(files: DataFrame, suffixes: list[str], parse) -> DataFrame:
    """path, page, text, method, blocks (text and box) of the files of these kinds: parse(content) gives the pages of one file as such records. The place where a reader of PDF files, a layout model or a recogniser of images is plugged in; a file that it cannot
    read fails its task."""
    columns = ["path", "page", "text", "method", "blocks"]

    def run(batches):
        for batch in batches:
            rows = [(path, p["page"], p.get("text", ""), p.get("method", "native"), p.get("blocks", [])) for path, content in zip(batch["path"], batch["content"]) for p in parse(content)]
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("suffix").isin(suffixes)).select("path", "content").mapInPandas(run, "path string, page int, text string, method string, blocks array<struct<text:string,box:array<double>>>")


def markdown_elements(docs: DataFrame, engine: str) -> DataFrame:
    """docs: document_id, markdown, as a layout parser writes it. An element a line that is not blank, by its number in the text; headings by their number signs."""
    lines = docs.select("document_id", F.posexplode(F.split("markdown", r"\r\n|[\n\r]")).alias("position", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return lines.select("document_id", F.concat(F.lit(f"{engine}-"), F.col("position").cast("string")).alias("element_id"), F.when(F.col("line").startswith("#"), "heading").otherwise("paragraph").alias("element_type"), F.regexp_replace("line", "^[# ]+", "").alias("text"), "position")


def paragraph_elements(docs: DataFrame) -> DataFrame:
    """docs: document_id, text, of a word-processor file, whose paragraphs stand between blank lines. An element a paragraph."""
    return docs.select("document_id", F.posexplode(F.split("text", "\n\n")).alias("position", "text")).where("text <> ''").withColumn("element_id", F.concat(F.lit("p1-docx-"), F.col("position").cast("string"))).withColumn("page", F.lit(1))
