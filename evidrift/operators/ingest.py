"""Ingestion: canonical documents, chunks, provenance, page quality, versions, idempotent merges."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


# Defaults of chunks and page routes.
SIZE, OVERLAP, INDEX_VERSION, OCR_BELOW = 800, 120, "v2", 0.6
_NOT_SPACE = re.compile(r"\S+")


def canonical(docs: DataFrame) -> DataFrame:
    """docs: project_id, source_uri, title, text. Adds document_id, canonical text, content_hash and a title where there is none. The text is normalised once, below the projection that uses it twice."""
    out = docs.withColumn("text", T.normalise(F.col("text")))
    return out.select(
        "project_id", "source_uri", F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.col("source_uri")).alias("title"), "text",
        T.uuid5(F.concat_ws(":", "project_id", "source_uri")).alias("document_id"), F.sha2("text", 256).alias("content_hash"),
    )


def _windows(size: int, step: int):
    def run(batches):
        for batch in batches:
            names, hashes, texts = (batch.column(c).to_pylist() for c in ("document_id", "content_hash", "text"))
            out = []
            for name, digest, text in zip(names, hashes, texts):
                spans = [m.span() for m in _NOT_SPACE.finditer(text or "")]
                for n, at in enumerate(range(0, len(spans), step)):
                    a, b = spans[at][0], spans[min(len(spans), at + size) - 1][1]
                    out.append((name, digest, n, min(size, len(spans) - at), a, b, text[a:b]))
                    if at + size >= len(spans):
                        break
            if out:
                kinds = (batch.schema.field("document_id").type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["document_id", "content_hash", "ordinal", "token_count", "char_start", "char_end", "text"])

    return run


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, index_version: str = INDEX_VERSION) -> DataFrame:
    """docs: document_id, content_hash, text. Windows of white-space tokens, the last one the first to reach the end, with their exact offsets. A document's chunks are made from its
    own row in one pass over its text, without a shuffle; tokens with offsets are what built-in functions cannot give without going over the text once a chunk."""
    kind = docs.schema["document_id"].dataType.simpleString()
    schema = f"document_id {kind}, content_hash string, ordinal int, token_count int, char_start int, char_end int, text string"
    rows = docs.select("document_id", "content_hash", "text").mapInArrow(_windows(size, max(1, size - overlap)), schema)
    name = F.concat_ws(":", F.col("document_id").cast("string"), "content_hash", F.col("char_start").cast("string"), F.col("char_end").cast("string"), F.lit(index_version))
    return rows.select("document_id", "ordinal", "token_count", "char_start", "char_end", "text", T.uuid5(name).alias("chunk_id"), "content_hash")


def section_ids(parts: DataFrame, index_version: str = INDEX_VERSION) -> DataFrame:
    """parts: document_id, section. parent_chunk_id of the section, heading_path; null and empty without a section."""
    name = F.concat(F.col("document_id").cast("string"), F.lit(":section:"), "section", F.lit(f":{index_version}"))
    has = F.coalesce(F.col("section") != "", F.lit(False))
    return parts.withColumn("parent_chunk_id", F.when(has, T.uuid5(name))).withColumn("heading_path", F.when(has, F.array("section")).otherwise(F.array().cast("array<string>")))


def headings(docs: DataFrame) -> DataFrame:
    """document_id, start (offset of the line) and heading of Markdown headings in canonical texts (document_id, text), whose lines stand between blank ones."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    at = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("document_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = lines.withColumn("start", at.cast("int")).withColumn("heading", F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    return found.where("heading <> ''").select("document_id", "start", T.strip(F.col("heading")).alias("heading"))


def with_sections(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """parts with section, the last heading that begins no later than the chunk, its parent id and heading path."""
    found = as_of(parts, headings(docs).withColumnRenamed("heading", "section"), ["document_id"], "char_start", "start", "section")
    return section_ids(found)


def align(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """elements: document_id, page, position, element_id, text. Their normalised text and offsets in the document's canonical text: each is looked for behind the one before it, in order of pages; those that are not found have none.
    The cursor runs in one Arrow pass over a document's elements, which stand in one array beside its text: folds of built-in functions copy their array at every step."""
    own = elements.withColumn("text", T.normalise(F.col("text"))).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "position", "element_id", "text"))).alias("e")).join(docs.select("document_id", F.col("text").alias("body")), "document_id")
    cast = lambda e: (e["page"].cast("int").alias("page"), e["position"].cast("int").alias("position"), e["element_id"].cast("string").alias("element_id"), e["text"].alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for name, body, es in zip(*(batch.column(c).to_pylist() for c in ("document_id", "body", "e"))):
                cursor = 0
                for e in es:
                    at = body.find(e["text"], cursor) if e["text"] else -1
                    out.append((name, e["page"], e["position"], e["element_id"], e["text"], at if at >= 0 else None, at + len(e["text"]) if at >= 0 else None))
                    cursor = at + len(e["text"]) if at >= 0 else cursor
            if out:
                kinds = (batch.schema.field("document_id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["document_id", "page", "position", "element_id", "text", "start", "end"])

    kind = docs.schema["document_id"].dataType.simpleString()
    shaped = own.withColumn("e", F.transform("e", lambda e: F.struct(*cast(e))))
    return shaped.mapInArrow(run, f"document_id {kind}, page int, position int, element_id string, text string, start int, end int")


def table_rows(tables: DataFrame, docs: DataFrame | None = None, index_version: str = INDEX_VERSION) -> DataFrame:
    """tables: table_id, headers, rows, and for whole chunks document_id, content_hash, caption, pages, element_ids, confidence. A row chunk a table row: its text with the table's columns; with docs (document_id, text) also
    ids, where the row stands in the canonical text, in any case of letters (0 if nowhere), and the elements of its cells."""
    line = lambda cells: F.array_join(cells, " | ")
    rest = [c for c in tables.columns if c not in ("headers", "rows")]
    rows = tables.select(*rest, "headers", F.size("rows").alias("n_rows"), F.posexplode("rows").alias("i", "row")).withColumn("row_index", F.col("i") + 1)
    text = F.concat(F.lit("Table "), F.col("table_id"), F.lit("; columns: "), line(F.col("headers")), F.lit("; row: "), line(F.col("row")))
    rows = rows.withColumn("text", T.strip(text))
    if docs is None:
        return rows.select(*rest, "row_index", "text")
    own = rows.join(docs.select("document_id", F.col("text").alias("body")), "document_id")
    start = F.greatest(F.instr(F.lower("body"), F.lower(line(F.col("row")))) - 1, F.lit(0))
    width = F.size("headers")
    offset = F.when(F.size("element_ids") >= width * (F.col("n_rows") + 1), width).otherwise(0)
    doc = F.col("document_id").cast("string")
    name = F.concat_ws(":", doc, "content_hash", "table_id", F.lit("row"), F.col("row_index").cast("string"), F.lit(index_version))
    return own.select(
        "document_id", "table_id", "row_index", "text", F.size(T.words(F.col("text"))).alias("token_count"), start.alias("char_start"), (start + F.length("text")).alias("char_end"),
        F.col("caption").alias("section"), F.get("pages", F.lit(0)).alias("page"), F.concat(F.lit("table "), "table_id", F.lit(", row "), F.col("row_index").cast("string")).alias("location_marker"),
        F.when(width > 0, F.slice("element_ids", offset + width * (F.col("row_index") - 1) + 1, F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("element_ids"),
        F.lit("table-structured").alias("extraction_method"), F.col("confidence").alias("min_confidence"), T.uuid5(F.concat_ws(":", doc, F.lit("table"), "table_id", F.lit(index_version))).alias("parent_chunk_id"),
        T.uuid5(name).alias("chunk_id"), F.lit("row").alias("chunk_level"), F.array(F.coalesce("caption", "table_id")).alias("heading_path"), F.sha2("text", 256).alias("content_hash"), (F.col("row_index") - 1).alias("ordinal"),
    )


def cells_of(tables: DataFrame) -> DataFrame:
    """tables: page, table_no, grid (rows of cells). Tables of the rows that are not empty: the first is the header, and every cell that is not empty an element."""
    clean = F.filter(F.transform("grid", lambda row: F.transform(row, lambda c: T.strip(F.coalesce(c, F.lit(""))))), lambda row: F.exists(row, lambda c: c != ""))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-table-"), F.col("table_no").cast("string"))
    own = tables.select("page", name.alias("table_id"), clean.alias("grid")).where(F.size("grid") > 0)
    ids = F.flatten(F.transform("grid", lambda row, r: F.filter(F.transform(row, lambda c, i: F.when(c != "", F.concat(F.col("table_id"), F.lit("-r"), r.cast("string"), F.lit("-c"), i.cast("string")))), lambda x: x.isNotNull())))
    return own.select("page", "table_id", F.col("grid")[0].alias("headers"), F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(1))).alias("rows"), ids.alias("element_ids"))


def blocks_of(pages: DataFrame, engine: str = "native") -> DataFrame:
    """pages: page, text, blocks (struct<text, box>). An element a block with text, headings told by their look; a page of text without blocks is one paragraph."""
    block = F.filter(F.transform("blocks", lambda b: F.struct(T.strip(b["text"]).alias("text"), b["box"].alias("box"))), lambda b: b["text"] != "")
    kind = pages.schema["blocks"].dataType.elementType["box"].dataType.simpleString()
    whole = F.when(T.strip(F.col("text")) != "", F.array(F.struct(T.strip(F.col("text")).alias("text"), F.lit(None).cast(kind).alias("box")))).otherwise(F.array().cast(f"array<struct<text:string,box:{kind}>>"))
    own = pages.withColumn("found", block).withColumn("bare", F.size("found") == 0)
    rows = own.select("page", "bare", F.posexplode(F.when(F.col("bare"), whole).otherwise(F.col("found"))).alias("position", "b"))
    look = F.when(~F.col("bare") & T.heading(F.col("b.text")), "heading").otherwise("paragraph")
    return rows.select("page", "position", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(f"-{engine}-"), F.col("position").cast("string")).alias("element_id"), look.alias("element_type"), F.col("b.text").alias("text"), F.col("b.box").alias("box"))


def ocr_elements(results: DataFrame, engine: str = "ocr") -> DataFrame:
    """results: page, payload (JSON of a recogniser: rec_texts or texts, rec_scores or scores, rec_boxes or boxes). Its texts that are not blank as elements with confidence and bounds."""
    shape = "rec_texts array<string>, texts array<string>, rec_scores array<double>, scores array<double>, rec_boxes array<array<array<double>>>, boxes array<array<array<double>>>"
    r = results.select("page", F.from_json("payload", shape).alias("r")).where("r is not null")
    full = lambda a, b: F.when(F.size(F.col(f"r.{a}")) > 0, F.col(f"r.{a}")).otherwise(F.col(f"r.{b}"))
    r = r.select("page", full("rec_texts", "texts").alias("t"), full("rec_scores", "scores").alias("s"), full("rec_boxes", "boxes").alias("b"))
    rows = r.select("page", "s", "b", F.posexplode("t").alias("i", "text")).where(T.strip(F.col("text")) != "")
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("page").orderBy("i")) - 1)
    return rows.select("page", "position", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(f"-{engine}-"), F.col("position").cast("string")).alias("element_id"), T.strip(F.col("text")).alias("text"), F.get("s", F.col("i")).alias("confidence"), T.box(F.get("b", F.col("i"))).alias("box"))


def ocr_choice(primary: DataFrame, fallback: DataFrame, least: float = 0.75) -> DataFrame:
    """The elements of the primary recogniser, or the fallback's for pages where the primary has no confident element (or one below the bar) and the fallback has any."""
    sure = primary.groupBy("page").agg(F.min("confidence").alias("low"))
    other = fallback.select("page").distinct().join(sure, "page", "left").where(F.col("low").isNull() | (F.col("low") < least)).select("page")
    return primary.join(other, "page", "left_anti").unionByName(fallback.join(other, "page", "left_semi"), allowMissingColumns=True)


def markdown(table_id: Column, headers: Column, rows: Column) -> Column:
    """A table as Markdown under its name, headers and rows filled up to the widest."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), F.lit(1))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda row: F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(row))))
    head = F.array(F.concat(F.lit("Table "), table_id), line(fit(headers)), line(F.array_repeat(F.lit("---"), width)))
    return F.array_join(F.concat(head, F.transform(rows, lambda r: line(fit(r)))), "\n")


def provenance(elements: DataFrame, parts: DataFrame, bucket: int = 4096) -> DataFrame:
    """elements: document_id, element_id, start, end, method, confidence, page, and where given position and box. An interval join within a document, then what each chunk draws on: elements and boxes in order of pages and
    positions. Spans meet in the buckets of offsets they touch, and a pair counts in the first it shares, so a long document is no group of all pairs."""
    order = ["page", "position" if "position" in elements.columns else "start", "element_id"]
    box = "box" if "box" in elements.columns else None
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / bucket)))
    right = elements.where("start is not null and end is not null").withColumn("bucket", over("start", "end"))
    left = parts.select("document_id", "chunk_id", "char_start", "char_end").withColumn("bucket", over("char_start", "char_end"))
    met = left.join(right, ["document_id", "bucket"]).where((F.col("end") > F.col("char_start")) & (F.col("start") < F.col("char_end")) & (F.col("bucket") == F.floor(F.greatest("char_start", "start") / bucket)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, *([box] if box else []))))
    out = met.groupBy("chunk_id").agg(
        ordered.alias("e"), F.min("confidence").alias("min_confidence"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("extraction_method"), F.min_by("page", F.struct(*order)).alias("page"),
    )
    boxes = [F.filter("e.box", lambda b: b.isNotNull()).alias("bbox_refs")] if box else []
    return out.select("chunk_id", F.col("e.element_id").alias("element_ids"), *boxes, "min_confidence", "extraction_method", "page")


def anchors(parts: DataFrame) -> DataFrame:
    """parts: project_id, content_hash, chunk_id, ordinal, element_ids, page, char_start, char_end, text, extraction_method, min_confidence, and where given bbox_refs. One source anchor an element of a version, from the first chunk that
    has it; boxes belong to elements by their place."""
    version = F.sha2(F.concat_ws(":", "project_id", "content_hash"), 256)
    rows = parts.withColumn("version_id", version).select("*", F.posexplode("element_ids").alias("i", "element_id"))
    w = W.partitionBy("version_id", "element_id").orderBy("ordinal", "chunk_id", "i")
    rows = rows.withColumn("k", F.row_number().over(w)).where("k = 1")
    box = [F.get("bbox_refs", F.col("i")).alias("bbox")] if "bbox_refs" in parts.columns else []
    return rows.select(F.concat_ws(":", "version_id", "element_id").alias("anchor_id"), "version_id", "element_id", "chunk_id", "page", "char_start", "char_end", *box, T.text_hash(F.col("text")).alias("text_hash"), F.lit("observed").alias("anchor_kind"), "extraction_method", F.col("min_confidence").alias("confidence"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: str) -> DataFrame:
    """left with the value of the last right row of its group that is not later: a backward as-of join by one sort of both sides."""
    a = left.select(*by, F.struct(*left.columns).alias("row"), F.col(left_on).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("value"))
    b = right.select(*by, F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(right_on).alias("at"), F.lit(0).alias("side"), F.col(value).alias("value"))
    w = W.partitionBy(*by).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("latest", F.last("value", ignorenulls=True).over(w)).where("side = 1")
    return found.select("row.*", F.col("latest").alias(value))


def page_quality(pages: DataFrame, ocr_below: float = OCR_BELOW) -> DataFrame:
    """pages: page_id, text, n_tables (elements that are tables or parts of them), lefts (left edges of elements), orders (reading orders of elements). Signals of each page's quality and the route they lead to."""
    compact = T.strip(F.col("text"))
    own = pages.withColumn("compact", compact).withColumn("n", F.length("compact"))
    columns = F.size(F.array_distinct(F.transform("lefts", lambda x: F.bround(x / 20))))
    steps = F.zip_with(F.slice("orders", 2, F.greatest(F.size("orders") - 1, F.lit(1))), F.slice("orders", 1, F.greatest(F.size("orders") - 1, F.lit(1))), lambda now, before: (now > before + 1).cast("int"))
    jumps = F.when(F.size("orders") > 1, F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    out = own.select(
        "page_id", F.least(F.lit(1.0), F.col("n") / 100).alias("coverage"), (T.occurrences(F.col("compact"), F.lit("\ufffd")) / F.greatest(F.col("n"), F.lit(1))).alias("replacement_rate"), (F.col("n") == 0).alias("image_only"),
        F.least(F.lit(1.0), F.col("n_tables") / 8).alias("table_likelihood"), F.least(F.lit(1.0), F.greatest(F.lit(0), columns - 1) / 3).alias("column_likelihood"), (jumps / F.greatest(F.size("orders") - 1, F.lit(1))).alias("discontinuity"),
    )
    ocr = F.col("image_only") | (F.col("coverage") < ocr_below)
    layout = (F.col("replacement_rate") > 0.01) | (F.col("table_likelihood") >= 0.5) | (F.col("column_likelihood") >= 0.67)
    return out.withColumn("route", F.when(ocr, "ocr").when(layout, "layout").otherwise("native"))


def quality_summary(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """pages: document_id, method. tables: document_id. How many pages, tables and recognised pages each document has."""
    n = tables.groupBy("document_id").agg(F.count(F.lit(1)).alias("table_count"))
    own = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("method") == "ocr").alias("ocr_pages"))
    return own.join(n, "document_id", "left").select("document_id", "page_count", F.coalesce("table_count", F.lit(0)).alias("table_count"), "ocr_pages")


def choose_parser(docs: DataFrame, parsers: list[tuple[str, str, list[str] | None]]) -> DataFrame:
    """docs: media_type, text. parsers: name, version and the media types each takes (None: any, and none given). The first that takes the document, why, and an error where none does."""
    chosen = F.coalesce(*[F.when(F.lit(True) if kinds is None else F.col("media_type").isin(kinds), F.struct(F.lit(n).alias("name"), F.lit(v).alias("version"))) for n, v, kinds in parsers], F.lit(None))
    return docs.withColumn("parser", chosen).select(
        "*", F.when(F.col("media_type").isNotNull(), "structured candidate available").otherwise("native fast path").alias("reason"), F.least(F.lit(1.0), F.length(T.strip(F.col("text"))) / 100).alias("coverage"),
        F.when(F.col("parser").isNull(), F.concat(F.lit("No parser can handle media type: "), F.coalesce("media_type", F.lit("None")))).alias("error"),
    )


def classify_incoming(incoming: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """incoming and state: project_id, source_uri, content_hash. action: index, reindex or skip."""
    known = state.select("project_id", "source_uri", F.col("content_hash").alias("known"))
    action = F.when(F.col("known").isNull(), "index").when((F.col("known") == F.col("content_hash")) & F.lit(not force), "skip").otherwise("reindex")
    return incoming.join(known, ["project_id", "source_uri"], "left").withColumn("action", action).drop("known")


def job_counters(classified: DataFrame, parts: DataFrame) -> DataFrame:
    """classified: project_id, document_id, action. parts: document_id. Documents seen, indexed and skipped, and chunks written, a project."""
    n = parts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    done = F.col("action") != "skip"
    return classified.join(n, "document_id", "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(done).alias("indexed"), F.count_if(~done).alias("skipped"), F.coalesce(F.sum(F.when(done, F.col("n"))), F.lit(0)).alias("chunks"))


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after documents have been written again: those of old of the same documents are no longer current, those of new are, and a chunk of both is new's."""
    again = old.join(new.select("document_id").distinct().withColumn("again__", F.lit(True)), "document_id", "left").join(new.select("chunk_id"), "chunk_id", "left_anti")
    kept = again.withColumn("is_current", F.col("is_current") & F.col("again__").isNull()).select(*old.columns)
    return kept.unionByName(new.withColumn("is_current", F.lit(True)).select(*old.columns))


def prune(stale_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables (each with document_id, or version_id of one given as versions) less the rows of stale documents."""
    versions_ = tables.get("versions")
    gone = versions_.join(stale_ids.select("document_id"), "document_id", "left_semi").select("version_id") if versions_ is not None else None
    return {k: (t.join(stale_ids.select("document_id"), "document_id", "left_anti") if "document_id" in t.columns else t.join(gone, "version_id", "left_anti")) for k, t in tables.items()}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, and those of old whose key new does not have; within new the last by `updated_at` wins."""
    w = W.partitionBy(*keys).orderBy(F.desc("updated_at"), *[F.col(c).desc() for c in new.columns if c not in keys and c != "updated_at"])
    latest = new.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")
    return old.join(latest, keys, "left_anti").unionByName(latest)


def embedding_upsert(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Embeddings by (chunk_id, embedding_version, index_version), the last by updated_at; vectors of another dimension are an error."""
    size = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding of "), F.size("embedding").cast("string"), F.lit(f" components, not {dimension}"))))
    return upsert(old, new.withColumn("embedding", size.cast(new.schema["embedding"].dataType)), ["chunk_id", "embedding_version", "index_version"])


def versions(events: DataFrame) -> DataFrame:
    """events: project_id, document, content_hash, created_at. Slowly changing versions: unchanged repeats are one version."""
    w = W.partitionBy("project_id", "document").orderBy("created_at", "content_hash")
    changed = events.withColumn("before", F.lag("content_hash").over(w)).where("before is null or before <> content_hash")
    named = changed.withColumn("version_id", F.sha2(F.concat_ws(":", "project_id", "content_hash"), 256))
    until = F.lead("created_at").over(w)
    return named.select("project_id", "document", "version_id", "created_at", F.lag("version_id").over(w).alias("predecessor"), until.alias("superseded_at"), until.isNull().alias("is_current"))


def stale(docs: DataFrame, seen: DataFrame, prefix: str) -> DataFrame:
    """Documents of the pruned kinds that a run has not seen."""
    kind = (F.col("publisher") == "arXiv") | F.col("source_uri").startswith(prefix) | (F.col("source_uri") == "local://roadmap-notes")
    return docs.where(kind).join(seen.select("document_id"), "document_id", "left_anti")


def merge_corpora(records: DataFrame) -> DataFrame:
    """records: file, line, source_uri, …: the first row of every uri that is not empty, and all rows without one."""
    w = W.partitionBy("source_uri").orderBy("file", "line")
    full = F.coalesce(F.col("source_uri"), F.lit("")) != ""
    return records.where(full).withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__").unionByName(records.where(~full))
