"""Retrieval: dense, sparse and hybrid search of a batch of queries over chunks.

queries: qid, query. chunks: chunk_id, document_id, title, text. Results: qid, chunk_id, score and ranks. Scores that agree to nine decimals are
ties, since sums of the same terms in another order differ beyond; ties go to the smaller chunk_id. Plans are lazy, but for counts of the sides that may be
broadcast and for the vectors and terms of the queries themselves, which go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

_TOKEN = re.compile("[a-z0-9]+")
#: A side is broadcast up to so many rows, counted first; beyond, joins shuffle.
SMALL = 1_000_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has no more rows than the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Queries whose vectors or terms go to the tasks at a time.
BATCH = 4096

# What parts a query of several questions, weights of the mixtures, and sizes of windows.
SEPARATORS = r"(?i)\s+(?:and|also|then|versus|vs\.?|compared with|compare with)\s+|[;?]\s+"
DENSE_WEIGHT, SPARSE_WEIGHT, RANK_CONSTANT, BASE_WEIGHT = 0.6, 0.4, 60, 0.7
CANDIDATES, RERANKED, PER_DOCUMENT, TERMS = 12, 8, 2, 64


def decompose(queries: DataFrame, most: int = 4) -> DataFrame:
    """qid, part, query: each query, and if conjunctions and separators split it, its parts in order, at most so many with the query itself."""
    whole = T.collapse(F.col("query"))
    parts = F.filter(F.transform(F.split("whole", SEPARATORS), lambda x: F.regexp_replace(x, "^[ ,]+|[ ,]+$", "")), lambda x: x != "")
    every = F.when(F.size("parts") > 1, F.concat(F.array("whole"), F.slice("parts", 1, max(1, most - 1)))).otherwise(F.array("whole"))
    return queries.select("qid", whole.alias("whole")).where("whole <> ''").withColumn("parts", parts).select("qid", F.posexplode(every).alias("part", "query"))


def merge_parts(hits: DataFrame) -> DataFrame:
    """hits: qid, part, chunk_id, score, position and whatever else, of the parts of queries. Each chunk once a query, by its best score (the first part's among equals), in falling order of score."""
    best = F.row_number().over(W.partitionBy("qid", "chunk_id").orderBy(F.round("score", 9).desc(), "part", "position"))
    first = F.min(F.struct("part", "position")).over(W.partitionBy("qid", "chunk_id"))
    kept = hits.withColumn("best", best).withColumn("first", first).where("best = 1")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "first"))).drop("best", "first")


def filtered(chunks: DataFrame, project_id: str | None = None, current_only: bool = True, embedding_version: str | None = None, index_version: str | None = None, published_after: str | None = None, **allowed: list) -> DataFrame:
    """Chunks of a project whose columns are in the given lists (document_id, source_uri, access_policy, version_id, chunk_level); an empty list, no version and no date filter nothing."""
    if project_id is not None:
        chunks = chunks.where(F.col("project_id") == project_id)
    for name, values in allowed.items():
        if values:
            chunks = chunks.where(F.col(name).isin(list(values)))
    for name, value in (("embedding_version", embedding_version), ("index_version", index_version)):
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    if published_after is not None:
        chunks = chunks.where(F.col("published_at") >= F.lit(published_after).cast("timestamp"))
    return chunks.where("is_current") if current_only and "is_current" in chunks.columns else chunks


def backend_order(target: str, available: set[str], primary: str = "auto", fallback: bool = True) -> tuple[list[str], dict[str, str]]:
    """The dense backends to try for a requested target (auto, vectors or local) among those available, and why others are left out."""
    primary = "vectors" if primary == "auto" else primary
    wanted = ["local"] if target == "local" else [target if target != "auto" else primary] + (["local"] if fallback else [])
    wanted = [x for x in dict.fromkeys(wanted) if x != "local" or fallback or target == "local"]
    return [x for x in wanted if x in available], {x: f"{x} search is not available" for x in wanted if x not in available}


def embed(texts: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """key, slot, value: the hashed bag of tokens of each text, of length one, one row a component that is not zero. Each
    token of a text is hashed once."""
    counts = texts.select(key, F.explode(T.tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    sha = F.sha2("token", 256)
    byte = lambda i: F.conv(F.substring(sha, 2 * i + 1, 2), 16, 10).cast("int")
    slot = F.pmod(F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    weight = F.when(byte(4) % 2 == 0, 1.0).otherwise(-1.0) * (0.5 + byte(5) / 255.0)
    sums = counts.withColumn("slot", slot).groupBy(key, "slot").agg(F.sum(F.col("n") * weight).alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(key)))
    return sums.withColumn("norm", norm).where("norm > 0").select(key, "slot", (F.col("value") / F.col("norm")).alias("value"))


def embed_with(texts: DataFrame, key: str, provider, dim: int, batch: int = 4) -> DataFrame:
    """key, v: the vectors that provider(list of texts) gives, so many texts at a time; a vector of another dimension is an error. The place of an embedding model, loaded once a task by the
    provider; `embed` is the one that needs none."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            own = frame.reset_index(drop=True)
            vectors = [v for at in range(0, len(own), batch) for v in provider(own["text"][at : at + batch].tolist())]
            if any(len(v) != dim for v in vectors) or len(vectors) != len(own):
                raise ValueError(f"the provider must give a vector of {dim} components for every text")
            yield pd.DataFrame({key: own[key], "v": [[float(x) for x in v] for v in vectors]})

    return texts.select(key, "text").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, v array<double>")


def _dense_rows(column: pa.Array, width: int) -> np.ndarray:
    """Arrays as rows of a matrix; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str, others: bool = False) -> DataFrame:
    """qid, key, score, rank: the k rows of vectors (key, v) with the highest positive cosine to each query (qid, v), over arrays; others leaves out the row with the query's own id. The vectors of the
    queries go to the tasks in blocks of BATCH; each task multiplies whole batches and passes on k rows a query and batch, so no pair is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    asked = queries.select("qid", F.col("v").cast("array<double>").alias("v")).where("v is not null").toArrow().combine_chunks()
    parts = None
    for at in range(0, max(1, len(asked)), BATCH):
        block = asked.slice(at, BATCH).combine_chunks()
        column = block.column("v").chunk(0) if block.num_rows else pa.array([], pa.list_(pa.float64()))
        width = int(np.diff(column.offsets.to_numpy()).max(initial=1)) if len(column) else 1
        own, ids = _dense_rows(column, width), block.column("qid").to_pylist()
        norms = np.sqrt((own * own).sum(1))

        def run(batches, own=own, ids=ids, norms=norms, width=width):
            for batch in batches:
                v = _dense_rows(batch.column("v"), width)
                full = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sizes = np.diff(batch.column("v").offsets.to_numpy())
                length = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), full * full, len(sizes)))
                names = batch.column(key).to_pylist()
                places: dict = {}
                for j, name in enumerate(names if others else ()):
                    places.setdefault(name, []).append(j)
                order = _order(names)
                for a in range(0, len(own), 256):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = np.nan_to_num(own[a : a + 256] @ v.T / (norms[a : a + 256, None] * length[None, :]), nan=0.0, posinf=0.0, neginf=0.0)
                    rounded = np.round(scores, 9)
                    found = []
                    for i in range(len(scores)):
                        good = np.flatnonzero(scores[i] > 0)
                        if ids[a + i] in places:
                            good = np.setdiff1d(good, places[ids[a + i]], assume_unique=True)
                        found += [(ids[a + i], names[j], float(scores[i, j])) for j in _best(rounded[i], good, order, k)]
                    if found:
                        yield pa.RecordBatch.from_pylist([dict(zip(("qid", key, "score"), x)) for x in found], schema=out_schema)

        out_schema = pa.schema([("qid", asked.schema.field("qid").type), (key, _arrow(kinds[key])), ("score", pa.float64())])
        part = vectors.select(key, F.col("v").cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
        parts = part if parts is None else parts.unionAll(part)
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def vectors(texts: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """key, v: what `embed` gives, as arrays, in one pass over the texts without a shuffle; texts without tokens have none. A task hashes each token it meets once."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            names, out = [], []
            for name, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                v = [0.0] * dim
                for token, n in Counter(_TOKEN.findall((text or "").lower())).items():
                    at = known.get(token)
                    if at is None:
                        if len(known) > 500_000:
                            known.clear()
                        raw = sha256(token.encode()).digest()
                        at = known[token] = int.from_bytes(raw[:4], "big") % dim, (1.0 if raw[4] % 2 == 0 else -1.0) * (0.5 + raw[5] / 255.0)
                    v[at[0]] += n * at[1]
                norm = math.sqrt(sum(x * x for x in v))
                if norm > 0:
                    names.append(name)
                    out.append([x / norm for x in v])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, _arrow(kind)), pa.array(out, pa.list_(pa.float64()))], names=[key, "v"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, v array<double>")


def dense(query_vectors: DataFrame, chunk_vectors: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: the k chunks (chunk_id, v) with the highest positive cosine to each query (qid, v)."""
    return nearest(query_vectors, chunk_vectors, k, "chunk_id")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def dense_arrays(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, score, rank: the k nearest other rows of vectors (vec_id, v) to each query (qid, v)."""
    return nearest(queries, vectors, k, "vec_id", others=True)


def top(scores: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(rounded: np.ndarray, good: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k of the places in good with the highest rounded scores, equals in order."""
    if len(good) > 4 * k:
        good = good[rounded[good] >= np.partition(rounded[good], len(good) - k)[len(good) - k]]
    return good[np.lexsort((order[good], -rounded[good]))[:k]]


def _order(names: list) -> np.ndarray:
    out = np.empty(len(names), np.int64)
    out[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return out


def _blocks(asked: list[tuple], most_terms: int, cells: int = 1 << 23):
    """Blocks of queries (ids, terms, how often each query has each term), as many queries at a time as keep the table below so many cells."""
    ids, rows, terms = [], [], {}
    for qid, query in asked:
        own = [t for t in (query or "").lower().split() if t][:most_terms]
        new = len(terms.keys() | set(own))
        if ids and new * (len(ids) + 1) > cells:
            yield ids, rows, terms
            ids, rows, terms = [], [], {}
        ids.append(qid)
        rows.append([terms.setdefault(t, len(terms)) for t in own])
    if ids:
        yield ids, rows, terms


def sparse(queries: DataFrame, chunks: DataFrame, k: int, most_terms: int = TERMS) -> DataFrame:
    """qid, chunk_id, score, rank: the sum over a query's first terms (repeats counted) of their occurrences in title and text.

    A term has no white space, so its occurrences in a text are those in the text's words. The terms of a block of queries go to the tasks, which look for them in each word they meet once, by one automaton, count the terms of
    their chunks, multiply the counts with the queries' own, and pass on k rows a query and batch. Chunks are read once a block and never shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    asked = [(r.qid, r.query) for r in queries.select("qid", "query").toLocalIterator()]
    texts = chunks.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    out_schema = pa.schema([("qid", _arrow(kinds["qid"])), ("chunk_id", _arrow(kinds["chunk_id"])), ("score", pa.float64())])
    parts = None
    for ids, rows, terms in _blocks(asked, most_terms) if asked else [([], [], {})]:
        own = np.zeros((max(1, len(terms)), max(1, len(ids))))
        for q, found in enumerate(rows):
            np.add.at(own[:, q], found, 1)

        def run(batches, ids=ids, terms=terms, own=own):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, i in terms.items():
                automaton.add_word(t, (i, len(t)))
            if terms:
                automaton.make_automaton()
            known: dict[str, tuple[list[int], list[int]]] = {}

            def within(word: str) -> tuple[list[int], list[int]]:
                ends: dict[int, list[int]] = {}
                for last, (i, n) in automaton.iter(word) if terms else ():
                    at = ends.setdefault(i, [-1, 0])
                    if last - n >= at[0]:  # not over the occurrence before
                        at[0], at[1] = last, at[1] + 1
                if len(known) > 500_000:
                    known.clear()
                known[word] = got = (list(ends), [n for _, n in ends.values()])
                return got

            for batch in batches:
                names, scores = batch.column("chunk_id").to_pylist(), np.zeros((batch.num_rows, len(ids)))
                titles, bodies = batch.column("title").to_pylist(), batch.column("text").to_pylist()
                for a in range(0, len(names), 128):
                    counts = np.zeros((len(names[a : a + 128]), own.shape[0]))
                    for r, (title, body) in enumerate(zip(titles[a : a + 128], bodies[a : a + 128])):
                        at: list[int] = []
                        n: list[int] = []
                        for word, times in Counter(f"{title} {body}".lower().split()).items():
                            i, m = known.get(word) or within(word)
                            at += i
                            n += m if times == 1 else [x * times for x in m]
                        counts[r] = np.bincount(at, n, own.shape[0]) if at else 0
                    scores[a : a + 128] = (counts @ own)[:, : len(ids)]
                order, found = _order(names), []
                for q, qid in enumerate(ids):
                    column = scores[:, q]
                    found += [(qid, names[j], float(column[j])) for j in _best(column, np.flatnonzero(column > 0), order, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found), out_schema)], schema=out_schema)

        part = texts.mapInArrow(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")
        parts = part if parts is None else parts.unionAll(part)
    return top(parts, k)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT), constant: int = RANK_CONSTANT) -> DataFrame:
    """qid, chunk_id, fused and both scores. A hit of the sparse list has the weighted normalised scores and the reciprocal-rank bonus; a hit of
    the dense list alone keeps its normalised score as it is."""
    d = dense_hits.select("qid", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse_hits.select("qid", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both, w = d.join(s, ["qid", "chunk_id"], "full_outer"), W.partitionBy("qid")
    norm = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.coalesce(F.max(c).over(w), F.lit(1.0)), F.lit(1e-9))
    bonus = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    mixed = weights[0] * norm("dense_score") + weights[1] * norm("sparse_score") + bonus("dense_rank") + bonus("sparse_rank")
    return both.withColumn("fused", F.when(F.col("sparse_rank").isNull(), norm("dense_score")).otherwise(mixed))


def in_order(hits: DataFrame, score: str) -> DataFrame:
    """base_rank: by falling score; the dense list's order comes before the sparse list's among equals."""
    w = W.partitionBy("qid").orderBy(F.round(score, 9).desc(), F.col("dense_rank").isNull(), "dense_rank", "sparse_rank", "chunk_id")
    return hits.withColumn("base_rank", F.row_number().over(w))


def quality(query: Column, title: Column, text: Column) -> Column:
    """Coverage of the query's tokens by title and text, a bonus for the query as a phrase in either, and a fifth of the title's coverage."""
    q, body = F.array_distinct(T.tokens(query)), F.concat_ws(" ", F.coalesce(title, F.lit("")), text)
    share = lambda x: F.size(F.array_intersect(q, x)) / F.greatest(F.size(q), F.lit(1))
    phrase = F.when(F.lower(body).contains(F.lower(query)), 0.25).otherwise(0.0)
    return share(F.array_distinct(T.tokens(body))) + phrase + 0.2 * share(F.array_distinct(T.tokens(F.coalesce(title, F.lit("")))))


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, window: int = RERANKED, scorer=None, base_weight: float | None = None) -> DataFrame:
    """hits: qid, chunk_id, base_rank and any of fused, dense_score, sparse_score, score. rerank_score, score (0.7 of the first base score that is not zero and 0.3 of the quality) and final_rank: hits in the window
    by the new score, the others behind them as they were. scorer(query, text), a pandas UDF, replaces the quality; it then has half the weight."""
    full = hits.join(small(queries), "qid").join(chunks.select("chunk_id", "document_id", "title", "text"), "chunk_id")
    near = F.col("base_rank") <= window
    base = T.any_score(*[F.col(c) for c in ("fused", "dense_score", "sparse_score", "score") if c in hits.columns], F.lit(0.0))
    weight = base_weight if base_weight is not None else BASE_WEIGHT if scorer is None else 0.5
    own = quality(F.col("query"), F.col("title"), F.col("text")) if scorer is None else scorer(F.col("query"), F.col("text"))
    full = full.withColumn("base", base).withColumn("rerank_score", F.when(near, own))
    full = full.withColumn("score", F.when(near, F.col("base") * weight + F.col("rerank_score") * (1 - weight)).otherwise(F.col("base")))
    w = W.partitionBy("qid").orderBy(F.desc(near), F.when(near, F.round("score", 9)).desc(), "base_rank")
    return full.withColumn("final_rank", F.row_number().over(w)).drop("query", "text", "base")


def diversify(hits: DataFrame, per_document: int = PER_DOCUMENT, k: int = 5) -> DataFrame:
    """At most so many hits of a document in rank order, then the first k; position counts from 1."""
    own = F.row_number().over(W.partitionBy("qid", "document_id").orderBy("final_rank"))
    kept = hits.withColumn("own", own).where(F.col("own") <= per_document)
    return kept.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("final_rank"))).where(F.col("position") <= k).drop("own")


def expand(hits: DataFrame, chunks: DataFrame, most: int = 2, limit: int = 1600) -> DataFrame:
    """context and sibling_ids: the hit's text and those of up to two other chunks of its parent, nearest in order, joined and cut."""
    own = hits.join(chunks.select("chunk_id", "parent_chunk_id", "text"), "chunk_id")
    first = F.row_number().over(W.partitionBy("parent_chunk_id").orderBy("ordinal", "chunk_id"))  # besides the hit itself, more of a parent are never needed
    others = chunks.where("parent_chunk_id is not null").withColumn("k", first).where(F.col("k") <= most + 1)
    others = others.select("parent_chunk_id", F.col("chunk_id").alias("sibling"), "k", F.col("text").alias("sibling_text"))
    near = own.select("qid", "chunk_id", "parent_chunk_id").where("parent_chunk_id is not null").join(others, "parent_chunk_id").where("sibling <> chunk_id")
    near = near.groupBy("qid", "chunk_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "sibling", "sibling_text"))), 1, most).alias("s"))
    out = own.join(near, ["qid", "chunk_id"], "left")
    texts = F.filter(F.array_distinct(F.concat(F.array("text"), F.col("s.sibling_text"))), lambda x: x != "")
    context = F.when(F.size("s") > 0, F.substring(F.array_join(texts, "\n\n"), 1, limit)).otherwise(F.col("text"))
    return out.withColumn("context", context).withColumn("sibling_ids", F.coalesce("s.sibling", F.array().cast(near.schema["s"].dataType.elementType["sibling"].dataType.simpleString().join(["array<", ">"])))).drop("s", "text")


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, strategy: str = "hybrid", candidates: int = CANDIDATES, dim: int = 64, reranked: bool = True, scorer=None) -> DataFrame:
    """qid, chunk_id, document_id, title, the scores, explain and position: a search by the strategy (sparse, dense or hybrid), reranking, at most two hits a document, the first k."""
    limit = max(k, candidates)
    null = lambda kind: F.lit(None).cast(kind)
    if strategy not in ("sparse", "dense", "hybrid"):
        raise ValueError(f"strategy must be sparse, dense or hybrid, not {strategy}")
    if strategy != "sparse":
        d = dense(vectors(queries.select("qid", F.col("query").alias("text")), "qid", dim), vectors(chunks, "chunk_id", dim), limit)
    if strategy != "dense":
        s = sparse(queries, chunks, limit if strategy == "hybrid" else k)
    if strategy == "hybrid":
        hits = in_order(fuse(d, s), "fused")
    elif strategy == "dense":
        hits = d.select("qid", "chunk_id", null("double").alias("fused"), F.col("score").alias("dense_score"), null("double").alias("sparse_score"), F.col("rank").alias("dense_rank"), null("int").alias("sparse_rank"), F.col("rank").alias("base_rank"))
    else:
        hits = s.select("qid", "chunk_id", null("double").alias("fused"), null("double").alias("dense_score"), F.col("score").alias("sparse_score"), null("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"), F.col("rank").alias("base_rank"))
    ranked = rerank(hits, queries, chunks, max(k, RERANKED) if reranked else 0, scorer)
    return diversify(ranked.withColumn("explain", explain(strategy)), PER_DOCUMENT, k)


def explain(strategy: str, requested: str = "auto", used: str = "local") -> Column:
    """How a hit came about: backends, ranks, and the method of fusion where both lists were mixed for it."""
    mixed = F.when(F.col("sparse_rank").isNotNull() & F.lit(strategy == "hybrid"), "weighted_rrf")
    return F.struct(
        F.lit(strategy).alias("strategy"), F.lit(requested).alias("requested_backend"), F.lit(used if strategy != "sparse" else None).cast("string").alias("used_backend"), F.col("dense_rank").cast("int").alias("dense_rank"),
        F.col("sparse_rank").cast("int").alias("sparse_rank"), mixed.alias("fusion_method"), F.when(F.col("rerank_score").isNotNull(), "heuristic").alias("reranker"),
    )


def decomposed_search(queries: DataFrame, chunks: DataFrame, k: int = 5, strategy: str = "hybrid", parts: int = 4) -> DataFrame:
    """The hits of each query and of its parts, merged by best score: qid, chunk_id, document_id, title, score, rank and part, the part that scored it best."""
    split = decompose(queries, parts).withColumn("owner", F.col("qid")).withColumn("qid", F.concat_ws("#", "part", F.col("qid").cast("string")))
    hits = search(split.select("qid", "query"), chunks, k, strategy)
    hits = hits.join(small(split.select("qid", "owner", "part")), "qid").drop("qid").withColumnRenamed("owner", "qid")
    return merge_parts(hits)


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 5, candidates: int = CANDIDATES, dim: int = 64) -> DataFrame:
    return search(queries, chunks, k, "hybrid", candidates, dim)


# Limits of a request.
QUERY_CHARS, MOST_RESULTS, STRATEGIES, TARGETS = 2000, 50, ["sparse", "dense", "hybrid"], ["auto", "vectors", "local"]


def validate(requests: DataFrame) -> DataFrame:
    """requests: qid, query, top_k, strategy, index_target. Why a request is refused, null where it is not; what is left out counts as its default."""
    n, k = F.length(F.coalesce("query", F.lit(""))), F.coalesce("top_k", F.lit(5))
    why = (
        F.when((n < 1) | (n > QUERY_CHARS), f"query must have 1 to {QUERY_CHARS} characters").when((k < 1) | (k > MOST_RESULTS), f"top_k must be 1 to {MOST_RESULTS}")
        .when(~F.coalesce("strategy", F.lit("hybrid")).isin(STRATEGIES), "strategy must be sparse, dense or hybrid").when(~F.coalesce("index_target", F.lit("auto")).isin(TARGETS), "index_target must be auto, vectors or local")
    )
    return requests.select("qid", why.alias("error"))


def results(hits: DataFrame, chunks: DataFrame, include_explain: bool = False) -> DataFrame:
    """Hits as flat rows with all that the chunk is known by: its columns beside the scores, and those that say how it was made in one struct; explain only if it is asked for."""
    about = [c for c in ("access_policy", "embedding_version", "index_version", "section", "page", "element_ids", "bbox_refs", "extraction_method", "min_confidence", "parent_chunk_id", "chunk_level", "heading_path", "version_id", "is_current", "source_anchor_ids") if c in chunks.columns]
    own = chunks.select("chunk_id", *[c for c in ("source_uri", "location_marker", "text") if c in chunks.columns], F.struct(*about).alias("metadata") if about else F.lit(None).alias("metadata"))
    kept = hits if include_explain or "explain" not in hits.columns else hits.drop("explain")
    return kept.join(own, "chunk_id")
