"""Exact top-k inner-product search with a three-phase uniform threshold.

A vector's score is the sum of its partial scores over PARTS groups of components; the list of partial scores of a group over a block of candidate rows is local to
the task that holds the block. Phase 1 gathers, for every query, the k best entries of each local list of one bounded block of candidates (those of least hash) and resolves their whole
scores; the k-th best is a safe lower bound of the query's k-th best score. Phase 2 sends each query the cutoff bound / PARTS: a row whose partial scores all lie below it has a whole
score below the bound, whatever the signs, so only entries of rows with some partial score at the cutoff or above are collected. Phase 3 resolves the whole scores of
those rows alone, exactly, keeps those at the bound or above, and merges the k best of each block. Each product of components is formed once besides phase 1.

Components are floor(1024 * x) in double precision; scores are whole numbers, computed exactly: in double precision where no sum can reach 2^53, else in 64-bit integers.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; of vectors of different length the shorter counts as filled up with zeros, and an empty one scores 0;
components beyond a long are taken at its end; equal scores go to the smaller vec_id; rows that repeat a vec_id are candidates each, and a query meets every row of another id; a query row that
is repeated is answered once, by the vector of its first row; fewer candidates than k give as many rows; other columns are ignored; empty tables give none.

Plan: candidates are dealt into blocks of about BLOCK rows and queries into groups of about QUERIES by hashes of row number and id, so that no id, vector or group of equal vectors
gathers in one; each pair of a group and a block is one task's work of bounded size, and a row is copied once for every QUERIES queries. What is shuffled besides is k rows a query and block.
The queries are never broadcast, as they grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, stored

BLOCK = 16_384
QUERIES = 8192
PARTS = 4
TILE = 1 << 22  # partial scores of a list that are in memory at a time
_LEAST = -(1 << 62)
_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as whole numbers floor(1024 * x), of rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * 1024)).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _lists(q: np.ndarray, c: np.ndarray, parts: int):
    """Tiles of queries (first, last) with their local lists of partial scores over the candidates, a list a group of components."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width < 2.0**53:
        q, c = q.astype(np.float64), c.astype(np.float64)
    groups = [x for x in np.array_split(np.arange(width), parts) if len(x)]
    step = max(1, TILE // max(1, len(c)))
    for a in range(0, len(q), step):
        yield a, min(len(q), a + step), [q[a : a + step, x] @ c[:, x].T for x in groups]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by falling score and rising id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _answer(query: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    n = [len(a) for a, _ in found]
    ids = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([b for _, b in found]) if found else np.zeros(0)
    return pa.table({"query_id": pa.array(np.repeat(query, n)), "vec_id": pa.array(ids.astype(np.int64)), "score": pa.array(scores.astype(np.int64))})


def _gather(k: int, parts: int):
    """Phase 1: of each local list the k best entries, and of those the k best whole scores."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _answer(np.zeros(0, np.int64), [])
        qid, cid, found = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), []
        for a, b, lists in _lists(_matrix(left["v"]), _matrix(right["v"]), parts):
            for i in range(b - a):
                others = np.flatnonzero(cid != qid[a + i])
                rows = np.unique(np.concatenate([others[np.argpartition(x[i, others], max(0, len(others) - k))[max(0, len(others) - k) :]] for x in lists]))
                whole = sum(x[i, rows] for x in lists)
                best = _best(whole, cid[rows], k)
                found.append((cid[rows[best]], whole[best]))
        return _answer(qid, found)

    return run


def _resolve(k: int, parts: int):
    """Phases 2 and 3 on one group of queries and one block: rows with a partial score at the cutoff, their whole scores, the best k."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _answer(np.zeros(0, np.int64), [])
        qid, cid, bound, found = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["bound"].to_numpy(), []
        for a, b, lists in _lists(_matrix(left["v"]), _matrix(right["v"]), parts):
            cutoff = (bound[a:b] / len(lists))[:, None]
            some = lists[0] >= cutoff
            for x in lists[1:]:
                some |= x >= cutoff
            for i in range(b - a):
                rows = np.flatnonzero(some[i])
                rows = rows[cid[rows] != qid[a + i]]
                whole = sum(x[i, rows] for x in lists)
                rows, whole = rows[whole >= bound[a + i]], whole[whole >= bound[a + i]]
                best = _best(whole, cid[rows], k)
                found.append((cid[rows[best]], whole[best]))
        return _answer(qid, found)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, group: int = QUERIES, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of other ids with the highest inner products, per id for which is_query holds."""
    rows = stored(usable(vectors).withColumn("row_no", F.monotonically_increasing_id()))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min_by("v", "row_no").alias("v"))
    n, m = rows.count(), queries.count()
    blocks, groups = n // block + 1, m // group + 1
    asked = stored(queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))))
    copies = lambda df, name, of: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(of - 1)).cast("array<bigint>")))
    probe = copies(rows.orderBy(F.xxhash64("row_no"), "row_no").limit(block).select("vec_id", "v"), "g", groups)
    first = asked.groupBy("g").cogroup(probe.groupBy("g")).applyInArrow(_gather(k, parts), _SCHEMA)
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("k", F.row_number().over(by_score)).where(F.col("k") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = stored(asked.join(kth, "vec_id", "left").select("vec_id", "v", "g", F.coalesce("bound", F.lit(_LEAST)).alias("bound")))
    pair = F.struct("g", "b").alias("pair")
    left = copies(bounded, "b", blocks).select(pair, "vec_id", "v", "bound")
    right = copies(rows.withColumn("b", F.pmod(F.xxhash64("row_no"), F.lit(blocks))), "g", groups).select(pair, "vec_id", "v")
    last = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(_resolve(k, parts), _SCHEMA)
    ranked = last.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    forget(asked)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
