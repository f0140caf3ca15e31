"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles (blank-separated words, A-Z lower-cased; all words as one shingle if there are fewer).
Documents with equal sets are one class. Classes are joined by the chosen-path method: in each run a set starts at a root and goes on to the children of those
of its own shingles that a hash samples, BRANCH of them on average. Sets that share much keep meeting in nodes; a node with at most LIMIT sets is a leaf and is
compared by brute force, a larger one is split again, for as long as splitting helps: from the second level on by sampled coordinates of the sets' min-hashes (byte values, BRANCH coordinates
a node on average), which sets share as often as they share shingles. Runs are repeated until the chance of a pair at the threshold to meet at any depth reaches the target
recall. A pair that meets in several leaves is counted in the least of them alone. Pairs are first compared by 64-byte min-hash sketches, with a margin of over
four standard deviations that counts toward the recall (3 pairs in 100,000 at the threshold fall below it), then exactly by their sets.

A child that keeps more than TIGHT of its node holds mostly one group of near copies, which no split would part. It is a leaf too: cut into blocks
of LIMIT sets, every pair of blocks is a task's work of bounded size. Exact sets are compared in tiles bounded by their tokens, so long texts make smaller tiles. No pair is ever
written out, only each set's count of links and one edge of a spanning forest. The links of G different near copies of one text are counted pair by pair, which is G squared comparisons of sketches, spread over the blocks.

Result: a row a document row: class_id (smallest doc_id of its connected component of links and copies) and n_links (other document rows at similarity of the threshold or
more, copies included).

Defined results: null, empty and blank texts have no set, no links and a class of their own; very long texts are sets like any, worked through whole; rows that repeat a doc_id are rows of their own; if no row of a component has an id its class_id is null;
other columns are ignored by `join`, whatever their names, and kept by `keep_one`; an empty table gives no rows. `keep_one` tells rows apart by a hash of all their columns (maps aside), so that nothing depends on how files are packed;
of rows that are equal in all of them, one stays.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hash_words, mix64, row_key, shingles, slices, stored, text_bytes, tidy, unused
from .graph import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
BRANCH, LIMIT, TIGHT, SKETCH, TILE = 2.0, 2048, 0.7, 64, 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * _ODD)


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, branch: float = BRANCH) -> int:
    """Runs until a pair at the threshold meets at whatever depth with the target chance: the shared children of a node are
    Poisson with mean branch * threshold, and the line of common nodes must not die out."""
    meet = 1.0
    for _ in range(200):
        meet = 1 - math.exp(-branch * threshold * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sets_of(column: pa.Array, words: int = WORDS):
    """The sorted distinct shingle hashes of each text."""
    hashes, _, begins = hash_words(*text_bytes(column))
    for a, b in zip(begins[:-1], begins[1:]):
        yield np.unique(shingles(hashes[a:b], words))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _nodes(tokens: np.ndarray, roots: np.ndarray, branch: float) -> np.ndarray:
    """The children of the roots that the set goes on to."""
    share, found = branch / len(tokens), []
    for at in range(0, len(tokens), 1 << 16):
        part = tokens[at : at + (1 << 16)]
        hashed = (part[None, :] ^ roots[:, None]) * (roots[:, None] | np.uint64(1))
        parent, which = np.nonzero(hashed < np.uint64(share * 2.0**64)) if share < 1 else np.nonzero(np.ones_like(hashed, bool))
        found.append(mix64(part[which] + roots[parent] * _ODD))
    return np.unique(np.concatenate(found))


def sketch_of(tokens: np.ndarray) -> bytes:
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        low = np.minimum(low, ((tokens[None, at : at + 4096] ^ _SEEDS[:, None]) * (_SEEDS[:, None] | np.uint64(1))).min(1))
    return (mix64(low) & np.uint64(255)).astype(np.uint8).tobytes()


def _list(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))


_ROW = "row_no bigint, doc_id bigint, text_hash bigint, key bigint, d1 bigint, d2 bigint, n int, sketch binary, nodes array<bigint>"


def _described(docs: DataFrame, words: int, branch: float, runs: int) -> DataFrame:
    roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                d1, d2, n, sketch, nodes, counts = ([] for _ in range(6))
                for tokens in sets_of(part.column("text"), words):
                    a, b = digest(tokens) if len(tokens) else (None, None)
                    d1.append(a)
                    d2.append(b)
                    n.append(len(tokens))
                    sketch.append(sketch_of(tokens) if len(tokens) else None)
                    if len(tokens):
                        nodes.append(_nodes(tokens, roots, branch))
                    counts.append(len(nodes[-1]) if len(tokens) else 0)
                columns = [part.column(c) for c in ("row_no", "doc_id", "text_hash", "key")] + [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), _list(counts, _signed(nodes))]
                yield pa.RecordBatch.from_arrays(columns, names=["row_no", "doc_id", "text_hash", "key", "d1", "d2", "n", "sketch", "nodes"])

    return docs.mapInArrow(tidy(run), _ROW)


def cells(batches, keys: list[str]):
    """Groups of a partition that is sorted by keys, as tables; holds one batch and one group at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(changed)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


_CELL = ["leaf", "i", "j"]
_FOUND = "rep bigint, leaf bigint, cell bigint, part int, across boolean"


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _tiles(n: np.ndarray) -> np.ndarray:
    """Number of the tile of each row, in order; a tile holds at most TILE tokens (one row at least)."""
    return np.cumsum(n, dtype=np.int64) // TILE


def _candidates(batches, threshold: float):
    """Rows of each cell that have a partner by sketch whose least common leaf is the cell's, dealt out to pairs of tiles."""
    bar = SKETCH * threshold - 4.2 * math.sqrt(SKETCH * threshold * (1 - threshold))
    for cell in cells(batches, _CELL):
        if cell.num_rows < 2:
            continue
        i, j, leaf = (cell.column(c)[0].as_py() for c in ("i", "j", "leaf"))
        own = cell.column("own").to_numpy()
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        n = cell.column("n").to_numpy().astype(np.float64)
        likely = np.zeros((len(n), len(n)), bool)
        for a in range(0, len(n), 16):
            same = (sketch[a : a + 16, None, :] == sketch[None, :, :]).sum(2, dtype=np.uint8) >= bar
            same &= np.minimum(n[a : a + 16, None], n[None, :]) >= threshold * np.maximum(n[a : a + 16, None], n[None, :]) - 1e-9
            same &= own[a : a + 16, None] != own[None, :] if i != j else np.arange(a, a + len(same))[:, None] != np.arange(len(n))[None, :]
            likely[a : a + 16] = same
        some = np.flatnonzero(likely.any(0))
        if not len(some):
            continue
        keep = _least_common(likely[np.ix_(some, some)], _one(cell.column("leaves").take(pa.array(some))), leaf)
        some, keep = some[keep.any(0)], keep[np.ix_(keep.any(0), keep.any(0))]
        rep, tile = cell.column("rep").to_numpy()[some], _tiles(n[some])
        sides = [(own[some] == i, own[some] == j)] if i != j else [(np.ones(len(some), bool),) * 2]
        for left, right in sides:
            for p in np.unique(tile[left]):
                for q in np.unique(tile[right]):
                    if i == j and q < p:
                        continue
                    a, b = np.flatnonzero(left & (tile == p)), np.flatnonzero(right & (tile == q))
                    met = keep[np.ix_(a, b)]
                    if not met.any():
                        continue
                    across = i != j or p != q
                    a, b = (a[met.any(1)], b[met.any(0)]) if across else (a[met.any(1)], a[:0])
                    name = int(mix64(np.array([leaf & (2**64 - 1)], np.uint64) + np.uint64(((i * 8191 + j) * 8191 + int(p)) * 8191 + int(q)))[0].view(np.int64))
                    rows = np.concatenate([a, b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep[rows]), pa.array(np.full(len(rows), leaf)), pa.array(np.full(len(rows), name)), pa.array(np.repeat(np.array([0, 1], np.int32), [len(a), len(b)])), pa.array(np.full(len(rows), across))],
                        names=["rep", "leaf", "cell", "part", "across"],
                    )


def _least_common(pairs: np.ndarray, listed: pa.ListArray, leaf: int) -> np.ndarray:
    """Those of the pairs that share no leaf below this one. Leaves that only one of the sets has play no part; the rest are compared a block of them at a time."""
    sizes = np.diff(listed.offsets.to_numpy())
    flat, row = listed.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    below = flat < leaf
    names, place, times = np.unique(flat[below], return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times > 1)
    column = np.full(len(names), -1)
    column[kept] = np.arange(len(kept))
    row, column = row[below], column[place]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    pairs = pairs.copy()
    for a in range(0, len(kept), 1024):
        lo, hi = np.searchsorted(column, [a, a + 1024])
        some, at = np.unique(row[lo:hi], return_inverse=True)
        has = np.zeros((len(some), min(1024, len(kept) - a)), np.float32)
        has[at, column[lo:hi] - a] = 1
        pairs[np.ix_(some, some)] &= has @ has.T == 0
    return pairs


def _common(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = np.array([len(t) for t in tokens])
    names, at, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times > 1)
    column = np.full(len(names), -1)
    column[kept] = np.arange(len(kept))
    rows, columns = np.repeat(np.arange(len(n)), n), column[at]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(n), len(n)), np.float32)
    for a in range(0, len(kept), 1024):
        lo, hi = np.searchsorted(columns, [a, a + 1024])
        some, place = np.unique(rows[lo:hi], return_inverse=True)
        has = np.zeros((len(some), min(1024, len(kept) - a)), np.float32)
        has[place, columns[lo:hi] - a] = 1
        common[np.ix_(some, some)] += has @ has.T
    return common


def _verify(threshold: float):
    def run(batches):
        for cell in cells(batches, ["cell"]):
            leaf, across = (cell.column(c)[0].as_py() for c in ("leaf", "across"))
            part, rep, copies = (cell.column(c).to_numpy() for c in ("part", "rep", "copies"))
            tokens = [np.frombuffer(x, np.uint64) for x in cell.column("tokens").to_pylist()]
            n = np.array([len(t) for t in tokens], np.float32)
            common = _common(tokens)
            linked = np.zeros(common.shape, bool)
            for a in range(0, len(n), 256):  # common tokens are whole numbers, exact in 32 bits
                both = common[a : a + 256].astype(np.float64)
                linked[a : a + 256] = both >= threshold * (n[a : a + 256, None].astype(np.float64) + n[None, :] - both) - 1e-6
            linked &= part[:, None] != part[None, :] if across else ~np.eye(len(n), dtype=bool)
            linked = _least_common(linked, _one(cell.column("leaves")), leaf)
            if not linked.any():
                continue
            root = np.arange(len(n))
            while True:
                reach = np.array([min(int(root[row].min(initial=len(n))), len(n)) for row in linked])
                new = np.minimum(root, reach)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            links = (linked * copies[None, :]).sum(1)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some].astype(np.int64))], names=["rep", "root", "links"])

    return run


def _tokens(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                packed = [t.tobytes() for t in sets_of(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(packed, pa.binary())], names=["rep", "tokens"])

    return run


def _leaves(reps: DataFrame, limit: int, branch: float = BRANCH) -> DataFrame:
    """rep, leaf, count of the leaves that hold more than one set: nodes are split, level by level, until all are leaves."""
    rows = reps.select("rep", F.explode("nodes").alias("node"), F.lit(None).cast("bigint").alias("above"))
    leaf = (F.col("count") <= limit) | (F.coalesce(F.col("count") > F.col("above") * TIGHT, F.lit(False)))
    out, sketches = None, reps.select("rep", "sketch")
    sampled = F.filter(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.pmod(F.xxhash64("node", i), F.lit(1 << 20)) < int(branch / SKETCH * (1 << 20)))
    child = F.transform(sampled, lambda i: F.xxhash64("node", i, F.substr("sketch", i + 1, F.lit(1))))
    while True:
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.max("above").alias("above")).where("count > 1")
        met = stored(rows.select("rep", "node").join(counts, "node"))
        done = met.where(leaf).select("rep", F.col("node").alias("leaf"), "count")
        out = done if out is None else out.unionAll(done)
        large = met.where(~leaf)
        if large.isEmpty():
            return out
        rows = large.join(sketches, "rep").select("rep", F.explode(child).alias("node"), F.col("count").alias("above"))


def _joined(docs: DataFrame, words: int, threshold: float, recall: float, limit: int) -> DataFrame:
    """The result by row, with the rows' keys. docs: doc_id, text, key."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "key")
    texts = docs.select("doc_id", "text", "key", F.xxhash64("text").alias("text_hash"))
    rows = stored(_described(texts.withColumn("row_no", F.monotonically_increasing_id()), words, BRANCH, runs_needed(recall, threshold)))
    full = rows.where("n > 0")
    reps = full.groupBy("d1", "d2").agg(F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low_id"), F.min_by(F.struct("doc_id", "text_hash", "n", "sketch", "nodes"), "row_no").alias("own"))
    reps = stored(reps.select("d1", "d2", "rep", "copies", "low_id", "own.*"))
    leaves = stored(_leaves(reps, limit).groupBy("rep").agg(F.collect_list(F.struct("leaf", "count")).alias("met")))
    met = reps.select("rep", "n", "sketch").join(leaves, "rep").withColumn("leaves", F.col("met.leaf"))
    met = met.select("rep", "n", "sketch", "leaves", F.explode("met").alias("m")).select("rep", "n", "sketch", "leaves", F.col("m.leaf").alias("leaf"), F.ceil(F.col("m.count") / limit).cast("int").alias("nb"))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("rep", "n", "sketch", "leaves", "leaf", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = stored(met.repartition(*_CELL).sortWithinPartitions(*_CELL, "rep").mapInArrow(tidy(lambda x: _candidates(x, threshold)), _FOUND))
    wanted = found.select("rep").distinct().join(reps.select("rep", "doc_id", "text_hash"), "rep")
    wanted = wanted.withColumnRenamed("doc_id", "id_")
    own = texts.select("doc_id", "text_hash", "text").join(wanted, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("id_")))
    sets = own.select("rep", "text").dropDuplicates(["rep"]).mapInArrow(tidy(_tokens(words)), "rep bigint, tokens binary")
    held = found.join(leaves.select("rep", F.col("met.leaf").alias("leaves")), "rep").join(reps.select("rep", "copies"), "rep").join(sets, "rep")
    links = stored(held.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(tidy(_verify(threshold)), "rep bigint, root bigint, links bigint"))
    forget(found)
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sets = reps.select("d1", "d2", "rep", "copies", "low_id").join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    sets = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = sets.groupBy("root").agg(F.min("low_id").alias("class_id"), F.min("rep").alias("first_row"))
    sets = sets.join(classes, "root").select("d1", "d2", "copies", "class_id", "first_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("row_no", "key", "doc_id", "d1", "d2").join(sets, ["d1", "d2"], "left")
    return out.select("row_no", "key", "doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("first_row").isNull() | (F.col("first_row") == F.col("row_no"))).alias("first"))


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """row_no, doc_id, class_id, copies (rows with the same set, itself included), n_links and first (of its class) of every row of docs."""
    return _joined(docs.select("doc_id", "text", F.lit(0).cast("bigint").alias("key")), words, threshold, recall, limit).drop("key")


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, less all but the first row of each class."""
    key = row_key(docs)
    rows = _joined(docs.select("doc_id", "text", key.alias("key")), words, threshold, recall, limit)
    keys = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("kept")).where("kept < rows"))
    name = unused(docs, "key")
    marked = docs.withColumn(name, key)
    rest = marked.join(keys.select(F.col("key").alias(name)), name, "left_anti")
    some = marked.join(keys.where("kept > 0").select(F.col("key").alias(name)), name).dropDuplicates([name])
    return rest.unionByName(some).select(*docs.columns)
