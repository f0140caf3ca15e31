"""Line dedup by a segment-partition edit join.

A line is what stands between newlines, without blanks at its ends; blank lines are none. Lines are the same if they are equal, and near if both have
SHORTEST bytes or more and their edit distance over bytes is at most TAU. The lines of the corpus fall into classes, the connected components of near lines; of each
class the first line stays, in order of rows and lines.

Distinct lines are split into TAU + 1 segments of even length. If two lines are near, a segment of the shorter stands unchanged in the longer, and the multi-match
rule bounds where: each line is indexed by (length, segment number, segment) and probes the lengths up to TAU below its own with the few substrings that may match. Lines that
meet under a key and whose letter counts differ by no more than the edits allow are compared by a banded bit-parallel edit distance. Where a segment is frequent, what the lines have besides it is
split again: in some alignment of near lines the segment matches and the edits all lie in the rest, so the rests are near as well, and a second key tells them apart.

Defined results: null and empty texts have no line; lines too short to be near anything match equal lines only; lines of any length are compared whole; rows that repeat a doc_id are rows of their own,
and the first keeps the line; other columns, whatever their names, are kept by `dedup` and ignored by `summary`; an empty table gives no rows. Lines are told apart by 64-bit hashes.

Plan: one narrow pass stores the hashes of the lines of each row; a second sends the keys of each partition's distinct lines to one sum by key, map-side first. A key that two lines have is a
pair already; where more lines have it, they are found by a join with these keys alone, broadcast up to FEW of them and shuffled beyond. Keys of more than BLOCK lines are refined, and what is
still larger is cut into blocks of BLOCK lines; every pair of blocks is a task's work of bounded size. The texts of lines that share a key are fetched by their hash, again broadcast up to FEW
and shuffled beyond. Only edges of spanning forests are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, forget, mix64, slices, stored, text_bytes, tidy, unused
from .graph import components

TAU, SHORTEST, BLOCK, FEW = 2, 24, 256, 1_000_000
_P = 0xD6E8FEB86659FD93
_INVERSE = pow(_P, -1, 1 << 64)
_tables: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        out = []
        for base in (_P, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _tables = tuple(out)
    return _tables[0][:n], _tables[1][:n]


def bounds_of_lines(data: np.ndarray, rows: np.ndarray):
    """First and last byte (exclusive) of every line that is not blank, its row, and its number among all lines of the row's text."""
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([newline + 1, rows]))
    cuts = cuts[cuts <= len(data)]
    first, last = cuts[:-1], cuts[1:].copy()
    row = np.searchsorted(rows, first, "right") - 1
    starts = np.searchsorted(cuts, rows)
    number = np.arange(len(first)) - starts[row]
    solid = np.flatnonzero((data > 32) | ((data < 9) | ((data > 13) & (data < 32))))
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    a, b = np.searchsorted(solid, first), np.searchsorted(solid, last)
    full = b > a
    return solid[np.minimum(a, len(solid) - 1)][full], solid[b[full] - 1] + 1, row[full], number[full]


class Substrings:
    """Hashes of substrings of a run of bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a] ^ (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keys_of(sub: Substrings, a: np.ndarray, n: np.ndarray, tau: int):
    """(key, which line, whether it is an index key, where its substring begins, its size) of lines at a of length n."""
    line = np.arange(len(a))
    for shorter in range(tau + 1):
        length = n - shorter
        for i in range(1, tau + 2):
            base, long = length // (tau + 1), length % (tau + 1)
            size = base + (i > tau + 1 - long)
            start = base * (i - 1) + np.maximum(0, i - 1 - (tau + 1 - long))
            tag = mix64((length * 64 + i).astype(np.uint64))
            for p in range(max(-(i - 1), shorter - (tau + 1 - i)), min(i - 1, shorter + (tau + 1 - i)) + 1):
                ok = np.flatnonzero((start + p >= 0) & (start + p + size <= n) & (size > 0))
                at = a[ok] + start[ok] + p
                yield mix64(sub.of(at, at + size[ok]) ^ tag[ok]), line[ok], shorter == 0 and p == 0, at, size[ok]


_LINES = "row_no bigint, doc_id bigint, lines array<struct<line_no:int,line:bigint>>"
_KEYED = "key bigint, line bigint, indexed boolean, at int, size int"


def _described(batches):
    """The lines of each row."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, rows = text_bytes(part.column("text"))
            a, b, row, number = bounds_of_lines(data, rows)
            line = Substrings(data).of(a, b)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(line.view(np.int64))], ["line_no", "line"])
            yield pa.RecordBatch.from_arrays([part.column("row_no"), part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), inner)], names=["row_no", "doc_id", "lines"])


def _distinct(batches, shortest: int = 0):
    """Bytes, bounds and hashes of the lines of each part that the partition has not had before. What is remembered is bounded;
    beyond it lines come again, which changes no result."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            data, rows = text_bytes(part.column("text"))
            a, b, _, _ = bounds_of_lines(data, rows)
            sub = Substrings(data)
            line = sub.of(a, b)
            names, first = np.unique(line, return_index=True)
            new = np.array([h not in seen for h in names.tolist()], bool) if len(names) else np.zeros(0, bool)
            if len(seen) < 500_000:
                seen.update(names[new].tolist())
            own = first[new]
            own = own[(b - a)[own] >= shortest]
            yield data, sub, a[own], b[own], line[own]


def _keyed(tau: int, shortest: int):
    def run(batches):
        for _, sub, a, b, line in _distinct(batches, shortest):
            for key, which, indexed, at, size in keys_of(sub, a, b - a, tau):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(line[which].view(np.int64)), pa.array(np.full(len(key), indexed)), pa.array((at - a[which]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["key", "line", "indexed", "at", "size"],
                )

    return run


def _refined(tau: int):
    """Second keys of lines under a frequent segment: of what they have besides it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "bytes"):
                key, at, size, line, indexed = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "at", "size", "line", "indexed"))
                data, rows = text_bytes(part.column("bytes"))
                n = np.diff(rows)
                rest = np.ones(len(data), bool)
                for r in range(len(n)):
                    rest[rows[r] + at[r] : rows[r] + at[r] + size[r]] = False
                left = n - size
                sub, first = Substrings(data[rest]), np.concatenate([[0], np.cumsum(left)])[:-1]
                for second, which, own, begin, length in keys_of(sub, first, left, tau):
                    both = mix64(second ^ mix64(key[which].view(np.uint64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both.view(np.int64)), pa.array(line[which]), pa.array(indexed[which] | own), pa.array(np.zeros(len(which), np.int32)), pa.array(np.zeros(len(which), np.int32))],
                        names=["key", "line", "indexed", "at", "size"],
                    )

    return run


def _texts(batches):
    for data, _, a, b, line in _distinct(batches):
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary())], names=["line", "bytes"])


def within(pairs: list[tuple[bytes, bytes]], tau: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most tau: a banded bit-parallel recurrence (Hyyrö), all pairs side by side.
    Each column holds the band's vertical differences as bits; the top bit is the lowest row of the band."""
    out = np.zeros(len(pairs), bool)
    order = np.argsort([max(len(a), len(b)) for a, b in pairs], kind="stable")
    at = 0
    while at < len(order):
        widest = max(map(len, pairs[order[at]]))
        to = at + 1
        while to < len(order) and (to + 1 - at) * (max(map(len, pairs[order[to]])) + 2 * tau) < 8_000_000 and to - at < 20_000:
            to += 1
        own = order[at:to]
        widest = max(max(map(len, pairs[i])) for i in own)
        m, n = (np.array([len(pairs[i][k]) for i in own]) for k in (0, 1))
        p = np.zeros((widest + 2 * tau + 1, len(own)), np.uint16)
        t = np.full((widest + 1, len(own)), 300, np.uint16)
        for k, i in enumerate(own):
            p[tau : tau + m[k], k] = np.frombuffer(pairs[i][0], np.uint8).astype(np.uint16) + 1
            t[: n[k], k] = np.frombuffer(pairs[i][1], np.uint8).astype(np.uint16) + 1
        one, top = np.uint64(1), np.uint64(1 << 63)
        vp = np.full(len(own), ((1 << 64) - 1) << (63 - tau) & ((1 << 64) - 1), np.uint64)
        vn, score, level = np.zeros(len(own), np.uint64), np.full(len(own), tau), np.full(len(own), 1 << 62, np.uint64)
        for j in range(widest):
            x = np.zeros(len(own), np.uint64)
            for o in range(2 * tau + 1):
                x |= (p[j + o] == t[j]).astype(np.uint64) << np.uint64(63 - 2 * tau + o)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            diagonal, live = j < m - tau, j < n
            score += np.where(live & diagonal, (d0 & top) == 0, 0)
            flat = live & ~diagonal
            score += np.where(flat, ((hp & level) != 0).astype(np.int64) - ((hn & level) != 0), 0)
            level = np.where(flat, level >> one, level)
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        out[own] = (score <= tau) & (np.abs(m - n) <= tau)
        at = to
    return out


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups of a partition that is sorted by keys, and where the groups begin (one more at the end)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(changed)])
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _linked(tau: int, most: int = 1 << 19):
    def run(batches):
        for table, cuts in _whole_groups(batches, ["key", "i", "j"]):
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            own, line, indexed = table.column("own").to_numpy(), table.column("line").to_numpy(), table.column("indexed").to_numpy(zero_copy_only=False)
            texts = table.column("bytes").to_pylist()
            n = np.array([len(x) for x in texts])
            letters = np.stack([np.bincount(np.frombuffer(x, np.uint8) & 31, minlength=32) for x in texts]).astype(np.int32)
            after = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(n)) - 1  # rows of the group behind each row
            upto, edges, at = np.cumsum(after), [], 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                k = after[at:to]
                a = np.repeat(np.arange(at, to), k)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                ok = (indexed[a] | indexed[b]) & (np.abs(n[a] - n[b]) <= tau) & (line[a] != line[b]) & (~across[a] | (own[a] != own[b]))
                a, b = a[ok], b[ok]
                ok = np.abs(letters[a] - letters[b]).sum(1) <= 2 * tau  # an edit changes two counts of letters at most
                a, b = a[ok], b[ok]
                if len(a):
                    pairs, first = np.unique(np.stack([np.minimum(line[a], line[b]), np.maximum(line[a], line[b])], 1), axis=0, return_index=True)
                    near = within([(texts[a[i]], texts[b[i]]) for i in first], tau)
                    edges.append(pairs[near])
                at = to
            found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
            root: dict[int, int] = {}

            def top(x):
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            for x, y in found.tolist():
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if root:
                yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(x) for x in list(root)], pa.int64())], names=["a", "b"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """The stored df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _met(keyed: DataFrame) -> DataFrame:
    """key, line, indexed, at, size, n: the lines that share a key, n at least their number; a line that has a key at several places is given with each."""
    sums = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("useful"), F.min("line").alias("low"), F.max("line").alias("high"))
    shared = stored(sums.where("useful and low < high").select("key", "n", "low", "high"))
    pairs = shared.where("n = 2").select("key", F.explode(F.array("low", "high")).alias("line"))
    none = F.lit(0).cast("int")
    pairs = pairs.select("key", "line", F.lit(True).alias("indexed"), none.alias("at"), none.alias("size"), F.lit(2).cast("bigint").alias("n"))
    crowds = keyed.join(_few(shared.where("n > 2").select("key", "n")), "key")
    crowds = crowds.groupBy("key", "line", "at", "size").agg(F.max("indexed").alias("indexed"), F.max("n").alias("n"))
    met = stored(pairs.unionByName(crowds))
    forget(shared)
    return met


def _near(texts: DataFrame, tau: int, shortest: int, block: int) -> DataFrame:
    """a, b: edges between near lines, enough to join each class."""
    met = _met(texts.mapInArrow(tidy(_keyed(tau, shortest)), _KEYED))
    wanted = stored(met.select("line").distinct())
    known = stored(texts.mapInArrow(tidy(_texts), "line bigint, bytes binary").join(_few(wanted), "line").groupBy("line").agg(F.min("bytes").alias("bytes")))
    cells = met.where(F.col("n") <= block)
    if shortest - -(-shortest // (tau + 1)) > tau:  # what is left besides a segment has tau + 1 segments of its own
        again = met.where(F.col("n") > block).join(known, "line").select("key", "at", "size", "line", "indexed", "bytes")
        cells = cells.unionByName(_met(again.mapInArrow(_refined(tau), _KEYED)))
    else:
        cells = met
    cells = cells.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("line"), F.col("nb")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("key", "line", "indexed", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(known, "line")
    edges = stored(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(_linked(tau)), "a bigint, b bigint"))
    for x in (met, wanted, known):
        forget(x)
    return edges


def _kept(rows: DataFrame, tau: int, shortest: int, block: int) -> tuple[DataFrame, DataFrame]:
    """rows: row_no, doc_id, text. The stored lines by row (row_no, doc_id, lines) and the first line of each class (row_no, line_no)."""
    described = stored(rows.mapInArrow(tidy(_described), _LINES))
    edges = _near(rows.select("text"), tau, max(shortest, tau + 1), block)
    labels = components(edges).select(F.col("node").alias("line"), "root")
    every = described.select("row_no", F.explode("lines").alias("l")).select("row_no", "l.*")
    first = every.groupBy("line").agg(F.min(F.struct("row_no", "line_no")).alias("at")).join(labels, "line", "left")
    first = stored(first.groupBy(F.coalesce("root", "line").alias("class")).agg(F.min("at").alias("at")).select("at.row_no", "at.line_no"))
    forget(edges)
    return described, first


def _rows(docs: DataFrame, row_no) -> DataFrame:
    return docs.select(row_no.alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def summary(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """row_no, doc_id, n_lines, n_kept and n_dropped of every row of docs."""
    described, first = _kept(_rows(docs, F.monotonically_increasing_id()), tau, shortest, block)
    kept = first.groupBy("row_no").agg(F.count(F.lit(1)).alias("n_kept"))
    rows = described.select("row_no", "doc_id", F.size("lines").cast("bigint").alias("n_lines")).join(kept, "row_no", "left")
    k = F.coalesce("n_kept", F.lit(0))
    return rows.select("row_no", "doc_id", "n_lines", k.alias("n_kept"), (F.col("n_lines") - k).alias("n_dropped"))


def dedup(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """docs with the text of every row less its dropped lines; blank lines stay. The rows are stored once with their numbers, so that a number means the same row
    in every later read."""
    name = unused(docs, "row_no")
    gone_name = unused(docs, "gone")
    numbered = stored(docs.withColumn(name, F.monotonically_increasing_id()))
    described, first = _kept(_rows(numbered, F.col(name)), tau, shortest, block)
    every = described.select("row_no", F.explode("lines").alias("l")).select("row_no", "l.line_no")
    gone = every.join(first, ["row_no", "line_no"], "left_anti").groupBy(F.col("row_no").alias(name)).agg(F.collect_set("line_no").alias(gone_name))
    marked = numbered.join(gone, name, "left")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(gone_name), s["i"]))
    text = F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(F.array_join(F.transform(lines, lambda s: s["x"]), "\n"))
    return marked.withColumn("text", text).select(*docs.columns)
