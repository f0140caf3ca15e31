"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words when words are runs of non-blank bytes: \x20 and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: The same class as a regular expression for Spark and DuckDB.
NON_BLANK = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PIECE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode and an error on a cluster, whose executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "evidrift-checkpoints")
    return at.rstrip("/")


def stored(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Writes df into the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/evidrift/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(kind) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed: the same for a row in every read of the table, however its files are packed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)], F.lit(len(df.columns)))


def forget(df: DataFrame) -> None:
    """Removes the files of a stored() frame that nothing reads any more."""
    at = getattr(df, "_stored_at", None)
    if at:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows of counts whose column `by` is at the least value or above at which no more than limit rows remain, to a 64th of a binary
    order. The cutoff comes from a count of rows by level, so nothing is sorted and no task gathers the rows."""
    level = F.floor(F.log2(F.col(by).cast("double")) * 64).cast("int")
    rest, cutoff = limit, None
    for value, rows in sorted(((r[0], r[1]) for r in counts.where(F.col(by) > 0).groupBy(level.alias("v")).count().collect()), reverse=True):
        rest -= rows
        if rest < 0:
            break
        cutoff = value
    return counts.where(F.lit(False) if cutoff is None else (F.col(by) > 0) & (level >= cutoff))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        out = np.empty(max(n, 64), np.uint64)
        out[0] = 1
        out[1:] = np.uint64(0xD6E8FEB86659FD93)
        _power = np.multiply.accumulate(out)
    return _power


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more at the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = wide.buffers()
    starts = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def hash_words(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = BLANK, stems: tuple[int, ...] = (), lengths: bool = False):
    """Lower-cased (A-Z) words of all rows: 64-bit hashes, first bytes, and where each row's words begin. breaks: the bytes
    that separate words. stems: also hashes of each word's first so many bytes (falling lengths), a row of a
    fourth result each. lengths: adds the words' lengths in bytes."""
    blank = breaks[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[bounds] = True
    hashes, firsts, begun, sizes, at = [], [], [[] for _ in stems], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not blank[end] and not row_start[end]:  # a word stays whole
            stop = end + 4096
            cut = np.flatnonzero(blank[end:stop] | row_start[end : min(stop, len(data))])
            end = end + int(cut[0]) if len(cut) else min(stop, len(data))
        solid = ~blank[at:end]
        first = solid & row_start[at:end]
        first[0] = solid[0]
        first[1:] |= solid[1:] & ~solid[:-1]
        where = np.flatnonzero(first)
        if len(where):
            letters = np.flatnonzero(solid)
            begins = np.searchsorted(letters, where)
            sizes.append(np.diff(begins, append=len(letters)))
            within = np.arange(len(letters)) - np.repeat(begins, sizes[-1])
            values = _BYTE_LOWER[data[at:end][letters]] * _powers(int(sizes[-1].max()))[within]
            hashes.append(np.add.reduceat(values, begins))
            for size, found in zip(stems, begun):
                values[within >= size] = 0
                found.append(np.add.reduceat(values, begins))
            firsts.append(where + at)
        at = end
    none = np.zeros(0, np.uint64)
    first = np.concatenate([np.zeros(0, np.int64), *firsts])
    out = mix64(np.concatenate([none, *hashes])), first, np.searchsorted(first, bounds)
    if stems:
        out = (*out, np.stack([mix64(np.concatenate([none, *x])) for x in begun]))
    return (*out, np.concatenate([np.zeros(0, np.int64), *sizes])) if lengths else out


class Keys:
    """Places of distinct 64-bit keys in the list they were given in, exactly. Keys are hashes, so their leading bits say where to look in sorted order; the few that share these are met in turn."""

    def __init__(self, keys: np.ndarray, presorted: bool = False):
        keys = keys.astype(np.uint64, copy=False)
        order, bits = None if presorted else np.argsort(keys, kind="stable"), max(1, len(keys).bit_length())
        self.n, self.shift = len(keys), np.uint64(64 - bits)
        self.sorted = np.append(keys if presorted else keys[order], np.uint64((1 << 64) - 1))
        self.place = None if presorted else np.append(order, -1).astype(np.int32)
        self.begins, step = np.empty(1 << bits, np.int32), 1 << min(bits, 16)
        for at in range(0, 1 << bits, step):  # a part at a time, as places are wider than what is kept of them
            self.begins[at : at + step] = np.searchsorted(self.sorted[:-1], np.arange(at, at + step, dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the list, or -1."""
        at = self.begins[(keys >> self.shift).astype(np.int64)]
        here = self.sorted[at]
        out = np.where(here == keys, at, self.n)
        on = np.flatnonzero(here < keys)
        at = at[on]
        while len(on):
            at = at + 1
            here, want = self.sorted[at], keys[on]
            hit = here == want
            out[on[hit]] = at[hit]
            more = here < want
            on, at = on[more], at[more]
        return np.where(out == self.n, -1, out) if self.place is None else self.place[out]


def tidy(run):
    """run, a function over Arrow batches, which gives the memory that it no longer uses back to the system at its end: Python workers live on from job to job."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words; all words as one run if there are fewer, none if there are none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : len(words) - size + 1 + i]
    return mix64(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch whose texts hold about limit bytes at most (one row at least)."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def crc_fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts; null ids fall in no part."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts
