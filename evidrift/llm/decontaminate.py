"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark text.

Words are runs of bytes other than ASCII blanks, punctuation and controls, with A-Z lower-cased. Every
run of `window` benchmark words (or the whole item, where it is shorter but not empty) is a pattern. The
letters of the automaton are words: each benchmark word is one character, and any other word is one more. It
runs once over the words of each document that has enough benchmark words in a row to match at all; a match is carried back to byte offsets of the original text.

Defined results: a null or empty text has no words, no hits and no items; items with null or blank
text have no window; items with equal ids pool their windows; items without an id are one item whose id is null, and their windows hit like any; repeated document rows are answered row by row;
texts of any length are scanned whole; other columns of either table, whatever their names, are ignored by `scan` and kept by `clean`; empty tables give no rows, or rows without hits.

Plan: one narrow pass over the documents, no shuffle. The windows are broadcast in blocks: block_bytes bounds a block's benchmark text, and with it its windows (a block of 2 MB has about
350,000 windows of 13 characters) and the automaton (about 14 nodes a window at most). With one block (any usual benchmark) that is the whole job; a larger benchmark is scanned
block by block over rows stored once with their numbers, and the hits of each row are united by one grouped aggregate.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Keys, hash_words, slices, stored, text_bytes, tidy, unused

#: Bytes that are not in [^\x00-\x2F\x3A-\x60\x7B-\x7F] become blanks, A-Z become a-z.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = np.frombuffer(_CLEAN, np.uint8) != 32
_BREAKS = ~_WORD

SCHEMA = "doc_id bigint, n_words bigint, items array<bigint>, hit_words array<int>, spans array<struct<first:bigint,last:bigint>>"

#: The automaton of the last broadcast, kept for the next task of the same Python worker.
_built: dict[str, Scanner] = {}


BLOCK_BYTES = 2 << 20
_OTHER = "\x00"


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_CLEAN).split()


def windows(items: list[tuple[int | None, str | None]], size: int) -> tuple[dict[bytes, str], list[tuple[str, list]]]:
    """The character of each benchmark word, and (pattern, ids of the items that have it) for every distinct window."""
    letters: dict[bytes, str] = {}
    owners: dict[str, set] = defaultdict(set)
    for item, text in items:
        line = ""
        for w in words(text):
            n = len(letters) + 1
            line += letters.setdefault(w, chr(n if n < 0xD800 else n + 0x800))  # surrogates are no characters
        for i in range(max(1, len(line) - size + 1) if line else 0):
            owners[line[i : i + size]].add(item)
    return letters, [(k, sorted(v, key=str)) for k, v in owners.items()]


def automaton(patterns: list[tuple[str, list]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, (text, _) in enumerate(patterns):
        out.add_word(text, (i, len(text)))
    if patterns:
        out.make_automaton()
    return out


def _row(raw: bytes, found: ahocorasick.Automaton, letters: dict[bytes, str], patterns: list) -> tuple[int, list, list, list]:
    split = raw.translate(_CLEAN).split()
    if not split or not len(found):
        return len(split), [], [], []
    hits = list(found.iter("".join([letters.get(w, _OTHER) for w in split])))
    if not hits:
        return len(split), [], [], []
    marks, items = np.zeros(len(split) + 1, np.int64), set()
    for last, (which, n) in hits:
        marks[last + 1 - n] += 1
        marks[last + 1] -= 1
        items.update(patterns[which][1])
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    solid = np.concatenate(([False], _WORD[np.frombuffer(raw, np.uint8)], [False]))
    first, last = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    runs = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
    ends = np.append(runs[1:], len(hit)) - 1
    spans = [{"first": int(first[hit[a]]), "last": int(last[hit[b]])} for a, b in zip(runs, ends)]
    return len(split), sorted(items, key=str), hit.tolist(), spans


class Scanner:
    """The automaton, and what tells the texts that cannot match: a window occurs only where as many words in a row as the shortest window has are all words of the benchmark."""

    def __init__(self, letters: dict[bytes, str], patterns: list[tuple[str, list]]):
        self.letters, self.patterns, self.found = letters, patterns, automaton(patterns)
        self.least = min((len(p) for p, _ in patterns), default=1)
        every = pa.array([*letters], pa.binary())
        self.known = Keys(np.unique(hash_words(*text_bytes(every), _BREAKS)[0]), presorted=True)

    def rows(self, part: pa.RecordBatch) -> list[tuple[int, list, list, list]]:
        data, bounds = text_bytes(part.column("text"))
        words_, _, begins = hash_words(data, bounds, _BREAKS)
        upto = np.concatenate([[0], np.cumsum(self.known.find(words_) >= 0)])
        full = np.flatnonzero(upto[self.least :] - upto[: max(0, len(upto) - self.least)] == self.least)  # where runs of known words begin
        first = np.searchsorted(full, begins[:-1])
        may = (first < np.searchsorted(full, begins[1:] - self.least, "right")) & (np.diff(begins) >= self.least)
        raw = data.tobytes()
        return [_row(raw[a:b], self.found, self.letters, self.patterns) if m else (int(n), [], [], []) for a, b, m, n in zip(bounds[:-1], bounds[1:], may, np.diff(begins))]


def _found(batch: pa.RecordBatch, shared, name: str):
    """Parts of a batch, each with what _row says of its rows."""
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(*shared.value)
    for part in slices(batch, "text"):
        yield part, _built[name].rows(part)


def _scan(docs: DataFrame, patterns: tuple, key: list[str]) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    schema = ", ".join([*(f"{k} bigint" for k in key), SCHEMA])

    def run(batches):
        for batch in batches:
            for part, rows in _found(batch, shared, name):
                columns = [part.column(k) for k in (*key, "doc_id")]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "doc_id", "n_words", "items", "hit_words", "spans"])

    return docs.mapInArrow(tidy(run), schema)


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """item_id, text of the items with a text, and into how many blocks they go."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items, int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, items (ids with occurring windows), hit_words (ordinals), spans (byte offsets of the
    runs of hit words in the UTF-8 text, last exclusive). block_bytes bounds the benchmark text that is broadcast at a time."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, blocks = _items(benchmark, block_bytes)
    if blocks == 1:
        return _scan(docs, windows([tuple(r) for r in items.collect()], window), [])
    return _pooled(stored(docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")), items, blocks, window).drop("row_no")


def _pooled(numbered: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    parts = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _scan(numbered, windows([tuple(r) for r in own], window), ["row_no"])
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least one hit word, and at least one word in twenty hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Each row is judged by its own text; with one block of
    benchmark text this is one narrow pass."""
    items, blocks = _items(benchmark, block_bytes)
    if blocks == 1:
        patterns = windows([tuple(r) for r in items.collect()], window)
        shared, name = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

        def run(batches):
            for batch in batches:
                for part, rows in _found(batch, shared, name):
                    yield part.filter(pa.array([not (len(hit) > 0 and 20 * len(hit) >= n) for n, _, hit, _ in rows], pa.bool_()))

        return docs.mapInArrow(tidy(run), docs.schema)
    name = unused(docs, "row_no")
    numbered = stored(docs.withColumn(name, F.monotonically_increasing_id()))
    found = _pooled(numbered.select(F.col(name).alias("row_no"), F.lit(0).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), items, blocks, window)
    bad = found.where(contaminated(F.size("hit_words").cast("bigint"), F.col("n_words"))).select(F.col("row_no").alias(name))
    return numbered.join(bad, name, "left_anti").select(*docs.columns)
