"""Toxicity scores from two class-conditional Kneser-Ney models, one of toxic and one of ordinary documents.

A word is a run of letters, digits and non-ASCII bytes, A-Z lower-cased; an expression is a word after the word before it. Expressions are counted by the
documents that have them, so that no long document outweighs the rest. The class is the context: each class has a discounted model (modified Kneser-Ney, discounts from the counts of counts) of
its expressions; what the discounts leave goes to the expressions by the shared counts, in how many classes each occurs at all, weighted by the order below: the same model of words, by the
Kneser-Ney counts of how many different words each follows in a class. So a rare expression gets what its word says, a rare word what both classes share, and what neither class has seen says nothing.
The evidence of a word is its toxic less its ordinary log-probability; that of a text the mean over its words, the difference of the length-normalised log-likelihoods, and the mean over
its PEAK strongest words, since a long text may be toxic in few places. A logistic curve turns evidence and length into the score; it is fitted on the training rows with each row's
own counts taken out of the models first, so that it holds for rows outside the training set.

Defined results: null or empty texts, and texts without words, get the score of no evidence at no length; texts of any length are scored whole;
labels with null doc_id or null label are ignored; if a doc_id has several labels the highest counts; rows that
repeat an id are scored each by its own text, and of several texts of a labelled id the one of least hash teaches; equal texts have equal scores; with no labels of either class every score is the prior;
other columns are ignored by `score`, whatever their names, and kept by `keep`; an empty table gives no rows.

Plan: the labels used for training are at most MAX_LABELS rows (lowest hash of doc_id first), so they are
broadcast at a bounded 16 bytes each and the documents are never shuffled, but for one text of each of these labels. Counts are summed map-side, then by hash.
The models hold every expression of the training rows; as these are bounded, so are the models, and they are broadcast. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Keys, forget, hash_words, mix64, slices, stored, text_bytes, tidy

MAX_LABELS = 10_000  # at most 32,767, so that a count of documents fits its type
PEAK = 3
_C = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x2545F4914F6CDD1D)

#: Bytes other than digits, letters and non-ASCII separate words.
BREAKS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def expressions(column: pa.Array):
    """Hashes of the words, of each with the word before it, and where each row's words begin (one more at the end)."""
    words, _, begins = hash_words(*text_bytes(column), BREAKS)
    before = np.append(_START, words[:-1])[: len(words)]
    first = begins[:-1][np.diff(begins) > 0]
    before[first] = _START
    return words, mix64(before * _C + words), begins


def _distinct_in_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first place of each key in each row."""
    return np.unique(keys ^ mix64(row.astype(np.uint64) * _C), return_index=True)[1]


def _count_rows(batches):
    """pair, word, n1, n0: the documents of each class that have an expression, summed within parts of a partition."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            words, pairs, begins = expressions(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(begins))
            own = _distinct_in_row(pairs, row)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[row[own]]
            keys, first, group = np.unique(pairs[own], return_index=True, return_inverse=True)
            n = [np.bincount(group, toxic == y, len(keys)).astype(np.int64) for y in (1, 0)]
            columns = [pa.array(x.view(np.int64)) for x in (keys, words[own][first])]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, n)], names=["pair", "word", "n1", "n0"])


def _packed(batches):
    """Keys and counts of parts of the pairs, and the words of these with how many pairs of each class they end, as bytes."""
    for batch in batches:
        n = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint16) for c in ("n1", "n0")], 1)
        words, place = np.unique(batch.column("word").to_numpy().view(np.uint64), return_inverse=True)
        follows = np.stack([np.bincount(place, n[:, i] > 0, len(words)).astype(np.int32) for i in (0, 1)], 1)
        columns = [batch.column("pair").to_numpy(), n, words, follows]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["keys", "counts", "words", "follows"])


def _model(parts) -> Model:
    """The model of all parts, which come one after the other, so that no table of all of them is held beside it."""
    got, words, follows, waiting = [], np.zeros(0, np.uint64), np.zeros((0, 2), np.int32), []

    def added():
        both = np.concatenate([words, *(np.frombuffer(w, np.uint64) for w, _ in waiting)])
        n = np.concatenate([follows, *(np.frombuffer(f, np.int32).reshape(-1, 2) for _, f in waiting)])
        waiting.clear()
        out, place = np.unique(both, return_inverse=True)
        return out, np.stack([np.bincount(place, n[:, i], len(out)).astype(np.int32) for i in (0, 1)], 1)

    for part in parts:
        got.append((part.keys, part.counts))
        waiting.append((part.words, part.follows))
        if sum(len(w) for w, _ in waiting) > 1 << 22:
            words, follows = added()
    words, follows = added()
    size = sum(len(keys) for keys, _ in got) // 8
    keys, n, at = np.empty(size, np.uint64), np.empty((size, 2), np.uint16), 0
    while got:
        own, counts = got.pop()
        to = at + len(own) // 8
        keys[at:to], n[at:to] = np.frombuffer(own, np.uint64), np.frombuffer(counts, np.uint16).reshape(-1, 2)
        at = to
    return Model(Counts(keys, n), Counts(words, follows))


class Counts:
    """Numbers by key; zeros for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.values = np.zeros((len(keys) + 1, values.shape[1]), values.dtype)
        np.take(values, order, 0, out=self.values[:-1])
        keys = keys[order]
        del order
        self.keys = Keys(keys, presorted=True)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.keys.find(keys)].astype(np.float32)


def discounts(values: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discounts of counts of one, two, and three or more, by class, from how many keys have counts of one to four."""
    out = []
    for own in values.T:
        t = np.maximum([np.count_nonzero(own == i) for i in range(1, 5)], 1).astype(float)
        y = t[0] / (t[0] + 2 * t[1])
        out.append([min(i + 0.95, max(0.1 * (i + 1), (i + 1) - (i + 2) * y * t[i + 1] / t[i])) for i in range(3)])
    return np.array(out)


class Order:
    """Counts of one order of both classes, toxic and ordinary."""

    def __init__(self, counts: Counts):
        self.counts, n = counts, counts.values
        self.total, self.discounts = n.sum(0) + 1.0, discounts(n[:-1])
        taken = sum(np.stack([np.sum(own) * d for own, d in zip(((n == i + 1) if i < 2 else (n > 2)).T, self.discounts[:, i])]) for i in range(3))
        self.shared = (taken + 1) / self.total / ((n > 0).sum() + 1.0)  # what is left for each class that a key occurs in

    def ratio(self, n: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of each key in the two classes to the mean of both; below is that of the order below. Keys that neither class has are left to it."""
        level = np.minimum(n, 3).astype(np.int64) - 1
        kinds = (n > 0).sum(1)
        p = np.stack([np.where(level[:, i] >= 0, n[:, i] - self.discounts[i][level[:, i]], 0) / self.total[i] + self.shared[i] * kinds * below[i] for i in (0, 1)])
        return np.where(kinds > 0, p / np.maximum(p.mean(0), 1e-300), below)


class Model:
    """pairs: documents with an expression. words: different words that a word follows. Both toxic and ordinary."""

    def __init__(self, pairs: Counts, words: Counts):
        self.pairs, self.words, self.curve = Order(pairs), Order(words), np.array([-2.0, 0.0, 0.0, 0.0])

    def evidence(self, words: np.ndarray, pairs: np.ndarray, less: tuple | None = None) -> np.ndarray:
        """Toxic less ordinary log-probability of each word after the one before it. less: the row and the class of each word, whose own counts are left out."""
        n, k = self.pairs.counts.of(pairs), self.words.counts.of(words)
        if less is not None:
            row, toxic = less
            side, here = np.where(toxic == 1, 0, 1), np.arange(len(words))
            alone = n[here, side] <= 1  # no other document of the class has the expression
            n[here, side] = np.maximum(n[here, side] - 1, 0)
            own = _distinct_in_row(pairs, row)
            _, group = np.unique(words ^ mix64(row.astype(np.uint64) * _C), return_inverse=True)
            k[here, side] = np.maximum(k[here, side] - np.bincount(group[own], alone[own], group.max(initial=-1) + 1)[group], 0)
        ratio = self.pairs.ratio(n, self.words.ratio(k, np.ones((2, len(words)))))
        return np.log(ratio[0]) - np.log(ratio[1])

    def features(self, evidence: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row a text: one, the mean evidence, the same by the log of the length, the mean of the strongest."""
        total, n = np.concatenate([[0.0], np.cumsum(evidence, dtype=np.float64)]), np.diff(begins)
        mean = (total[begins[1:]] - total[begins[:-1]]) / np.maximum(n, 1)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((-evidence, row))
        back = np.arange(len(order)) - begins[:-1][row]
        top = back < PEAK
        peak = np.bincount(row[top], evidence[order][top], len(n)) / np.maximum(np.minimum(n, PEAK), 1)
        return np.stack([np.ones(len(n)), mean, mean * np.log1p(n), peak], 1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, lightly regularised."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1); only its rows are learnt from."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    rows = stored(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("text", "toxic"))
    pairs = rows.mapInArrow(tidy(_count_rows), "pair bigint, word bigint, n1 bigint, n0 bigint").groupBy("pair")
    small = lambda c: F.least(F.sum(c), F.lit(65_535 >> 1)).cast("smallint").alias(c)  # noqa: E731  no more documents are learnt from
    parts = pairs.agg(F.min("word").alias("word"), small("n1"), small("n0")).mapInArrow(tidy(_packed), "keys binary, counts binary, words binary, follows binary")
    model = _model(parts.toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, pairs, begins = expressions(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(toxic)), np.diff(begins))
                x = own.features(own.evidence(words, pairs, (row, toxic[row])), begins)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, i])) for i in range(1, 4)), pa.array(toxic.astype(np.int32))], names=["mean", "long", "peak", "toxic"])

    sample = rows.mapInArrow(tidy(left_out), "mean double, long double, peak double, toxic int").toArrow()
    if len(sample):
        x = np.stack([np.ones(len(sample)), *(sample.column(c).to_numpy() for c in ("mean", "long", "peak"))], 1)
        model.curve = _fit_curve(x, sample.column("toxic").to_numpy().astype(float))
    shared.destroy()
    forget(rows)
    return model


def _scored(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    out = []
    for part in slices(batch, "text"):
        *own, begins = expressions(part.column("text"))
        out.append(model.score(model.features(model.evidence(*own), begins)))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scored(batch, own))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, own) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
