"""The models against a plain version, and held-out accuracy on the labelled rows of a table."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidrift.llm import toxicity
from evidrift.llm.common import crc_fold

ROWS = [("the vile scum came", 1), ("vile scum and vile scum", 1), ("the quiet river came", 0), ("a quiet river and the sea", 0), ("The sea and the river", 0), ("", 0), ("vile sea", 1), ("the scum", 1)]


def words_of(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())


def plain(text, rows):
    """Evidence of each word, written out."""
    pairs, follows = defaultdict(lambda: [0, 0]), defaultdict(lambda: [set(), set()])
    for t, y in rows:
        w = words_of(t)
        for v, x in set(zip([None, *w], w)):
            pairs[v, x][1 - y] += 1
            follows[x][1 - y].add(v)
    words = {x: [len(s) for s in n] for x, n in follows.items()}

    def order(counts):
        total = [sum(n[i] for n in counts.values()) + 1 for i in (0, 1)]
        d = []
        for i in (0, 1):
            t = [max(1, sum(n[i] == j for n in counts.values())) for j in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1])
            d.append([min(j + 0.95, max(0.1 * (j + 1), (j + 1) - (j + 2) * y * t[j + 1] / t[j])) for j in range(3)])
        kinds = sum(n[i] > 0 for n in counts.values() for i in (0, 1)) + 1
        rest = [(sum(d[i][min(n[i], 3) - 1] for n in counts.values() if n[i]) + 1) / total[i] / kinds for i in (0, 1)]

        def ratio(key, below):
            n = counts.get(key, [0, 0])
            if not any(n):
                return below
            p = [(n[i] - d[i][min(n[i], 3) - 1] if n[i] else 0) / total[i] + rest[i] * sum(x > 0 for x in n) * below[i] for i in (0, 1)]
            return [x / (sum(p) / 2) for x in p]

        return ratio

    high, low = order(dict(pairs)), order(words)
    w = words_of(text)
    return [np.log(r[0]) - np.log(r[1]) for v, x in zip([None, *w], w) for r in [high((v, x), low(x, [1.0, 1.0]))]]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(ROWS)], "doc_id bigint, text string, toxic string")
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(ROWS)], "doc_id bigint, toxic int"))


@pytest.mark.parametrize("text", ["the vile scum", "quiet sea, the VILE river", "unseen words only", "scum"])
def test_evidence_equals_the_plain_version(model, text):
    words, pairs, _ = toxicity.expressions(pa.array([text]))
    assert model.evidence(words, pairs) == pytest.approx(plain(text, ROWS), abs=1e-5)


def test_own_counts_are_left_out(model):
    """Without the counts of its only document, an expression says what its word says."""
    words, pairs, begins = toxicity.expressions(pa.array([t for t, _ in ROWS]))
    row = np.repeat(np.arange(len(ROWS)), np.diff(begins))
    own = model.evidence(words, pairs, (row, np.array([y for _, y in ROWS])[row]))
    assert own[begins[6] + 1] < model.evidence(words, pairs)[begins[6] + 1] and np.isfinite(own).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    out = crc_fold("doc_id", 4) == 2
    found = toxicity.score(docs.where(out), toxicity.train(docs, labels.where(~out))).join(labels, "doc_id").toPandas()
    said, true = found.score >= 0.3, found.toxic == 1
    assert (said & true).sum() / said.sum() >= 0.9 and (said & true).sum() / true.sum() >= 0.85
    assert found.score.between(0, 1).all()


def test_repeated_ids_ties_and_very_long_texts(spark):
    rows = [(1, "vile scum here", "x"), (1, "quiet river", "x"), (2, "quiet river " * 60_000, "x"), (2, "quiet river " * 60_000, "x"), (3, None, "x"), (None, "vile scum", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id bigint, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.keep(docs, model, 2.0).count() == 6 and toxicity.keep(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).select(F.col("score")).count() == 0


