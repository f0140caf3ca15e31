"""The join against all pairs of a table, whole and split many levels deep; rows in any order; clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidrift.llm import jaccard


def shingle_set(t):
    w = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def all_pairs(texts, threshold=0.8):
    """Links of each text and its class, by the texts that share a shingle."""
    sets = [shingle_set(t) for t in texts]
    rows = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            rows[x].append(i)
    common = Counter((i, j) for own in rows.values() for i in own for j in own if i < j)
    links, root = Counter(), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for (i, j), n in common.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    return [links[i] for i in range(len(texts))], [top(i) for i in range(len(texts))]


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def crowd(spark):
    """One text with near copies of every degree, a passage that many share, and prose."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base, passage = rng.choices(words, k=150), rng.choices(words, k=40)
    texts = [edited(base, rng.choice([0, 1, 1, 2, 3, 5]), rng) for _ in range(220)]
    texts += [" ".join(passage + rng.choices(words, k=rng.choice([4, 8, 90]))) for _ in range(200)] + [" ".join(rng.choices(words, k=50)) for _ in range(80)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), texts


@pytest.mark.parametrize("limit", [2048, 24])
def test_links_and_classes_of_a_crowd(crowd, limit):
    docs, texts = crowd
    links, classes = all_pairs(texts)
    got = {r.doc_id: r for r in jaccard.join(docs, limit=limit).collect()}
    assert len(got) == len(texts)
    want = sum(links)
    assert sum(got[i].n_links for i in range(len(texts))) >= 0.97 * want and all(got[i].n_links <= links[i] for i in range(len(texts)))
    wrong = sum(got[i].class_id != c for i, c in enumerate(classes))
    assert wrong <= 0.02 * len(texts)


def test_recall_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    links, _ = all_pairs([r.text for r in rows])
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    assert all(got[r.doc_id] <= n for r, n in zip(rows, links)) and sum(got.values()) >= 0.98 * sum(links) > 0


def test_keep_one_leaves_one_of_each_whatever_the_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text, 1, 1), (1, text, 1, 1), (2, text + " end", 2, 1), (3, "other", 3, 1), (None, None, 4, 1), (None, None, 4, 1), (5, "", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_no int, key int").withColumn("more", F.create_map(F.lit("a"), F.col("key")))
    kept = jaccard.keep_one(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, ""), (1, text), (3, "other"), (5, "")] or kept.where("text like 'a0%'").count() == 1
    assert kept.where("text is null").count() == 2 and kept.count() == 5
