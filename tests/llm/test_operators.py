"""Each operator on a small table with nulls, empty and long texts, ties, repeats and clashing columns, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrift.llm import decontaminate, jaccard, licences, linededup, mixing, mixing_lm, topk, toxicity
from evidrift.llm.sharding import Conflict, ShardStore

random.seed(7)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, rng=random):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(60)
TEXTS = [None, "", "   \n ", "one", BASE, BASE, BASE.replace(" ", "  ").upper(), " ".join(["x", *BASE.split()[1:]]), prose(30) + " " + PASSAGE + " " + prose(20), prose(10) + " " + PASSAGE, prose(4000), "a b", "A b"]
_SCHEMA = "doc_id bigint, text string, source string, row_no int, n int, words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], 1, 2, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, BASE, "a", 1, 2, "z")], _SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], _SCHEMA)


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def shingle_set(t):
    w = split(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(docs, none):
    rows = jaccard.join(docs).collect()
    texts = [r.text for r in docs.collect()]
    assert len(rows) == len(texts)
    by = {r.row_no: r for r in rows}
    sets = [shingle_set(t) for t in texts]
    want = [sum(1 for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]
    assert [by[k].n_links for k in sorted(by)] == want
    classes = [by[k].class_id for k in sorted(by)]
    assert classes[4] == classes[5] == classes[6] == classes[7] == classes[13] == 4 and classes[0] == 0 and classes[11] == classes[12] == 11
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c if shingle_set(t) else f"own{i}" for i, (c, t) in enumerate(zip(classes, texts))})


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.68) ** jaccard.runs_needed(0.99) >= 0.98 and jaccard.runs_needed(0.999) > jaccard.runs_needed(0.9)


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, prose(60, rng) + (" vile scum " * 3 if i % 4 == 0 else ""), i % 4 == 0) for i in range(240)]
    own = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 160] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(own, labels)
    found = {r.doc_id: r.score for r in toxicity.score(own, model).collect()}
    held = [(found[i] >= 0.3, y) for i, _, y in rows if i >= 160]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(none, model).count() == 0 and toxicity.keep(docs, model).columns == docs.columns
    blank = toxicity.train(none.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score(docs, blank).count() == docs.count()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 8)))]
    vectors += [(200, vectors[7][1]), (201, vectors[7][1]), (202, None), (203, [None] + [0.0] * 7), (204, [float("nan")] * 8), (205, [1.0]), (206, []), (40, vectors[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id bigint, embedding array<float>, score string")
    good = [(i, np.pad(np.floor(1024 * np.array(v, np.float32).astype(float)), (0, 8 - len(v)))) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    seen, want = set(), set()
    for q, x in good:
        if q % 20 == 0 and q not in seen:
            seen.add(q)
            best = sorted(((-int(x @ y), i) for i, y in good if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=5, block=32, group=3).collect()
    assert {tuple(r) for r in got} == want
    assert topk.search(df.limit(0), F.lit(True)).count() == 0
    assert topk.search(df.where("vec_id < 3"), F.lit(True), k=5).count() == 6


def test_language_model(docs, none):
    model, counts = mixing_lm.train(docs, F.coalesce(F.col("doc_id") != 7, F.lit(True)))
    rows = mixing_lm.score(docs, model, counts).collect()
    train = Counter()
    for r in docs.collect():
        if r.doc_id != 7:
            train.update([*split(r.text), ("end",)])
    n, v = sum(train.values()), len(train)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        own = [*split(texts[r.doc_id]), ("end",)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in own), rel=1e-6)
        assert np.isfinite(r.score) and r.score < 0
    again = {(r.doc_id, round(r.score, 6)) for r in mixing_lm.score(docs.repartition(1), model, counts).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in rows}
    assert mixing_lm.score(none, model, counts).count() == 0
    empty, counted = mixing_lm.train(none, F.lit(True))
    assert mixing_lm.score(docs, empty, counted).count() == docs.count()


def test_huffman_is_a_prefix_code():
    starts, path, bits = mixing_lm.huffman(np.array([5, 1, 1, 9, 3]))
    codes = ["".join(map(str, bits[a:b])) for a, b in zip(starts[:-1], starts[1:])]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and len(set(codes)) == 5 and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_sharding(spark, docs, none, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=3)
    assert store.version() == 0 and store.read().count() == 0
    for part in (docs, docs, docs.withColumn("more", F.lit(1)), none):
        store.append(part.repartition(3), rows=5)
    before = store.read().count()
    version = store.version()
    assert version == 4 and before == 3 * docs.count()
    store.compact()
    assert store.version() > version and store.read().count() == before and len(store.manifest()[1]) < len(store.manifest(version)[1])
    assert store.read(version).count() == before
    assert store.read().where("more is null").count() == 2 * docs.count()
    placed = store.read(place=True)
    assert placed.where("shard is null or shard_bytes is null").count() == 0
    store.vacuum()
    assert store.read().count() == before
    with pytest.raises(Conflict):
        store._commit(store.version() - 1, *store.manifest())
    with pytest.raises(ValueError):
        store.append(docs.withColumn("more", F.lit("x")))


def test_licences(spark):
    own = [None, "", "Nothing here.\n" + prose(40), "Intro line.\nReleased under the MIT License.\nThe end.", "Licensed under CC BY-NC 4.0.", "The licence office is under the bridge.", prose(500).replace("\n", " ") + " This work is licensed under the GNU General Public License, version 3. " + prose(50)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*own, own[3]])], "doc_id bigint, text string, words string")
    got = {(r.doc_id, r.families) for r in licences.scan(rows).collect()}
    assert got == {(0, ""), (1, ""), (2, ""), (3, "MIT"), (4, "CC-BY-NC"), (5, ""), (6, "GPL"), (7, "MIT")}
    assert licences.scan(rows.limit(0)).count() == 0


def test_mixing(docs, none):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r, source in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [r.source for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))]):
        by.setdefault(source, []).append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and len(r.shards) == (r.taken // r.size if r.size else len(r.shards))
    total = sum(r.size for r in rows)
    targets = {s: rs[0].target for s, rs in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, rs in by.items():
        assert targets[s] <= 3 * rs[0].source_size + 1e-6 and rs[0].source_size == sum(r.size for r in rs)
    assert mixing.plan(none).count() == 0
    out = mixing.materialise(docs)
    assert out.columns == docs.columns and out.where("size(split(trim(text), '[ ]+')) >= 1").count() >= 1
    assert mixing.materialise(none).count() == 0


def test_decontamination(spark, docs, none):
    item = prose(40)
    bench = spark.createDataFrame([(1, item, "x"), (2, "Short  Question?", "x"), (3, None, "x"), (4, "", "x"), (10, item, "x")], "item_id bigint, text string, doc_id string")
    own = ["A short question, indeed.", prose(50) + ", " + item.upper() + ". " + prose(5), None, "", "shortquestion", item[:20]]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)], "doc_id bigint, text string, n_words string")
    for block in (32 << 20, 64):
        got = {r.doc_id: r for r in decontaminate.scan(rows, bench, block_bytes=block).collect()}
        assert got[0].items == [2] and got[0].hit_words == [1, 2] and own[0].encode()[got[0].spans[0]["first"] : got[0].spans[0]["last"]] == b"short question"
        assert sorted(got[1].items) == [1, 10] and len(got[1].hit_words) == 40 and got[2].n_words == got[3].n_words == 0 and got[4].items == got[5].items == []
        assert [r.doc_id for r in decontaminate.clean(rows, bench, block_bytes=block).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    assert decontaminate.scan(none, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).count() == docs.count()


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d = d, [i + 1]
        for j, y in enumerate(b):
            d.append(min(p[j] + (x != y), p[j + 1] + 1, d[j] + 1))
    return d[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_edit_distance(tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(400):
        a = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(5, 50)))
        b = bytearray(a)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = bytes([rng.randrange(97, 100)])[: rng.randrange(2)]
        pairs.append((a, bytes(b)))
    assert linededup.within(pairs, tau).tolist() == [edits(a, b) <= tau for a, b in pairs]


def test_line_dedup(spark, none):
    line = "The quick brown fox jumps over the lazy dog"
    own = [f"{line}\nkeep me one", f" {line}!\nabc", f"{line[:20]}X{line[20:]}\nabc\n\nabd", None, "", "abc", f"Prefix {line}"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*own, own[0]])], "doc_id bigint, text string, row_no string").coalesce(1)
    got = [(r.doc_id, r.n_lines, r.n_kept) for r in linededup.summary(rows).orderBy("row_no").collect()]
    assert got == [(0, 2, 2), (1, 2, 1), (2, 3, 1), (3, 0, 0), (4, 0, 0), (5, 1, 0), (6, 1, 1), (7, 2, 0)]
    assert [r.text for r in linededup.dedup(rows).collect()] == [own[0], "abc", "\nabd", None, "", "", own[6], ""]
    assert linededup.summary(none).count() == 0


def test_items_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]
