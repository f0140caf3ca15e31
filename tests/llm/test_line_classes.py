"""Line classes against all pairs of lines, with a segment that very many lines have, and columns that clash."""

import random

import pytest

from evidrift.llm import linededup


def edits(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return most + 1
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d = d, [i + 1]
        for j, y in enumerate(b):
            d.append(min(p[j] + (x != y), p[j + 1] + 1, d[j] + 1))
    return d[-1]


def kept_lines(texts, shortest=linededup.SHORTEST):
    """Lines of each text, and those of them that are the first of their class."""
    lines = [(r, x.strip(" \t")) for r, t in enumerate(texts) for x in (t or "").split("\n") if x.strip(" \t")]
    names = sorted({x for _, x in lines})
    root = {x: x for x in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in names if len(x.encode()) >= shortest]
    for i, x in enumerate(long):
        for y in long[i + 1 :]:
            if edits(x.encode(), y.encode()) <= 2:
                root[max(top(x), top(y))] = min(top(x), top(y))
    seen, out = set(), [[0, 0] for _ in texts]
    for r, x in lines:
        out[r][0] += 1
        if top(x) not in seen:
            seen.add(top(x))
            out[r][1] += 1
    return out


def changed(line, n, rng):
    out = list(line)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefgh ")]
    return "".join(out).strip() or "x"


@pytest.mark.parametrize("block", [256, 8])
def test_classes_equal_those_of_all_pairs(spark, block):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 45))) for _ in range(25)]
    crowd = ["header of the section " + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(45)]
    pool = [changed(rng.choice(base + crowd), rng.randrange(5), rng) for _ in range(170)] + crowd
    texts = ["\n".join(rng.sample(pool, rng.randrange(1, 6))) for _ in range(90)] + [None, "", " \n\t", texts_long(pool, rng)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row_no string, line int").coalesce(1)
    got = {r.doc_id: [r.n_lines, r.n_kept] for r in linededup.summary(rows, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == kept_lines(texts)
    out = linededup.dedup(rows, block=block)
    assert out.columns == rows.columns
    assert {r.doc_id: len([x for x in (r.text or "").split("\n") if x.strip()]) for r in out.collect()} == {i: k for i, (_, k) in got.items()}


def texts_long(pool, rng):
    return "\n".join(rng.choice(pool) for _ in range(300)) + "\n" + "word " * 60_000
