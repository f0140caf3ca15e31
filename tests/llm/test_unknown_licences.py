"""The classifier on paragraphs it has not seen: families by the words of their notices, and nothing for prose that has words in common with them."""

import random
import re

import pytest

from evidrift.llm import licences


@pytest.fixture(scope="module")
def classifier(spark):
    rng = random.Random(3)
    lines = [prose(rng) for _ in range(600)]
    return licences.train(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))


def prose(rng):
    odd = ["license", "licensed", "software", "permission", "copyright", "redistribution", "attribution", "public", "commons", "domain", "rights", "reserved", "source", "code"]
    return " ".join(rng.choice(odd) if rng.random() < 0.25 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 40)))


def predicted(spark, classifier, texts):
    rows = spark.createDataFrame([(i, [w for w in re.split(r"[\W_]+", t.lower()) if w]) for i, t in enumerate(texts)], "i int, words array<string>")
    return {r.i: r.family for r in classifier.predict(rows).collect()}


def test_prose_with_words_of_notices_is_unknown(spark, classifier):
    rng = random.Random(4)
    texts = [prose(rng) for _ in range(1500)]
    assert len(predicted(spark, classifier, texts)) <= 6


def test_notices_are_told_apart(spark, classifier):
    got = predicted(spark, classifier, [t for _, t in licences.TEMPLATES])
    right = sum(got.get(i) == family for i, (family, _) in enumerate(licences.TEMPLATES))
    assert right >= 0.9 * len(licences.TEMPLATES) and licences.anchors()


def test_documents_without_a_confirmed_notice_have_none(spark, classifier):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, prose(rng), "x") for i in range(200)] + [(900, licences.TEMPLATES[4][1], "x"), (901, None, "x"), (None, "", "x")], "doc_id bigint, text string, own string")
    got = licences.scan(rows, classifier).collect()
    assert len(got) == 203 and {r.doc_id: r.families for r in got if r.families} == {900: "MIT"}
    assert licences.scan(rows.limit(0), classifier).count() == 0
