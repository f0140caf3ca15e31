"""Every stage of the pipeline, and the whole, on rows with nulls, empty and very long texts, repeats and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidrift.llm.sharding import ShardStore

rng = random.Random(8)
WORDS = [f"w{i}" for i in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEM, LONG = prose(40), prose(30_000)
BASE = prose(100)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, row_no int, key string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = [prose(60) + (" vile scum trash" if i % 3 == 0 else "") for i in range(120)] + [BASE, BASE, BASE + " end", None, "", "  ", LONG, f"{ITEM} {prose(20)}", f"{ITEM} {prose(2000)}"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), 1, 2, "k") for i, t in enumerate(texts)] + [(None, prose(50), "en", "a", 1, 1, 2, "k"), (5, prose(50), "en", "a", 1, 1, 2, "k")]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (4, None)], "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), at, rows


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]


def test_toxicity_rejects_toxic_documents_alone(spark, corpus):
    docs, at, rows = corpus
    kept = stage("toxicity")(spark, docs, at)
    left = ids(kept)
    assert kept.columns == docs.columns and sum(i % 3 == 0 for i in left if 0 <= i < 120 and i != 5) <= 4
    assert {i for i in range(120) if i % 3} | set(range(120, 129)) <= set(left)


def test_one_of_each_near_duplicate_stays(spark, corpus):
    docs, at, rows = corpus
    kept = stage("ngram_jaccard_join")(spark, docs, at)
    left = ids(kept)
    assert kept.columns == docs.columns and len([i for i in left if i in (120, 121, 122)]) == 1
    assert len(left) == len(rows) - 2


def test_contaminated_documents_go(spark, corpus):
    docs, at, rows = corpus
    kept = stage("benchmark_decontamination")(spark, docs, at)
    assert kept.columns == docs.columns and ids(kept) == sorted((r[0] if r[0] is not None else -1) for r in rows if r[0] != 127)


def test_the_mix_takes_whole_rows_at_most_three_times(spark, corpus):
    docs, at, rows = corpus
    out = stage("mixing_sources")(spark, docs, at)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id", "text").count().collect()}
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in rows}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, stage("mixing_sources")(spark, docs.repartition(3), at).collect()), key=str)


def test_sharding_keeps_every_row(spark, corpus):
    docs, at, rows = corpus
    out = stage("sharding")(spark, docs, at)
    assert out.columns == [*docs.columns, "shard_", "shard_bytes"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_the_whole_equals_its_stages_and_empty_tables_stay_empty(spark, corpus):
    docs, at, rows = corpus
    out = corpus_pipeline.run(spark, at)
    texts = {r.text for r in out.collect()}
    assert out.columns == [*docs.columns, "shard_", "shard_bytes"] and 0 < out.count() and not any(t and "vile scum trash" in t for t in texts) and sum(t in (BASE, BASE + " end") for t in texts) <= 1
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, at).count() == 0


def test_vacuum_spares_what_a_writer_may_yet_commit(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=2)
    rows = spark.range(50).withColumn("text", F.lit("x"))
    for _ in range(3):
        store.append(rows.repartition(2))
    waiting = store._write(rows)  # another writer has written, and not yet committed
    store.compact()
    store.vacuum()
    base = store.version()
    schema, shards = store.manifest(base)
    store._commit(base, schema, [*shards, *waiting])
    assert store.read().count() == 200 and sorted(r.id for r in store.read().distinct().collect()) == list(range(50))
    store.vacuum(orphan_age_s=0)
    assert store.read().count() == 200
