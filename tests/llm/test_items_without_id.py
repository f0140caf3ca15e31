"""Benchmark items without an id hit like any other, in one block and in many, as OP9_SQL has it."""

from evidrift.llm import decontaminate


def test_items_without_an_id_hit(spark):
    item, other = (" ".join(f"{p}{i}" for i in range(30)) for p in "ab")
    bench = spark.createDataFrame([(None, item), (None, item + " end"), (7, other)], "item_id bigint, text string")
    rows = spark.createDataFrame([(0, item), (1, f"{item} {other}"), (2, other), (3, "clean text")], "doc_id bigint, text string")
    for block in (32 << 20, 64):
        got = {r.doc_id: r for r in decontaminate.scan(rows, bench, block_bytes=block).collect()}
        assert [len(got[i].hit_words) for i in range(4)] == [30, 60, 30, 0]
        assert {i: set(got[i].items) for i in range(4)} == {0: {None}, 1: {None, 7}, 2: {7}, 3: set()} and len(got[1].items) == 2
        assert [r.doc_id for r in decontaminate.clean(rows, bench, block_bytes=block).collect()] == [3]
