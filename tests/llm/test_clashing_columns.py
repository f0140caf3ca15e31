"""Columns named like those that operators add, and a benchmark in many blocks over stored rows."""

from pyspark.sql import functions as F

from evidrift.llm import decontaminate, mixing
from evidrift.llm.common import unused


def test_unused_names_are_free_in_any_case(spark):
    df = spark.createDataFrame([(1, 2)], "Row_No int, row_no_ int")
    assert unused(df, "row_no") == "row_no__" and unused(df, "x") == "x"


def test_cleaning_in_blocks_keeps_columns_and_rows(spark):
    item = " ".join(f"a{i}" for i in range(30))
    bench = spark.createDataFrame([(i, f"{item} b{i}") for i in range(20)], "item_id bigint, text string")
    rows = [(1, item, 7, 8), (1, "clean text", 7, 8), (1, "clean text", 7, 8), (None, None, 7, 8), (2, item + " x" * 2000, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_no int, n_words int")
    for block in (1 << 20, 300):
        kept = decontaminate.clean(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text is null or text = 'clean text' or doc_id = 2").collect()))
        assert decontaminate.scan(docs, bench, block_bytes=block).where(F.size("items") == 20).count() == 2


def test_the_tree_draws_what_the_plan_takes(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), ["a", "b", "c", None][i % 4], "k", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key string, block int")
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    out = {r.doc_id: r["count"] for r in mixing.materialise(docs).groupBy("doc_id").count().collect()}
    assert mixing.materialise(docs).columns == docs.columns
    assert all(r.taken == out.get(i, 0) * r.size and len(r.shards) == out.get(i, 0) and set(r.shards) <= set(range(32)) for i, r in plan.items())
    by = {}
    for r in plan.values():
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 8 for target, taken in by.values()) or sum(t for _, t in by.values()) > 0
