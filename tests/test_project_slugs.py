"""Slugs of new projects against those of a plain loop, and of very many projects of one name."""

import time

import pandas as pd

from evidrift.operators import workflows


def looped(existing, names):
    taken, out = set(existing), []
    for name in names:
        n = 1
        while (slug := name if n == 1 else f"{name}-{n}") in taken:
            n += 1
        taken.add(slug)
        out.append(slug)
    return out


def test_first_free_numbers(spark):
    existing, names = ["a", "a-2", "a-3", "a-7", "a-9", "b-2", "b-3", "b-5", "d"], ["a"] * 8 + ["b"] * 5 + ["c"] * 3
    got = workflows.create_projects(spark.createDataFrame([(x,) for x in existing], "slug string"), spark.createDataFrame(list(enumerate(names)), "seq int, name string"))
    assert [r.slug for r in got.orderBy("seq").collect()] == looped(existing, names)


def test_one_name_very_often(spark):
    n, start = 60_000, time.time()
    existing = spark.createDataFrame(pd.DataFrame({"slug": ["p", "p-3", *(f"p-{i}" for i in range(5, 20_000))]}))
    got = workflows.create_projects(existing, spark.range(n).selectExpr("id as seq", "'p' as name")).toPandas().set_index("seq").slug
    assert (got[0], got[1], got[2], got[n - 1], got.nunique()) == ("p-2", "p-4", "p-20000", f"p-{n + 19_997}", n)
    assert time.time() - start < 60  # no work a number and project
