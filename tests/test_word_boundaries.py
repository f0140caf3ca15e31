"""Numbers and negations next to letters outside ASCII, against the SQL of the queries."""

import duckdb
import pytest

from evidrift import catalog

TURNS = [
    (1, 0, "user", "Noñasción que esos"), (1, 1, "assistant", "Noñasción que esos. Que esos son 12é y 7."),
    (2, 0, "user", "que esos 12é"), (2, 1, "assistant", "Noñasción que esos. éno 5%a 3,5ñ"), (3, 0, "user", "not now 12"), (3, 1, "assistant", "not now 12."),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(TURNS, "conv_id bigint, turn int, role string, text string").toPandas().to_parquet(at / "conversations.parquet")
    return at


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    return sorted(map(tuple, catalog.queries()[name](spark, str(folder)).collect()), key=str), sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=str)


def test_decisions_follow_the_sql(spark, folder):
    got, want = both(spark, folder, "e16_apply_decisions")
    assert got == want and any(r[2] == "contradicted" for r in got)


def test_refined_answers_follow_the_sql(spark, folder):
    got, want = both(spark, folder, "e17_refine")
    assert got == want and any(r[2] == "insufficient_evidence" for r in got)


def test_numbers_follow_the_sql(spark, folder):
    got, want = both(spark, folder, "x08_numbers")
    assert got == want and (1, 0, "", True) in got and (2, 0, "12", False) in got


def test_negations_in_capitals_follow_the_sql(spark, tmp_path):
    turns = [(1, 0, "user", "W\u0130THOUT 7"), (1, 1, "user", "\u0130no 7"), (1, 2, "user", "\u039f\u03a3 no"), (1, 3, "user", None), (1, 4, "user", "")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    got, want = both(spark, tmp_path, "x08_numbers")
    assert got == want and (1, 0, "7", True) in got and (1, 1, "7", False) in got


@pytest.mark.parametrize(
    "turns, status",
    [
        ([(0, "user", "alpha beta"), (1, "assistant", "alpha beta.\u2028not gamma")], "insufficient_evidence"),  # one sentence: no space of RE2 ends the first
        ([(0, "user", "alpha beta"), (1, "user", None), (2, "assistant", "zeta. alpha beta")], "needs_review"),  # a turn without a text counts as a context
        ([(0, "user", "ix"), (1, "user", "i x not"), (2, "assistant", "\u0130X omega")], "qualified"),
    ],
)
def test_refined_answers_to_odd_turns_follow_the_sql(spark, tmp_path, turns, status):
    spark.createDataFrame([(1, *t) for t in turns], "conv_id bigint, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    got, want = both(spark, tmp_path, "e17_refine")
    assert got == want and [r[2] for r in got] == [status]
