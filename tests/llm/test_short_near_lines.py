"""Near lines of 24 to 31 bytes join as longer ones do."""

from evidrift.llm import linededup


def test_lines_of_24_bytes_and_more_join(spark):
    own = ["See page 12 of the report", "See page 13 of the report", "Chapter nine, the rivers", "Chapter nine, the rivets", "Chapter ten, the rivers", "Chapter ten, the rivets"]
    assert [len(x) for x in own] == [25, 25, 24, 24, 23, 23]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id bigint, text string").coalesce(1)
    kept = [r.n_kept for r in linededup.summary(rows).orderBy("row_no").collect()]
    assert kept == [1, 0, 1, 0, 1, 1]
