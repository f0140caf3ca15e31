"""Queries of evaluation metrics and thresholds, calculations and diffs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from . import query, table

_VERDICTS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'supported' WHEN '2-HIGH' THEN 'contradicted' WHEN '3-MEDIUM' THEN 'unsupported' WHEN '4-NOT SPECIFIED' THEN 'insufficient' ELSE 'partially_supported' END"
_CASES = f"""c AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN ['supported', 'contradicted'] WHEN 1 THEN ['contradicted'] ELSE [] END AS expected, c_custkey % 4 = 0 AS abstain, c_custkey % 5 = 0 AS review, CASE c_custkey % 2 WHEN 0 THEN 'needs_review' ELSE 'supported' END AS status FROM customer),
v AS (SELECT o_custkey AS case_id, {_VERDICTS} AS verdict, CASE WHEN o_orderstatus = 'F' THEN 'why' END AS reason FROM orders),
g AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE verdict <> 'unsupported') AS passed, count(*) FILTER (WHERE verdict = 'contradicted') AS against, list(DISTINCT verdict) AS seen, count(*) FILTER (WHERE verdict NOT IN ('insufficient', 'uncertain')) AS sure, count(*) FILTER (WHERE verdict = 'supported' AND reason IS NOT NULL) AS wrong FROM v GROUP BY case_id),
m AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(passed, 0) AS passed, coalesce(against, 0) AS against, coalesce(seen, []) AS seen, coalesce(sure, 0) AS sure, coalesce(wrong, 0) AS wrong, len(list_filter(expected, lambda x: x = 'contradicted')) AS ea FROM c LEFT JOIN g USING (case_id)),
w AS (SELECT case_id, CASE WHEN n = 0 THEN 1.0 ELSE passed / n END::DOUBLE AS verification_pass_rate, CASE WHEN n = 0 THEN 0.0 ELSE (n - passed) / n END::DOUBLE AS unsupported_claim_ratio, CASE WHEN sure = 0 THEN 0.0 ELSE wrong / sure END::DOUBLE AS false_supported_rate,
CASE WHEN len(expected) > 0 THEN len(list_filter(expected, lambda x: list_contains(seen, x))) / len(expected) END::DOUBLE AS claim_verdict_recall, CASE WHEN len(expected) > 0 THEN CASE WHEN ea = 0 THEN 1.0 ELSE least(against, ea) / ea END ELSE 0.0 END::DOUBLE AS contradiction_recall,
CASE WHEN abstain THEN CASE WHEN status = 'needs_review' THEN 1.0 ELSE 0.0 END END::DOUBLE AS abstention_compliance, CASE WHEN review THEN CASE WHEN status = 'needs_review' THEN 1.0 ELSE 0.0 END END::DOUBLE AS review_requirement_compliance,
CASE WHEN case_id % 2 = 0 THEN len(list_intersect(['a1', 'a' || (case_id % 3)], ['a1', 'a' || (case_id % 3)])) / 2 * CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0.5 END END::DOUBLE AS expected_anchor_recall FROM m)"""


def _cases(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    wanted = F.when(k % 3 == 0, F.array(F.lit("supported"), F.lit("contradicted"))).when(k % 3 == 1, F.array(F.lit("contradicted"))).otherwise(none)
    return c.select(k.alias("case_id"), wanted.alias("expected_verdicts"), (k % 4 == 0).alias("requires_abstention"), (k % 5 == 0).alias("requires_review"), F.when(k % 2 == 0, "needs_review").otherwise("supported").alias("status"))


def _claims(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.expr(_VERDICTS).alias("verdict"), F.when(F.col("o_orderstatus") == "F", "why").alias("reason"))


@query("v08_claim_metrics", f"WITH {_CASES} SELECT * EXCLUDE (expected_anchor_recall) FROM w")
def v08(spark, d):
    return A.claim_metrics(_cases(spark, d), _claims(spark, d))


@query("v15_anchor_recall", "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 0.5 ELSE 1.0 END END::DOUBLE AS expected_anchor_recall FROM customer")
def v15(spark, d):
    k = F.col("case_id")
    cases = _cases(spark, d).select("case_id", F.when(k % 2 == 0, F.array(F.lit("a1"), F.lit("a2"))).otherwise(F.array().cast("array<string>")).alias("expected_anchors"), F.when(k % 3 == 0, F.array(F.lit("a1"))).otherwise(F.array(F.lit("a2"), F.lit("a1"), F.lit("x"))).alias("anchors"))
    return A.claim_metrics(cases, _claims(spark, d)).select("case_id", "expected_anchor_recall")


_CITED = "l AS (SELECT l_orderkey AS case_id, l_partkey AS chunk_id, l_linenumber AS n FROM lineitem), ci AS (SELECT *, CASE WHEN n % 4 <> 3 THEN 'doc' END AS document_id, 'uri' AS source_uri FROM l WHERE n <= 4), re AS (SELECT * FROM l WHERE n >= 3)"
_CITATION = f"{_CITED}, cm AS (SELECT o_orderkey AS case_id, count(DISTINCT chunk_id) AS k, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM re WHERE re.case_id = ci.case_id AND re.chunk_id = ci.chunk_id) THEN chunk_id END) AS found, count(chunk_id) AS n, count(*) FILTER (WHERE document_id IS NOT NULL) AS traced FROM orders LEFT JOIN ci ON ci.case_id = o_orderkey GROUP BY o_orderkey)"


@query("v06_citation_metrics", f"WITH {_CITATION} SELECT case_id, CASE WHEN k = 0 THEN 1.0 ELSE found / k END::DOUBLE AS citation_retrieval_precision, CASE WHEN n = 0 THEN 1.0 ELSE traced / n END::DOUBLE AS citation_traceability_rate, 1.0::DOUBLE AS citation_anchor_validity FROM cm")
def v06(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("n"))  # noqa: E741
    cited = l.where("n <= 4").select("case_id", "chunk_id", F.when(F.col("n") % 4 != 3, "doc").alias("document_id"), F.lit("uri").alias("source_uri"))
    return A.citation_metrics(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")), cited, l.where("n >= 3"))


@query("v09_overlap_f1", """WITH p AS (SELECT a.conv_id * 1000 + a.turn AS case_id, a.text AS answer, u.text AS reference FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
a AS (SELECT case_id, t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t FROM p) GROUP BY ALL), r AS (SELECT case_id, t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS t FROM p) GROUP BY ALL),
b AS (SELECT case_id, sum(least(a.n, r.n)) AS both_n FROM a JOIN r USING (case_id, t) GROUP BY case_id), n AS (SELECT case_id, len(regexp_extract_all(lower(answer), '[a-z0-9]+')) + len(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS n FROM p)
SELECT case_id, CASE WHEN n = 0 THEN 0 ELSE 2.0 * coalesce(both_n, 0) / n END::DOUBLE AS f1 FROM n LEFT JOIN b USING (case_id)""")
def v09(spark, d):
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return A.overlap_f1(c.join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("answer"), "reference"))


def _metrics(spark, d):
    return A.long_metrics(A.claim_metrics(_cases(spark, d), _claims(spark, d)), "case_id")


_LONG = f"WITH {_CASES}, lm AS (UNPIVOT (SELECT * EXCLUDE (expected_anchor_recall) FROM w) ON COLUMNS(* EXCLUDE (case_id)) INTO NAME metric VALUE value)"
_RULES = "(metric IN ('claim_verdict_recall', 'abstention_compliance', 'review_requirement_compliance') AND value < 1) OR (metric = 'verification_pass_rate' AND value < 0.7) OR (metric = 'false_supported_rate' AND value > 0.02)"
_FAILED = f"{_LONG}, fl AS (SELECT case_id, metric AS failure, value FROM lm WHERE {_RULES} UNION ALL SELECT case_id, 'critical_contradiction_recall', value FROM lm JOIN c USING (case_id) WHERE metric = 'contradiction_recall' AND value < 0.9 AND list_contains(expected, 'contradicted'))"


@query("v17_summary", f"{_LONG} SELECT metric, round(avg(value), 9) AS value FROM lm GROUP BY metric")
def v17(spark, d):
    return A.summary(_metrics(spark, d)).withColumn("value", F.round("value", 9))


@query("v18_case_failures", f"{_FAILED} SELECT * FROM fl")
def v18(spark, d):
    return A.failures(_metrics(spark, d), _cases(spark, d))


@query("v19_run_failures", f"{_FAILED} SELECT 'case:' || case_id || ':' || failure AS failure FROM fl UNION ALL SELECT 'summary:' || metric FROM (SELECT metric, avg(value) AS value FROM lm GROUP BY metric) WHERE (metric = 'verification_pass_rate' AND value < 0.7) OR (metric = 'false_supported_rate' AND value > 0.02)")
def v19(spark, d):
    m = _metrics(spark, d)
    return A.run_failures(A.failures(m, _cases(spark, d)), m)


@query("v21_probes", "SELECT source AS probe, count(*) AS n, round((max(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(text), 'zzzz') THEN 1 ELSE 0 END)) / 2, 3)::DOUBLE AS keyword_hit_rate, round(count(*) FILTER (WHERE doc_id % 3 = 0) / count(*), 3)::DOUBLE AS temporal_compliance FROM documents GROUP BY source")
def v21(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("probe"), "text", F.when(F.col("doc_id") % 3 == 0, F.lit("2023-01-01").cast("date")).otherwise(F.lit("2020-01-01").cast("date")).alias("published_at"))
    return A.probes(docs, docs.select("probe").distinct().withColumn("keywords", F.array(F.lit("The"), F.lit("ZZZZ"))))


@query("a21_gold_recall", "SELECT count(*) AS gold_total, count(*) FILTER (WHERE page_id % 2 = 0 OR page_id % 3 = 0) AS found, round(count(*) FILTER (WHERE page_id % 2 = 0 OR page_id % 3 = 0) / count(*), 3)::DOUBLE AS recall_at_k FROM pages")
def a21(spark, d):
    uri = F.concat(F.lit("https://x.org/abs/"), "page_id")
    p = table(spark, d, "pages")
    hits = p.where("page_id % 2 = 0").select(uri.alias("source_uri")).unionByName(p.where("page_id % 3 = 0").select(F.concat(F.lit("http://other/"), "page_id", F.lit("/")).alias("source_uri")))
    return A.gold_recall(hits, p.select(uri.alias("source_uri")))


# Calculations: each order is a plan over its lines' prices; the names of two lines may be equal, so the last of them counts.

_CELLS = "SELECT l_orderkey AS plan_id, l_linenumber AS pos, arg_max(l_extendedprice, l_partkey * 10 + l_suppkey) AS v, arg_max(l_returnflag, l_partkey * 10 + l_suppkey) AS unit FROM lineitem GROUP BY ALL"
_CALC = "SELECT plan_id, CASE WHEN {ok} THEN round({value}, 4) END::DOUBLE AS value, {error} AS error FROM (SELECT plan_id, list(v ORDER BY pos) AS v, sum(v) AS s, count(*) AS n, count(DISTINCT unit) AS u FROM ({cells}) GROUP BY plan_id)"


def _cells(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_partkey") * 10 + F.col("l_suppkey")).alias("cell_no"), F.concat(F.lit("line "), "l_linenumber").alias("name"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").cast("string").alias("value"), F.col("l_returnflag").alias("unit"))


def _plans(cells, operation):
    names = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"])
    return cells.groupBy("plan_id").agg(names.alias("input_names")).withColumn("operation", F.lit(operation))


for _op, _value, _checked in (
    ("sum", "s", "unit"), ("difference", "2 * v[1] - s", "unit"), ("product", "", ""), ("ratio", "v[1] / v[2]", "two"), ("percentage_change", "(v[2] - v[1]) / v[1] * 100", "two"),
    ("min", "list_min(v)", "unit"), ("max", "list_max(v)", "unit"), ("average", "s / n", "unit"), ("count", "n::DOUBLE", ""),
):
    _said = {"ratio": "ratio requires two inputs and a non-zero denominator", "percentage_change": "percentage_change requires old and new non-zero values"}.get(_op, "")
    _ok, _error = {"unit": ("u <= 1", "CASE WHEN u > 1 THEN 'Inputs have incompatible units' END"), "two": ("n = 2", f"CASE WHEN n <> 2 THEN '{_said}' END"), "": ("true", "CAST(NULL AS VARCHAR)")}[_checked]
    _number = {"sum": 1, "difference": 2, "product": 3, "ratio": 4, "percentage_change": 5}.get(_op, 6)

    def _run(spark, d, op=_op):
        cells = _cells(spark, d)
        out = A.execute(_plans(cells, op), cells).select("plan_id", "value", "error")
        return out.withColumn("value", F.round("value", 4) if op != "product" else F.round(F.log10("value"), 6))

    _sql = _CALC.format(ok=_ok, value=_value, error=_error, cells=_CELLS)
    if _op == "product":
        _sql = f"SELECT plan_id, round(sum(log10(v)), 6) AS value, CAST(NULL AS VARCHAR) AS error FROM ({_CELLS}) GROUP BY plan_id"
    query(f"c0{_number}_{_op}", _sql)(_run)


@query("c07_date_difference", "SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 <> 0 THEN date_diff('day', o_orderdate::DATE, DATE '2000-01-01') END::DOUBLE AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'Invalid ISO date: soon' END AS error FROM orders")
def c07(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    cell = lambda n, name, value: F.struct(F.lit(n).alias("cell_no"), F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit"))
    cells = o.select("plan_id", F.explode(F.array(cell(0, "from", F.col("day")), cell(1, "to", F.when(F.col("plan_id") % 3 == 0, "soon").otherwise("2000-01-01")))).alias("c")).select("plan_id", "c.*")
    plans = o.select("plan_id", F.lit("date_difference_days").alias("operation"), F.array(F.lit("from"), F.lit("to")).alias("input_names"))
    return A.execute(plans, cells).select("plan_id", "value", "error")


@query("c08_units_and_currencies", """SELECT o_orderkey AS plan_id, CASE o_orderkey % 4 WHEN 0 THEN 'Inputs have incompatible currencies' WHEN 1 THEN 'Calculation input is missing: c' WHEN 2 THEN 'Calculation input is not numeric: b' END AS error,
CASE WHEN o_orderkey % 4 = 3 THEN o_totalprice + 5 END AS value, CASE WHEN o_orderkey % 4 = 3 THEN 'Input has no source anchor: b' END AS warnings FROM orders""")
def c08(spark, d):
    k = F.col("o_orderkey") % 4
    cell = lambda n, name, value, currency, anchors: F.struct(F.lit(n).alias("cell_no"), F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit"), currency.alias("currency"), anchors.cast("array<string>").alias("anchor_ids"))
    o = table(spark, d, "orders")
    both = F.array(cell(0, "a", F.col("o_totalprice").cast("string"), F.lit("USD"), F.array(F.lit("x"))), cell(1, "b", F.when(k == 2, "five").otherwise("5"), F.when(k == 0, "EUR"), F.array()))
    cells = o.select(F.col("o_orderkey").alias("plan_id"), F.explode(both).alias("c")).select("plan_id", "c.*")
    plans = o.select(F.col("o_orderkey").alias("plan_id"), F.lit("sum").alias("operation"), F.when(k == 1, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("input_names"))
    return A.execute(plans, cells).select("plan_id", "error", "value", F.nullif(F.array_join("warnings", ";"), F.lit("")).alias("warnings"))


@query("c11_reproducibility_hash", """SELECT o_orderkey AS plan_id, sha256('{"cells":[{"anchor_ids":["x"],"currency":null,"name":"a","unit":"kg","value":"' || o_custkey || '"}],"input_names":["a"],"operation":"sum"}') AS reproducibility_hash FROM orders""")
def c11(spark, d):
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_orderkey").alias("plan_id"), F.lit(0).alias("cell_no"), F.lit("a").alias("name"), F.col("o_custkey").cast("string").alias("value"), F.lit("kg").alias("unit"), F.lit(None).cast("string").alias("currency"), F.array(F.lit("x")).alias("anchor_ids"))
    return A.execute(cells.select("plan_id", F.lit("sum").alias("operation"), F.array("name").alias("input_names")), cells).select("plan_id", "reproducibility_hash")


# Diffs


def _sides(spark, d):
    """Documents of a source in order, each against the next; lines are the elements. Pairs are made of ids alone, and texts joined to them."""
    docs = table(spark, d, "documents")
    pairs = docs.select("source", "doc_id").withColumn("next", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id"))).where("next is not null").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old"), F.col("next").alias("new"))

    def lines(side):
        own = pairs.select("pair_id", F.col(side).alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id")
        return own.select("pair_id", F.posexplode(F.split("text", "\n")).alias("element_no", "text")).withColumn("section", (F.col("element_no") / 5).cast("int"))

    return lines("old"), lines("new")


_EXACT = """WITH d AS (SELECT * FROM (SELECT source, doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents) WHERE next IS NOT NULL),
o0 AS (SELECT doc_id AS pair_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d), n0 AS (SELECT doc_id AS pair_id, unnest(string_split(next, chr(10))) AS t, generate_subscripts(string_split(next, chr(10)), 1) - 1 AS i FROM d),
o AS (SELECT pair_id, i, i // 5 AS s, h, row_number() OVER (PARTITION BY pair_id, h ORDER BY i) AS k FROM (SELECT *, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS h FROM o0)), n AS (SELECT pair_id, i, i // 5 AS s, h, row_number() OVER (PARTITION BY pair_id, h ORDER BY i) AS k FROM (SELECT *, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS h FROM n0))"""


@query("j17_exact_matches", f"{_EXACT} SELECT pair_id, CAST(o.i AS INTEGER) AS old_no, CAST(n.i AS INTEGER) AS new_no, CASE WHEN o.s = n.s THEN 'unchanged' ELSE 'moved' END AS operation FROM o JOIN n USING (pair_id, h, k)")
def j17(spark, d):
    return A.exact_matches(*_sides(spark, d))


def _turns(spark, d):
    """Sentences of each turn against those of the next turn of its conversation."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "text")
    rows = c.select("pair_id", F.posexplode(T.sentences(F.col("text"))).alias("element_no", "text")).withColumn("section", F.lit("s")).withColumn("kind", F.lit("sentence")).withColumn("anchor", F.concat_ws(":", "pair_id", "element_no"))
    pairs = c.select("pair_id").join(c.select((F.col("pair_id") - 1).alias("pair_id")), "pair_id", "left_semi")
    return rows.join(pairs, "pair_id"), rows.withColumn("pair_id", F.col("pair_id") - 1).join(pairs, "pair_id")


@query("d01_compare")
def d01(spark, d):
    return A.compare(*_turns(spark, d)).withColumn("opcodes", F.to_json("opcodes"))



@query("d06_diff_summary", "SELECT p_partkey AS pair_id, '1 added, 1 removed, 1 modified' AS summary, 1::BIGINT AS unchanged, 1::BIGINT AS moved FROM part")
def d06(spark, d):
    """A pair a part: its name kept, a note moved to another section, its price modified, one line gone and one new."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("the price of it is "), "p_partkey").alias("a"), F.concat(F.lit("The price of it is "), F.col("p_partkey") + 1).alias("b"))
    line = lambda n, t, s, k="p": F.struct(F.lit(n).alias("element_no"), t.alias("text"), F.lit(s).alias("section"), F.lit(k).alias("kind"))
    old = F.array(line(0, F.concat(F.lit("name "), "p_name"), "1"), line(1, F.lit("note of the maker"), "1"), line(2, F.col("a"), "2"), line(3, F.lit("0123456789"), "2", "code"))
    new = F.array(line(0, F.concat(F.lit(" Name  "), "p_name"), "1"), line(1, F.col("b"), "2"), line(2, F.lit("note of the maker"), "3"), line(3, F.lit("zyxwvutsr"), "3", "table"))
    side = lambda x: p.select(F.col("p_partkey").alias("pair_id"), F.explode(x).alias("e")).select("pair_id", "e.*")
    return A.diff_summary(A.compare(side(old), side(new))).select("pair_id", "summary", "unchanged", "moved")


@query("d08_diff_rows", "SELECT p_partkey AS diff_id, 'modified' AS operation, 'o' || p_partkey AS old_anchor, 'n' || p_partkey AS new_anchor, '[{\"tag\":\"replace\",\"old_start\":8,\"old_end\":10,\"new_start\":8,\"new_end\":10}]' AS opcodes FROM part")
def d08(spark, d):
    side = lambda text, name: table(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), F.lit(0).alias("element_no"), F.lit("p").alias("kind"), F.lit(text).alias("text"), F.lit("s").alias("section"), F.concat(F.lit(name), "p_partkey").alias("anchor"))
    head, rows = A.diff_rows(A.compare(side("Term is 12 months.", "o"), side("Term is 34 months.", "n")))
    return rows.join(head.where("element_count = 1").select("diff_id"), "diff_id", "left_semi").select("diff_id", "operation", "old_anchor", "new_anchor", "opcodes")


@query("k12_calculation_runs", """SELECT o_orderkey AS plan_id, '{"operation":"sum","input_names":["a"]}' AS plan_json, '{"value":' || o_custkey || '.0}' AS output_json, '["Input has no source anchor: a"]' AS warnings_json FROM orders WHERE o_orderkey % 5 <> 0""")
def k12(spark, d):
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_orderkey").alias("plan_id"), F.lit(0).alias("cell_no"), F.lit("a").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_custkey").cast("string")).alias("value"), F.lit(None).cast("string").alias("unit"))
    plans = cells.select("plan_id", F.lit("sum").alias("operation"), F.array("name").alias("input_names"))
    return A.calculation_runs(plans, A.execute(plans, cells)).select("plan_id", "plan_json", "output_json", "warnings_json")


@query("j25_case_results", "SELECT o_orderkey AS case_id, o_totalprice AS expected, l.n AS lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def j25(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count(F.lit(1)).alias("lines"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("expected")).join(lines.select("case_id"), "case_id", "left_semi")
    return A.case_results(cases, lines.join(cases.select("case_id"), "case_id", "left_semi"))
