"""Evaluation metrics and thresholds, latency, typed calculations, structured diffs and telemetry."""

from __future__ import annotations

import json
from difflib import SequenceMatcher
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


# Thresholds of evaluation cases and runs, and the similarity at which an element counts as modified.
PRECISION, CITATION, FAITHFUL, RELEVANT, FALSE_SUPPORT, CONTRADICTION = 0.5, 1.0, 0.7, 0.5, 0.02, 0.90
MODIFIED, SAME_SECTION = 0.45, 0.1
OPERATIONS = ["sum", "difference", "product", "ratio", "percentage_change", "min", "max", "average", "count", "date_difference_days"]
SAME_UNIT = ["sum", "difference", "average", "min", "max"]


def ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d == 0, F.lit(default)).otherwise(n / d)


# Evaluation


def relevance(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits: case_id, rank, chunk_id, document_id, source_uri. expected: case_id, kind (chunk, document or source), value. relevant, and units: which expectations a hit meets, sources named as the hit names them."""
    value = F.when(F.col("kind") == "source", T.source_uri(F.col("value"))).otherwise(F.col("value"))
    wanted = expected.select("case_id", "kind", value.alias("value")).distinct()
    keys = F.array(
        F.struct(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("value"), F.col("chunk_id").cast("string").alias("name")), F.struct(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("value"), F.col("document_id").cast("string").alias("name")),
        F.struct(F.lit("source").alias("kind"), T.source_uri(F.col("source_uri")).alias("value"), F.col("source_uri").alias("name")),
    )
    met = hits.select("case_id", "rank", F.explode(keys).alias("k")).select("case_id", "rank", "k.*").join(wanted, ["case_id", "kind", "value"])
    met = met.groupBy("case_id", "rank").agg(F.collect_set(F.concat_ws(":", "kind", "name")).alias("units"))
    return hits.join(met, ["case_id", "rank"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<string>"))).withColumn("relevant", F.size("units") > 0)


def retrieval_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits: case_id, rank, relevant, unit or units. expected: case_id, n_expected (above 0). The rank metrics of each case, one row a case; cases without hits have zeros."""
    rel = F.col("relevant")
    units = F.col("units") if "units" in hits.columns else F.when(rel, F.array(F.col("unit").cast("string"))).otherwise(F.array().cast("array<string>"))
    found = hits.select("case_id", F.explode(units).alias("u")).groupBy("case_id").agg(F.count_distinct("u").alias("found"))
    per = hits.groupBy("case_id").agg(
        F.max(F.when(rel, 1.0).otherwise(0.0)).alias("hit_rate_at_k"), F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr_at_k"), ratio(F.count_if(rel), F.count(F.lit(1))).alias("context_precision"),
        F.coalesce(F.sum(F.when(rel, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"), F.count(F.lit(1)).alias("n"),
    )
    full = expected.where("n_expected > 0").join(per, "case_id", "left").join(found, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    best = F.least("n_expected", F.coalesce("n", F.lit(0)))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return full.select("case_id", zero("hit_rate_at_k").alias("hit_rate_at_k"), zero("mrr_at_k").alias("mrr_at_k"), zero("context_precision").alias("context_precision"), (F.coalesce("found", F.lit(0)) / F.col("n_expected")).alias("context_recall"), ratio(zero("dcg"), ideal).alias("ndcg_at_k"))


def citation_metrics(cases: DataFrame, cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cases: case_id. cited: case_id, chunk_id, document_id, source_uri. retrieved: case_id, chunk_id. Shares of distinct cited chunks that were retrieved, of citations that can be traced, and of those that name a chunk; one where nothing is cited."""
    there = retrieved.select("case_id", "chunk_id").distinct().withColumn("there", F.lit(True))
    full = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    per = cited.join(there, ["case_id", "chunk_id"], "left").groupBy("case_id").agg(
        F.count_distinct("chunk_id").alias("chunks"), F.count_distinct(F.when(F.col("there"), F.col("chunk_id"))).alias("found"), F.count(F.lit(1)).alias("n"),
        F.count_if(full("chunk_id") & full("document_id") & full("source_uri")).alias("traced"), F.count_if(full("chunk_id")).alias("named"),
    )
    out = cases.select("case_id").join(per, "case_id", "left").fillna(0)
    return out.select("case_id", ratio(F.col("found"), F.col("chunks"), 1.0).alias("citation_retrieval_precision"), ratio(F.col("traced"), F.col("n"), 1.0).alias("citation_traceability_rate"), ratio(F.col("named"), F.col("n"), 1.0).alias("citation_anchor_validity"))


def claim_metrics(cases: DataFrame, verified: DataFrame) -> DataFrame:
    """cases: case_id, and where given expected_verdicts, requires_abstention, requires_review, status, expected_anchors, anchors. verified: case_id, verdict, reason. What claims show of each case; a metric that a case does not ask for is null."""
    v = F.col("verdict")
    per = verified.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v != "unsupported").alias("passed"), F.count_if(v == "contradicted").alias("against"), F.collect_set("verdict").alias("seen"),
        F.count_if(~v.isin("insufficient", "uncertain")).alias("sure"), F.count_if((v == "supported") & (F.coalesce("reason", F.lit("")) != "")).alias("false"),
    )
    counts = ["n", "passed", "against", "sure", "false"]
    out = cases.join(per, "case_id", "left").fillna(0, counts).withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    columns = ["case_id", ratio(F.col("passed"), F.col("n"), 1.0).alias("verification_pass_rate"), ratio(F.col("n") - F.col("passed"), F.col("n")).alias("unsupported_claim_ratio"), ratio(F.col("false"), F.col("sure")).alias("false_supported_rate")]
    if "expected_verdicts" in cases.columns:
        e = F.coalesce("expected_verdicts", F.array().cast("array<string>"))
        against = F.size(F.filter(e, lambda x: x == "contradicted"))
        columns += [F.when(F.size(e) > 0, F.size(F.filter(e, lambda x: F.array_contains("seen", x))) / F.size(e)).alias("claim_verdict_recall"), F.when(F.size(e) > 0, ratio(F.least(F.col("against"), against), against, 1.0)).otherwise(0.0).alias("contradiction_recall")]
    if "requires_abstention" in cases.columns:
        columns.append(F.when(F.col("requires_abstention"), F.col("status").isin("insufficient_evidence", "needs_review").cast("double")).alias("abstention_compliance"))
    if "requires_review" in cases.columns:
        columns.append(F.when(F.col("requires_review"), (F.col("status") == "needs_review").cast("double")).alias("review_requirement_compliance"))
    if "expected_anchors" in cases.columns:
        columns.append(F.when(F.size("expected_anchors") > 0, F.size(F.array_intersect("expected_anchors", "anchors")) / F.size("expected_anchors")).alias("expected_anchor_recall"))
    return out.select(*columns)


def overlap_f1(answers: DataFrame) -> DataFrame:
    """answers: case_id, answer, reference. F1 of the token multisets."""
    def count(c):
        return answers.select("case_id", F.explode(T.tokens(F.col(c))).alias("token")).groupBy("case_id", "token").agg(F.count(F.lit(1)).alias(c[0]))

    common = count("answer").join(count("reference"), ["case_id", "token"]).groupBy("case_id").agg(F.sum(F.least("a", "r")).alias("both"))
    sizes = answers.select("case_id", F.size(T.tokens(F.col("answer"))).alias("na"), F.size(T.tokens(F.col("reference"))).alias("nr"))
    both = F.coalesce("both", F.lit(0))
    return sizes.join(common, "case_id", "left").select("case_id", ratio(2.0 * both, F.col("na") + F.col("nr")).alias("f1"))


def long_metrics(wide: DataFrame, key: str) -> DataFrame:
    """key, metric, value of the metrics that are there."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "metric", "value").where("value is not null")


def summary(metrics: DataFrame) -> DataFrame:
    """metric, value: the mean over the cases that have the metric."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


#: metric, whether it must not be above (else not below), and the bound; those that cases ask for are only there if they do.
CASE_RULES = [
    ("context_precision", False, PRECISION), ("citation_retrieval_precision", False, CITATION), ("verification_pass_rate", False, FAITHFUL), ("reference_overlap_f1", False, RELEVANT), ("trait_coverage", False, RELEVANT),
    ("claim_verdict_recall", False, 1.0), ("abstention_compliance", False, 1.0), ("review_requirement_compliance", False, 1.0), ("expected_anchor_recall", False, 1.0), ("citation_anchor_validity", False, 1.0),
    ("false_supported_rate", True, FALSE_SUPPORT),
]
RUN_RULES = [("citation_retrieval_precision", False, CITATION), ("verification_pass_rate", False, FAITHFUL), ("context_precision", False, PRECISION), ("citation_anchor_validity", False, 1.0), ("false_supported_rate", True, FALSE_SUPPORT)]


def _broken(metrics: DataFrame, rules: list[tuple[str, bool, float]]) -> DataFrame:
    low = F.create_map(*[F.lit(x) for name, above, bound in rules if not above for x in (name, bound)])
    high = F.create_map(*[F.lit(x) for name, above, bound in rules if above for x in (name, bound)])
    return metrics.where((F.col("value") < F.try_element_at(low, F.col("metric"))) | (F.col("value") > F.try_element_at(high, F.col("metric"))))


def failures(metrics: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """metrics: case_id, metric, value. cases: case_id, expected_verdicts. case_id, failure, value of the rules of a case that are broken; where a contradiction is expected its recall is one."""
    out = _broken(metrics, CASE_RULES).select("case_id", F.col("metric").alias("failure"), "value")
    if cases is None:
        return out
    asks = cases.where(F.array_contains("expected_verdicts", "contradicted")).select("case_id")
    missed = metrics.where((F.col("metric") == "contradiction_recall") & (F.col("value") < CONTRADICTION)).join(asks, "case_id", "left_semi")
    return out.unionByName(missed.select("case_id", F.lit("critical_contradiction_recall").alias("failure"), "value"))


def run_failures(case_failures: DataFrame, metrics: DataFrame, mode: str = "ci") -> DataFrame:
    """failure: those of the cases and of the summary over them; a run that only reports has none."""
    if mode != "ci":
        return case_failures.select(F.lit("").alias("failure")).limit(0)
    per_case = case_failures.select(F.concat(F.lit("case:"), F.col("case_id").cast("string"), F.lit(":"), "failure").alias("failure"))
    return per_case.unionByName(_broken(summary(metrics), RUN_RULES).select(F.concat(F.lit("summary:"), "metric").alias("failure")))


def probes(hits: DataFrame, wanted: DataFrame, since: int = 2022) -> DataFrame:
    """hits: probe, text, published_at. wanted: probe, keywords. Share of the keywords in the joined texts and share of hits published since the year, to three decimals; zeros without hits."""
    near = hits.join(wanted, "probe").select("probe", F.explode(F.filter("keywords", lambda k: F.lower("text").contains(F.lower(k)))).alias("k")).groupBy("probe").agg(F.count_distinct("k").alias("found"))
    recent = hits.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.year("published_at") >= since).alias("recent"))
    out = wanted.join(near, "probe", "left").join(recent, "probe", "left").fillna(0, ["found", "n", "recent"])
    return out.select("probe", "n", F.round(ratio(F.col("found"), F.size(F.array_distinct("keywords"))), 3).alias("keyword_hit_rate"), F.round(ratio(F.col("recent"), F.col("n")), 3).alias("temporal_compliance"))


def gold_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits and gold: source_uri. Share of the gold sources that were found, by address or by the last part of it, to three decimals."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    have = hits.select(F.explode(F.array("source_uri", last("source_uri"))).alias("k")).distinct()
    found = gold.select("source_uri", F.explode(F.array_distinct(F.array("source_uri", last("source_uri")))).alias("k")).join(have, "k", "left_semi").select("source_uri").distinct().withColumn("hit", F.lit(1))
    return gold.distinct().join(found, "source_uri", "left").agg(F.count(F.lit(1)).alias("gold_total"), F.count("hit").alias("found")).select("gold_total", "found", F.round(ratio(F.col("found"), F.col("gold_total")), 3).alias("recall_at_k"))


# Latency


def percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """by and p50, p95 and so on: exact percentiles with linear interpolation. Approximate ones, whose error in rank is bounded, tell a narrow band of values around each; the rows below it are counted and those in it ranked, so no task gathers
    or sorts all values of a key."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    wide = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in points for d in (-wide, wide)]
    bands = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"))
    bands = bands.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high")) for i, p in enumerate(points)])).alias("b")).select(*by, "n", "b.*")
    met = rows.join(bands, by)
    under, over = F.col("v") < F.col("low"), F.col("v") > F.col("high")
    below = met.groupBy(*by, "p").agg(F.count_if(under).alias("below"), F.max(F.when(under, F.col("v"))).alias("before"), F.min(F.when(over, F.col("v"))).alias("after"))  # a band may miss its place by one
    inside = met.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy(*by, "p", "n", "v").agg(F.count(F.lit(1)).alias("times"))
    w = W.partitionBy(*by, "p").orderBy("v")
    ranked = inside.join(below, [*by, "p"]).withColumn("upto", F.col("below") + F.sum("times").over(w))
    place = F.col("p") * (F.col("n") - 1)
    at = lambda r: F.when(r < F.min("below"), F.max("before")).otherwise(F.coalesce(F.min(F.when(F.col("upto") > r, F.col("v"))), F.min("after")))
    found = ranked.groupBy(*by, "p", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    share = place - F.floor(place)
    out = found.select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("x"))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("x"))).alias(f"p{round(p * 100):d}") for p in points])


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("low"), F.round(F.max(value), 4).alias("high"))
    return own.join(percentiles(rows, by, value), by).select(*by, "n", "mean", "low", "high", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


# Calculations


@F.pandas_udf(StringType())
def canonical_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of JSON text written anew with sorted keys and no blanks."""
    return payload.map(lambda x: None if x is None else sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def selected_cells(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """plans: plan_id, input_names. cells: plan_id, cell_no, name, value, unit, and where given currency and anchor_ids. The cell of each input, in order; of several cells of a name the last; null where there is none."""
    known = [c for c in ("value", "unit", "currency", "anchor_ids") if c in cells.columns]
    last = cells.select("plan_id", "cell_no", "name", *known).withColumn("k", F.row_number().over(W.partitionBy("plan_id", "name").orderBy(F.desc("cell_no")))).where("k = 1").drop("k", "cell_no")
    return plans.select("plan_id", F.posexplode("input_names").alias("pos", "name")).join(last.withColumn("there", F.lit(True)), ["plan_id", "name"], "left")


def execute(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """plans: plan_id, operation, input_names, and where given output_unit. Value, error, warnings and a reproducibility hash of every plan; a bad plan does not fail the rest."""
    for name, kind in (("currency", "string"), ("anchor_ids", "array<string>")):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast(kind))
    own = selected_cells(plans, cells).withColumn("v", F.expr("try_cast(value as double)")).withColumn("d", F.to_date(F.expr("try_cast(value as timestamp_ntz)")))
    dated = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    own = own.withColumn("d", F.when(dated, F.col("d")))
    g = own.groupBy("plan_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "value", "unit", "currency", "anchor_ids", "v", "d", F.col("there").isNotNull().alias("there")))).alias("c"), F.count_distinct("unit").alias("units"), F.count_distinct("currency").alias("currencies"),
    )
    g = plans.join(g, "plan_id").withColumn("vs", F.transform("c", lambda x: x["v"])).withColumn("n", F.size("c"))
    op, a, b = F.col("operation"), F.get("vs", F.lit(0)), F.get("vs", F.lit(1))
    total = F.aggregate("vs", F.lit(0.0), lambda s, x: s + x)
    day = lambda i: F.get("c", F.lit(i))["d"]
    value = (
        F.when(op == "sum", total).when(op == "difference", 2 * a - total).when(op == "product", F.aggregate("vs", F.lit(1.0), lambda s, x: s * x)).when(op == "ratio", F.try_divide(a, b)).when(op == "percentage_change", F.try_divide(b - a, a) * 100)
        .when(op == "min", F.array_min("vs")).when(op == "max", F.array_max("vs")).when(op == "average", total / F.col("n")).when(op == "count", F.col("n").cast("double")).when(op == "date_difference_days", F.datediff(day(1), day(0)).cast("double"))
    )
    dates = op == "date_difference_days"
    first = lambda bad: F.get(F.filter("c", bad), F.lit(0))["name"]
    missing, wrong, undated = first(lambda x: ~x["there"]), first(lambda x: x["v"].isNull()), F.get(F.filter("c", lambda x: x["d"].isNull()), F.lit(0))["value"]
    error = (
        F.when(~op.isin(OPERATIONS), F.concat(F.lit("Unknown operation: "), op)).when(missing.isNotNull(), F.concat(F.lit("Calculation input is missing: "), missing))
        .when(op.isin(SAME_UNIT) & (F.col("units") > 1), "Inputs have incompatible units").when(op.isin(SAME_UNIT) & (F.col("currencies") > 1), "Inputs have incompatible currencies")
        .when(~dates & wrong.isNotNull(), F.concat(F.lit("Calculation input is not numeric: "), wrong)).when((op == "ratio") & ((F.col("n") != 2) | (b == 0)), "ratio requires two inputs and a non-zero denominator")
        .when((op == "percentage_change") & ((F.col("n") != 2) | (a == 0)), "percentage_change requires old and new non-zero values").when(dates & (F.col("n") != 2), "date_difference_days requires two inputs")
        .when(dates & undated.isNotNull(), F.concat(F.lit("Invalid ISO date: "), undated))
    )
    warnings = F.transform(F.filter("c", lambda x: F.coalesce(F.size(x["anchor_ids"]), F.lit(0)) <= 0), lambda x: F.concat(F.lit("Input has no source anchor: "), x["name"]))
    payload = F.to_json(F.struct(op.alias("operation"), F.col("input_names"), F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["unit"].alias("unit"), x["currency"].alias("currency"), x["anchor_ids"].alias("anchor_ids"))).alias("cells")), {"ignoreNullFields": "false"})
    out = g.withColumn("error", error).withColumn("value", value).withColumn("payload", payload)
    return out.select("plan_id", "operation", F.when(F.col("error").isNull(), F.col("value")).alias("value"), "error", F.when(F.col("error").isNull(), warnings).alias("warnings"), F.when(F.col("error").isNull(), canonical_hash("payload")).alias("reproducibility_hash"))


def calculate(inputs: DataFrame, operation: str) -> DataFrame:
    """inputs: plan_id, pos, value, unit. The operation over each plan's inputs in order."""
    cells = inputs.withColumn("name", F.concat(F.lit("c"), F.col("pos").cast("string"))).withColumnRenamed("pos", "cell_no")
    plans = cells.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "name"))), lambda x: x["name"]).alias("input_names")).withColumn("operation", F.lit(operation))
    return execute(plans, cells).select("plan_id", "value", "error")


# Diffs


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: pair_id, element_no, kind, text, section, and where given anchor. Every element's operation: in order of the old elements each takes the first free equal one (unchanged, or moved if its section differs), else the free one of its
    kind that is most like it, if it is like enough (modified, with the changes of characters); the rest are removed or added. Earlier choices bind later ones, so a pair of versions is one group; upper bounds of the similarity pass over most candidates."""
    def likeness(m: SequenceMatcher, a: str, least: float) -> float | None:
        """m holds the new text, which it has indexed once for all old ones."""
        m.set_seq1(a)
        return m.ratio() if m.real_quick_ratio() > least and m.quick_ratio() > least else None

    def match(pair, olds: list[dict], news: list[dict]) -> list[tuple]:
        by_hash: dict[str, list[int]] = {}
        for i, x in enumerate(news):
            x["matcher"], x["free"] = None, True
            by_hash.setdefault(" ".join(x["text"].split()).lower(), []).append(i)
        out = []
        for x in olds:
            same = next((news[i] for i in by_hash.get(" ".join(x["text"].split()).lower(), []) if news[i]["free"]), None)
            if same is not None:
                same["free"] = False
                out.append((pair, x["element_no"], same["element_no"], "unchanged" if x["section"] == same["section"] else "moved", None, None, x["anchor"], same["anchor"]))
                continue
            best, top, own = None, None, x["text"].lower()
            for y in news:
                if y["free"] and y["kind"] == x["kind"]:
                    bonus = SAME_SECTION if y["section"] == x["section"] else 0.0
                    y["matcher"] = y["matcher"] or SequenceMatcher(None, "", y["text"].lower())
                    s = likeness(y["matcher"], own, -1.0 if top is None else top - bonus)
                    if s is not None and (top is None or s + bonus > top):
                        best, top, plain = y, s + bonus, s
            if best is not None and plain >= MODIFIED:
                best["free"] = False
                codes = [{"tag": t, "old_start": i, "old_end": j, "new_start": m, "new_end": n} for t, i, j, m, n in SequenceMatcher(None, x["text"], best["text"]).get_opcodes() if t != "equal"]
                out.append((pair, x["element_no"], best["element_no"], "modified", plain, codes, x["anchor"], best["anchor"]))
            else:
                out.append((pair, x["element_no"], None, "removed", None, None, x["anchor"], None))
        return out + [(pair, None, y["element_no"], "added", None, None, None, y["anchor"]) for y in news if y["free"]]

    names = ["pair_id", "old_no", "new_no", "operation", "similarity", "opcodes", "old_anchor", "new_anchor"]
    codes = pa.list_(pa.struct([("tag", pa.string()), *((c, pa.int32()) for c in ("old_start", "old_end", "new_start", "new_end"))]))

    def run(batches):
        for batch in batches:
            pairs, olds, news = (batch.column(c).to_pylist() for c in ("pair_id", "old", "new"))
            rows = [r for pair, a, b in zip(pairs, olds, news) for r in match(pair, a or [], b or [])]
            if rows:
                kinds = [batch.schema.field("pair_id").type, pa.int32(), pa.int32(), pa.string(), pa.float64(), codes, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def side(x: DataFrame, name: str) -> DataFrame:
        x = x if "anchor" in x.columns else x.withColumn("anchor", F.lit(None).cast("string"))
        element = F.struct(F.col("element_no").cast("int").alias("element_no"), F.col("kind").cast("string").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("section").cast("string").alias("section"), "anchor")
        return x.groupBy("pair_id").agg(F.array_sort(F.collect_list(element)).alias(name))

    kind = old.schema["pair_id"].dataType.simpleString()
    schema = f"pair_id {kind}, old_no int, new_no int, operation string, similarity double, opcodes array<struct<tag:string,old_start:int,old_end:int,new_start:int,new_end:int>>, old_anchor string, new_anchor string"
    a, b = side(old, "old"), side(new, "new").withColumnRenamed("pair_id", "new_pair")
    both = a.join(b, F.col("pair_id").eqNullSafe(F.col("new_pair")), "full_outer")
    return both.select(F.coalesce("pair_id", "new_pair").alias("pair_id"), "old", "new").mapInArrow(run, schema)


def exact_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: pair_id, element_no, text, section. Equal elements paired one to one in order, without the search for modified ones: a join by hash and number."""
    def side(df, name):
        h = df.select("pair_id", F.col("element_no").alias(f"{name}_no"), F.col("section").alias(f"{name}_section"), T.text_hash(F.col("text"), fold=True).alias("h"))
        return h.withColumn("k", F.row_number().over(W.partitionBy("pair_id", "h").orderBy(f"{name}_no")))

    both = side(old, "old").join(side(new, "new"), ["pair_id", "h", "k"])
    return both.select("pair_id", "old_no", "new_no", F.when(F.col("old_section").eqNullSafe(F.col("new_section")), "unchanged").otherwise("moved").alias("operation"))


def diff_summary(ops: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("operation") == x)
    said = F.format_string("%d added, %d removed, %d modified", n("added"), n("removed"), n("modified"))
    return ops.groupBy("pair_id").agg(n("added").alias("added"), n("removed").alias("removed"), n("modified").alias("modified"), n("unchanged").alias("unchanged"), n("moved").alias("moved"), said.alias("summary"))


def diff_rows(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header and the element rows of each pair, to be appended to the tables of diffs."""
    head = diff_summary(ops).select(F.col("pair_id").alias("diff_id"), "summary", (F.col("added") + F.col("removed") + F.col("modified") + F.col("unchanged") + F.col("moved")).alias("element_count"), F.lit("v1").alias("matcher_version"))
    element = F.concat_ws(":", F.col("pair_id").cast("string"), F.coalesce(F.col("old_no").cast("string"), F.lit("")), F.coalesce(F.col("new_no").cast("string"), F.lit("")))
    return head, ops.select(element.alias("element_diff_id"), F.col("pair_id").alias("diff_id"), "operation", "old_no", "new_no", F.to_json("opcodes").alias("opcodes"), "old_anchor", "new_anchor")


# Telemetry


def ring(events: DataFrame, by: list[str], order: list[str], value: str, size: int = 1000) -> DataFrame:
    """All events of a key are counted; mean, maximum and latest are of the last so many, nulls passed over."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    last = events.select(*by, *order, value).withColumn("k", k).where(F.col("k") <= size)
    own = last.groupBy(*by).agg(F.count(F.lit(1)).alias("sampled"), F.avg(value).alias("mean"), F.max(value).alias("high"), F.max_by(value, F.struct(*order)).alias("latest"))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).join(own, by)


def trailing_count(events: DataFrame, by: list[str], seconds: int = 60, limit: int = 30) -> DataFrame:
    """Requests of the trailing window a client, and whether they are within the limit."""
    w = W.partitionBy(*by).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_window") <= limit)




def calculation_runs(plans: DataFrame, done: DataFrame) -> DataFrame:
    """plans and done: as execute takes and gives them. A row a calculation that succeeded, to be appended to its table: plan, output and warnings as JSON, engine and hash."""
    rows = plans.join(done.where("error is null").select("plan_id", "value", "warnings", "reproducibility_hash"), "plan_id")
    return rows.select("plan_id", F.to_json(F.struct("operation", "input_names")).alias("plan_json"), F.to_json(F.struct("value")).alias("output_json"), F.to_json("warnings").alias("warnings_json"), F.lit("typed-arithmetic").alias("engine_name"), F.lit("v1").alias("engine_version"), "reproducibility_hash")


def case_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases and their results by case_id; a case without a result, or a result without a case, is an error."""
    both = cases.withColumn("case__", F.lit(True)).join(results.withColumn("result__", F.lit(True)), "case_id", "full_outer")
    fine = F.when(F.col("case__") & F.col("result__"), F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("case and result do not match: "), F.col("case_id").cast("string"))))
    return both.withColumn("case_id", fine.cast(cases.schema["case_id"].dataType)).drop("case__", "result__")
