"""Evidence: query plans, answers and citations, claims, evidence selection, deterministic checks, verdicts, ledgers and memory.

Frames hold many answers at once, by answer_id; what the reference does claim by claim is a join or a window here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Phrases that are answered without a search, and the limits of contexts, spans and evidence.
GREETINGS = ["hi", "hi there", "hello", "hello there", "hey", "hey there", "good morning", "good afternoon", "good evening", "greetings"]
THANKS = ["thanks", "thank you", "thank you very much", "thx"]
HELP = ["who are you", "what can you do", "help"]
FRESH = ["latest", "recent", "today", "current"]
ONLINE = ["web", "internet", "online"]
CONSTRAINTS = ["only", "must", "without", "latest", "cite", "citation"]
CONTEXT_CHARS, SPAN_CHARS, CITATIONS, CANDIDATES = 320, 180, 3, 8
NOT_HELD = ["unsupported", "contradicted", "insufficient"]
HELD = ["supported", "partially_supported"]


def share(part: Column, whole: Column) -> Column:
    """Share of whole's distinct members that part has; 0 for an empty whole or no part."""
    return F.when((F.size(whole) > 0) & part.isNotNull(), F.size(F.array_intersect(whole, part)) / F.size(whole)).otherwise(0.0)


def token_set(text: Column) -> Column:
    return F.array_distinct(T.tokens(text))


# Queries


def conversational(query: Column) -> Column:
    """greeting, thanks or help for queries that are nothing else, in any case and with any punctuation around; null for the rest."""
    low = F.regexp_replace(F.lower(T.collapse(query)), "^[.!?,;: ]+|[.!?,;: ]+$", "")
    return F.when(low.isin(GREETINGS), "greeting").when(low.isin(THANKS), "thanks").when(low.isin(HELP), "help")


def query_reasons(query: Column, fresh: Column | None = None, code: Column | None = None) -> Column:
    """Reason codes of a query by words that may stand within words, a flag for freshness, and attached code."""
    fresh = F.coalesce(fresh, F.lit(False)) if fresh is not None else F.lit(False)
    code = F.coalesce(code, F.lit("")) if code is not None else F.lit("")
    found = F.array(
        F.when(fresh | T.mentions(query, FRESH), F.lit("freshness_required")), F.when(T.mentions(query, ONLINE), F.lit("user_requested_web")), F.when(code != "", F.lit("computation_requested")),
    )
    return F.when(conversational(query).isNotNull(), F.array(F.lit("conversational"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def plan(requests: DataFrame, web: bool = False, python: bool = False) -> DataFrame:
    """requests: qid, query, and where given freshness_required, allow_web, allow_python, code. Adds reasons and what the plan uses; web and python are the defaults
    of requests that do not say."""
    has = lambda name, kind: F.col(name) if name in requests.columns else F.lit(None).cast(kind)
    reasons = query_reasons(F.col("query"), has("freshness_required", "boolean"), has("code", "string"))
    out = requests.withColumn("reasons", reasons)
    asks = F.array_contains("reasons", "freshness_required") | F.array_contains("reasons", "user_requested_web")
    return out.select(
        "*", (~F.array_contains("reasons", "conversational")).alias("retrieval_required"), (F.coalesce(has("allow_web", "boolean"), F.lit(web)) & asks).alias("use_web"),
        (F.coalesce(has("allow_python", "boolean"), F.lit(python)) & F.array_contains("reasons", "computation_requested")).alias("use_python"),
    )


def insufficient(queries: DataFrame, contexts: DataFrame, least: float = 0.2) -> DataFrame:
    """qid and whether the query has no context, or none that scores at least so much."""
    best = contexts.groupBy("qid").agg(F.max("score").alias("best"))
    return queries.select("qid").join(best, "qid", "left").select("qid", (F.col("best").isNull() | (F.col("best") < least)).alias("insufficient"))


# Answers


def packed(text: Column, space: str = T.SPACE) -> Column:
    """What of a result goes into a context."""
    return T.truncate(T.stripped(text, space), CONTEXT_CHARS, space)


def support_span(text: Column, space: str = T.SPACE) -> Column:
    return T.truncate(F.replace(T.stripped(text, space), F.lit("\n"), F.lit(" ")), SPAN_CHARS, space)


def contexts(hits: DataFrame) -> DataFrame:
    """hits: qid, rank, text and whatever else: the same with the text packed."""
    return hits.withColumn("text", packed(F.col("text")))


def analysis_contexts(runs: DataFrame) -> DataFrame:
    """runs: qid, stdout, result. The output of attached code as a context of score one; runs without output give none."""
    out = F.coalesce(F.nullif(F.col("stdout"), F.lit("")), F.nullif(F.col("result"), F.lit("")))
    name = F.concat(F.lit("analysis:"), F.col("qid").cast("string"))
    return runs.withColumn("text", out).where("text is not null").select("qid", name.alias("chunk_id"), name.alias("document_id"), F.lit("Python analysis output").alias("title"), "text", F.lit(1.0).alias("score"), F.lit("analysis").alias("source_type"))


def citations(contexts: DataFrame, most: int = CITATIONS, space: str = T.SPACE) -> DataFrame:
    """contexts: qid, rank, chunk_id, text and whatever else. citation_id (C1 and so on) and support_span of the first contexts."""
    return contexts.where(F.col("rank") <= most).withColumn("citation_id", F.concat(F.lit("C"), F.col("rank").cast("string"))).withColumn("support_span", support_span(F.col("text"), space))


def extractive_answer(contexts: DataFrame, queries: DataFrame | None = None, most: int = CITATIONS) -> DataFrame:
    """contexts: qid, rank, chunk_id, text. qid, answer, evidence (spans of the first contexts), chunk_ids, limitations. queries (qid, query) that have no context are
    answered by saying so."""
    own = contexts.withColumn("text", packed(F.col("text"))).withColumn("span", support_span(F.col("text")))
    own = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "chunk_id", "span", "text")))).alias("c"))
    first = F.regexp_replace(T.strip(F.get(F.col("c.text"), F.lit(0))), r"\.+$", "")
    out = own.select(
        "qid", F.concat(F.lit("Based on the retrieved sources, "), first, F.lit(".")).alias("answer"), F.col("c.span").alias("evidence"), F.col("c.chunk_id").alias("chunk_ids"),
        F.when(F.col("n") == 1, "The answer is grounded in a single retrieved context.").alias("limitations"),
    )
    if queries is None:
        return out
    empty = F.array().cast("array<string>")
    full = queries.select("qid", "query").join(out, "qid", "left")
    return full.select(
        "qid", F.coalesce("answer", F.concat(F.lit("I do not have enough grounded context to answer: "), "query", F.lit("."))).alias("answer"), F.coalesce("evidence", empty).alias("evidence"),
        F.coalesce("chunk_ids", F.array().cast(out.schema["chunk_ids"].dataType)).alias("chunk_ids"), F.when(F.col("answer").isNull(), "No retrieved context satisfied the query.").otherwise(F.col("limitations")).alias("limitations"),
    )


def prompt(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """requests: qid, query, trace_id, summary. contexts: qid, rank, chunk_id, title, source_uri, text. The prompt of each request, for a generator that is plugged in."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] chunk_id="), F.col("chunk_id").cast("string"), F.lit(" title='"), F.col("title"), F.lit("' source_uri='"), F.col("source_uri"), F.lit("' text='"), F.col("text"), F.lit("'"))
    lines = contexts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    body = F.concat_ws("\n", F.concat(F.lit("Trace ID: "), "trace_id"), F.concat(F.lit("User query: "), "query"), F.concat(F.lit("Compressed memory: "), F.coalesce(F.nullif("summary", F.lit("")), F.lit("None"))), F.lit("Contexts:"), F.coalesce("lines", F.lit("None")))
    return requests.join(lines, "qid", "left").select("qid", body.alias("prompt"))


def generate(prompts: DataFrame, provider) -> DataFrame:
    """prompts: qid, prompt. qid, output: what provider(prompt) says, or nothing where it fails, so that the fallback answers. The place of a language model."""
    import pandas as pd

    def say(prompt: str) -> str | None:
        try:
            return provider(prompt)
        except Exception:  # a generator that is down must not fail the batch
            return None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"qid": frame["qid"], "output": [say(p) for p in frame["prompt"]]})

    return prompts.select("qid", "prompt").mapInPandas(run, f"qid {prompts.schema['qid'].dataType.simpleString()}, output string")


def parsed_answer(raw: Column, fallback: Column) -> Column:
    """The direct answer of a generator's JSON output; the fallback where there is none or the output is no JSON."""
    return F.coalesce(F.nullif(F.get_json_object(raw, "$.direct_answer"), F.lit("")), fallback)


def final_status(overall: Column, status: Column) -> Column:
    return F.when(overall == "supported", "supported").when(status == "draft", "qualified").otherwise(status)


# Claims and evidence


def claims(answers: DataFrame, cited: DataFrame | None = None, space: str = T.SPACE) -> DataFrame:
    """answers: answer_id, text. cited: answer_id, rank, citation_id, chunk_id, support_span. A claim a sentence: claim_no from 1, claim_id, type, importance, and the
    citation whose span has the most tokens in common with it (the first of equals; a missing span has none)."""
    rows = answers.select("answer_id", F.posexplode(T.sentences(F.col("text"), space)).alias("n", "claim"))
    out = rows.select(
        "answer_id", (F.col("n") + 1).alias("claim_no"), F.concat(F.lit("claim-"), (F.col("n") + 1).cast("string")).alias("claim_id"), "claim", T.claim_type(F.col("claim")).alias("claim_type"),
        F.when(T.material(F.col("claim")), "material").otherwise("supporting").alias("importance"),
    )
    if cited is None:
        return out
    spans = cited.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id", "chunk_id", token_set(F.col("support_span")).alias("t")))).alias("spans"))
    own = token_set(F.col("claim"))
    scored = F.transform("spans", lambda s: F.struct((-F.coalesce(F.size(F.array_intersect(own, s["t"])), F.lit(0))).alias("less"), s["rank"].alias("rank"), s["citation_id"].alias("citation_id"), s["chunk_id"].alias("chunk_id")))
    return out.join(spans, "answer_id", "left").withColumn("near", F.array_min(scored)).select(*out.columns, F.col("near.citation_id").alias("citation_id"), F.col("near.chunk_id").alias("cited"))


def select_evidence(claimed: DataFrame, contexts: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """claimed: answer_id, claim_no, claim, cited (context_id or null). contexts: answer_id, context_id, rank, text, score. The k best contexts of each claim by coverage of
    its tokens, citation and retrieval score, above zero, equals in order of rank. Each side is tokenised once, before they meet."""
    left = claimed.withColumn("claim_tokens", token_set(F.col("claim")))
    right = contexts.select("answer_id", "context_id", F.col("rank").alias("context_rank"), "text", "score", token_set(F.col("text")).alias("context_tokens"))
    weight = share(F.col("context_tokens"), F.col("claim_tokens")) + F.when(F.col("cited") == F.col("context_id"), 0.5).otherwise(0.0) + 0.1 * F.greatest(F.lit(0.0), F.col("score"))
    w = W.partitionBy("answer_id", "claim_no").orderBy(F.round("weight", 9).desc(), "context_rank")
    pairs = left.join(right, "answer_id").withColumn("weight", weight).where("weight > 0").drop("claim_tokens", "context_tokens")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def checks(claim: Column, evidence: Column, anchors: Column | None = None) -> Column:
    """The checks of a claim against its evidence, null where none was selected: name, passed, severity."""
    check = lambda name, passed, severity: F.struct(F.lit(name).alias("name"), passed.alias("passed"), severity.alias("severity"))
    numeric = F.size(F.array_except(T.numbers(claim), T.numbers(evidence))) == 0
    negation = T.negated(claim) == T.negated(evidence)
    level = lambda ok: F.when(ok, "info").otherwise("critical")
    yes, no = F.lit(True), F.lit(False)
    full = F.array(
        check("evidence_present", yes, F.lit("info")), check("numeric_consistency", numeric, level(numeric)), check("negation_consistency", negation, level(negation)),
        check("source_anchor_present", anchors if anchors is not None else no, F.lit("warning")),
    )
    return F.when(evidence.isNull(), F.array(check("evidence_present", no, F.lit("critical")))).otherwise(full)


def verdicts(selected: DataFrame, claimed: DataFrame) -> DataFrame:
    """One decision a claim, from its best candidate alone: verdict, confidence, reason and checks. A failed critical check is never outweighed."""
    best = selected.where("rank = 1").select("answer_id", "claim_no", "context_id", F.col("text").alias("evidence"), "weight", (F.size("anchors") > 0 if "anchors" in selected.columns else F.lit(False)).alias("anchored"))
    out = claimed.join(best, ["answer_id", "claim_no"], "left").withColumn("checks", checks(F.col("claim"), F.col("evidence"), F.col("anchored")))
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"] & (c["severity"] == "critical")), lambda c: c["name"])
    against = F.array_contains(failed, "numeric_consistency") | F.array_contains(failed, "negation_consistency")
    held = F.col("weight") >= 0.65
    verdict = F.when(against, "contradicted").when(F.size(failed) > 0, "insufficient").when(held, "supported").otherwise("partially_supported")
    confidence = F.when(against, 0.92).when(F.size(failed) > 0, 0.1).when(held, F.least(F.lit(0.98), "weight")).otherwise(F.least(F.lit(0.75), "weight"))
    reason = F.when(F.size(failed) > 0, F.array_join(failed, "; ")).when(~held, "Evidence overlaps the claim but does not fully cover it.")
    return out.select("answer_id", "claim_no", "claim_type", verdict.alias("verdict"), confidence.alias("confidence"), reason.alias("reason"), "checks", "context_id")


# Citations


def best_claims(answers: DataFrame, cited: DataFrame, space: str = T.SPACE) -> DataFrame:
    """answers: answer_id, text. cited: answer_id, citation_no, span, context and whatever else. claim: the sentence whose tokens the context covers best, the
    first of equals; the span itself where the citation has no context or the answer no sentence."""
    sentences = answers.select("answer_id", T.sentences(F.col("text"), space).alias("sentences"))
    sentences = sentences.withColumn("sentences", F.transform("sentences", lambda s, i: F.struct(i.alias("i"), s.alias("s"), token_set(s).alias("t"))))
    context = token_set(F.col("context"))
    scored = F.transform("sentences", lambda s: F.struct((-share(context, s["t"])).alias("less"), s["i"].alias("i"), s["s"].alias("s")))
    best = F.when(F.col("context").isNotNull(), F.array_min(scored)["s"])
    return cited.join(sentences, "answer_id", "left").withColumn("claim", F.coalesce(best, "span")).drop("sentences")


def verify_citations(cited: DataFrame) -> DataFrame:
    """cited: answer_id, citation_no, claim, span, context (null where it was not retrieved), web, fetched. Verdict, confidence and failure reason of each citation by its words."""
    overlap = share(token_set(F.col("context")), token_set(F.col("claim")))
    missing = F.size(F.array_except(T.numbers(F.col("claim")), T.numbers(F.col("context")))) > 0
    held = (F.col("span") != "") & T.lower(F.col("context")).contains(T.lower(F.col("span")))
    own = cited.withColumn("overlap", overlap).withColumn("missing", missing).withColumn("held", F.coalesce(held, F.lit(False)))
    partial, stale = F.col("overlap") >= 0.4, F.col("web") & ~F.col("fetched")
    absent = F.col("context").isNull()
    verdict = F.when(absent, "unsupported").when(F.col("missing"), "contradicted").when(F.col("held"), "supported").when(partial, "partially_supported").when(stale, "stale").otherwise("unsupported")
    confidence = F.when(absent, 0.0).when(F.col("missing"), 0.92).when(F.col("held"), 0.98).when(partial, F.least(F.lit(0.85), "overlap")).when(stale, 0.2).otherwise(F.col("overlap"))
    reason = (
        F.when(absent, "Citation chunk was not part of retrieved context.").when(F.col("missing"), "Claim contains numeric values absent from the cited context.").when(F.col("held"), F.lit(None))
        .when(partial, "Claim only partially overlaps retrieved context.").when(stale, "Web citation is missing a retrieval timestamp.").otherwise("Claim text is not supported by the cited chunk.")
    )
    return own.select("answer_id", "citation_no", "claim", verdict.alias("verdict"), confidence.alias("confidence"), reason.alias("reason"))


def apply_nli(verified: DataFrame, pairs: DataFrame, score: Callable[[Column, Column], Column], most: int = 32, bar: float = 0.75) -> DataFrame:
    """verified: as verify_citations gives it. pairs: answer_id, citation_no, context. score: a struct of entailment and contradiction for claim and context, as a pandas UDF
    gives it; at most so many unresolved pairs an answer are scored. A clear contradiction or entailment replaces verdict and confidence."""
    own = verified.join(pairs.select("answer_id", "citation_no", "context"), ["answer_id", "citation_no"], "left")
    open_ = F.col("context").isNotNull() & F.col("verdict").isin("unsupported", "partially_supported")
    w = W.partitionBy("answer_id", open_).orderBy("citation_no")
    asked = own.withColumn("asked", open_ & (F.row_number().over(w) <= most))
    scored = asked.where("asked").withColumn("nli", score(F.col("claim"), F.col("context"))).unionByName(asked.where(~F.col("asked")).withColumn("nli", F.lit(None)), allowMissingColumns=True)
    against, holds = F.coalesce(F.col("nli.contradiction") >= bar, F.lit(False)), F.coalesce(F.col("nli.entailment") >= bar, F.lit(False))
    return scored.select(
        "answer_id", "citation_no", "claim", F.when(against, "contradicted").when(holds, "supported").otherwise(F.col("verdict")).alias("verdict"),
        F.when(against, F.col("nli.contradiction")).when(holds, F.col("nli.entailment")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(against, "NLI verifier found contradictory evidence.").when(~holds, F.col("reason")).alias("reason"),
    )


def unattributed(answers: DataFrame, cited: DataFrame, space: str = T.SPACE) -> DataFrame:
    """The row that stands for an answer without citations: insufficient."""
    bare = answers.where(T.stripped(F.col("text"), space) != "").join(cited.select("answer_id").distinct(), "answer_id", "left_anti")
    return bare.select("answer_id", F.lit(1).alias("citation_no"), T.stripped(F.col("text"), space).alias("claim"), F.lit("insufficient").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("Answer contains no citations.").alias("reason"))


def apply_decisions(verified: DataFrame, decisions: DataFrame) -> DataFrame:
    """Citations' verdicts lowered by the decisions on the claims of the same number; a decision never raises one."""
    d = decisions.select("answer_id", F.col("claim_no").alias("citation_no"), F.col("verdict").alias("d_verdict"), F.col("confidence").alias("d_confidence"), F.col("reason").alias("d_reason"))
    out = verified.join(d, ["answer_id", "citation_no"], "left")
    keep = F.col("d_verdict").isNull() | (F.col("d_verdict") == "supported")
    return out.select(
        "answer_id", "citation_no", "claim", F.when(keep, F.col("verdict")).otherwise(F.col("d_verdict")).alias("verdict"), F.when(keep, F.col("confidence")).otherwise(F.least("confidence", "d_confidence")).alias("confidence"),
        F.when(keep, F.col("reason")).otherwise(F.coalesce("d_reason", "reason")).alias("reason"),
    )


def overall(verified: DataFrame) -> DataFrame:
    """Per answer: overall verdict, coverage, contradictions and the citations that do not hold."""
    v = F.col("verdict")
    verdict = F.when(F.bool_and(v == "supported"), "supported").when(F.bool_or(v.isin(HELD)), "partially_supported").otherwise("unsupported")
    return verified.groupBy("answer_id").agg(
        verdict.alias("overall"), (F.count_if(v.isin(HELD)) / F.count(F.lit(1))).alias("coverage"), F.count_if(v == "contradicted").alias("contradictions"),
        F.array_sort(F.collect_list(F.when(v.isin(NOT_HELD), F.col("citation_no")))).alias("failed"),
    )


def refine(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """answers: answer_id, query, text, limitations. Citations that failed go; an answer without any left is replaced by a guarded one, others are qualified or sent to review."""
    v = F.col("verdict")
    per = verified.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.when(~v.isin([*NOT_HELD, "stale"]), F.col("citation_no")))).alias("kept"), F.bool_or(v.isin("contradicted", "insufficient", "stale")).alias("review"))
    out = answers.join(per, "answer_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast(per.schema["kept"].dataType)))
    none = F.size("kept") == 0
    return out.select(
        "answer_id", F.when(none, T.guarded_answer(F.col("query"))).otherwise(F.col("text")).alias("text"), F.when(none, "insufficient_evidence").when(F.col("review"), "needs_review").otherwise("qualified").alias("status"),
        "kept", F.coalesce(F.nullif("limitations", F.lit("")), F.lit("Verification found claims requiring qualification or review.")).alias("limitations"),
    )


# Ledger


def ledger(runs: DataFrame, verified: DataFrame, cited: DataFrame, anchors: DataFrame, known_runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append for runs (answer_id, query, project_id) that the ledger does not hold yet: runs, claims and claim evidence. cited: answer_id, citation_no, anchor_ids; only
    anchors that exist are linked."""
    new = runs.join(known_runs.select("answer_id"), "answer_id", "left_anti")
    own = verified.join(new.select("answer_id"), "answer_id", "left_semi")
    claim_id = F.concat_ws(":", F.col("answer_id").cast("string"), F.concat(F.lit("claim-"), F.col("citation_no").cast("string")))
    filed = own.select(claim_id.alias("claim_id"), "answer_id", F.col("citation_no").alias("claim_order"), "claim", T.ledger_type(F.col("claim")).alias("claim_type"), F.lit("material").alias("importance"), F.col("verdict").alias("status"), "confidence")
    links = own.join(cited.select("answer_id", "citation_no", F.explode("anchor_ids").alias("anchor_id")), ["answer_id", "citation_no"]).join(anchors.select("anchor_id"), "anchor_id", "left_semi")
    links = links.select(F.concat_ws(":", claim_id, "anchor_id").alias("claim_evidence_id"), claim_id.alias("claim_id"), "anchor_id", F.when(F.col("verdict") == "contradicted", "contradicts").otherwise("supports").alias("relation")).dropDuplicates(["claim_evidence_id"])
    return new, filed, links


def ledger_view(runs: DataFrame, filed: DataFrame, links: DataFrame) -> DataFrame:
    """A row a run: its claims in order, each with the anchors that support or contradict it."""
    evidence = links.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "relation"))).alias("evidence"))
    per = filed.join(evidence, "claim_id", "left").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_order", "claim_id", "claim_type", "status", "confidence", F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType)).alias("evidence")))).alias("claims"))
    return runs.join(per, "answer_id", "left")


def token_usage(stages: DataFrame) -> DataFrame:
    """stages: qid, stage, text. Estimated tokens by stage; empty texts count nothing."""
    return stages.where("text <> ''").groupBy("qid", "stage").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).cast("bigint").alias("tokens"))


# Memory


def memory(turns: DataFrame, recent: int = 4, limit: int = 600, cited: int = 8) -> DataFrame:
    """turns: session_id, turn, role, text, and where given citation_ids and chunk_ids. Per session: how many turns are recent, a summary of the older ones (lines of 120
    characters, until the limit is reached), the last four different constraints of the user, and which chunks the citations of the last turns name. Turns of other roles than user and
    assistant count, but are in no summary."""
    ranked = turns.withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn"))))
    name = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    older = ranked.where((F.col("back") > recent) & F.col("role").isin("user", "assistant"))
    older = older.select("session_id", "turn", F.concat(name, T.truncate(F.replace(T.strip(F.col("text")), F.lit("\n"), F.lit(" ")), 120)).alias("line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy("session_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    older = older.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= limit)
    kept = older.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), " ").alias("summary"))
    counts = ranked.groupBy("session_id").agg(F.count_if(F.col("back") <= recent).alias("recent_turns"), F.count(F.lit(1)).alias("turns"))
    asks = turns.where((F.col("role") == "user") & T.mentions(F.col("text"), CONSTRAINTS)).select("session_id", "turn", T.strip(F.col("text")).alias("text"))
    asks = asks.groupBy("session_id", "text").agg(F.min("turn").alias("turn")).withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))).where("back <= 4")
    asks = asks.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("constraints"))
    out = counts.join(kept, "session_id", "left").join(asks, "session_id", "left")
    columns = ["session_id", "turns", "recent_turns", F.regexp_replace(F.substring(F.coalesce("summary", F.lit("")), 1, limit), f"{T.SPACE}+$", "").alias("summary"), F.coalesce("constraints", F.array().cast("array<string>")).alias("constraints")]
    if "citation_ids" not in turns.columns:
        return out.select(*columns)
    graph = citation_graph(ranked.where(F.col("back") <= cited))
    return out.join(graph, "session_id", "left").select(*columns, "graph")


def citation_graph(turns: DataFrame) -> DataFrame:
    """turns: session_id, turn, role, citation_ids, chunk_ids. graph: the chunks of each citation of assistant turns, citations and chunks in order of first mention; arrays of
    different length are paired up to the shorter."""
    n = F.least(F.size("citation_ids"), F.size("chunk_ids"))
    pairs = turns.where((F.col("role") == "assistant") & (n > 0)).select("session_id", "turn", F.posexplode(F.arrays_zip(F.slice("citation_ids", F.lit(1), n).alias("c"), F.slice("chunk_ids", F.lit(1), n).alias("k"))).alias("i", "p"))
    first = pairs.groupBy("session_id", F.col("p.c").alias("citation_id"), F.col("p.k").alias("chunk_id")).agg(F.min(F.struct("turn", "i")).alias("at"))
    per = first.groupBy("session_id", "citation_id").agg(F.min("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    return per.groupBy("session_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("at", "citation_id", "chunks"))), lambda x: F.struct(x["citation_id"], x["chunks"]))).alias("graph"))


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, title (the first user turn, 80 characters) and turn count."""
    first = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 80)), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("session_id").agg(F.coalesce(first, F.lit("New conversation")).alias("title"), F.count(F.lit(1)).alias("turns"))
