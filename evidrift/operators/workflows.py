"""Work products, reviews, jobs, projects and sessions, as frames of states and events."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .analysis import canonical_hash

# The workflows with their fields, what becomes of verdicts, and the review policy (status, action, next status).
MANIFESTS = [
    ("contract_review", "Contract review", True, ["parties", "term", "termination", "payment", "liability"], ["parties", "term", "termination", "liability"]),
    ("compliance_mapping", "Compliance evidence map", True, ["requirement", "evidence", "gap", "owner"], ["requirement", "gap"]),
    ("vendor_comparison", "Vendor comparison", False, ["criterion", "vendor_value", "evidence", "exception"], ["vendor_value", "exception"]),
    ("due_diligence", "Due-diligence register", True, ["finding", "category", "impact", "evidence", "missing_information"], ["finding", "impact"]),
    ("investigation_timeline", "Investigation timeline", True, ["timestamp", "event", "entity", "evidence", "certainty"], ["timestamp", "event"]),
]
FINDING_STATUS = {"supported": "supported", "partially_supported": "needs_review", "contradicted": "contradicted", "unsupported": "insufficient", "insufficient": "insufficient", "uncertain": "uncertain", "stale": "needs_review"}
TRANSITIONS = [
    ("needs_review", "approve", "approved"), ("draft", "approve", "approved"), ("needs_review", "reject", "rejected"), ("draft", "reject", "rejected"), ("needs_review", "request_reanalysis", "draft"),
    ("rejected", "request_reanalysis", "draft"), ("needs_review", "edit", "needs_review"), ("draft", "edit", "needs_review"), ("needs_review", "waive_with_reason", "approved"),
]
REFUSALS = {"approve": "Cannot approve product in ", "reject": "Cannot reject product in ", "request_reanalysis": "Cannot request reanalysis from ", "edit": "Cannot edit product in ", "waive_with_reason": "Cannot waive product in "}
PRODUCT_STATES = ["draft", "needs_review", "approved", "rejected", "superseded"]
FINDING_STATES = ["supported", "contradicted", "insufficient", "uncertain", "missing", "needs_review"]
IMPORTANCE = ["critical", "material", "supporting", "incidental"]
DISCLAIMER = "This product is evidence support, not a professional determination."


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, "workflow_id string, title string, always_review boolean, required_fields array<string>, critical_fields array<string>")


# Work products


def field_of(claim: Column, fields: Column) -> Column:
    """The first field of which a word of more than three letters stands in the claim, else claim."""
    named = lambda f: F.exists(F.split(F.replace(f, F.lit("_"), F.lit(" ")), " "), lambda w: (F.length(w) > 3) & F.lower(claim).contains(w))
    return F.coalesce(F.get(F.filter(fields, named), F.lit(0)), F.lit("claim"))


def findings(runs: DataFrame, verified: DataFrame, cited: DataFrame) -> DataFrame:
    """runs: run_id, workflow_id. verified: run_id, claim_no, claim, verdict, confidence, citation_id. cited: run_id, citation_id, chunk_id, document_id, anchor_ids. A finding a claim, in order, with the link to its evidence, and one for
    every required field that no claim fills."""
    flows = runs.join(F.broadcast(manifests(runs.sparkSession)), "workflow_id")
    linked = verified.join(cited.select("run_id", "citation_id", "chunk_id", "document_id", "anchor_ids"), ["run_id", "citation_id"], "left").join(flows, "run_id")
    link = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.coalesce("anchor_ids", F.array().cast("array<string>")).alias("anchor_ids"), F.when(F.col("verdict") == "contradicted", "contradicts").otherwise("supports").alias("relation"))
    none = F.array().cast("array<struct<chunk_id:string,document_id:string,anchor_ids:array<string>,relation:string>>")
    said = linked.select(
        "run_id", F.col("claim_no").cast("int").alias("position"), F.concat(F.lit("finding-"), F.col("claim_no").cast("string")).alias("finding_id"), field_of(F.col("claim"), F.col("required_fields")).alias("field"), F.col("claim").alias("value"),
        F.coalesce(F.try_element_at(_map(FINDING_STATUS), F.col("verdict")), F.lit("needs_review")).alias("status"), F.lit("material").alias("importance"), "confidence", F.when(F.col("chunk_id").isNotNull(), F.array(link)).otherwise(none).alias("evidence"),
    )
    required = flows.select("run_id", F.posexplode("required_fields").alias("i", "field"), "critical_fields")
    missing = required.join(said.select("run_id", "field").distinct(), ["run_id", "field"], "left_anti")
    missing = missing.select(
        "run_id", (F.col("i") + 1_000_000).alias("position"), F.concat(F.lit("missing-"), "field").alias("finding_id"), "field", F.lit(None).cast("string").alias("value"), F.lit("missing").alias("status"),
        F.when(F.array_contains("critical_fields", F.col("field")), "critical").otherwise("material").alias("importance"), F.lit(0.0).alias("confidence"), none.alias("evidence"),
    )
    return said.unionByName(missing)


def products(runs: DataFrame, found: DataFrame, cited: DataFrame) -> DataFrame:
    """runs: run_id, workflow_id, summary, limitations. A product a run: its findings in order, its status, the documents it rests on, what is wrong with it, and hashes of its content."""
    flows = runs.join(F.broadcast(manifests(runs.sparkSession)), "workflow_id")
    per = found.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "finding_id", "field", "value", "status", "importance", "confidence", "evidence"))).alias("findings"), F.bool_or(F.col("status") != "supported").alias("open"))
    docs = cited.where(F.coalesce(F.col("document_id").cast("string") != "", F.lit(False))).groupBy("run_id").agg(F.array_sort(F.collect_set(F.col("document_id").cast("string"))).alias("source_document_ids"))
    out = flows.join(per, "run_id", "left").join(docs, "run_id", "left")
    out = out.select(
        "run_id", "workflow_id", F.lit("v1").alias("version"), "title", F.when(F.col("always_review") | F.coalesce("open", F.lit(False)), "needs_review").otherwise("draft").alias("status"),
        F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)).alias("findings"), "summary", F.array(F.coalesce(F.nullif("limitations", F.lit("")), F.lit(DISCLAIMER))).alias("limitations"),
        F.coalesce("source_document_ids", F.array().cast("array<string>")).alias("source_document_ids"),
    )
    return with_hash(out).withColumn("violations", violations())


def with_hash(rows: DataFrame) -> DataFrame:
    """content_hash of products, whatever it was before."""
    content = F.to_json(F.struct(*[c for c in ("run_id", "workflow_id", "version", "title", "status", "findings", "summary", "limitations", "source_document_ids") if c in rows.columns]), {"ignoreNullFields": "false"})
    return rows.withColumn("content_hash", canonical_hash(content))


def violations() -> Column:
    """What a product must not be: without a run, with a supported finding that has no evidence, or with values that its schema does not know."""
    each = lambda bad: F.exists("findings", bad)
    rules = [
        (F.coalesce(F.col("run_id").cast("string"), F.lit("")) == "", "Work product requires an analysis run ID"), (each(lambda f: (f["status"] == "supported") & (F.size(f["evidence"]) == 0)), "Supported findings must include evidence"),
        (~F.col("status").isin(PRODUCT_STATES), "status is not allowed"), (each(lambda f: ~f["status"].isin(FINDING_STATES)), "finding status is not allowed"), (each(lambda f: ~f["importance"].isin(IMPORTANCE)), "importance is not allowed"),
        (each(lambda f: (f["confidence"] < 0) | (f["confidence"] > 1)), "confidence is not between 0 and 1"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]), lambda x: x.isNotNull())


def render_markdown(rows: DataFrame) -> DataFrame:
    """run_id and the product as a report that shows every finding."""
    proof = lambda e: F.concat(F.lit("- Evidence: `"), F.coalesce(e["document_id"], F.lit("")), F.lit("` (source)"))
    finding = lambda f: F.array_join(F.concat(
        F.array(F.concat(F.lit("### "), f["field"], F.lit(" — "), f["status"]), F.concat(F.lit("- Value: "), F.coalesce(f["value"], F.lit("None"))), F.concat(F.lit("- Importance: "), f["importance"]), F.concat(F.lit("- Confidence: "), F.format_string("%.2f", f["confidence"]))),
        F.transform(f["evidence"], proof), F.array(F.lit("")),
    ), "\n")
    head = [F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("- Status: **"), "status", F.lit("**")), F.concat(F.lit("- Workflow: `"), "workflow_id", F.lit("@"), "version", F.lit("`")), F.concat(F.lit("- Analysis run: `"), F.col("run_id").cast("string"), F.lit("`")), F.lit(""), F.coalesce("summary", F.lit("")), F.lit(""), F.lit("## Findings"), F.lit("")]
    tail = F.concat(F.array(F.lit("## Limitations"), F.lit("")), F.transform("limitations", lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))
    return rows.select("run_id", F.array_join(F.concat(F.array(*head), F.transform("findings", finding), tail), "\n").alias("report"))


def bundles(rows: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """run_id and a ZIP archive of each product: report, product, claims, provenance, review history and manifest. Rows are packed by the tasks, a batch at a time."""
    body = rows.join(render_markdown(rows), "run_id").withColumn("product", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    if events is not None:
        body = body.join(events.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "actor", "action", "comment")))).alias("history")), "run_id", "left")
    body = body.select("run_id", "report", "product", (F.col("history") if events is not None else F.lit(None).cast("string")).alias("history"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for run, report, product, history in zip(*(batch.column(c).to_pylist() for c in ("run_id", "report", "product", "history"))):
                own = json.loads(product)
                manifest = {"bundle_version": "v1", "run_id": run, "workflow_id": own["workflow_id"], "schema_version": own["version"], "status": own["status"], "contains_source_documents": False}
                files = {"manifest.json": manifest, "work-product.json": own, "claims.json": own["findings"], "provenance.json": [e for f in own["findings"] for e in f["evidence"]], "review-history.json": json.loads(history or "[]")}
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in [("report.md", report), *((n, json.dumps(x, sort_keys=True, indent=2)) for n, x in files.items())]:
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), pa.array(out, pa.binary())], names=["run_id", "bundle"])

    return body.mapInArrow(pack, f"run_id {rows.schema['run_id'].dataType.simpleString()}, bundle binary")


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows: products. edits: run_id, finding_id, value, reviewer_note (null: as it was). Only these two of a finding can be changed."""
    per = edits.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("finding_id", F.struct("value", "reviewer_note")))).alias("edits__"))
    patch = lambda f: F.try_element_at("edits__", f["finding_id"])
    names = [x.name for x in rows.schema["findings"].dataType.elementType]
    note = lambda f: f["reviewer_note"] if "reviewer_note" in names else F.lit(None).cast("string")
    new = lambda f: F.struct(*[(F.coalesce(patch(f)["value"], f["value"]) if n == "value" else f[n]).alias(n) for n in names if n != "reviewer_note"], F.coalesce(patch(f)["reviewer_note"], note(f)).alias("reviewer_note"))
    out = rows.join(per, "run_id", "left").withColumn("findings", F.transform("findings", new)).drop("edits__")
    return with_hash(out)


# Reviews


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "status string, action string, next_status string")


def review(actions: DataFrame) -> DataFrame:
    """actions: product_id, status, action. next_status, or an error where the policy does not allow the action."""
    out = actions.join(F.broadcast(transitions(actions.sparkSession)), ["status", "action"], "left")
    refusal = F.coalesce(F.concat(F.try_element_at(_map(REFUSALS), F.col("action")), F.col("status"), F.lit(" state")), F.concat(F.lit("Unsupported review action: "), "action"))
    return out.withColumn("error", F.when(F.col("next_status").isNull(), refusal))


def product_hash(content: Column, status: Column) -> Column:
    return F.sha2(F.concat_ws(":", content, status), 256)


def decide(states: DataFrame, events: DataFrame) -> DataFrame:
    """states: product_id, content_hash, status. events: product_id, seq, action, comment, expected_hash, and for edits new_hash, the content after them. Every event in order: before and after status and hash, or the error for which it was
    refused; refused events change nothing, and approving what is approved or rejecting what is rejected says nothing new. A fold over the events of a product."""
    policy = F.create_map(*[F.lit(x) for s, a, n in TRANSITIONS for x in (f"{s}:{a}", n)])
    step_kind = "struct<seq:bigint,before:string,after:string,before_hash:string,after_hash:string,error:string>"
    if "new_hash" not in events.columns:
        events = events.withColumn("new_hash", F.lit(None).cast("string"))
    own = states.join(events.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "action", "comment", "expected_hash", "new_hash"))).alias("events")), "product_id")
    start = F.struct(F.col("status").alias("status"), F.col("content_hash").alias("content"), F.array().cast(f"array<{step_kind}>").alias("log"))

    def step(s, e):
        before = product_hash(s["content"], s["status"])
        allowed = F.try_element_at(policy, F.concat_ws(":", s["status"], e["action"]))
        idle = ((e["action"] == "approve") & (s["status"] == "approved")) | ((e["action"] == "reject") & (s["status"] == "rejected"))
        error = (
            F.when(~e["action"].isin(*REFUSALS), F.concat(F.lit("Unsupported review action: "), e["action"])).when(e["expected_hash"].isNotNull() & (e["expected_hash"] != before), "Work product changed since it was loaded")
            .when((e["action"] == "waive_with_reason") & (F.coalesce(e["comment"], F.lit("")) == ""), "waive_with_reason requires a reviewer comment").when(~idle & allowed.isNull(), F.concat(F.try_element_at(_map(REFUSALS), e["action"]), s["status"], F.lit(" state")))
        )
        moves = error.isNull() & ~idle
        status, content = F.when(moves, allowed).otherwise(s["status"]), F.when(moves & (e["action"] == "edit"), F.coalesce(e["new_hash"], s["content"])).otherwise(s["content"])
        entry = F.struct(e["seq"].alias("seq"), s["status"].alias("before"), status.alias("after"), before.alias("before_hash"), product_hash(content, status).alias("after_hash"), error.alias("error"))
        return F.struct(status.alias("status"), content.alias("content"), F.concat(s["log"], F.array(entry)).alias("log"))

    folded = own.select("product_id", F.aggregate("events", start, step)["log"].alias("log"))
    return folded.select("product_id", F.explode("log").alias("l")).select("product_id", "l.*")


def pending(rows: DataFrame, created: str = "created_at", limit: int = 100) -> DataFrame:
    return rows.where("status = 'needs_review'").orderBy(created).limit(limit)


def checkpoints(states: DataFrame) -> DataFrame:
    """states: thread_id, seq, state. The version rises only when the state's hash changes."""
    w = W.partitionBy("thread_id").orderBy("seq")
    h = states.withColumn("h", F.sha2("state", 256))
    changed = F.when(F.lag("h").over(w).eqNullSafe(F.col("h")), 0).otherwise(1)
    return h.withColumn("changed", changed).withColumn("version", F.sum("changed").over(w)).select("thread_id", "seq", "version")


def save_product(old: DataFrame, new: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """The products after new ones have replaced those of the same run, and the states to append for their checkpoints."""
    kept = old.join(new.select("run_id"), "run_id", "left_anti").unionByName(new, allowMissingColumns=True)
    state = F.to_json(F.struct("run_id", "workflow_id", "status", "content_hash"))
    return kept, new.select(F.col("run_id").alias("thread_id"), seq.alias("seq"), state.alias("state"))


# Jobs, projects, sessions


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs: job_id, status, attempt_count, max_attempts, lease_expires_at. Expired running jobs go back to the queue, or to quarantine after the last attempt."""
    gone = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return jobs.withColumn("status", F.when(gone & (F.col("attempt_count") >= F.col("max_attempts")), "quarantined").when(gone, "queued").otherwise(F.col("status")))


def claim(jobs: DataFrame, workers: list[str], now: Column, seconds: int) -> DataFrame:
    """The jobs after each worker has claimed one of the oldest queued ones, in order: running, owned, with a lease and an attempt more. One statement decides for all workers, so none is claimed twice."""
    oldest = jobs.where("status = 'queued'").orderBy("started_at", "job_id").limit(len(workers)).withColumn("turn__", F.row_number().over(W.orderBy("started_at", "job_id"))).select("job_id", "turn__")
    own = jobs.join(F.broadcast(oldest), "job_id", "left")
    mine = F.col("turn__").isNotNull()
    return own.select(
        *[c for c in jobs.columns if c not in ("status", "attempt_count", "lease_owner", "lease_expires_at")], F.when(mine, "running").otherwise(F.col("status")).alias("status"), (F.col("attempt_count") + mine.cast("int")).alias("attempt_count"),
        F.when(mine, F.element_at(F.array(*map(F.lit, workers)), F.col("turn__"))).otherwise(F.col("lease_owner")).alias("lease_owner"), F.when(mine, now + F.make_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
    )


def heartbeat(jobs: DataFrame, beats: DataFrame, seconds: int) -> DataFrame:
    """beats: job_id, worker, at. Leases of running jobs extended by their owners; beats of others change nothing."""
    last = beats.groupBy("job_id", F.col("worker").alias("lease_owner")).agg(F.max("at").alias("beat__")).withColumn("status", F.lit("running"))
    own = jobs.join(last, ["job_id", "lease_owner", "status"], "left")
    return own.withColumn("lease_expires_at", F.coalesce(F.col("beat__") + F.make_interval(secs=F.lit(seconds)), F.col("lease_expires_at"))).select(*jobs.columns)


def job_states(events: DataFrame) -> DataFrame:
    """events: job_id, seq, event (created, queued, claimed, completed, failed) and error. The last state of each job and how many times it was claimed; completed and failed jobs stay so."""
    to = _map({"created": "running", "queued": "queued", "claimed": "running", "completed": "completed", "failed": "failed"})
    e = events.withColumn("state", F.try_element_at(to, F.col("event"))).where("state is not null")
    done = F.min(F.when(F.col("state").isin("completed", "failed"), F.struct("seq", "state", "error")))
    return e.groupBy("job_id").agg(F.coalesce(done["state"], F.max_by("state", "seq")).alias("status"), F.count_if(F.col("event") == "claimed").alias("attempts"), done["error"].alias("error"))


def has_work(jobs: DataFrame, paths: DataFrame) -> DataFrame:
    """paths: source_path, project_id, expected (documents, or null). Whether a job of the path waits or runs, or has completed (with just as many documents, where a number is expected)."""
    own = paths.join(jobs.select("source_path", "project_id", "status", "documents_seen"), ["source_path", "project_id"], "left")
    yes = F.col("status").isin("queued", "running") | ((F.col("status") == "completed") & (F.col("expected").isNull() | (F.col("documents_seen") == F.col("expected"))))
    return own.groupBy("source_path", "project_id").agg(F.coalesce(F.bool_or(yes), F.lit(False)).alias("has_work"))


def readiness(projects: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """projects: project_id, status. Counts of documents and of jobs at work and failed, and what they say: archived, ready, preparing, failed or empty."""
    d = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"))
    j = jobs.groupBy("project_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("processing"), F.count_if(F.col("status").isin("failed", "quarantined")).alias("failed"))
    out = projects.join(d, "project_id", "left").join(j, "project_id", "left").fillna(0, ["documents", "processing", "failed"])
    state = F.when(F.col("status") == "archived", "archived").when(F.col("documents") > 0, "ready").when(F.col("processing") > 0, "preparing").when(F.col("failed") > 0, "failed").otherwise("empty")
    return out.select("project_id", "documents", "processing", "failed", state.alias("readiness"))


def create_projects(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing: slug. new: seq, name. slug of each new project: that of its name, or with the first number from 2 on that is still free, in order; existing slugs are kept."""
    base = new.withColumn("base", T.slug(F.col("name")))
    stem = F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1)
    taken = existing.select("slug", stem.alias("base"), F.expr(r"try_cast(regexp_extract(slug, '^(.*?)(?:-(\\d+))?$', 2) as int)").alias("n"))
    whole = existing.select("slug", F.col("slug").alias("base"), F.lit(1).alias("n"))
    used = whole.unionByName(taken.where("n >= 2")).groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("used"))
    used = used.select("base", F.transform("used", lambda n, i: F.struct((n - i - 1).alias("before"), (i + 1).alias("upto"))).alias("used"))  # free numbers before each one taken, and how many are taken up to it
    used = used.select("base", F.filter("used", lambda x, i: (i + 1 == F.size("used")) | (F.get("used", i + 1)["before"] > x["before"])).alias("used"))  # one of each run of numbers
    own = base.withColumn("turn", F.row_number().over(W.partitionBy("base").orderBy("seq"))).join(used, "base", "left")
    n = F.col("turn") + F.coalesce(F.array_max(F.filter("used", lambda x: x["before"] < F.col("turn")))["upto"], F.lit(0))
    return own.select("seq", "name", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", F.col("base"), n.cast("string"))).alias("slug"))


def update_projects(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """projects: project_id, name, description, status, is_sample. changes: project_id, name, description, archive. The sample keeps its name and is never archived; what a change leaves null stays."""
    c = changes.select("project_id", F.col("name").alias("name__"), F.col("description").alias("description__"), F.col("archive").alias("archive__"))
    own, free = projects.join(c, "project_id", "left"), ~F.col("is_sample")
    return own.select(
        "project_id", F.when(free, F.coalesce(T.strip(F.col("name__")), F.col("name"))).otherwise(F.col("name")).alias("name"), F.coalesce("description__", "description").alias("description"),
        F.when(free & F.coalesce("archive__", F.lit(False)), "archived").otherwise(F.col("status")).alias("status"), "is_sample",
    )


def project_list(projects: DataFrame, limit: int = 100) -> DataFrame:
    """The sample first, then the last updated."""
    return projects.orderBy(F.desc("is_sample"), F.desc("updated_at"), "project_id").limit(limit)


def writable(requests: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests: qid, project_id, session_id. Why a request is refused: no such project, an archived one, or a session of another project; null where it is not."""
    p = projects.select("project_id", F.col("status").alias("p"))
    s = sessions.select("session_id", F.col("project_id").alias("owner"))
    out = requests.join(p, "project_id", "left").join(s, "session_id", "left")
    why = F.when(F.col("p").isNull(), "Project not found").when(F.col("p") == "archived", "Project is archived").when(F.col("owner") != F.col("project_id"), "Conversation belongs to another project")
    return out.select("qid", why.alias("error"))


def save_sessions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, project_id, updated_at and whatever else) after new ones are saved, the last of each, and those refused because the session belongs to another project."""
    owner = old.select("session_id", F.col("project_id").alias("owner__"))
    marked = new.join(owner, "session_id", "left")
    mine = F.col("owner__").isNull() | (F.col("owner__") == F.col("project_id"))
    own = marked.where(mine).drop("owner__").withColumn("k__", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("updated_at")))).where("k__ = 1").drop("k__")
    return old.join(own.select("session_id"), "session_id", "left_anti").unionByName(own), marked.where(~mine).drop("owner__")


def delete_sessions(old: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gone: session_id, project_id. The sessions that are left, and whether each one to delete existed in its project."""
    keys = ["session_id", "project_id"]
    there = gone.join(old.select(*keys).withColumn("existed", F.lit(True)), keys, "left")
    return old.join(gone.select(*keys), keys, "left_anti"), there.select(*keys, F.coalesce("existed", F.lit(False)).alias("existed"))


def admit(requests: DataFrame, active: int = 1, waiting: int = 2, patience: float = 0.25) -> DataFrame:
    """requests: gate, at, seconds (how long it would run), in seconds. A simulation of bounded admission, gate by gate: a request runs at once if a place is free, waits if the line is not full and a place is free in time, and is turned away else."""
    import pandas as pd

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ends, line, out = [0.0] * active, [], []
        for r in rows.sort_values(["at", "seq"]).itertuples():
            line = [t for t in line if t > r.at]
            free = min(range(active), key=ends.__getitem__)
            begin = max(r.at, ends[free])
            if begin > r.at and (len(line) >= waiting or begin - r.at > patience):
                out.append((r.gate, r.seq, None))
                if len(line) < waiting:
                    line.append(r.at + patience)
                continue
            if begin > r.at:
                line.append(begin)
            ends[free] = begin + r.seconds
            out.append((r.gate, r.seq, begin))
        return pd.DataFrame(out, columns=["gate", "seq", "began"])

    kind = requests.schema["gate"].dataType.simpleString()
    return requests.groupBy("gate").applyInPandas(run, f"gate {kind}, seq bigint, began double")


def event_log(events: DataFrame, decided: DataFrame) -> DataFrame:
    """events: product_id, seq, actor, action, comment. decided: as decide gives it. The events that took effect, with the hashes before and after, to be appended to the log."""
    took = decided.where("error is null and before_hash <> after_hash or error is null and before <> after").select("product_id", "seq", "before_hash", "after_hash")
    return events.join(took, ["product_id", "seq"]).select("product_id", "seq", "actor", "action", "before_hash", "after_hash", "comment")


def bootstrap(paths: DataFrame, jobs: DataFrame) -> DataFrame:
    """paths: source_path, project_id, expected. Those that no job has in hand or has finished: what a start of the system has to ingest, once."""
    return paths.join(has_work(jobs, paths).where(~F.col("has_work")).select("source_path", "project_id"), ["source_path", "project_id"], "left_semi")


def response_events(responses: DataFrame) -> DataFrame:
    """responses: qid, answer, error. The events of each response in order, as lines of JSON: start, then complete or error."""
    end = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.lit("error").alias("event"), F.col("qid"), F.col("error").alias("message")))).otherwise(F.to_json(F.struct(F.lit("complete").alias("event"), F.col("qid"), F.col("answer"))))
    return responses.select("qid", F.posexplode(F.array(F.to_json(F.struct(F.lit("start").alias("event"), F.col("qid"))), end)).alias("position", "line"))
