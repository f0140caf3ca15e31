"""Queries of work products, reviews, jobs, projects and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflows as X
from . import query, table

_VERDICT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'supported' WHEN '2-HIGH' THEN 'contradicted' WHEN '3-MEDIUM' THEN 'stale' WHEN '4-NOT SPECIFIED' THEN 'unsupported' ELSE 'partially_supported' END"
_FLOW = "CASE c_custkey % 5 WHEN 0 THEN 'contract_review' WHEN 1 THEN 'compliance_mapping' WHEN 2 THEN 'vendor_comparison' WHEN 3 THEN 'due_diligence' ELSE 'investigation_timeline' END"
_CLAIM = "CASE o_orderkey % 6 WHEN 0 THEN 'The Payment is due' WHEN 1 THEN 'an owner of evidence' WHEN 2 THEN 'vendor price' WHEN 3 THEN 'missing event' WHEN 4 THEN 'no gap' ELSE 'liability ends' END"
_FIELDS = "(VALUES ('contract_review', ['parties', 'term', 'termination', 'payment', 'liability'], ['parties', 'term', 'termination', 'liability']), ('compliance_mapping', ['requirement', 'evidence', 'gap', 'owner'], ['requirement', 'gap']), ('vendor_comparison', ['criterion', 'vendor_value', 'evidence', 'exception'], ['vendor_value', 'exception']), ('due_diligence', ['finding', 'category', 'impact', 'evidence', 'missing_information'], ['finding', 'impact']), ('investigation_timeline', ['timestamp', 'event', 'entity', 'evidence', 'certainty'], ['timestamp', 'event'])) f(flow, fields, critical)"
_FOUND = f"""WITH r AS (SELECT c_custkey AS run_id, {_FLOW} AS flow FROM customer), rf AS (SELECT * FROM r JOIN {_FIELDS} USING (flow)),
o AS (SELECT o_custkey AS run_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n, {_CLAIM} AS claim, {_VERDICT} AS verdict FROM orders),
s AS (SELECT rf.run_id, n, 'finding-' || n AS finding_id, coalesce(list_filter(fields, lambda f: len(list_filter(string_split(replace(f, '_', ' '), ' '), lambda w: length(w) > 3 AND contains(lower(claim), w))) > 0)[1], 'claim') AS field, claim AS value,
CASE verdict WHEN 'supported' THEN 'supported' WHEN 'contradicted' THEN 'contradicted' WHEN 'unsupported' THEN 'insufficient' ELSE 'needs_review' END AS status, 'material' AS importance, o_orderkey % 4 <> 0 AS linked, verdict FROM o JOIN rf USING (run_id)),
ms AS (SELECT run_id, unnest(fields) AS field, critical FROM rf), fi AS (SELECT run_id, finding_id, field, value, status, importance, CASE WHEN linked THEN CASE verdict WHEN 'contradicted' THEN 'contradicts' ELSE 'supports' END END AS relation, linked FROM s
UNION ALL SELECT run_id, 'missing-' || field, field, NULL, 'missing', CASE WHEN list_contains(critical, field) THEN 'critical' ELSE 'material' END, NULL, false FROM ms WHERE (run_id, field) NOT IN (SELECT (run_id, field) FROM s))"""


def _frames(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.expr(_FLOW).alias("workflow_id"), F.lit("summary").alias("summary"), F.lit("").alias("limitations"))
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    verified = o.select(F.col("o_custkey").alias("run_id"), F.col("n").alias("claim_no"), F.expr(_CLAIM).alias("claim"), F.expr(_VERDICT).alias("verdict"), F.lit(0.5).alias("confidence"), F.concat(F.lit("C"), "n").alias("citation_id"))
    cited = o.where("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("C"), "n").alias("citation_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 10).alias("document_id"), F.array(F.lit("a")).alias("anchor_ids"))
    return runs, verified, cited


def _products(spark, d):
    runs, verified, cited = _frames(spark, d)
    return X.products(runs, X.findings(runs, verified, cited), cited)


@query("p02_findings", f"{_FOUND} SELECT run_id, finding_id, field, value, status, importance, relation FROM fi")
def p02(spark, d):
    out = X.findings(*_frames(spark, d))
    return out.select("run_id", "finding_id", "field", "value", "status", "importance", F.get("evidence", F.lit(0))["relation"].alias("relation"))


@query("p03_products", f"""{_FOUND}, docs AS (SELECT o_custkey AS run_id, string_agg(DISTINCT CAST(o_orderkey % 10 AS VARCHAR), ',' ORDER BY CAST(o_orderkey % 10 AS VARCHAR)) AS documents FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey)
SELECT rf.run_id, CASE WHEN flow <> 'vendor_comparison' OR bool_or(status <> 'supported') THEN 'needs_review' ELSE 'draft' END AS status, count(finding_id) AS n_findings, coalesce(max(documents), '') AS documents, CASE WHEN bool_or(status = 'supported' AND NOT linked) THEN 'Supported findings must include evidence' ELSE '' END AS violations
FROM rf LEFT JOIN fi USING (run_id) LEFT JOIN docs USING (run_id) GROUP BY rf.run_id, flow""")
def p03(spark, d):
    return _products(spark, d).select("run_id", "status", F.size("findings").cast("bigint").alias("n_findings"), F.array_join("source_document_ids", ",").alias("documents"), F.array_join("violations", ";").alias("violations"))


@query("p04_content_hash", """SELECT c_custkey AS run_id, sha256('{"findings":[{"confidence":0.5,"evidence":[],"field":"claim","finding_id":"finding-1","importance":"material","position":1,"status":"supported","value":"v"}],"run_id":' || c_custkey || ',"status":"draft","summary":null,"title":"t"}') AS content_hash FROM customer""")
def p04(spark, d):
    evidence = F.array().cast("array<struct<a:string>>")
    finding = F.struct(F.lit(1).alias("position"), F.lit("finding-1").alias("finding_id"), F.lit("claim").alias("field"), F.lit("v").alias("value"), F.lit("supported").alias("status"), F.lit("material").alias("importance"), F.lit(0.5).alias("confidence"), evidence.alias("evidence"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("t").alias("title"), F.lit("draft").alias("status"), F.array(finding).alias("findings"), F.lit(None).cast("string").alias("summary"))
    return X.with_hash(rows).select("run_id", "content_hash")


@query("p07_edits", f"{_FOUND} SELECT run_id, finding_id, CASE WHEN finding_id = 'finding-1' AND run_id % 2 = 0 THEN 'edited' ELSE value END AS value, CASE WHEN finding_id = 'finding-1' AND run_id % 2 = 0 THEN 'note' END AS note, status FROM fi")
def p07(spark, d):
    edits = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("run_id"), F.lit("finding-1").alias("finding_id"), F.lit("edited").alias("value"), F.lit("note").alias("reviewer_note"))
    out = X.edited(_products(spark, d), edits).select("run_id", F.explode("findings").alias("f"))
    return out.select("run_id", "f.finding_id", "f.value", F.col("f.reviewer_note").alias("note"), "f.status")


@query("p10_markdown", """SELECT c_custkey AS run_id, '# t' || chr(10) || chr(10) || '- Status: **draft**' || chr(10) || '- Workflow: `w@v1`' || chr(10) || '- Analysis run: `' || c_custkey || '`' || chr(10) || chr(10) || 's' || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) ||
'### term — supported' || chr(10) || '- Value: v' || chr(10) || '- Importance: material' || chr(10) || '- Confidence: 0.57' || chr(10) || '- Evidence: `d' || c_nationkey || '` (source)' || chr(10) || chr(10) || '## Limitations' || chr(10) || chr(10) || '- l' || chr(10) AS report FROM customer""")
def p10(spark, d):
    link = F.struct(F.concat(F.lit("d"), "c_nationkey").alias("document_id"))
    finding = F.struct(F.lit("term").alias("field"), F.lit("supported").alias("status"), F.lit("v").alias("value"), F.lit("material").alias("importance"), F.lit(0.5678).alias("confidence"), F.array(link).alias("evidence"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("t").alias("title"), F.lit("draft").alias("status"), F.lit("w").alias("workflow_id"), F.lit("v1").alias("version"), F.lit("s").alias("summary"), F.array(finding).alias("findings"), F.array(F.lit("l")).alias("limitations"))
    return X.render_markdown(rows)


_ACTION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'approve' WHEN '2-HIGH' THEN 'reject' WHEN '3-MEDIUM' THEN 'edit' WHEN '4-NOT SPECIFIED' THEN 'waive_with_reason' ELSE 'request_reanalysis' END"
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'needs_review' WHEN 'F' THEN 'draft' ELSE 'rejected' END"
_NEXT = """CASE WHEN action IN ('approve', 'reject') AND status IN ('needs_review', 'draft') THEN CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END WHEN action = 'request_reanalysis' AND status IN ('needs_review', 'rejected') THEN 'draft'
WHEN action = 'edit' AND status IN ('needs_review', 'draft') THEN 'needs_review' WHEN action = 'waive_with_reason' AND status = 'needs_review' THEN 'approved' END"""
_REFUSED = "CASE action WHEN 'approve' THEN 'Cannot approve product in ' WHEN 'reject' THEN 'Cannot reject product in ' WHEN 'edit' THEN 'Cannot edit product in ' WHEN 'waive_with_reason' THEN 'Cannot waive product in ' ELSE 'Cannot request reanalysis from ' END || status || ' state'"


@query("p05_review", f"SELECT *, CASE WHEN next_status IS NULL THEN {_REFUSED} END AS error FROM (SELECT *, {_NEXT} AS next_status FROM (SELECT o_orderkey AS product_id, {_STATUS} AS status, {_ACTION} AS action FROM orders))")
def p05(spark, d):
    actions = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.expr(_STATUS).alias("status"), F.expr(_ACTION).alias("action"))
    return X.review(actions).select("product_id", "status", "action", "next_status", "error")


_EVENTS = f"SELECT o_custkey AS product_id, o_orderkey AS seq, {_ACTION} AS action, o_orderkey % 3 = 0 AS bare, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"


@query("p06_decisions", f"""WITH RECURSIVE e AS MATERIALIZED ({_EVENTS}), f AS (
SELECT c_custkey AS product_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::VARCHAR AS before, 'needs_review' AS status, NULL::VARCHAR AS error FROM customer UNION ALL
SELECT product_id, n, seq, status, CASE WHEN err IS NULL AND NOT idle THEN nx ELSE status END, err FROM (SELECT *, CASE WHEN action = 'waive_with_reason' AND bare THEN 'waive_with_reason requires a reviewer comment' WHEN NOT idle AND nx IS NULL THEN {_REFUSED} END AS err
FROM (SELECT f.product_id, e.n, e.seq, f.status, e.action, e.bare, {_NEXT.replace('status IN', 'f.status IN').replace('status =', 'f.status =')} AS nx, (e.action = 'approve' AND f.status = 'approved') OR (e.action = 'reject' AND f.status = 'rejected') AS idle FROM f JOIN e ON e.product_id = f.product_id AND e.n = f.n + 1)))
SELECT product_id, seq, before, status AS after, error FROM f WHERE n > 0""")
def p06(spark, d):
    o = table(spark, d, "orders")
    events = o.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("seq"), F.expr(_ACTION).alias("action"), F.when(F.col("o_orderkey") % 3 != 0, "because").alias("comment"), F.lit(None).cast("string").alias("expected_hash"))
    states = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.lit("h").alias("content_hash"), F.lit("needs_review").alias("status"))
    return X.decide(states, events).select("product_id", "seq", "before", "after", "error")


@query("p08_checkpoints", "SELECT thread_id, seq, sum(c) OVER (PARTITION BY thread_id ORDER BY seq) AS version FROM (SELECT user_id AS thread_id, event_id AS seq, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events)")
def p08(spark, d):
    states = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return X.checkpoints(states).withColumn("version", F.col("version").cast("bigint"))


@query("p12_save_products", "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'approved' ELSE 'draft' END AS status FROM customer")
def p12(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("w").alias("workflow_id"), F.lit("h").alias("content_hash"))
    kept, _ = X.save_product(c.withColumn("status", F.lit("draft")), c.where("run_id % 3 = 0").withColumn("status", F.lit("approved")), F.lit(1))
    return kept.select("run_id", "status")


@query("t12_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def t12(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_STATUS).alias("status"), F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    return X.pending(rows).select("o_orderkey")


# Jobs, projects, sessions


@query("f11_expired_leases", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN CASE WHEN o_custkey % 5 >= 3 THEN 'quarantined' ELSE 'queued' END WHEN o_orderstatus = 'O' THEN 'running' ELSE 'complete' END AS status FROM orders")
def f11(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("complete").alias("status"), (F.col("o_custkey") % 5).alias("attempt_count"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").alias("lease_expires_at"))
    return X.expired_leases(jobs, F.lit("1996-01-01").cast("timestamp_ntz")).select("job_id", "status")


def _jobs(spark, d):
    o = table(spark, d, "orders")
    null = lambda kind: F.lit(None).cast(kind)
    return o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), F.col("o_orderdate").alias("started_at"), F.lit(0).alias("attempt_count"), F.when(F.col("o_orderstatus") == "F", "w1").alias("lease_owner"), null("timestamp_ntz").alias("lease_expires_at"))


@query("z01_claim", "WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT o.o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'O' OR n <= 3 THEN 'running' ELSE 'queued' END AS status, CASE WHEN n <= 3 THEN 1 ELSE 0 END AS attempt_count, CASE WHEN n <= 3 THEN 'w' || n WHEN o_orderstatus = 'F' THEN 'w1' END AS lease_owner, CASE WHEN n <= 3 THEN TIMESTAMP '2024-01-01 00:05:00' END AS lease_expires_at FROM orders o LEFT JOIN q ON q.o_orderkey = o.o_orderkey")
def z01(spark, d):
    return X.claim(_jobs(spark, d), ["w1", "w2", "w3"], F.lit("2024-01-01").cast("timestamp_ntz"), 300).drop("started_at")


@query("z02_heartbeat", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:02:00' END AS lease_expires_at FROM orders")
def z02(spark, d):
    jobs = _jobs(spark, d)
    beats = jobs.where("job_id % 2 = 0").select("job_id", F.lit("w1").alias("worker"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    return X.heartbeat(jobs, beats.unionByName(beats.withColumn("worker", F.lit("w2")).withColumn("at", F.lit("2025-01-01").cast("timestamp_ntz"))), 120).select("job_id", "lease_expires_at")


@query("k15_job_states", """WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN CASE WHEN event_id % 500 = 0 THEN 'completed' END WHEN 'error' THEN CASE WHEN event_id % 700 = 0 THEN 'failed' END END AS event FROM events),
x AS (SELECT *, CASE event WHEN 'claimed' THEN 'running' ELSE event END AS state FROM e WHERE event IS NOT NULL) SELECT job_id, coalesce(arg_min(state, seq) FILTER (WHERE state IN ('completed', 'failed')), arg_max(state, seq)) AS status, count(*) FILTER (WHERE event = 'claimed') AS attempts FROM x GROUP BY job_id""")
def k15(spark, d):
    kind = F.expr("CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN CASE WHEN event_id % 500 = 0 THEN 'completed' END WHEN 'error' THEN CASE WHEN event_id % 700 = 0 THEN 'failed' END END")
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.lit("").alias("error"))
    return X.job_states(e).select("job_id", "status", "attempts")


@query("f10_has_work", "SELECT c_custkey AS source_path, coalesce(bool_or(CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN o_orderkey % 3 = 1 ELSE false END), false) AS has_work FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def f10(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("source_path"), F.lit("p").alias("project_id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'failed' END").alias("status"), (F.col("o_orderkey") % 3).alias("documents_seen"))
    return X.has_work(jobs, table(spark, d, "customer").select(F.col("c_custkey").alias("source_path"), F.lit("p").alias("project_id"), F.lit(1).alias("expected"))).select("source_path", "has_work")


@query("a03_readiness", """SELECT c_custkey AS project_id, coalesce(d, 0) AS documents, coalesce(p, 0) AS processing, coalesce(f, 0) AS failed, CASE WHEN c_custkey % 11 = 0 THEN 'archived' WHEN coalesce(d, 0) > 0 THEN 'ready' WHEN coalesce(p, 0) > 0 THEN 'preparing' WHEN coalesce(f, 0) > 0 THEN 'failed' ELSE 'empty' END AS readiness
FROM customer LEFT JOIN (SELECT doc_id % 3000 AS k, count(*) AS d FROM documents GROUP BY 1) ON k = c_custkey LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS p, count(*) FILTER (WHERE o_orderstatus = 'P') AS f FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1) ON o_custkey = c_custkey""")
def a03(spark, d):
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 11 == 0, "archived").otherwise("active").alias("status"))
    jobs = table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("project_id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'failed' ELSE 'completed' END").alias("status"))
    return X.readiness(projects, table(spark, d, "documents").select((F.col("doc_id") % 3000).alias("project_id")), jobs)


@query("k14_project_slugs", "WITH n AS (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)) SELECT p_partkey, CASE WHEN k = 1 AND s <> 'brand-11' THEN s ELSE s || '-' || (k + CASE WHEN s = 'brand-11' THEN CASE WHEN k >= 2 THEN 2 ELSE 1 END ELSE 0 END) END AS slug FROM n")
def k14(spark, d):
    existing = spark.createDataFrame([("brand-11",), ("brand-11-3",)], "slug string")
    return X.create_projects(existing, table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name"))).select(F.col("seq").alias("p_partkey"), "slug")


@query("k14_project_updates", "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey <> 3 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey <> 3 THEN 'archived' ELSE 'active' END AS status FROM customer")
def k14b(spark, d):
    c = table(spark, d, "customer")
    projects = c.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.lit("d").alias("description"), F.lit("active").alias("status"), (F.col("c_custkey") == 3).alias("is_sample"))
    changes = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"), F.lit(" new ").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(True).alias("archive"))
    return X.update_projects(projects, changes).select("project_id", "name", "status")


@query("t11_project_list", "SELECT c_custkey AS project_id FROM customer ORDER BY c_custkey = 7 DESC, c_acctbal DESC, c_custkey LIMIT 100")
def t11(spark, d):
    return X.project_list(table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") == 7).alias("is_sample"), F.col("c_acctbal").alias("updated_at"))).select("project_id")


@query("e23_writable", "SELECT o_orderkey AS qid, CASE WHEN c_custkey IS NULL THEN 'Project not found' WHEN c_custkey % 5 = 0 THEN 'Project is archived' WHEN o_orderkey % 3 = 0 THEN 'Conversation belongs to another project' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 <> 0")
def e23(spark, d):
    o = table(spark, d, "orders")
    projects = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 5 == 0, "archived").otherwise("active").alias("status"))
    sessions = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).alias("project_id"))
    return X.writable(o.select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("session_id")), projects, sessions)


@query("k13_sessions", "SELECT conv_id AS session_id, CASE WHEN conv_id % 4 = 0 THEN 'b' ELSE 'a' END AS project_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 4 <> 0 THEN 2 ELSE 0 END AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations) WHERE NOT (conv_id % 4 = 0 AND conv_id % 3 = 0)")
def k13(spark, d):
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    old = ids.select("session_id", F.when(F.col("session_id") % 4 == 0, "b").otherwise("a").alias("project_id"), F.lit(0).alias("updated_at"))
    new = ids.where("session_id % 2 = 0").select("session_id", F.lit("a").alias("project_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("updated_at"))
    saved, _ = X.save_sessions(old, new)
    left, _ = X.delete_sessions(saved, ids.where("session_id % 3 = 0").select("session_id", F.lit("b").alias("project_id")))
    return left


@query("z07_admission")
def z07(spark, d):
    """A simulation of bounded admission over the events of each user; SQL has no fold over what was admitted."""
    e = table(spark, d, "events").select(F.col("user_id").alias("gate"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.lit(60_000.0).alias("seconds"))
    return X.admit(e.withColumn("at", F.col("at") / 1000))


@query("p09_event_log", f"""WITH RECURSIVE e AS MATERIALIZED ({_EVENTS}), f AS (
SELECT c_custkey AS product_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::VARCHAR AS before, 'needs_review' AS status, NULL::VARCHAR AS error, NULL::VARCHAR AS action FROM customer UNION ALL
SELECT product_id, n, seq, status, CASE WHEN err IS NULL AND NOT idle THEN nx ELSE status END, err, action FROM (SELECT *, CASE WHEN action = 'waive_with_reason' AND bare THEN 'x' WHEN NOT idle AND nx IS NULL THEN 'x' END AS err
FROM (SELECT f.product_id, e.n, e.seq, f.status, e.action, e.bare, {_NEXT.replace('status IN', 'f.status IN').replace('status =', 'f.status =').replace('action', 'e.action')} AS nx, (e.action = 'approve' AND f.status = 'approved') OR (e.action = 'reject' AND f.status = 'rejected') AS idle FROM f JOIN e ON e.product_id = f.product_id AND e.n = f.n + 1)))
SELECT product_id, seq, action, sha256('h:' || before) AS before_hash, sha256('h:' || status) AS after_hash FROM f WHERE n > 0 AND error IS NULL AND before <> status""")
def p09(spark, d):
    o = table(spark, d, "orders")
    events = o.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("seq"), F.expr(_ACTION).alias("action"), F.when(F.col("o_orderkey") % 3 != 0, "because").alias("comment"), F.lit(None).cast("string").alias("expected_hash"), F.lit("me").alias("actor"))
    states = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.lit("h").alias("content_hash"), F.lit("needs_review").alias("status"))
    return X.event_log(events, X.decide(states, events)).select("product_id", "seq", "action", "before_hash", "after_hash")


@query("i17_bootstrap", "SELECT c_custkey AS source_path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey % 3 = 1))")
def i17(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("source_path"), F.lit("p").alias("project_id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'failed' END").alias("status"), (F.col("o_orderkey") % 3).alias("documents_seen"))
    return X.bootstrap(table(spark, d, "customer").select(F.col("c_custkey").alias("source_path"), F.lit("p").alias("project_id"), F.lit(1).alias("expected")), jobs).select("source_path")


@query("z05_response_events", """SELECT event_id AS qid, 0 AS position, '{"event":"start","qid":' || event_id || '}' AS line FROM events UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'error' THEN '{"event":"error","qid":' || event_id || ',"message":"down"}' ELSE '{"event":"complete","qid":' || event_id || ',"answer":"yes"}' END FROM events""")
def z05(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("qid"), F.lit("yes").alias("answer"), F.when(F.col("event_type") == "error", "down").alias("error"))
    return X.response_events(e)
