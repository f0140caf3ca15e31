"""The library as one object: ingest a folder, search, answer, verify, remember, evaluate and turn answers into work products, as plans over its tables.

Documents, chunks and the contexts of questions are written as Parquet once they are made, below the folder that spark.checkpoint.dir names (a temporary one in local mode), since later
plans read them many times over.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, evidence, ingest, retrieval, workflows
from ..sources import loaders


class Engine:
    def __init__(self, spark: SparkSession, project: str = "default", size: int = ingest.SIZE, overlap: int = ingest.OVERLAP):
        self.spark, self.project, self.size, self.overlap = spark, project, size, overlap
        self.documents: DataFrame | None = None
        self.chunks: DataFrame | None = None

    def _kept(self, df: DataFrame, kind: str) -> DataFrame:
        at = self.spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = "file://" + os.path.join(tempfile.gettempdir(), "evidrift-tables")
        path = f"{at.rstrip('/')}/engine/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Ingestion

    def ingest(self, path: str, force: bool = False, **limits: int) -> DataFrame:
        """Loads a file or folder; returns its documents with their action against what the engine holds."""
        loaded = loaders.load(self.spark, path, **limits).withColumn("project_id", F.lit(self.project))
        return self.add(loaded, force)

    def add(self, loaded: DataFrame, force: bool = False) -> DataFrame:
        """loaded: source_uri, title, text, access_policy, published_at. The documents with their action; unchanged ones are skipped unless forced."""
        loaded = self._kept(loaded.withColumn("project_id", F.lit(self.project)).dropDuplicates(["project_id", "source_uri"]), "loaded")
        more = [c for c in ("access_policy", "published_at") if c in loaded.columns]
        docs = ingest.canonical(loaded).join(loaded.select("project_id", "source_uri", *more), ["project_id", "source_uri"])
        if self.documents is None:
            acted = docs.withColumn("action", F.lit("index"))
            self.documents = self._kept(docs, "documents")
        else:
            acted = self._kept(ingest.classify_incoming(docs, self.documents, force), "actions")
            self.documents = self._kept(self.documents.join(docs, ["project_id", "source_uri"], "left_anti").unionByName(docs, allowMissingColumns=True), "documents")
        parts = ingest.with_sections(ingest.chunks(self.documents, self.size, self.overlap).drop("content_hash"), self.documents)
        rest = [c for c in ("access_policy", "published_at") if c in self.documents.columns]
        chunks = parts.join(self.documents.select("document_id", "project_id", "title", "source_uri", "content_hash", *rest), "document_id").withColumn("is_current", F.lit(True)).withColumn("location_marker", T.location_marker(F.lit(None), F.col("char_start"), F.col("char_end")))
        self.chunks = self._kept(chunks, "chunks")
        return acted

    # Retrieval

    def search(self, queries: DataFrame, k: int = 5, strategy: str = "hybrid", source_uris: list[str] | None = None, decompose: bool = False, **filters) -> DataFrame:
        """queries: qid, query. strategy: hybrid, dense or sparse. Filters are those of retrieval.filtered; an empty one filters nothing. With decompose the parts of each query are searched too, and merged."""
        own = retrieval.filtered(self.chunks, self.project, source_uri=source_uris or [], **filters)
        return (retrieval.decomposed_search if decompose else retrieval.search)(queries, own, k, strategy)

    def expand(self, hits: DataFrame) -> DataFrame:
        return retrieval.expand(hits, self.chunks)

    # Answers

    def contexts(self, queries: DataFrame, k: int = 5, **options) -> DataFrame:
        """qid, rank, chunk_id, document_id, title, source_uri, location_marker, text, score of the contexts of each query."""
        hits = self.search(queries, k, **options)
        place = "rank" if "rank" in hits.columns else "position"
        hits = hits.select("qid", "chunk_id", "document_id", "score", F.col(place).alias("rank"))
        return evidence.contexts(hits.join(self.chunks.select("chunk_id", "title", "source_uri", "location_marker", "text"), "chunk_id"))

    def answer(self, queries: DataFrame, k: int = 3, **options) -> DataFrame:
        return evidence.extractive_answer(self.contexts(queries, k, **options), queries)

    def research(self, queries: DataFrame, k: int = 5, **options) -> dict[str, DataFrame]:
        """The whole way of a question: plan, contexts, answers, citations, claims, verified citations, overall verdicts and final answers. Conversational queries are not searched."""
        planned = evidence.plan(queries)
        asked = planned.where("retrieval_required").select("qid", "query")
        contexts = self._kept(self.contexts(asked, k, decompose=True, **options), "contexts")
        answers = self._kept(evidence.extractive_answer(contexts, asked), "answers")
        texts = answers.select(F.col("qid").alias("answer_id"), F.col("answer").alias("text"), "limitations")
        cited = evidence.citations(contexts).withColumnRenamed("qid", "answer_id")
        claimed = evidence.claims(texts, cited)
        selected = evidence.select_evidence(claimed, contexts.select(F.col("qid").alias("answer_id"), F.col("chunk_id").alias("context_id"), "rank", "text", "score"))
        decisions = evidence.verdicts(selected, claimed)
        rows = cited.select("answer_id", F.col("rank").alias("citation_no"), F.col("support_span").alias("span"), F.col("text").alias("context"), F.lit(False).alias("web"), F.lit(True).alias("fetched"))
        checked = evidence.verify_citations(evidence.best_claims(texts, rows)).unionByName(evidence.unattributed(texts, rows))
        verified = self._kept(evidence.apply_decisions(checked, decisions), "verified")
        overall = evidence.overall(verified)
        guarded = evidence.refine(texts.join(asked.withColumnRenamed("qid", "answer_id"), "answer_id"), verified)
        final = texts.drop("limitations").join(overall, "answer_id").join(guarded.withColumnRenamed("text", "guarded"), "answer_id")
        held = F.col("overall") == "supported"
        final = final.select("answer_id", F.when(held, F.col("text")).otherwise(F.col("guarded")).alias("text"), F.when(held, "supported").otherwise(F.col("status")).alias("status"), "overall", "coverage", "contradictions")
        return {"plan": planned, "contexts": contexts, "answers": answers, "citations": cited, "claims": claimed, "decisions": decisions, "verified": verified, "overall": overall, "final": final}

    def product(self, found: dict[str, DataFrame], workflow: str) -> DataFrame:
        """The work products of answers that research has given."""
        runs = found["final"].select(F.col("answer_id").alias("run_id"), F.lit(workflow).alias("workflow_id"), F.col("text").alias("summary"), F.lit("").alias("limitations"))
        name = F.concat(F.lit("C"), F.col("citation_no").cast("string")).alias("citation_id")
        verified = found["verified"].select(F.col("answer_id").alias("run_id"), F.col("citation_no").alias("claim_no"), "claim", "verdict", "confidence", name)
        cited = found["citations"].select(F.col("answer_id").alias("run_id"), "citation_id", "chunk_id", "document_id", F.array().cast("array<string>").alias("anchor_ids"))
        return workflows.products(runs, workflows.findings(runs, verified, cited), cited)

    # Evaluation

    def evaluate(self, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """cases: as loaders.evaluation_cases gives them. The metrics of every case (case_id, metric, value), and the rules that are broken."""
        asked = cases.select(F.col("eval_case_id").alias("qid"), F.col("question").alias("query"))
        found = self.research(asked, 5)
        hits = found["contexts"].select(F.col("qid").alias("case_id"), "rank", "chunk_id", "document_id", "source_uri")
        expected = loaders.expectations(cases)
        metrics = analysis.retrieval_metrics(analysis.relevance(hits, expected), expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected")))
        own = cases.select(F.col("eval_case_id").alias("case_id"), F.map_values("expected_claim_verdicts").alias("expected_verdicts"), "requires_abstention", "requires_review")
        own = own.join(found["final"].select(F.col("answer_id").alias("case_id"), "status"), "case_id", "left")
        claims = analysis.claim_metrics(own, found["verified"].withColumnRenamed("answer_id", "case_id"))
        cited = found["citations"].withColumnRenamed("answer_id", "case_id")
        long = [analysis.long_metrics(m, "case_id") for m in (metrics, claims, analysis.citation_metrics(own, cited, hits))]
        every = long[0].unionByName(long[1]).unionByName(long[2])
        return every, analysis.failures(every, own)

