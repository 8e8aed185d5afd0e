"""Evaluation: hit rate, method comparison, extraction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.operators import chat


def hits_gold(top: DataFrame, records: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, hit): whether the best record's impact contains the gold answer. An empty gold answer is contained in all."""
    best = top.where("rank = 1").join(records.select("id", "impact"), "id")
    return gold.select("qid", "gold_answer").join(best.select("qid", "impact"), "qid", "left").select("qid", F.coalesce(F.contains("impact", "gold_answer"), F.lit(False)).alias("hit"))


def hit_rate(hits: DataFrame) -> DataFrame:
    """(n, n_hit, hit_rate); the rate of no questions is 0."""
    return hits.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"), F.coalesce(F.round(F.avg(F.col("hit").cast("double")), 6), F.lit(0.0)).alias("hit_rate"))


def compare(questions: DataFrame, baseline: DataFrame, graph: DataFrame, config: dict | None = None, **prompts: str) -> DataFrame:
    """(question, baseline_answer, graphrag_answer, baseline_context_len, graph_context_triples); answers null without a model configuration."""
    none = F.lit(None).cast("string").alias("draft_answer")
    answered = lambda c: chat.answer(c, config, **prompts) if config else c.select("qid", none)

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Joined by ``qid``, which may be null."""
        return a.join(b.withColumnRenamed("qid", "of"), F.col("qid").eqNullSafe(F.col("of"))).drop("of")

    left = both(baseline.select("qid", F.length("context").alias("baseline_context_len")), answered(baseline).withColumnRenamed("draft_answer", "baseline_answer"))
    right = both(graph.select("qid", F.col("n_lines").alias("graph_context_triples")), answered(graph).withColumnRenamed("draft_answer", "graphrag_answer"))
    return both(both(questions.select("qid", F.col("text").alias("question")), left), right).select("question", "baseline_answer", "graphrag_answer", "baseline_context_len", "graph_context_triples")


def extraction_log(texts: DataFrame, config: dict, **prompts: str) -> DataFrame:
    """(doc_id, raw_text, extraction_result, latency)."""
    return texts.select("doc_id", F.col("text").alias("raw_text")).join(chat.extract(texts, config, **prompts).drop("status"), "doc_id")
