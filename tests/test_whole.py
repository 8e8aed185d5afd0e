"""Queries that cover whole tables: no question is left out."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


def _asked(spark, small, column):
    return sorted(r[0] for r in spark.read.parquet(f"{small}/qa_eval.parquet").select(column).collect())


@pytest.mark.parametrize("name", ["answer_offline", "engine_answer", "graph_rag_context", "vector_graph_rag_context"])
def test_every_question_has_a_row(spark, small, name):
    assert sorted(r["qid"] for r in entry.queries()[name](spark, small).select("qid").collect()) == _asked(spark, small, "qid")


def test_qa_comparison_has_every_question(spark, small):
    assert sorted(r["question"] for r in entry.queries()["qa_comparison"](spark, small).select("question").collect()) == _asked(spark, small, "question")


@pytest.mark.parametrize("name", ["engine_answer", "qa_comparison"])
def test_a_question_without_an_id_has_a_row(spark, small, tmp_path, name):
    for table in ("sample_events", "qa_eval"):
        rows = spark.read.parquet(f"{small}/{table}.parquet").limit(40)
        (rows.selectExpr("nullif(qid, 'q000000001') as qid", "question", "gold_answer") if table == "qa_eval" else rows).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).count() == 40
