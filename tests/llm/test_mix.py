from __future__ import annotations

import random

import pytest

from strandkg.llm import mix

T = "source string, weight double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, s, "word " * r.randint(1, 120)) for i, s in enumerate(r.choices(["a", "b", "c"], [6, 3, 1], k=3000))]
    return spark.createDataFrame([*rows, (9001, None, "x y"), (9002, "a", None), (9003, "other", "z"), (9004, "a", "")], "doc_id long, source string, text string")


def test_shares_and_caps(spark, docs):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 4), ("missing", 0.0, 1)], T)
    mixed, report = mix.mixture(docs, targets, 100_000.0)
    got = {r["source"]: r for r in report.collect()}
    for s, w in (("a", 0.3), ("b", 0.3)):
        assert abs(got[s]["actual_tokens"] / (100_000 * w) - 1) < 0.01
    assert got["missing"]["actual_tokens"] == 0
    most = {r["source"]: r["m"] for r in mixed.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4
    assert mixed.where("n_tokens = 0 and copies > 0").count() == 0 and mixed.where("copies < 0").count() == 0
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


def test_a_source_that_falls_short_gives_all(spark, docs):
    targets = spark.createDataFrame([("a", 0.1, 1), ("c", 0.9, 2)], T)
    mixed, report = mix.mixture(docs, targets, 1_000_000.0)
    c = report.where("source = 'c'").first()
    assert c["actual_tokens"] == 2 * c["available_tokens"] < c["target_tokens"]


def test_largest_feasible_total(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 3)], T)
    report = {r["source"]: r for r in mix.mixture(docs, targets)[1].collect()}
    assert all(abs(r["actual_share"] - r["weight"]) < 0.01 for r in report.values())


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["水位上涨", "a<|endoftext|>b", "", None]
    got = [r["n_tokens"] for r in mix.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "'s' as source", "text")).orderBy("doc_id").collect()]
    t = Tokenizer.from_file(mix.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert got == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


def test_both_kinds_of_files_count_alike():
    ranks, other = mix._counter(mix.TOKENIZER), mix._counter(mix.TOKENIZER.replace(".tiktoken", ".json"))
    for text in ("水位上涨 12.5 米。\n\nThe dam's held,  didn't it?", "a" + " " * 12_000 + "b", "\n" * 400_000 + "x", "字" * 20_000, "é\u3000\u200b🌊"):
        assert ranks(text) == other(text)


def test_steps_that_do_not_settle_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(mix, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError, match="settle"):
        mix.mixture(docs, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], T), 50_000.0)


def test_a_source_named_twice(spark, docs):
    once = mix.mixture(docs, spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 3)], T), 50_000.0)[1]
    twice = mix.mixture(docs, spark.createDataFrame([("a", 0.2, 3), ("a", 0.4, 1), ("b", 0.4, 3)], T), 50_000.0)[1]
    assert [tuple(r)[4:] for r in once.orderBy("source").collect()] == [tuple(r)[4:] for r in twice.orderBy("source").collect()]


def test_null_targets_and_empty_tables(spark, docs):
    targets = spark.createDataFrame([("a", None, None), (None, 0.5, 1)], T)
    assert mix.mixture(docs, targets, 1000.0)[1].first()["actual_tokens"] == 0
    assert mix.mixture(docs, targets.limit(0), 1000.0)[1].count() == 0
    mixed, report = mix.mixture(docs.limit(0), targets)
    assert mixed.count() == 0 and report.count() == 1
