from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def _norm(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: "NULL" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    got = df.collect()
    want = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _norm(df.columns, got) == _norm(columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _around(edges, seeds, hops):
    """The induced edges within ``hops`` of ``seeds``, by brute force."""
    near = set(seeds)
    for _ in range(hops):
        near |= {b for s, _, t in edges for a, b in ((s, t), (t, s)) if a in near}
    return sorted(f"- {s} {r} {t}" for s, r, t in edges if s in near and t in near)


def test_graph_contexts_by_brute_force(spark, small):
    q = entry.queries()
    edges = [tuple(r) for r in q["kg_edges_events"](spark, small).select("src", "rel", "dst").collect()]
    ids = {r["seq"]: r["id"] for r in spark.read.parquet(f"{small}/sample_events.parquet").select("seq", "id").collect()}
    seeds = {}
    for r in q["bm25_topk_batch"](spark, small).collect():
        seeds.setdefault(r["qid"], []).append(ids[r["id"]])
    want = {k: _around(edges, [x for x in v if x], 2) for k, v in seeds.items()}
    got = {r["qid"]: r for r in q["graph_rag_context"](spark, small).collect()}
    assert {k: r["context"].split("\n") for k, r in got.items()} == want and {k: r["n_lines"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert [tuple(r) for r in entry.entry(spark).select("qid", "n_lines").collect()] == [(k, len(v)) for k, v in want.items()]


def test_written_once_until_the_files_change(spark, tmp_path):
    from strandkg.session import once, shared_dir

    spark.range(1).write.mode("overwrite").parquet(f"{shared_dir(spark)}/strandkg/any")
    made = []
    make = lambda: made.append(1) or len(made)
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert [once(spark, str(tmp_path), "x", ("t",), make) for _ in range(2)] == [1, 1]
    assert once(spark, str(tmp_path), "y", ("t",), make) == 2
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert once(spark, str(tmp_path), "x", ("t",), make) == 3


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **kw):
            if name == "strandkg.llm":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **kw)

        return load

    monkeypatch.setattr(builtins, "__import__", without("strandkg.llm"))
    assert not any(n.startswith("p1_") for n in entry.queries()) and "p2_found" in entry.queries()
    monkeypatch.setattr(builtins, "__import__", without("ahocorasick"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def _no_edge_listed(monkeypatch):
    """An error wherever the edges of each question are listed."""
    from strandkg.operators import graph

    def listed(*args, **kw):
        raise AssertionError("the edges of each question were listed")

    monkeypatch.setattr(graph, "hop_subgraph", listed)


def _equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert _norm(df.columns, df.collect()) == _norm(columns, want.fetchall())


def test_answer_offline_lists_no_edges(spark, duck, small, monkeypatch):
    _no_edge_listed(monkeypatch)
    _equals_sql(spark, duck, small, "answer_offline")


def test_qa_comparison_lists_no_edges_and_searches_once(spark, duck, small, monkeypatch):
    from strandkg.operators import vector

    _no_edge_listed(monkeypatch)
    searched, top_k = [], vector.top_k
    monkeypatch.setattr(vector, "top_k", lambda *args, **kw: searched.append(1) or top_k(*args, **kw))
    _equals_sql(spark, duck, small, "qa_comparison")
    assert len(searched) == 1


def test_engine_answer_lists_no_edges(spark, duck, small, monkeypatch):
    _no_edge_listed(monkeypatch)
    _equals_sql(spark, duck, small, "engine_answer")


@pytest.mark.parametrize("name", ["graph_rag_context", "vector_graph_rag_context"])
def test_contexts_write_no_edges_by_question(spark, duck, small, monkeypatch, name):
    from strandkg.operators import graph

    written = graph.written

    def checked(df, *args):
        assert not {"qid", "src"} <= set(df.columns)
        return written(df, *args)

    monkeypatch.setattr(graph, "written", checked)
    _equals_sql(spark, duck, small, name)
