from __future__ import annotations

import json
from datetime import datetime

import duckdb
import pytest

from strandkg.functions.plaintext import plain_form
from strandkg.operators import nested, orphans
from strandkg.plans import records
from strandkg.schema import KG

LOG = "row_id long, extraction_result struct<entities: array<struct<name: string, type: string>>, relations: array<struct<head: string, relation: string, tail: string>>>, ingested_at timestamp, key string, status string"
NODES = "id string, label string, created_at timestamp, deleted_at timestamp, spans string"


def at(month):
    return datetime(2025, month, 5)


def test_orphans_by_hand(spark, rows):
    ents, rels = [("甲", "t"), None, (None, "t")], [("甲", "r", "乙"), None, ("丙", None, None), ("丁", "r", "戊")]
    log = spark.createDataFrame([(1, (ents, rels), at(6), "x", "y"), (2, None, at(6), "x", "y"), (3, (None, [("丁", "r", "甲")]), at(3), "x", "y"), (3, (None, [("丁", "r", "甲")]), at(3), "x", "y")], LOG)
    nodes = spark.createDataFrame(
        [("乙", "a", at(1), None, ""), ("丙", "a", at(1), at(2), ""), ("丙", "a", at(7), None, ""), ("丁", "a", at(4), None, ""), (None, "a", at(1), None, "")], NODES
    )
    found = orphans.find_orphans(orphans.open_references(log), nodes)
    assert rows(found.select("row_id", "rel_pos", "side", "status")) == [(1, 2, "head", "deleted"), (1, 3, "tail", "missing"), (3, 0, "head", "late"), (3, 0, "head", "late"), (3, 0, "tail", "missing"), (3, 0, "tail", "missing")]


def test_heavy_keys_give_the_same(spark, rows, monkeypatch, small):
    refs = orphans.open_references(spark.read.parquet(f"{small}/results_extraction.parquet"))
    nodes = spark.read.parquet(f"{small}/kg_nodes.parquet")
    light = rows(orphans.find_orphans(refs, nodes))
    monkeypatch.setattr(orphans, "HEAVY", 0)
    assert rows(orphans.find_orphans(refs, nodes, heavy_share=0.0)) == light
    assert light


def test_an_id_created_again_very_often(spark, rows):
    lives = [("乙", "a", datetime(2024, 1, d), datetime(2024, 1, d, 12), "") for d in range(1, 29)] * 2
    nodes = spark.createDataFrame(lives, NODES)
    log = spark.createDataFrame([(i, ([], [("乙", "r", None)]), when, "", "") for i, when in enumerate([datetime(2023, 1, 1), datetime(2024, 1, 9, 6), datetime(2024, 1, 9, 18), datetime(2024, 1, 9, 18)])], LOG)
    found = orphans.find_orphans(orphans.open_references(log), nodes)
    assert rows(found.select("row_id", "status")) == [(0, "late"), (2, "deleted"), (3, "deleted")]


def test_orphans_empty(spark):
    none = spark.createDataFrame([], LOG)
    refs = orphans.open_references(none)
    assert orphans.find_orphans(refs, spark.createDataFrame([], NODES)).count() == 0
    assert orphans.orphan_report(refs, spark.createDataFrame([], NODES), "t").count() == 0


def test_report_counts_keys_exactly(spark, rows):
    refs = spark.range(3000).selectExpr("id as row_id", "0 as rel_pos", "'head' as side", "concat('k', id % 1500) as key", "timestamp'2025-06-05' as at")
    report = orphans.orphan_report(refs, spark.createDataFrame([("k0", "a", at(1), None, "")], NODES), "t")
    assert rows(report.select("period", "side", "status", "n_orphans", "n_keys", "n_open")) == [("2025-06", "head", "missing", 2998, 1499, 3000)]


def test_references_without_a_time(spark, rows):
    refs = spark.createDataFrame([(1, 0, "head", "a", None), (2, 0, "head", "b", None), (3, 0, "head", "c", None), (4, 0, "head", "a", at(3))], "row_id long, rel_pos int, side string, key string, at timestamp_ntz")
    nodes = spark.createDataFrame([("a", "", at(1), None, ""), ("b", "", None, None, "")], NODES)
    assert rows(orphans.find_orphans(refs, nodes).select("row_id", "status")) == [(1, "late"), (3, "missing")]
    assert rows(orphans.orphan_report(refs, nodes, "t").drop("table")) == [(None, "head", "late", 1, 1, 3), (None, "head", "missing", 1, 1, 3)]


def test_report_counts_the_rows(spark, rows, small):
    d = small.replace("sf0.001", "sf0.01")
    got = {tuple(r)[1:5] for r in records.p2_report(spark, d).collect()}
    want = {}
    for _, _, side, status, period in _brute_orphans(d):
        want[period, side, status] = want.get((period, side, status), 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def _brute_orphans(d):
    c = duckdb.connect()
    nodes = {}
    for i, born, gone in c.execute(f"select id, created_at, deleted_at from '{d}/kg_nodes.parquet'").fetchall():
        nodes.setdefault(plain_form(i), []).append((born, gone))
    out = []
    for row_id, result, when in c.execute(f"select row_id, extraction_result, ingested_at from '{d}/results_extraction.parquet'").fetchall():
        own = {plain_form(e["name"]) for e in (result or {}).get("entities") or [] if e and e["name"] is not None}
        for pos, r in enumerate((result or {}).get("relations") or []):
            for side in ("head", "tail"):
                end = plain_form((r or {}).get(side))
                if end is None or end in own:
                    continue
                spans = nodes.get(end)
                if spans and any(b <= when and not (g and g <= when) for b, g in spans):
                    continue
                status = "missing" if not spans else "deleted" if any(g and g <= when for _, g in spans) else "late"
                out.append((row_id, pos, side, status, when.strftime("%Y-%m")))
    return sorted(out, key=repr)


def test_orphans_brute_force(spark, rows, small):
    d = small.replace("sf0.001", "sf0.01")
    assert rows(records.p2_found(spark, d)) == _brute_orphans(d)


BODY = {
    "batch": {"no": 1, "model": "m"},
    "items": [
        {"doc_id": "a", "extraction_result": {"entities": [{"name": "甲", "mentions": [{"start": 0, "end": 1}]}, None, {"name": "甲"}, {"name": "Ａ"}], "relations": {"head": "A", "relation": "r", "tail": None}}},
        None,
        {"doc_id": "b", "extraction_result": json.dumps({"entities": {"name": "乙"}, "relations": [None, {"head": "乙", "tail": "丙"}, {}]})},
        {"doc_id": "c", "extraction_result": "not json"},
    ],
}


@pytest.mark.parametrize("wrap", [lambda t: t, lambda t: f"```json\n{t}\n```", lambda t: "﻿" + t, json.dumps, lambda t: f"Here it is: {t} Done."])
def test_nested_shapes(spark, rows, wrap):
    body = wrap(json.dumps(BODY, ensure_ascii=False))
    emitted = nested.emit_rows(spark.createDataFrame([("payload", 7, body), ("payload", 8, None), ("payload", 9, body[: len(body) // 2]), ("payload", 10, "sorry")], "origin string, rec_id long, body string"))
    found = nested.as_table(emitted, "relation")
    assert rows(found.select("rec_id", "item_pos", "pos", "head_pos", "tail_pos")) == [(7, 0, 0, 3, -1), (7, 2, 1, 0, -1), (7, 2, 2, -1, -1)]
    assert rows(nested.as_table(emitted, "entity").select("pk", "parent_key", "name")) == [("payload/7/i0/e0", "payload/7/i0", "甲"), ("payload/7/i0/e2", "payload/7/i0", "甲"), ("payload/7/i0/e3", "payload/7/i0", "Ａ"), ("payload/7/i2/e0", "payload/7/i2", "乙")]
    assert rows(nested.as_table(emitted, "mention").select("parent_key", "start", "end")) == [("payload/7/i0/e0", 0, 1)]
    keys = {r["pk"] for r in emitted.collect()}
    assert all(r["parent_key"] is None or r["parent_key"] in keys for r in emitted.collect())


def test_nested_log_round_trip(spark, small, tmp_path):
    """All of the log comes back from its flat tables."""
    d = small
    log = spark.read.parquet(f"{d}/results_extraction.parquet").select("row_id", "extraction_result")
    nested.write_tables(nested.emit_rows(nested.log_bodies(log)), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    ents = {(r["rec_id"], r["pos"]): (r["name"], r["type"]) for r in nested.as_table(stored, "entity").collect()}
    rels = {(r["rec_id"], r["pos"]): r for r in nested.as_table(stored, "relation").collect()}
    want_e, want_r = {}, {}
    for row in log.collect():
        result = row["extraction_result"]
        for i, e in enumerate((result["entities"] if result else None) or []):
            if e is not None:
                want_e[row["row_id"], i] = (e["name"], e["type"])
        for i, r in enumerate((result["relations"] if result else None) or []):
            if r is not None:
                want_r[row["row_id"], i] = (r["head"], r["relation"], r["tail"])
    assert ents == want_e
    assert {k: (r["head"], r["relation"], r["tail"]) for k, r in rels.items()} == want_r
    for (rec, _), r in rels.items():
        for end in ("head", "tail"):
            names = [plain_form(n) for (q, _), (n, _) in sorted(want_e.items()) if q == rec]
            p = r[f"{end}_pos"]
            assert (p == -1) == (r[end] is None or plain_form(r[end]) not in names)
            assert p == -1 or plain_form(ents[rec, p][0]) == plain_form(r[end])


def test_nested_empty_and_null(spark):
    assert nested.emit_rows(spark.createDataFrame([], "origin string, rec_id long, body string, tag string")).count() == 0
    log = spark.createDataFrame([(1, None), (2, (None, None)), (3, ([], []))], f"row_id long, extraction_result {KG.simpleString()}")
    assert nested.emit_rows(nested.log_bodies(log), {"relation", "entity"}).count() == 0
