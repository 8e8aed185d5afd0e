from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strandkg import schema
from strandkg.operators import chat, context, graph, vector
from strandkg.operators.bm25 import Bm25Index
from strandkg.plans import evaluate, rag
from strandkg.sources import readers
from strandkg.sources.sinks import GraphStore, write_graph_database, write_graphml, write_json, write_report
from strandkg.streaming.ingest import ingest

EVENTS = [
    ("e1", "flood", "甲县", "2020-07", "淹没农田", "暴雨", "转移", "年鉴"),
    ("e2", "drought", "乙县", "2022-08", "水库见底", "少雨", "调水", "年鉴"),
    ("e3", "quake", "丙县", "2008-05", "房屋倒塌", "断层", "救援", "年鉴"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, schema.EVENT)


def _hops(spark, events, ids, hops):
    edges = graph.event_edges(events, "id", schema.EVENT_ONTOLOGY)
    seeds = spark.createDataFrame([(1, i) for i in ids], "qid int, id string")
    return graph.hop_nodes(edges, seeds, hops).count(), graph.hop_subgraph(edges, seeds, hops).count()


def test_three_events_that_share_a_source(spark, events):
    nodes, edges = graph.event_nodes(events, "id", schema.EVENT_ONTOLOGY), graph.event_edges(events, "id", schema.EVENT_ONTOLOGY)
    assert tuple(graph.graph_size(nodes, edges).first()) == (19, 18)
    assert [_hops(spark, events, ["e1"], h) for h in range(5)] == [(1, 0), (7, 6), (9, 8), (19, 18), (19, 18)]
    assert [_hops(spark, events, ["e1", "e2", "e3"], h) for h in range(3)] == [(3, 0), (19, 18), (19, 18)]
    assert [_hops(spark, events, ["source_年鉴"], h) for h in range(4)] == [(1, 0), (4, 3), (19, 18), (19, 18)]


def test_absent_attributes_and_ids(spark, rows):
    df = spark.createDataFrame([("a", None, "", "t", None, None, None, None), (None, "x", "l", "t", None, None, None, None), ("", "x", "l", "t", None, None, None, None)], schema.EVENT)
    assert rows(graph.event_edges(df, "id", schema.EVENT_ONTOLOGY)) == [("a", "occurs_on", "time_t")]


def test_induced_edges_between_boundary_nodes(spark, rows):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("b", "x", "c"), ("c", "y", "d"), ("a", "s", "a")], schema.EDGE)
    seeds = spark.createDataFrame([(1, "a"), (2, "nowhere")], "qid int, id string")
    assert rows(graph.hop_subgraph(edges, seeds, 1)) == [(1, "a", "r", "b"), (1, "a", "r", "c"), (1, "a", "s", "a"), (1, "b", "x", "c")]


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_subgraphs_of_random_graphs(spark, hops):
    import random

    r = random.Random(hops)
    edges = {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(80)}
    seeds = [(q, f"n{r.randrange(60)}") for q in range(6) for _ in range(2)]
    want = set()
    for q in range(6):
        near = {n for k, n in seeds if k == q}
        for _ in range(hops):
            near |= {b for s, t in edges for a, b in ((s, t), (t, s)) if a in near}
        want |= {(q, s, t) for s, t in edges if s in near and t in near}
    df = spark.createDataFrame([(s, "r", t) for s, t in edges], schema.EDGE)
    got = [tuple(x) for x in graph.hop_subgraph(df, spark.createDataFrame(seeds, "qid int, id string"), hops).select("qid", "src", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_entity_graph_keeps_unlisted_ends(spark, rows):
    kg = spark.createDataFrame([([("a", "T"), ("b", None)], [("a", "r1", "b"), ("a", "r2", "b"), ("b", "r", "z"), ("b", "r", None)])], schema.KG)
    nodes, edges = graph.entity_graph(kg)
    assert rows(nodes) == [("a", "T"), ("b", None), ("z", None)]
    assert rows(edges) == [("a", "r2", "b"), ("b", "r", "z")]


def test_triples_default_relation(spark, rows):
    assert rows(graph.triples(spark.createDataFrame([("a", None, "b")], schema.EDGE))) == [("a", "related_to", "b")]


def test_bm25_zero_rows_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "red blue"), (2, "green"), (3, "red red"), (4, None), (5, "red blue")], "id long, text string")
    index = Bm25Index(docs)
    asked = spark.createDataFrame([("q1", "purple"), ("q2", "blue blue"), ("q3", None)], "qid string, text string")
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in index.search(asked, 3).collect()}
    assert [got["q1", i] for i in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert [got["q2", i][0] for i in (1, 2, 3)] == [1, 5, 2] and got["q2", 1][1] == got["q2", 2][1] > 0
    assert got["q3", 1] == (1, 0.0)
    assert index.search(asked, 99).where("qid = 'q2'").count() == 5


def test_bm25_empty(spark):
    index = Bm25Index(spark.createDataFrame([], "id long, text string"))
    assert index.search(spark.createDataFrame([("q", "x")], "qid string, text string")).count() == 0


def test_vector_order_threshold_and_blocks(spark, rows, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None), (6, [1.0, 1.0])], "id long, vector array<double>")
    q = v.where("id in (1, 3)")
    want = [(1, 1, 1.0, 2), (1, 2, 1.0, 1), (1, 6, 0.707107, 3)]
    assert rows(vector.top_k(v, q, 3, 0.3)) == want
    for name, size in (("BLOCK", 1), ("TILE", 1)):
        monkeypatch.setattr(vector, name, size)
        assert rows(vector.top_k(v, q, 3, 0.3)) == want
    assert rows(vector.above(v, q, 0.8)) == [(1, 1, 1.0), (1, 2, 1.0)]
    assert vector.top_k(v.limit(0), q, 3).count() == 0 and vector.top_k(v, q.limit(0), 3).count() == 0


def test_vector_top_k_against_brute_force(spark, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "TILE", 200)
    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vector array<double>")
    unit = vector._unit(m.tolist())
    want = []
    for q in range(0, 300, 50):
        scores = np.round(unit @ unit[q], 6)
        order = sorted(range(300), key=lambda i: (-scores[i], -i))[:7]
        want += [(q, i, float(scores[i]), n) for n, i in enumerate(order, 1)]
    assert rows(vector.top_k(v, v.where("id % 50 = 0"), 7, None)) == sorted(want, key=repr)


def test_contexts_and_status(spark, rows):
    t = spark.createDataFrame([(1, "a", "r", "b"), (1, "a", None, "c")], "qid int, s string, r string, o string")
    q = spark.createDataFrame([(1, "x"), (2, "y")], "qid int, text string")
    got = rows(context.with_status(q, context.joined(t, context.arrow())))
    assert got == [(1, "x", "a --[r]--> b\na --[未知关系]--> c", 2, "ok"), (2, "y", context.NO_TRIPLES, 0, "empty")]
    assert rows(chat.answer(context.with_status(q, context.joined(t, context.arrow())), {})) == [(1, "a --[r]--> b"), (2, context.NO_TRIPLES)]


@pytest.mark.parametrize(("reply", "sizes"), [('{"entities":[{"name":"a","type":"t"}],"relations":[]}', (1, 0)), ('{"entities":null}', (0, 0)), ("no json", (0, 0)), ("", (0, 0)), (None, (0, 0)), ("[1]", (0, 0))])
def test_parse_extraction(spark, reply, sizes):
    row = spark.createDataFrame([(reply,)], "r string").select(chat.parse_extraction(F.col("r")).alias("k")).select(F.size("k.entities"), F.size("k.relations")).first()
    assert tuple(row) == sizes


def test_backends(spark, monkeypatch):
    with pytest.raises(ValueError, match="unknown provider"):
        chat.make_backend({"provider": "nobody"})
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    with pytest.raises(ValueError, match="LLM_API_KEY"):
        chat.make_backend({"provider": "http", "url": "http://127.0.0.1"})
    assert chat.message_list("p", "s") == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}]
    log = evaluate.extraction_log(readers.text_rows(spark, "2020年7月洪水，2020年7月与2021年1月"), {})
    assert [e["name"] for e in log.first()["extraction_result"]["entities"]] == ["2020年7月", "2021年1月"]


def test_what_services_are_sent(monkeypatch):
    monkeypatch.setenv("LLM_API_KEY", "k")
    http, other = (chat.make_backend({"provider": p, "url": "http://127.0.0.1", "temperature": 0.5}) for p in ("http", "http_folded"))
    assert http.body("p", "s", True)["response_format"] == {"type": "json_object"} and http.body("p", "s", True)["temperature"] == 0.1
    assert "response_format" not in http.body("p", None, False) and http.body("p", "s", False)["temperature"] == 0.5
    assert http.body("p", "s", False)["messages"][0] == {"role": "system", "content": "s"}
    sent = other.body("p", "s", False)
    assert sent["contents"][0]["parts"][0]["text"] == "System: s\nUser: p" and sent["generationConfig"]["temperature"] == 0.7
    assert other.body("p", None, True)["generationConfig"] == {"temperature": 0.1, "responseMimeType": "application/json"}
    assert other.reply({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab" and http.reply({"choices": [{"message": {"content": "a"}}]}) == "a"
    with pytest.raises(ValueError, match="url"):
        chat.make_backend({"provider": "http"})


def test_system_message_failures_and_own_backends(spark, rows, monkeypatch):
    class Echo:
        def __init__(self, config):
            self.config = config

        def chat(self, prompt, system=None, json_mode=False):
            if "boom" in prompt:
                raise OSError("gone")
            return f"{system}|{json_mode}|{prompt}"

    monkeypatch.setitem(chat.BACKENDS, "echo", Echo)  # at the driver only
    asked = spark.createDataFrame([("a", "hi"), ("b", "boom")], "k string, prompt string")
    assert rows(chat.chat(asked, "k", {"provider": "echo"}, True, "S").drop("latency")) == [("a", "S|True|hi", None), ("b", "", "OSError: gone")]
    lines = spark.createDataFrame([("a", "q", "c", "ok"), ("b", "boom", "c", "ok"), ("c", "q", "none", "empty")], "qid string, text string, context string, status string")
    got = dict(rows(chat.answer(lines, {"provider": "echo"}, "{question}-{context}", "S", failed=context.FAILED)))
    assert got == {"a": "S|False|q-c", "b": context.FAILED, "c": "none"}


def test_extraction_falls_back(spark):
    texts = readers.text_rows(spark, "2020年7月洪水", "没有时间")
    instead = readers.inline_kg(spark, [("甲", "地点"), ("乙", None)], [("甲", "r", "乙")])
    got = {r["doc_id"]: r for r in chat.extract(texts, {}, fallback=instead).collect()}
    assert [got[k]["status"] for k in ("doc_001", "doc_002")] == ["ok", "fallback"]
    assert [e["name"] for e in got["doc_002"]["extraction_result"]["entities"]] == ["甲", "乙"] and len(got["doc_002"]["extraction_result"]["relations"]) == 1
    assert {r["status"] for r in chat.extract(texts, {}).collect()} == {"ok", "empty"}
    nodes, edges = graph.entity_graph(instead)
    assert (nodes.count(), edges.count()) == (2, 1)


def test_own_tokenizer(spark):
    docs = spark.createDataFrame([(1, "A-B"), (2, "C")], "id long, text string")
    index = Bm25Index(docs, tokenizer=lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), "-"))
    assert index.search(spark.createDataFrame([("q", "x-b")], "qid string, text string"), 1).first()["id"] == 1


CONFIG = """\ufeff# settings
data_path: "{0}/e.jsonl"
qa_path: "{0}/q.jsonl"

graph_hops: 2

retriever:
  type: "vector" # or "bm25"
  top_k: 3

llm:
  provider: "somebody" # a service
  model_name: "model-1"
  temperature: 0.1

embedding:
  model_name: "some-sentence-model"
"""


def test_a_configuration_of_services_runs_with_stand_ins(spark, tmp_path, capsys):
    from strandkg.__main__ import main

    write = lambda name, rows_, fields: (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(fields, r, strict=True)), ensure_ascii=False) for r in rows_), "utf-8-sig")
    write("e.jsonl", EVENTS, schema.EVENT.names)
    write("q.jsonl", [("q1", "甲县淹没农田的洪水", "农田"), ("q2", "乙县水库见底", "水库")], schema.QA.names)
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("2020年7月洪水", "utf-8-sig")
    (tmp_path / "c.yaml").write_text(CONFIG.format(tmp_path), "utf-8")
    with pytest.raises(ValueError, match="somebody"):
        readers.read_config(str(tmp_path / "c.yaml"))
    config = readers.read_config(str(tmp_path / "c.yaml"), offline=True)
    assert (config.retriever, config.top_k, config.graph_hops, config.llm["provider"], config.llm["model_name"]) == ("vector", 3, 2, "offline", "model-1")
    c = str(tmp_path / "c.yaml")
    assert main(["--offline", "ask", c, "甲县淹没农田的洪水"]) == main(["--offline", "evaluate", c]) == 0
    assert main(["--offline", "compare", c, str(tmp_path / "r"), "乙县水库见底"]) == main(["--offline", "pipeline", c, str(tmp_path / "texts"), "甲县淹没农田的洪水"]) == 0
    assert main(["build", str(tmp_path / "e.jsonl"), str(tmp_path / "s")]) == main(["graphml", str(tmp_path / "e.jsonl"), str(tmp_path / "x")]) == 0
    assert main(["extract", str(tmp_path / "texts"), str(tmp_path / "l")]) == 0
    said = capsys.readouterr().out
    assert "- e1 " in said and "19" in said
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 1


def test_env_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# keys\nexport A_KEY='one'\nB_KEY=two\n\nnonsense\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("B_KEY", "set")
    monkeypatch.delenv("A_KEY", raising=False)
    assert (readers.secret("A_KEY"), readers.secret("B_KEY")) == ("one", "set")
    monkeypatch.delenv("A_KEY", raising=False)
    with pytest.raises(ValueError, match="C_KEY"):
        readers.secret("C_KEY")


@pytest.fixture(scope="module")
def numbered(events):
    return events.withColumn("seq", F.substring("id", 2, 1).cast("long"))


QUESTIONS = [("q1", "甲县淹没农田的洪水"), ("q2", "乙县水库见底")]


@pytest.mark.parametrize("retriever", ["bm25", "vector"])
def test_engine(spark, numbered, retriever):
    engine = rag.Engine(numbered, schema.Config(retriever=retriever, graph_hops=1, top_k=1))
    q = spark.createDataFrame(QUESTIONS, "qid string, text string")
    assert {(r["qid"], r["id"]) for r in engine.retrieve(q).collect()} == {("q1", 1), ("q2", 2)}
    got = {r["qid"]: r for r in engine.answer(q).collect()}
    assert len(got["q1"]["evidence"]) == 6 and got["q1"]["draft_answer"].startswith("- e1 ")
    assert {r["qid"]: r["impact"] for r in engine.text_only(q).collect()} == {"q1": "淹没农田", "q2": "水库见底"}


def test_engine_compares_and_evaluates(spark, numbered):
    engine = rag.Engine(numbered, schema.Config(graph_hops=1))
    q = spark.createDataFrame([*QUESTIONS, ("q3", "zzz")], "qid string, text string")
    got = {r["question"]: r for r in engine.compare(q).collect()}
    assert got["zzz"]["baseline_answer"] == context.NO_HIT and got["zzz"]["graph_context_triples"] == 0
    assert got[QUESTIONS[0][1]]["graph_context_triples"] == 6 and got[QUESTIONS[0][1]]["baseline_answer"].startswith("[1] flood 甲县")
    gold = spark.createDataFrame([("q1", QUESTIONS[0][1], "农田"), ("q2", QUESTIONS[1][1], "农田")], schema.QA)
    assert tuple(engine.hit_rate(gold).first()) == (2, 1, 0.5)
    with pytest.raises(ValueError, match="retriever"):
        rag.Engine(numbered, schema.Config(retriever="guess"))
    nodes, edges = graph.event_nodes(numbered, "id", schema.EVENT_ONTOLOGY), graph.event_edges(numbered, "id", schema.EVENT_ONTOLOGY)
    near = {r["qid"]: r for r in engine.semantic(spark.createDataFrame([("a", "location_甲县"), ("b", "zzz")], "qid string, text string"), nodes, edges, 0.9).collect()}
    assert near["a"]["context"] == "e1 --[occurs_in]--> location_甲县" and near["b"]["context"] == context.NO_NODE


def test_encoder(spark):
    from strandkg.operators import encode

    v = {r["id"]: r["vector"] for r in encode.encode(spark.createDataFrame([(1, "洪水 flood"), (2, "洪水 flood"), (3, ""), (4, None)], "id long, t string"), "t").collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[3]) and v[4] is None
    with pytest.raises(ValueError, match="unknown encoder"):
        encode.encode(spark.range(1), "id", "nobody")


def test_hit_rate(spark, events):
    gold = spark.createDataFrame([("q1", "农田"), ("q2", ""), ("q3", "不在"), ("q4", None)], "qid string, gold_answer string")
    top = spark.createDataFrame([("q1", "e1", 1), ("q2", "e1", 1), ("q3", "e1", 1)], "qid string, id string, rank int")
    assert tuple(evaluate.hit_rate(evaluate.hits_gold(top, events, gold)).first()) == (4, 2, 0.5)
    assert tuple(evaluate.hit_rate(evaluate.hits_gold(top, events, gold.limit(0))).first()) == (0, 0, 0.0)


def test_readers(spark, tmp_path):
    lines = "﻿" + "\n\n".join(json.dumps(dict(zip(schema.EVENT.names, e, strict=True)), ensure_ascii=False) for e in EVENTS)
    (tmp_path / "e.jsonl").write_text(lines, "utf-8")
    assert readers.read_events(spark, str(tmp_path / "e.jsonl")).count() == 3
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.b.txt").write_text("﻿one\ntwo", "utf-8")
    (tmp_path / "texts/c.md").write_text("no", "utf-8")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path / "texts")).collect()] == [("a.b", "one\ntwo")]
    (tmp_path / "c.yaml").write_text("﻿graph_hops: 3\nretriever:\n  type: vector\n  top_k: 5\n# note\n", "utf-8")
    c = readers.read_config(str(tmp_path / "c.yaml"))
    assert (c.graph_hops, c.retriever, c.top_k) == (3, "vector", 5)
    with pytest.raises(SystemExit):
        readers.read_config(str(tmp_path / "none.yaml"))
    (tmp_path / "log.json").write_text(json.dumps([{"doc_id": "d", "raw_text": "t", "extraction_result": {"entities": [], "relations": []}, "latency": 1.5}]))
    assert readers.read_extraction_log(spark, str(tmp_path / "log.json")).first()["latency"] == 1.5


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_events(spark, str(tmp_path / "e.jsonl")).collect()


def test_store_upsert_is_idempotent(spark, events, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    for _ in range(2):
        store.upsert(*graph.store_nodes(events))
    nodes, edges = store.read()
    assert (nodes.count(), edges.count()) == (19, 18)
    assert set(r["label"] for r in nodes.select("label").distinct().collect()) == {"Event", "Location", "Time", "Cause", "Impact", "Measure", "Source"}
    store.clear()
    assert store.read()[0].count() == 0


def _props(store):
    return {r["id"]: json.loads(r["props"])["description"] for r in store.read()[0].where("label = 'Event'").collect()}


def test_store_last_row_wins_and_writes_touched_buckets_only(spark, events, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=16)
    rows_of = lambda *impacts: spark.createDataFrame([(e, "flood", "甲县", None, x, None, None, None, n) for n, (e, x) in enumerate(impacts)], schema.EVENT.simpleString()[7:-1].replace(":", " ") + ", n long")
    first = rows_of(("e1", "z first"), ("e1", "a last"), ("e2", "two"))
    store.upsert(*graph.store_nodes(first, F.col("n")))
    assert _props(store) == {"e1": "a last", "e2": "two"}
    before = store._manifest()["nodes"]
    store.upsert(*graph.store_nodes(rows_of(("e1", "b newer")), F.col("n")))
    assert _props(store) == {"e1": "b newer", "e2": "two"}
    after = store._manifest()["nodes"]
    assert {b for b in after if after[b] != before.get(b)} < set(after)
    for i in range(5):
        store.upsert(*graph.store_nodes(rows_of(("e3", f"v{i}")), F.col("n")))
    assert _props(store) == {"e1": "b newer", "e2": "two", "e3": "v4"} and len(store._numbers()) == store.KEPT
    live = {f for n in store._numbers() for f in store._manifest(n)["nodes"].values()}
    on_disk = {str(p.relative_to(tmp_path / "g")) for p in (tmp_path / "g/data").glob("*/nodes/bucket=*")}
    assert live <= on_disk and len(on_disk - live) <= len(after) * 2
    ends = {tuple(r) for r in store.read()[1].select("dst", "dst_label").collect()}
    assert ("甲县", "Location") in ends and ("v4", "Impact") in ends


def test_store_survives_a_failed_write(spark, events, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.upsert(*graph.store_nodes(events))
    monkeypatch.setattr(GraphStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(*graph.store_nodes(events.limit(1).selectExpr("'e9' as id", *[c for c in schema.EVENT.names if c != "id"])))
    monkeypatch.undo()
    assert store.read()[0].count() == 19
    (tmp_path / "g/manifests/000000000002.json").write_text("{}")  # another writer was faster
    monkeypatch.setattr(store, "_numbers", lambda: [1])
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish({})


def test_graph_database_writes_in_batches(spark, events, tmp_path, monkeypatch):
    """With a stand-in for the driver that writes down what it is sent."""
    (tmp_path / "neo4j.py").write_text(
        f"""
import json, uuid
class Tx:
    def run(self, query, rows):
        open({str(tmp_path)!r} + "/sent-" + uuid.uuid4().hex, "w").write(json.dumps([query, rows]))
        return self
    def consume(self): pass
class Session:
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def execute_write(self, f): f(Tx())
class Driver(Session):
    def session(self): return Session()
class GraphDatabase:
    @staticmethod
    def driver(uri, auth): assert auth == ("u", "secret"); return Driver()
"""
    )
    spark.sparkContext.addPyFile(str(tmp_path / "neo4j.py"))
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        write_graph_database(*graph.store_nodes(events), "bolt://x", "u", "NO_SUCH_KEY")
    (tmp_path / ".env").write_text("GRAPH_KEY=secret\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("GRAPH_KEY", "secret")
    nodes, edges = graph.store_nodes(events)
    readers_env = "import os; os.environ.setdefault('GRAPH_KEY', 'secret')"
    spark.sparkContext.parallelize(range(8), 8).foreach(lambda _: exec(readers_env))
    write_graph_database(nodes.coalesce(1), edges.coalesce(1), "bolt://x", "u", "GRAPH_KEY", batch=2)
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("sent-*")]
    assert all(len(rows) <= 2 for _, rows in sent)
    merged = [(q, r) for q, rows in sent for r in rows]
    assert sum("MATCH" not in q for q, _ in merged) == 19 and sum("MATCH" in q for q, _ in merged) == 18
    assert any("MERGE (n:`Location` {name: row.id})" in q for q, _ in merged) and any(r.get("props", {}).get("type") == "flood" for _, r in merged)


def test_sinks(spark, events, tmp_path):
    nodes, edges = graph.event_nodes(events, "id", schema.EVENT_ONTOLOGY), graph.event_edges(events, "id", schema.EVENT_ONTOLOGY)
    write_graphml(nodes, edges, str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.split("?>", 1)[1])
    assert len(root.findall(".//{*}node")) == 19 and len(root.findall(".//{*}edge")) == 18
    write_json(edges, str(tmp_path / "j"))
    write_report(edges, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 18
    (report,) = (tmp_path / "c").glob("*.csv")
    assert report.read_bytes().startswith(b"\xef\xbb\xbfsrc,rel,dst\n")


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):  # the second file brings an event again
        lines = [json.dumps(dict(zip(schema.EVENT.names, e, strict=True)), ensure_ascii=False) for e in EVENTS[n : n + 2]]
        (tmp_path / f"in/{n}.json").write_text("\n".join(lines), "utf-8")
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination(120)
    nodes, edges = GraphStore(spark, str(tmp_path / "g")).read()
    assert (nodes.count(), edges.count()) == (19, 18)


@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_summaries_of_random_graphs(spark, rows, hops):
    import random

    r = random.Random(hops)
    edges = {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)} | {("n1", "n1"), ("n2", "n2")}
    df = spark.createDataFrame([(s, r.choice(["r", "x", None]), t) for s, t in sorted(edges)], schema.EDGE)
    seeds = spark.createDataFrame([(q, f"n{r.randrange(60)}") for q in range(8) for _ in range(2)] + [(8, "n1"), (8, "n2"), (9, "nowhere")], "qid int, id string")
    line = F.concat_ws(" ", F.lit("-"), "src", F.coalesce("rel", F.lit("related_to")), "dst")
    want = graph.hop_subgraph(df, seeds, hops).groupBy("qid").agg(F.count(F.lit(1)).cast("int"), F.min(line))
    assert rows(graph.hop_summary(df, seeds, hops, line)) == rows(want)


def test_vector_scan_keeps_what_comes_near(spark, rows, monkeypatch):
    import numpy as np

    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [1.0, 1e-6], [1.0, 1.0], [float("nan"), 0.0], [0.0, 1.0]] * 40)], "id long, vector array<double>").coalesce(1)
    whole = rows(vector.top_k(v, v.where("id < 5"), 3, None))
    computed, better = [], vector.better
    monkeypatch.setattr(vector, "better", lambda kept, q, s, i: computed.append(len(q)) or better(kept, q, s, i))
    monkeypatch.setattr(vector, "TILE", 1)
    queries = [(i, x) for i, x in enumerate(np.eye(4).tolist())]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(np.repeat(np.eye(4), 100, axis=0).tolist(), pa.list_(pa.float64()))], names=["id", "vector"])
    (got,) = vector._scan(queries, 2, None)(iter([batch]))
    assert got.column("id").to_pylist() == [99, 98, 199, 198, 299, 298, 399, 398]
    assert sum(computed) < 4 * 400  # not every pair
    assert rows(vector.top_k(v, v.where("id < 5"), 3, None)) == whole


@pytest.mark.parametrize(("tile", "terms", "k"), [(2_000_000, 1_000_000, 3), (50, 40, 1), (50, 40, 200)])
def test_bm25_against_brute_force(spark, rows, monkeypatch, tile, terms, k):
    import math
    import random
    from collections import Counter

    from strandkg.operators import bm25

    monkeypatch.setattr(bm25, "TILE", tile)
    monkeypatch.setattr(bm25, "TERMS", terms)
    r = random.Random(k)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 40}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(9)))) for i in r.sample(range(2000), 500)]
    asked = [(f"q{i}", " ".join(word() for _ in range(r.randrange(5)))) for i in range(30)] + [("same", "w3 unheard w5"), ("again", "w5 w3"), ("none", "unheard")]
    df, length = Counter(t for _, x in docs for t in set(x.split())), sum(len(x.split()) for _, x in docs) / len(docs)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    want = []
    for q, text in asked:
        scored = []
        for i, x in docs:
            tf, dl = Counter(x.split()), len(x.split())
            scored.append((-round(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / length)) for t in text.split() if t in tf), 6), i))
        want += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    sent, block = [], bm25.Bm25Index._block
    monkeypatch.setattr(bm25.Bm25Index, "_block", lambda self, b, k: sent.extend(b) or block(self, b, k))
    index = bm25.Bm25Index(spark.createDataFrame(docs, "id long, text string").repartition(3))
    got = index.search(spark.createDataFrame(asked, "qid string, text string"), k)
    assert [(q, i, round(s, 5), n) for q, i, s, n in rows(got)] == sorted([(q, i, round(s, 5), n) for q, i, s, n in want], key=repr)
    assert len(sent) == len({tuple(sorted(t for t in x.split() if t in df)) for _, x in asked})  # those of the same terms once


def test_contexts_are_not_collected_whole(spark, rows):
    """Texts of a context are sorted outside of any aggregation, and null lines count but are not there."""
    t = spark.createDataFrame([(q, f"s{i % 7}{i}", "r", None if i == 5 else "o") for q in (None, 1, 2, 3) for i in range(3000)], "qid int, s string, r string, o string")
    made = context.joined(t, context.arrow())
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = "\n".join(sorted(f"s{i % 7}{i} --[r]--> o" for i in range(3000) if i != 5))
    assert rows(made) == sorted([(q, want, 3000) for q in (None, 1, 2, 3)], key=repr)
    assert rows(context.joined(t.limit(0), context.arrow())) == []
