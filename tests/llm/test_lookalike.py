from __future__ import annotations

import duckdb

from strandkg.functions.plaintext import plain_form
from strandkg.llm import catalog, lookalike
from strandkg.schema import KG


def test_found_equals_brute_force(spark, rows, small):
    d = small.replace("sf0.001", "sf0.01")
    want = []
    for row_id, text, result in duckdb.sql(f"select row_id, raw_text, extraction_result from '{d}/results_extraction.parquet'").fetchall():
        names = [(e or {}).get("name") for e in (result or {}).get("entities") or []]
        want += [(row_id, f, p) for f, p, v in [("raw_text", 0, text), *(("entity", i, n) for i, n in enumerate(names))] if v is not None and plain_form(v) != v]
    assert rows(catalog.p6_found(spark, d)) == sorted(want, key=repr)


def test_vocabulary_repairs(spark, rows):
    log = spark.createDataFrame([(1, "сор сор", None), (2, "cоp", None), (3, None, ([("cоp",), None, (None,)], None)), (4, "", ([], [])), (4, "ΖΑ37K站", None)], "row_id long, raw_text string, extraction_result struct<entities: array<struct<name: string>>, relations: array<string>>")
    values = lookalike.values_of(log)
    assert rows(lookalike.repair(values).select("row_id", "field", "plain")) == [(2, "raw_text", "сор"), (3, "entity", "сор"), (4, "raw_text", "ZA37K站")]
    assert rows(lookalike.repair(values, most=0)) == rows(lookalike.repair(values))
    latin = values.where("row_id <> 1")
    assert rows(lookalike.repair(latin).select("row_id", "plain")) == [(2, "cop"), (3, "cop"), (4, "ZA37K站")]


def test_vocabulary_decides_between_readings():
    word = "cоp"  # Latin c and p, Cyrillic о
    assert lookalike.mixed_words(f"({word}) cop") == [word]
    assert lookalike.repaired(word, {"сор"}) == "сор" and lookalike.repaired(word, ()) == "cop"
    assert lookalike.repaired("Та\u0301onyо\u0300u", ()) == "Táonyòu"


def test_empty_and_long(spark):
    none = spark.createDataFrame([], f"row_id long, raw_text string, extraction_result {KG.simpleString()}, value string, plain string")
    assert lookalike.repair(lookalike.values_of(none)).count() == 0
    long = spark.createDataFrame([(1, "字" * 300_000 + "​", None)], f"row_id long, raw_text string, extraction_result {KG.simpleString()}")
    assert len(lookalike.repair(lookalike.values_of(long)).first()["plain"]) == 300_000
