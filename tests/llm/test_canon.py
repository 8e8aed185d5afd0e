from __future__ import annotations

import pytest

from strandkg.llm import canon, catalog

LIST = [
    (1, "location", "澜渡东镇", "Landudong", []),
    (2, "location", "云桥南水库", "Yunqiaonan", ["西云桥南"]),
    (3, "location", "石台北县", "Shitaibei", None),
    (4, "entity_type", "影响", "Impact", ["后果"]),
    (5, "entity_type", "灾害事件", "Disaster event", []),
    (6, "relation", "发生于", "occurs_in", ["地处"]),
]
CASES = [
    ("location", "澜渡东", 1), ("location", "澜渡东湖", 1), ("location", "瀾渡東鎮", 1), ("location", "澜东渡镇", 1), ("location", "澜钟东", 1), ("location", "渡东镇", 1), ("location", "澜 渡东镇", 1),
    ("location", "长江流域云桥南水库下游段", 2), ("location", "西云桥南", 2), ("location", "Yun Qiao Nan", 2), ("location", "Yùnqíaonǎn", 2), ("location", "云桥南水库（全境）", 2), ("location", "SHITAIBEI-County", 3), ("location", "石台北县？", 3),
    ("location", "琥珀郡", 0), ("location", "全境", 0), ("location", "??", 0), ("location", "N/A", 0), ("location", " ", 0), ("location", "澜", 0),
    ("entity_type", "影影响", 4), ("entity_type", "#影响", 4), ("entity_type", "impacct", 4), ("entity_type", "imp act", 4), ("entity_type", "后果。", 4), ("entity_type", "灾事件", 5), ("entity_type", "災害事件", 5), ("entity_type", "Disaster eevent", 5), ("entity_type", "评论", 0),
    ("relation", "OCCURS_IN", 6), ("relation", "ocurs_in", 6), ("relation", "地 处", 6), ("relation", "rel_9", 0), ("relation", "→", 0), ("nofield", "x", 0),
]
DDL = "canon_id long, field string, value string, latin string, also_called array<string>, rec_id long"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 9) for r in LIST], DDL)


def test_cases(spark, table, rows):
    values = spark.createDataFrame([(f, i, 0, v, "x") for i, (f, v, _) in enumerate(CASES)], "field string, rec_id long, pos int, value string, canon_id string")
    got = {r["rec_id"]: r["canon_id"] for r in canon.map_values(values, table).collect()}
    assert {CASES[i][:2]: c for i, c in got.items()} == {c[:2]: c[2] for c in CASES}


def test_exact_null_empty_repeated(spark, table, rows):
    values = spark.createDataFrame([("location", 1, 0, "澜渡东镇"), ("location", 2, 0, None), ("location", 3, 0, ""), ("location", 4, 0, "澜渡东"), ("location", 4, 0, "澜渡东"), (None, 5, 0, "x"), ("location", None, None, "x" * 100_000)], "field string, rec_id long, pos int, value string")
    assert rows(canon.map_values(values, table).drop("value")) == sorted([("location", 4, 0, 1), ("location", 4, 0, 1), (None, 5, 0, 0), ("location", None, None, 0)], key=repr)
    assert {r["canon_id"] for r in canon.map_values(values, table.limit(0)).collect()} == {0}
    assert canon.map_values(values.limit(0), table).count() == 0


@pytest.mark.parametrize("block", [1, 2, 4])
def test_a_list_in_blocks_gives_the_same(spark, table, rows, block):
    values = spark.createDataFrame([(f, i, 0, v) for i, (f, v, _) in enumerate([*CASES, *CASES, ("location", "澜渡东镇", 1), (None, "x", 0)])], "field string, rec_id long, pos int, value string")
    assert rows(canon.map_values(values, table, block=block)) == rows(canon.map_values(values, table))


def test_longest_mention_wins_over_one_that_begins_before():
    index = canon.FieldIndex([(1, "甲乙丙", None, None), (2, "丙丁戊己", None, None)], False)
    assert canon._settled([index.rank("在甲乙丙丁戊己处")]) == 2


def test_similarity_decides_among_names_within_the_edits():
    index = canon.FieldIndex([(1, "abcdefgh", None, None), (2, "abcdefgxy", None, None)], False)
    assert canon._settled([index.rank("abcdefgy")]) == 2


def test_unmatched_values_are_reported(spark, small, rows):
    got = rows(catalog.p1_unmatched(spark, small))
    n = catalog.p1_found(spark, small).where("canon_id = 0").count()
    assert sum(r[2] for r in got) == n and all(r[1] for r in got)


def test_traditional_table_is_small():
    assert len(canon.TRADITIONAL) <= 200
