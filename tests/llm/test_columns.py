from __future__ import annotations

import pytest

import __spark_entry__ as entry

COLUMNS = {
    "p1_found": "field string, rec_id bigint, pos int, canon_id bigint",
    "p2_found": "row_id bigint, rel_pos int, side string, status string, period string",
    "p3_found": "row_id bigint, forced string",
    "p4_found": "qid string, defect string",
    "p5_found": "origin string, rec_id bigint, item_pos int, rel_pos int, head_pos int, tail_pos int",
    "p6_found": "row_id bigint, field string, pos int",
    "p7_found": "row_id_a bigint, row_id_b bigint",
    "p8_found": "doc_id bigint, item_id bigint",
    "p10_found": "doc_id bigint, category string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[0] == "p" and n[1].isdigit()))
def test_empty_tables(spark, small, tmp_path, name):
    """Every query over tables without rows."""
    from pathlib import Path

    for f in Path(small).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(tmp_path / f.name))
    assert entry.queries()[name](spark, str(tmp_path)).count() >= 0
