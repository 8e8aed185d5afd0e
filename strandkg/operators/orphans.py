"""References to records that do not exist, per table and period (problem 2).

The references of a record that its own names satisfy are settled inside the record, without a shuffle. The others are counted per
key, period and side before anything moves, with their earliest and latest time: all joins are of these counts. A count whose key was neither born nor deleted between its earliest and its latest time has
one status for all its references; only the references of the other counts are looked at one by one.

Keys that hold more than ``heavy_share`` of all open references are heavy: there are at most ``1 / heavy_share`` of them, whatever the data. Their life spans are looked up from a broadcast table if these are at most
``SMALL`` rows, their counts being united with those of the other keys, which go through shuffled joins: an anti-join for keys that no target has, a join with the life spans of the others. Where the single
references are asked for, those of heavy keys meet their orphan counts in a broadcast, where they stand, under the same check, and the others in a shuffled join; no reference is dropped or counted twice.

Nulls: a null reference is no reference; a null target id matches nothing; a null ``created_at`` counts as created since ever, a null ``deleted_at`` as
never deleted; a reference without a time is live only at a target created since ever, else ``late`` or ``missing``, with a null period.
Empty tables give an empty result (no targets: every open reference is ``missing``). Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkg.functions.plaintext import plain_form
from strandkg.session import written

#: Keys of fewer references than this are never heavy.
HEAVY = 1000
#: Rows that may be broadcast.
SMALL = 100_000
STATUS = ("missing", "late", "deleted", "live")
_GROUP = ["key", "month", "side"]
OPEN = "row_id long, rel_pos int, side string, key string, at timestamp_ntz"
_OPEN = pa.schema([("row_id", pa.int64()), ("rel_pos", pa.int32()), ("side", pa.string()), ("key", pa.string()), ("at", pa.timestamp("us"))])


def _open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        ids, ats = batch.column("row_id").to_pylist(), batch.column("at").cast(pa.timestamp("us"))
        names, heads, tails = (batch.column(c).to_pylist() for c in ("names", "heads", "tails"))
        take = []
        for i, row_id in enumerate(ids):
            own = None
            for pos, (head, tail) in enumerate(zip(heads[i] or (), tails[i] or (), strict=True)):
                for side, end in (("head", head), ("tail", tail)):
                    if end is None:
                        continue
                    if own is None:
                        own = {plain_form(x) for x in names[i] or () if x is not None}
                    if (key := plain_form(end)) not in own:
                        for column, value in zip(out, (row_id, pos, side, key), strict=False):
                            column.append(value)
                        take.append(i)
        arrays = [pa.array(c, t) for c, t in zip(out[:4], (x.type for x in _OPEN), strict=False)]
        yield pa.RecordBatch.from_arrays([*arrays, ats.take(pa.array(take, pa.int64()))], schema=_OPEN)


def open_references(records: DataFrame) -> DataFrame:
    """Heads and tails of ``records`` (row_id, extraction_result, ingested_at) that equal no entity name of their own record."""
    result = F.col("extraction_result")
    slim = records.select(
        "row_id", F.col("ingested_at").cast("timestamp_ntz").alias("at"), result["entities"]["name"].alias("names"),
        result["relations"]["head"].alias("heads"), result["relations"]["tail"].alias("tails"),
    ).where("size(heads) > 0")
    return slim.mapInArrow(_open_ends, OPEN)


def _numbered(refs: DataFrame) -> DataFrame:
    """References with their month; that of a reference without a time is empty, so that it joins."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("month")
    return written(refs.select(F.monotonically_increasing_id().alias("ref_no"), "row_id", "rel_pos", "side", "key", "at", month), "references")


def _lives(nodes: DataFrame) -> DataFrame:
    """(key, born, gone): the distinct life spans of each plain id."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def plain(s):  # noqa: ANN001, ANN202
        return s.map(plain_form, na_action="ignore")

    born, gone = F.col("created_at").cast("timestamp_ntz").alias("born"), F.col("deleted_at").cast("timestamp_ntz").alias("gone")
    return written(nodes.where("id is not null").select(plain("id").alias("key"), born, gone).distinct(), "lives")


def _level(at: Column) -> Column:
    """What one life span says of a reference at that time, as a place in ``STATUS``; the highest of a key's life spans holds."""
    born = F.coalesce(F.col("born") <= at, F.col("born").isNull())
    gone = F.coalesce(F.col("gone") <= at, F.lit(False))
    return F.when(born & ~gone, 3).when(gone, 2).otherwise(1)


def _settled(counts: DataFrame, lives: DataFrame) -> DataFrame:
    """``counts`` (key, month, side, n, first, last) of keys that have life spans, with their ``level`` and whether it may change inside (``mixed``)."""
    inside = [(F.col(c) > F.col("first")) & (F.col(c) <= F.col("last")) for c in ("born", "gone")]
    change = F.coalesce(inside[0], F.lit(False)) | F.coalesce(inside[1], F.lit(False))
    return counts.join(lives, "key").groupBy(*_GROUP, "n").agg(F.max(_level(F.col("first"))).alias("level"), F.bool_or(change).alias("mixed"))


class Orphans:
    """The orphans among ``refs`` (row_id, rel_pos, side, key, at): references whose key has no row of ``nodes`` (id, created_at, deleted_at) live at that time."""

    def __init__(self, refs: DataFrame, nodes: DataFrame, heavy_share: float = 0.001) -> None:
        self.refs, self.lives = _numbered(refs), _lives(nodes)
        per_month = self.refs.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
        self.counts = written(per_month, "counts")
        per_key = self.counts.groupBy("key").agg(F.sum("n").alias("n"))
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        self.heavy = written(per_key.where(F.col("n") > max(total * heavy_share, HEAVY)).select("key"), "heavy")  # at most 1 / heavy_share keys
        self.n_heavy = self.heavy.count()
        self.levels = written(self._all_levels(), "levels")

    def _split(self, rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Rows of heavy keys (None where no key is heavy) and of the others; the heavy keys are few by their definition where a key needs ``HEAVY`` references."""
        if not self.n_heavy:
            return None, rows
        heavy = F.broadcast(self.heavy) if self.n_heavy <= SMALL else self.heavy
        return rows.join(heavy, "key", "left_semi"), rows.join(heavy, "key", "left_anti")

    @staticmethod
    def _small(rows: DataFrame, name: str) -> DataFrame:
        rows = written(rows, name)
        return F.broadcast(rows) if rows.count() <= SMALL else rows

    def _all_levels(self) -> DataFrame:
        """Every count with its level."""
        heavy, light = self._split(self.counts)
        out = self._levels_of(light, self.lives)
        return out if heavy is None else out.unionByName(self._levels_of(heavy, self._small(self._split(self.lives)[0], "heavy-lives")))

    @staticmethod
    def _levels_of(counts: DataFrame, lives: DataFrame) -> DataFrame:
        columns = [*_GROUP, "n", "level", "mixed"]
        missing = counts.join(lives, "key", "left_anti").select(*_GROUP, "n", F.lit(0).alias("level"), F.lit(False).alias("mixed"))
        return _settled(counts, lives).select(*columns).unionByName(missing)

    def _mixed(self) -> DataFrame:
        """The references of mixed counts, each by itself: (ref_no, row_id, rel_pos, side, key, at, month, level)."""
        some = self.levels.where("mixed").select(*_GROUP)
        refs = self.refs.join(some, _GROUP, "left_semi").join(self.lives, "key")
        keys = ["ref_no", "row_id", "rel_pos", "side", "key", "at", "month"]
        return refs.groupBy(*keys).agg(F.max(_level(F.col("at"))).alias("level"))

    def per_key(self) -> DataFrame:
        """(key, period, side, status, n): the orphan counts; those of mixed counts are counted anew."""
        counts = self.levels.where("not mixed").select(*_GROUP, "level", "n").unionByName(self._mixed().groupBy(*_GROUP, "level").agg(F.count(F.lit(1)).alias("n")))
        return counts.where("level < 3").select("key", F.nullif("month", F.lit("")).alias("period"), "side", _status().alias("status"), "n")

    def rows(self) -> DataFrame:
        """(row_id, rel_pos, side, key, at, status) of every orphan."""
        lost = self.levels.where("not mixed and level < 3").select(*_GROUP, "level")
        heavy_lost, light_lost = self._split(lost)
        heavy, light = self._split(self.refs)
        found = light.join(light_lost, _GROUP)
        if heavy is not None:
            found = found.unionByName(heavy.join(self._small(heavy_lost, "heavy-lost"), _GROUP))
        return found.unionByName(self._mixed().where("level < 3")).select("row_id", "rel_pos", "side", "key", "at", _status().alias("status"))


def _status() -> Column:
    return F.element_at(F.array(*map(F.lit, STATUS)), F.col("level") + 1)


def find_orphans(refs: DataFrame, nodes: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """Every orphan of ``refs`` with its ``status``: ``missing``, ``deleted`` or ``late``."""
    return Orphans(refs, nodes, heavy_share).rows()


def orphan_report(refs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Per table, period, side and status the orphans and their distinct keys, beside all open references of that period and side; from counts alone."""
    found = Orphans(refs, nodes)
    every = found.counts.groupBy("month", "side").agg(F.sum("n").alias("n_open"))
    lost = found.per_key().groupBy(F.coalesce("period", F.lit("")).alias("month"), "side", "status").agg(F.sum("n").alias("n_orphans"), F.count("key").alias("n_keys"))
    return lost.join(every, ["month", "side"]).select(F.lit(name).alias("table"), F.nullif("month", F.lit("")).alias("period"), "side", "status", "n_orphans", "n_keys", "n_open")
