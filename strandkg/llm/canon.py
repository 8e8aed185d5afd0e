"""Mapping freely entered values to a canonical list (problem 1).

A multi-pattern automaton over the canonical names and their other names finds embedded mentions; the longest match wins (so what overlaps it loses), then the leftmost.
Values without a mention go to token-set similarity: of the names that share tokens with the value, or failing that with a stretch of it as long as the name, the most similar one is taken, if the exact check that
follows finds it within one edit (two in Latin names of eight letters or more). What neither step settles stands for no entry: canon_id 0.

The list goes to the tasks as a broadcast of at most ``BLOCK`` entries; each Python worker makes its automaton and token index once, whatever the number of tasks. The values stay where they are: no
shuffle, so no value, however frequent, can make a task hot, and equal values are mapped once per task from a memo. A longer list is taken block by block: the distinct values are ranked against
each block and the best rank over all blocks decides, which is what the list as a whole would give.

Null and empty values give no row; blank ones give a row with canon_id 0. Repeated rows count each. Extra columns are ignored. An empty list maps all to 0. Ties: higher similarity, fewer edits, then the same kind of place, then the smaller canon_id; a
stretch of a value as similar to two entries stands for none.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.session import written

#: Entries of the list in one broadcast (some 300 bytes each with their names).
BLOCK = 100_000
#: Least token-set similarity (Dice) of a name.
SIMILAR = 0.4
#: Steps a value can be settled by, lowest first.
NONE, STRETCH, WHOLE, MENTION = range(4)
#: Kinds of place, which do not decide which place is meant.
KINDS = ("水库", "县", "市", "区", "镇", "湖", "乡", "村", "屯", "岛", "江", "河")
# Traditional characters of place and field names beside their simplified ones.
TRADITIONAL = dict(
    zip(
        "瀾東鎮雲橋庫臺縣龍嶺區灣裡裏後舊溝壩馬銅寧峽紫興烏門寒關雙豐壽衝衡楓峯岡塢頭廣島鄉莊灘礦濱閘灤潤滄澤漢濟瀘瀋灕瀏灄沖蓮蘇蘭葉薊蘆鄭鄧鄲陽陰陳陸隴際險雞鳳鵝鶴鷹鷺黃魯鯉鴨鵬貴賓賀贛趙軍輝遼運連遠遙達邊鐵銀鋼鍾鎖長廈廬應慶應徑從復態災種時間點處響後導緩保觀測報員責隸屬於阻斷監發生對護衛設機構損況單位標準標應減輕殃體團隊聯絡館學農業風險與無負脅牽歸眾築現辦確禦韓順頂飛馮驛騰齊龜",
        "澜东镇云桥库台县龙岭区湾里里后旧沟坝马铜宁峡紫兴乌门寒关双丰寿冲衡枫峰冈坞头广岛乡庄滩矿滨闸滦润沧泽汉济泸沈漓浏滠冲莲苏兰叶蓟芦郑邓郸阳阴陈陆陇际险鸡凤鹅鹤鹰鹭黄鲁鲤鸭鹏贵宾贺赣赵军辉辽运连远遥达边铁银钢钟锁长厦庐应庆应径从复态灾种时间点处响后导缓保观测报员责隶属于阻断监发生对护卫设机构损况单位标准标应减轻殃体团队联络馆学农业风险与无负胁牵归众筑现办确御韩顺顶飞冯驿腾齐龟",
        strict=True,
    )
)
_SIMPLE = str.maketrans(TRADITIONAL)
_drop = re.compile(r"[\W_]+")
_brackets = re.compile(r"[\((（〔][^)）〕]*[\))）〕]")


def folded(value: str) -> str:
    """Case, width, accents, traditional forms, spaces and punctuation taken out."""
    text = unicodedata.normalize("NFKD", value).casefold().translate(_SIMPLE)
    return _drop.sub("", "".join(ch for ch in text if unicodedata.category(ch) != "Mn"))


def proper(name: str) -> str:
    """A place's name without its kind, where something of at least two characters is left."""
    for kind in KINDS:
        if name.endswith(kind) and len(name) - len(kind) >= 2:
            return name[: -len(kind)]
    return name


def _han(text: str) -> bool:
    return any("⺀" <= ch <= "鿿" for ch in text)


def tokens(text: str) -> set[str]:
    """The token set of a folded name: single characters and pairs in Chinese, padded pairs else."""
    padded = text if _han(text) else f"^{text}$"
    pairs = {padded[i : i + 2] for i in range(len(padded) - 1)}
    return pairs | set(text) if _han(text) else pairs


def _edits(a: str, b: str) -> int:
    """Edits between two short strings; two neighbours changing places are one."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


class FieldIndex:
    """The automaton and the token index of one field's entries: rows of (canon_id, value, latin, also_called)."""

    def __init__(self, rows: list[tuple], place: bool) -> None:
        self.place, self.names, self.by_token, self.automaton = place, {}, {}, ahocorasick.Automaton()
        for canon_id, value, latin, also in sorted(rows):
            for name in (value, latin, *(also or ())):
                if not name or not (key := folded(name)):
                    continue
                for form in dict.fromkeys((key, proper(key)) if place else (key,)):
                    self.names.setdefault(form, canon_id)
        for form, canon_id in self.names.items():
            self.automaton.add_word(form, (form, canon_id))
            if not place or proper(form) == form or form not in self.names:
                for t in tokens(form):
                    self.by_token.setdefault(t, []).append(form)
        if self.names:
            self.automaton.make_automaton()

    def mention(self, key: str) -> tuple | None:
        """The rank of the longest embedded mention."""
        best = None
        for end, (form, canon_id) in self.automaton.iter(key) if self.names else ():
            if not self.place and not _han(form) and len(form) < 0.6 * len(key):
                continue  # a short Latin word inside a longer one is no mention of it
            best = max(best or (-1,), (float(len(form)), float(len(form) - end), 0.0, -canon_id))
        return (MENTION, *best) if best else None

    def _closest(self, form: str, kind: str, width: int | None = None) -> Iterator[tuple]:
        """(similarity, -edits, same kind, -canon_id) of the names that are similar enough and pass the check."""
        own, shared = tokens(form), {}
        for t in own:
            for name in self.by_token.get(t, ()):
                shared[name] = shared.get(name, 0) + 1
        for name, n in shared.items():
            if width is not None and len(name) != width or min(len(form), len(name)) < 2 or max(len(form), len(name)) < 3:
                continue
            score = 2 * n / (len(own) + len(tokens(name)))
            allowed = 1 if _han(name) or len(name) < 8 else 2
            if score >= (SIMILAR if width is None else 0.0) and abs(len(form) - len(name)) <= allowed and (edits := _edits(form, name)) <= allowed:
                yield score, float(-edits), float(bool(kind) and name + kind in self.names), -self.names[name]

    def similar(self, key: str) -> tuple | None:
        """The rank of the most similar name."""
        stem = proper(key) if self.place else key
        if found := [x for form in dict.fromkeys((key, stem)) for x in self._closest(form, key[len(stem) :])]:
            return (WHOLE, *max(found))
        if not (self.place and _han(key)):
            return None
        # A decorated misspelling of a Chinese place name of three characters: the stretch most like a name, if only one entry is.
        near = {x[3] for i in range(len(key) - 2) for x in self._closest(key[i : i + 3], "", 3)}
        return (STRETCH, 0.0, float(-len(near)), 0.0, max(near)) if near else None

    def rank(self, value: str) -> tuple:
        """(step, three numbers, -canon_id): the greater the better."""
        plain = folded(_brackets.sub("", value)) or folded(value)
        return self.mention(plain) or self.mention(folded(value)) or self.similar(plain) or (NONE, 0.0, 0.0, 0.0, 0)


def _settled(ranks: list[tuple]) -> int:
    """The entry of the best of ranks; a stretch that is like several entries stands for none."""
    best = max(ranks)
    if best[0] == STRETCH and (best[2] < -1 or len({r[4] for r in ranks if r[0] == STRETCH}) > 1):
        return 0
    return -best[4]


_made: dict[str, dict[str, FieldIndex]] = {}


def _indexes(token: str, by_field: dict[str, list[tuple]], place_fields: tuple[str, ...]) -> dict[str, FieldIndex]:
    """The indexes of a list, made once in a Python worker; of other lists none is kept."""
    if token not in _made:
        _made.clear()
        _made[token] = {f: FieldIndex(rows, f in place_fields) for f, rows in by_field.items()}
    return _made[token]


_MAPPED = pa.schema([("field", pa.string()), ("rec_id", pa.int64()), ("pos", pa.int32()), ("value", pa.string()), ("canon_id", pa.int64())])
_RANKED = pa.schema([("field", pa.string()), ("value", pa.string()), ("rank", pa.struct([("step", pa.int32()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("minus_id", pa.int64())]))])
_RANK_DDL = "field string, value string, rank struct<step: int, a: double, b: double, c: double, minus_id: bigint>"


def _block(canon: DataFrame) -> tuple:
    """A broadcast of (token, rows by field) of entries that are few enough."""
    by_field: dict[str, list[tuple]] = {}
    for r in canon.collect():
        by_field.setdefault(r["field"], []).append((r["canon_id"], r["value"], r["latin"], r["also_called"]))
    return canon.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, by_field))


def map_values(values: DataFrame, canon: DataFrame, place_fields: tuple[str, ...] = ("location",), block: int = BLOCK) -> DataFrame:
    """(field, rec_id, pos, value, canon_id) of each row of ``values`` (field, rec_id, pos, value) whose value is not exactly an entry's."""
    canon = canon.where("canon_id is not null and field is not null").select("canon_id", "field", "value", "latin", "also_called")
    asked = values.where("value is not null and value <> ''").select("field", F.col("rec_id").cast("long"), F.col("pos").cast("int"), "value")
    n = canon.count()
    if n > block:
        return _by_blocks(asked, canon, place_fields, -(-n // block))
    listed = _block(canon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, by_field = listed.value
        indexes, memo = _indexes(token, by_field, place_fields), {}
        exact = {f: {r[1] for r in rows} for f, rows in by_field.items()}
        for batch in batches:
            keep, ids = [], []
            for i, (field, value) in enumerate(zip(batch.column("field").to_pylist(), batch.column("value").to_pylist(), strict=True)):
                if value in exact.get(field, ()):
                    continue
                if (found := memo.get((field, value))) is None:
                    found = _settled([indexes[field].rank(value)]) if field in indexes else 0
                    if len(memo) < 500_000:
                        memo[field, value] = found
                keep.append(i)
                ids.append(found)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in _MAPPED.names[:4]), pa.array(ids, pa.int64())], schema=_MAPPED)

    return asked.mapInArrow(run, "field string, rec_id long, pos int, value string, canon_id long")


def _by_blocks(asked: DataFrame, canon: DataFrame, place_fields: tuple[str, ...], n_blocks: int) -> DataFrame:
    """The same for a list of any length: distinct values against each block, the best rank of all, joined back. A value's ranks are as many as blocks."""
    open_ = asked.join(canon.select("field", "value").distinct(), ["field", "value"], "left_anti")
    distinct = written(open_.select("field", "value").distinct(), "values")
    ranked = None
    for b in range(n_blocks):
        listed = _block(canon.where(F.pmod(F.xxhash64("canon_id"), F.lit(n_blocks)) == b))

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            token, by_field = listed.value
            indexes = _indexes(token, by_field, place_fields)
            for batch in batches:
                pairs = zip(batch.column("field").to_pylist(), batch.column("value").to_pylist(), strict=True)
                ranks = [indexes[f].rank(v) if f in indexes else (NONE, 0.0, 0.0, 0.0, 0) for f, v in pairs]
                named = [dict(zip(("step", "a", "b", "c", "minus_id"), r, strict=True)) for r in ranks]
                yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("value"), pa.array(named, _RANKED.field("rank").type)], schema=_RANKED)

        part = written(distinct.mapInArrow(run, _RANK_DDL), "ranks")
        ranked = part if ranked is None else ranked.unionByName(part)
    unclear = (F.col("best.step") == STRETCH) & ((F.col("best.b") < -1) | (F.size("near") > 1))
    near = F.collect_set(F.when(F.col("rank.step") == STRETCH, F.col("rank.minus_id"))).alias("near")
    best = ranked.groupBy("field", "value").agg(F.max("rank").alias("best"), near).select("field", "value", F.when(unclear, 0).otherwise(-F.col("best.minus_id")).cast("long").alias("canon_id"))
    null_safe = open_["field"].eqNullSafe(best["field"]) & (open_["value"] == best["value"])
    return open_.join(best, null_safe).select(open_["field"], "rec_id", "pos", open_["value"], "canon_id")


def free_values(events: DataFrame, log: DataFrame) -> DataFrame:
    """The freely entered values of both tables as (field, rec_id, pos, value)."""
    places = events.select(F.lit("location").alias("field"), F.col("seq").alias("rec_id"), F.lit(0).alias("pos"), F.col("location").alias("value"))
    result = F.col("extraction_result")
    kinds = log.select(F.lit("entity_type").alias("field"), F.col("row_id").alias("rec_id"), F.posexplode(result["entities"]["type"]).alias("pos", "value"))
    links = log.select(F.lit("relation").alias("field"), F.col("row_id").alias("rec_id"), F.posexplode(result["relations"]["relation"]).alias("pos", "value"))
    return places.unionByName(kinds).unionByName(links)
