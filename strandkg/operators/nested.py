"""Deeply nested records to flat tables that keep parent-child links (problem 5).

One pass: a depth-first visitor walks each JSON record and emits rows of (tag, pk, parent_key, payload), one per object, in whatever table
the ``TABLES`` map its path to; ``Tables`` writes them once, partitioned by tag, and applies a schema per tag to the folder that is asked for. A key is the path of positions from the root, so
it needs no counter and no shuffle, and stays the same when the input is read again. Scalars and nested single objects go into the payload (dotted names), arrays of objects into a child table, arrays of
scalars stay a JSON text.

Tolerated: a byte order mark, a Markdown fence or prose around the JSON, a part or the whole encoded once more as a string, a single object in place of an array, missing and null parts.
Null records and unreadable payloads give no row. Null array elements give no row but count as positions. Empty objects give a row with an empty payload.
Repeated records give rows each, under their own key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkg.functions.plaintext import plain_form
from strandkg.session import written

#: Path of an array (or single object) from the record on -> table tag.
TABLES = {
    "items": "item",
    "items.extraction_result.entities": "entity",
    "items.extraction_result.entities.mentions": "mention",
    "items.extraction_result.entities.attrs.codes": "code",
    "items.extraction_result.relations": "relation",
    "items.extraction_result.relations.evidence": "evidence",
}
#: Paths that hold an object but may come encoded once more as a string.
ENCODED = {"items", "items.extraction_result", "items.extraction_result.entities", "items.extraction_result.relations"}

EMITTED = T.StructType([T.StructField(c, T.StringType()) for c in ("tag", "pk", "parent_key", "payload")])
_EMITTED = pa.schema([(c, pa.string()) for c in ("tag", "pk", "parent_key", "payload")])

_KEYS = "origin string, rec_id long, item_pos int"
#: The schema of each tag's payload.
SCHEMAS = {
    "record": f"{_KEYS}, `batch.no` long, `batch.model` string, `batch.usage.in` long, `batch.usage.out` long",
    "item": f"{_KEYS}, doc_id string, `meta.page` long, `meta.section.title` string, `meta.section.path` string",
    "entity": f"{_KEYS}, pos int, name string, type string, `attrs.note` string",
    "relation": f"{_KEYS}, pos int, head string, relation string, tail string, head_pos int, tail_pos int",
    "mention": f"{_KEYS}, pos int, start long, end long",
    "code": f"{_KEYS}, pos int, scheme string, value string",
    "evidence": f"{_KEYS}, pos int, quote string, spans string",
}


def read_json(text: str | None) -> object:
    """The value of a payload, or None if it can't be read."""
    for _ in range(3):  # a payload may be encoded again, at most twice
        if not isinstance(text, str):
            return text
        text = text.strip("﻿ \t\r\n")
        for part in (text, text[min((i for c in "{[" if (i := text.find(c)) >= 0), default=0) : max(text.rfind("}"), text.rfind("]")) + 1]):
            try:
                text = json.loads(part)
                break
            except (ValueError, RecursionError):
                continue
        else:
            return None
    return None if isinstance(text, str) else text


def _decoded(value: object, path: str) -> object:
    return read_json(value) if path in ENCODED and isinstance(value, str) else value


class Visitor:
    """Walks records; ``emit(tag, pk, parent_key, payload dict)`` gets every object of a wanted table."""

    def __init__(self, wanted: set[str], emit) -> None:  # noqa: ANN001
        self.wanted, self.emit = wanted, emit

    def record(self, value: object, origin: str, rec_id: int) -> None:
        self.keys = {"origin": origin, "rec_id": rec_id, "item_pos": None}
        if isinstance(value, list):  # a bare array of items
            value = {"items": value}
        if isinstance(value, dict):
            self._object(value, "", "record", f"{origin}/{rec_id}", None, {})

    def _object(self, value: dict, path: str, tag: str, pk: str, parent: str | None, extra: dict) -> None:
        payload, children = {}, []
        self._fields(value, path, "", payload, children)
        keys = dict(self.keys)
        if tag in self.wanted:
            self.emit(tag, pk, parent, {**keys, **extra, **payload})
        firsts = None
        for child_path, rows in children:
            child = TABLES[child_path]
            for pos, row in enumerate(rows):
                row = _decoded(row, child_path) if child == "item" else row
                if not isinstance(row, dict):
                    continue
                more = {"pos": pos}
                if child == "item":
                    self.keys["item_pos"], more = pos, {}
                elif child == "relation":
                    if "relation" not in self.wanted and "evidence" not in self.wanted:
                        continue
                    if firsts is None:
                        firsts = self._firsts(children)
                    more |= {f"{e}_pos": -1 if not isinstance(row.get(e), str) else firsts.get(plain_form(row[e]), -1) for e in ("head", "tail")}
                self._object(row, child_path, child, f"{pk}/{child[0]}{pos}", pk, more)
            if child == "item":
                self.keys["item_pos"] = None

    @staticmethod
    def _firsts(children: list) -> dict[str, int]:
        """The first position of each plain entity name."""
        out: dict[str, int] = {}
        for path, rows in children:
            if TABLES[path] == "entity":
                for pos, row in enumerate(rows):
                    if isinstance(row, dict) and isinstance(row.get("name"), str):
                        out.setdefault(plain_form(row["name"]), pos)
        return out

    def _fields(self, value: dict, path: str, prefix: str, payload: dict, children: list) -> None:
        for name, x in value.items():
            at = f"{path}.{name}" if path else name
            x = _decoded(x, at)
            if at in TABLES:
                children.append((at, x if isinstance(x, list) else [] if x is None else [x]))
            elif isinstance(x, dict):
                self._fields(x, at, f"{prefix}{name}.", payload, children)
            elif isinstance(x, list):
                payload[prefix + name] = json.dumps(x, ensure_ascii=False)
            else:
                payload[prefix + name] = x


def emit_rows(records: DataFrame, tags: set[str] | None = None) -> DataFrame:
    """(tag, pk, parent_key, payload) of ``records`` (origin, rec_id, body: JSON text); only ``tags`` where given."""
    wanted = set(tags or SCHEMAS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]

            def emit(*row) -> None:  # noqa: ANN002
                *head, payload = row
                for column, value in zip(columns, (*head, json.dumps(payload, ensure_ascii=False)), strict=True):
                    column.append(value)

            visitor = Visitor(wanted, emit)
            for origin, rec_id, body in zip(*(batch.column(c).to_pylist() for c in ("origin", "rec_id", "body")), strict=True):
                if body is not None and (value := read_json(body)) is not None:
                    visitor.record(value, origin, rec_id)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=_EMITTED)

    return records.select("origin", "rec_id", "body").mapInArrow(run, EMITTED)


def log_bodies(log: DataFrame) -> DataFrame:
    """Rows of (row_id, extraction_result) as records of one item each."""
    items = F.array(F.struct(F.col("extraction_result")))
    return log.where("extraction_result is not null").select(F.lit("log").alias("origin"), F.col("row_id").alias("rec_id"), F.to_json(F.struct(items.alias("items"))).alias("body"))


def payload_bodies(payloads: DataFrame) -> DataFrame:
    """Rows of (payload_id, payload) as records."""
    return payloads.where("payload is not null").select(F.lit("payload").alias("origin"), F.col("payload_id").alias("rec_id"), F.col("payload").alias("body"))


def as_table(emitted: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: pk, parent_key and the fields of its schema."""
    fields: Column = F.from_json("payload", SCHEMAS[tag])
    return emitted.where(F.col("tag") == tag).select("pk", "parent_key", fields.alias("row")).select("pk", "parent_key", "row.*")


def write_tables(emitted: DataFrame, path: str) -> None:
    """All tables in one write, a folder per tag; ``as_table(spark.read.parquet(path), tag)`` reads one folder only."""
    emitted.write.partitionBy("tag").mode("overwrite").parquet(path)


class Tables:
    """The flat tables of ``records`` (origin, rec_id, body), emitted in one pass and kept by tag in the shared folder until the application ends."""

    def __init__(self, records: DataFrame) -> None:
        self.stored = written(emit_rows(records), "nested", "tag")

    def table(self, tag: str) -> DataFrame:
        """The table of one tag; of the others nothing is read."""
        return as_table(self.stored, tag)

    def sizes(self) -> DataFrame:
        """(tag, n_rows, n_with_parent), from the keys alone."""
        return self.stored.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count("parent_key").alias("n_with_parent"))
