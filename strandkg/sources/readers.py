"""Readers: JSON lines, whole-text folders, extraction logs, configuration, tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkg import schema


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event records of JSON lines; blank lines and a byte order mark are skipped, a malformed line fails."""
    return spark.read.schema(schema.EVENT).option("mode", "FAILFAST").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.QA).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the ``.txt`` files of a folder, not of folders below it."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("doc_id"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def read_extraction_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A log of extraction runs: files of one JSON array each, which one task reads, or of JSON lines, as ``write_json`` writes them, which many share."""
    return spark.read.schema(schema.EXTRACTION_LOG).option("multiLine", not lines).json(path)


def text_rows(spark: SparkSession, *texts: str) -> DataFrame:
    """Literal documents."""
    return spark.createDataFrame([(f"doc_{i:03d}", t) for i, t in enumerate(texts, 1)], "doc_id string, text string")


def inline_kg(spark: SparkSession, entities: list[tuple], relations: list[tuple]) -> DataFrame:
    """One extraction result given literally: (name, type) and (head, relation, tail)."""
    return spark.createDataFrame([(entities, relations)], schema.KG)


def line_order() -> F.Column:
    """Where a row of a JSON-lines file stands: greater later in a file; over several files by their split."""
    return F.monotonically_increasing_id()


def _flat_yaml(text: str) -> dict:
    """Nested mappings of scalars by indentation: what a configuration needs where no YAML library is there."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth, (name, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip().strip("\"'")
        if value:
            number = value.lstrip("-").replace(".", "", 1)
            stack[-1][1][name] = (float(value) if "." in value else int(value)) if number.isdigit() else value
        else:
            stack[-1][1][name] = child = {}
            stack.append((depth, child))
    return root


def read_config(path: str, offline: bool = False) -> schema.Config:
    """The YAML configuration; a missing file ends the program with status 1.

    A provider or encoder that nothing is registered for is an error here. ``offline``: the stand-ins that need no network and no model take the place of both.
    """
    from strandkg.operators import chat, encode

    if not Path(path).exists():
        print(f"no configuration at {path}", file=sys.stderr)
        raise SystemExit(1)
    text = Path(path).read_text("utf-8-sig")
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = _flat_yaml(text)
    retriever = raw.get("retriever", {})
    kept = {k: raw[k] for k in ("data_path", "qa_path", "graph_hops", "llm", "prompts") if k in raw}
    embedding = raw.get("embedding", {}).get("model_name", "")
    if offline:
        kept["llm"], embedding = kept.get("llm", {}) | {"provider": "offline"}, "hashing"
    config = schema.Config(**kept, retriever=retriever.get("type", "bm25"), top_k=retriever.get("top_k", 3), embedding_model=embedding)
    chat.check_provider(config.llm)
    encode.factory_of(config.embedding_model)
    return config


def load_env(path: str = ".env") -> None:
    """Names and values of a ``.env`` file into the environment; what is set there already stays."""
    if not Path(path).exists():
        return
    for line in Path(path).read_text("utf-8-sig").splitlines():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def secret(name: str) -> str:
    """A secret from the environment or the ``.env`` file of the working folder; secrets are never in plans or files of this package."""
    load_env()
    if not (value := os.environ.get(name)):
        raise ValueError(f"set {name} in the environment")
    return value
