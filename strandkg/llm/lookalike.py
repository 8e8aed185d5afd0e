"""Visually identical text with different characters (problem 6).

Script-aware repair: text is brought to plain form (width, composition, unified characters, spaces, invisible characters; see ``functions.plaintext``), and a
word that mixes scripts is rewritten in one script by look-alike letters. Of several possible readings the one that exists in the corpus vocabulary is
taken. The vocabulary holds the one-script words of all values that are readings of some mixed word: both sides meet in a semi-join on
the word, so of the corpus only the words in question are kept; they are few, and their number is checked before they go to the tasks (beyond ``MAX_WORDS`` each
value gets its own words by a join).

Which reading is taken decides how a value is repaired, not whether it is plain. When no reading is in the vocabulary (identifiers such as station codes occur once), the substitution still takes place, in the order of
``plaintext.readings``: a look-alike word left in two scripts would compare unequal for good. This goes beyond the named method, which would leave it.

Values without a suspicious character are settled by a pattern inside the scan; only the others reach Python. Null values give no row, empty ones are
plain. Whole texts of any length are processed. Repeated rows give rows each.
"""

from __future__ import annotations

from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.functions.plaintext import SUSPECT, WORD, foreign, plain_form, readings, unrepaired
from strandkg.session import written

#: Words of the vocabulary that may go to the tasks (some 20 bytes each).
MAX_WORDS = 50_000
_KEYS = "row_id long, field string, pos int"


def mixed_words(text: str) -> list[str]:
    """The words of ``text`` that mix scripts and have a reading in one, as they stand after all other steps."""
    return [w for w in WORD.findall(unrepaired(text)) if foreign(w) and readings(w)]


def repaired(text: str, known: Container[str]) -> str:
    """The plain form of ``text``: of the one-script readings of a mixed word the first in the vocabulary ``known``, or the first at all where none is."""
    return plain_form(text, lambda found: next((x for x in found if x in known), found[0]))


def values_of(log: DataFrame) -> DataFrame:
    """All texts and entity names as (row_id, field, pos, value)."""
    texts = log.select("row_id", F.lit("raw_text").alias("field"), F.lit(0).alias("pos"), F.col("raw_text").alias("value"))
    names = log.select("row_id", F.lit("entity").alias("field"), F.posexplode(F.col("extraction_result")["entities"]["name"]).alias("pos", "value"))
    return texts.unionByName(names).where("value is not null")


def suspicious(values: DataFrame) -> DataFrame:
    """The values that hold a character a plain text can't, or a letter that may be a look-alike."""
    return values.where(F.col("value").rlike(SUSPECT))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of one script (asked: false) and the readings of words that have several (asked: true), each once per batch."""
    for batch in batches:
        seen: set[tuple[str, bool]] = set()
        for value in batch.column("value").to_pylist():
            for w in WORD.findall(unrepaired(value)):
                if found := readings(w):
                    seen |= {(r, True) for r in found if len(found) > 1}
                elif not w.isdecimal():
                    seen.add((w, False))
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["word", "asked"])


def vocabulary(values: DataFrame) -> DataFrame:
    """The readings in question that occur in the corpus as words of one script.

    Words of plain values are split inside the scan; a value with suspicious characters goes through the steps before the repair first.
    """
    odd = written(suspicious(values).select("value").mapInArrow(_words, "word string, asked boolean").distinct(), "words")
    asked = odd.where("asked").select("word")
    letter = "A-Za-z\\u00c0-\\u02af\\u1e00-\\u1eff"
    clean = values.where(~F.col("value").rlike(SUSPECT)).select(F.explode(F.regexp_extract_all("value", F.lit(f"([0-9]*[{letter}][0-9{letter}]*)"), F.lit(1))).alias("word"))
    return clean.unionByName(odd.where("not asked").select("word")).join(asked, "word", "left_semi").distinct()


_REPAIRED = pa.schema([("row_id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("plain", pa.string())])


def _repaired(known: set[str] | None):  # noqa: ANN202
    """The values that change. ``known``: the vocabulary, where the rows don't bring their own words of it in ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            own = [set(k or ()) for k in batch.column("known").to_pylist()] if "known" in batch.schema.names else [known] * len(values)
            plain = [repaired(v, k) for v, k in zip(values, own, strict=True)]
            changed = [i for i, (v, p) in enumerate(zip(values, plain, strict=True)) if v != p]
            kept = batch.take(pa.array(changed, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in _REPAIRED.names[:4]), pa.array([plain[i] for i in changed], pa.string())], schema=_REPAIRED)

    return run


def _asked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(v, r) for v, value in zip(batch.column("vid").to_pylist(), batch.column("value").to_pylist(), strict=True) for r in {r for w in mixed_words(value) for r in readings(w)}]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["vid", "word"])


def repair(values: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """Every value that is not plain with its plain form, ambiguous words by the corpus vocabulary."""
    words = written(vocabulary(values), "vocabulary")
    odd = suspicious(values).select("row_id", "field", F.col("pos").cast("int").alias("pos"), "value")
    if words.count() <= most:
        return odd.mapInArrow(_repaired({r["word"] for r in words.collect()}), f"{_KEYS}, value string, plain string")
    odd = written(odd.withColumn("vid", F.uuid()), "odd")
    asked = odd.select("vid", "value").mapInArrow(_asked_words, "vid string, word string")
    own = asked.join(words, "word").groupBy("vid").agg(F.collect_set("word").alias("known"))
    return odd.join(own, "vid", "left").select("row_id", "field", "pos", "value", "known").mapInArrow(_repaired(None), f"{_KEYS}, value string, plain string")
