"""Field concatenation and tokens, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkg.schema import LEXICAL_FIELDS, VECTOR_FIELDS

# At each position at most one token begins: a pair of Chinese characters, one that stands alone, or a Latin word with its figures.
_HAN = "[\\u4e00-\\u9fff]"
_TOKEN = f"(?=({_HAN}{{2}}|(?<!{_HAN}){_HAN}|(?<![a-z0-9])[a-z0-9]+))"


def lexical_text(fields: tuple[str, ...] = LEXICAL_FIELDS) -> Column:
    """Fields joined by a space; a missing one leaves its two spaces."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])


def vector_text(fields: tuple[str, ...] = VECTOR_FIELDS) -> Column:
    """The fields that are there, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in fields])


def tokens(text: Column) -> Column:
    """Latin words and figures in lower case, and pairs of neighbouring Chinese characters (one that stands alone, itself)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(1))
