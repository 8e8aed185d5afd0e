from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandkg.llm import split


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="天地abc 。！\n，；", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_rebuild_the_text(text, limit, overlap):
    got = split.pieces(split.bisect(text, limit, overlap)[0], overlap)
    assert all(b - a <= limit for a, b, _ in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, end, _), (start, _, _) in zip(got, got[1:], strict=False):
        assert start == max(0, end - overlap)
    ends = [0, *[b for _, b, _ in got]]
    assert "".join(text[a:b] for a, b in zip(ends, ends[1:], strict=False)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="天地，。\n", max_size=600))
def test_no_cut_inside_a_sentence_that_fits(text):
    limit, overlap = 60, 6
    ends, forced = split.bisect(text, limit, overlap)
    if max(map(len, re.split("[。\n]", text))) < limit - overlap:
        assert forced == 0 and all(text[end - 1] in "。\n" and level < 2 for end, level in ends[:-1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="天地abc，。；\n ", max_size=500), st.integers(8, 60), st.integers(0, 7))
def test_forced_cuts_come_from_the_bisection(text, limit, overlap):
    """The longest stretch that had to be cut is the longest run without a sentence or line end, wherever that is over the limit."""
    longest = max(map(len, re.split("[。！？；\n]", text)))
    forced = split.bisect(text, limit, overlap)[1]
    assert (forced > limit) == (longest > limit) and (longest <= limit or forced == longest)


def test_frame(spark, rows):
    texts = spark.createDataFrame([(1, "短"), (2, None), (3, ""), (4, "长" * 601), (5, "句" * 299 + "。" + "句" * 310), (5, "句" * 299 + "。" + "句" * 310), (None, "x" * 700)], "row_id long, text string")
    got = split.split_texts(texts)
    assert rows(got.where("piece = 0").selectExpr("row_id", "forced_run > 600")) == sorted([(4, True), (5, False), (5, False), (None, True)], key=repr)
    assert split.split_texts(texts.limit(0)).count() == 0


def test_very_long(spark):
    text = ("汛" * 5000 + "。") * 200
    got = split.split_texts(spark.createDataFrame([(1, text, "clash")], "row_id long, text string, piece string")).collect()
    ends = [0, *sorted(r["end"] for r in got)]
    assert "".join(text[a:b] for a, b in zip(ends, ends[1:], strict=False)) == text and max(len(r["text"]) for r in got) <= 600
