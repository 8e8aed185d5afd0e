from __future__ import annotations

import random

import pytest

from strandkg.llm import leak


def brute(docs, items, n=60):
    out = set()
    for d, text in docs:
        t = leak.letters(text)
        for i, passage in items:
            p = leak.letters(passage)
            if any(p[j : j + n] in t for j in range(len(p) - n + 1)):
                out.add((d, i))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("水利江河湖海风雨abcdeF12，。 ") for _ in range(n))
    items = [(i, word(r.randint(30, 250))) for i in range(12)]
    docs = []
    for d in range(60):
        text = word(r.randint(0, 300))
        for _ in range(r.randint(0, 2)):
            p = r.choice(items)[1]
            a = r.randrange(len(p))
            part = p[a : a + r.randint(40, 120)]
            text += r.choice([part, part.upper(), "-".join(part), part.translate({ord("1"): "１", ord("a"): "ａ"})]) + word(r.randint(0, 50))
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("most", [leak.MAX_BYTES, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed, most):
    docs, items = made(seed)
    found = leak.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), most=most)
    want = brute(docs, items)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 5


@pytest.mark.parametrize("most", [leak.MAX_BYTES, 0])
def test_edges(spark, rows, most):
    run, other = "汛" * 59, "abcdefghij" * 6
    docs = spark.createDataFrame([(1, run), (2, run + "汛"), (2, run + "汛"), (3, None), (4, ""), (None, other), (5, "x" * 200_000 + other.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(1, "汛" * 60, "x"), (1, "汛" * 70, "x"), (2, other, "x"), (3, None, "x"), (4, "", "x"), (5, other, "x"), (None, other, "x")], "item_id long, passage string, doc_id string")
    got = rows(leak.find_leaks(docs, items, most=most))
    assert got == sorted([(2, 1), (2, 1), (None, 2), (None, 5), (5, 2), (5, 5)], key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    one = spark.createDataFrame([(1, "a" * 99)], "doc_id long, text string")
    assert leak.find_leaks(docs, items).count() == leak.find_leaks(one, items).count() == 0


def test_letters():
    assert leak.letters("Ａ-b，。 １中　") == "ab1中" and leak.letters(None) == ""


def test_spans_in_periodic_text(spark):
    """A span that begins in text repeated every few letters is found, as it is kept wherever it lies."""
    import random

    r = random.Random(5)
    word = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    documents, passages = [], []
    for i in range(60):
        unit = word(r.choice([6, 12, 20, 30]))
        text = (unit * 60)[: r.randrange(90, 200)] + word(40)
        at = r.randrange(20, len(text) - 60)
        documents.append((i, word(5) + text))
        passages.append((i, word(9) + text[at : at + 60] + word(9)))
    docs, items = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string")
    assert {(i, i) for i in range(60)} <= {tuple(x) for x in leak.find_leaks(docs, items).collect()}
