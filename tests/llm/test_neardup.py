from __future__ import annotations

import random

import numpy as np
import pytest

from strandkg.functions.plaintext import plain_form
from strandkg.llm import neardup


def brute(texts, threshold=0.7):
    sets = {i: {p[j : j + 3] for j in range(len(p) - 2)} for i, t in texts if i is not None and t is not None and (p := plain_form(t)) is not None}
    ids = sorted(sets)
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                out.add((a, b))
    return out


def made(n, seed):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = "".join(r.choice("水利江河湖海风雨雷电山石田土abc12") for _ in range(r.randint(5, 400)))
        for _ in range(r.randint(1, 4)):
            chars = list(base)
            for _ in range(r.randint(0, max(1, len(chars) // 12))):
                chars[r.randrange(len(chars))] = r.choice("春夏秋冬")
            out.append("".join(chars))
    return [(i, t) for i, t in enumerate(out[:n])]


def pairs_of(df):
    return {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(*neardup.near_duplicates(df)).collect()}


def test_recall_and_precision(spark):
    texts = [*made(400, 3), (1000, None), (1001, ""), (1002, "ab"), (1003, "ab"), (None, "abcdef")]
    got, want = pairs_of(spark.createDataFrame(texts, "id long, text string")), brute(texts)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_in_other_characters_and_hot_group(spark):
    texts = [(i, "同一条通报的全文，重复了许多次。") for i in range(40)] + [(100 + i, "同一条通报的​全文，重复了许多次。") for i in range(2)] + [(200, "另一条毫不相干的记录文字内容。")]
    got = pairs_of(spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "id long, text string, rep string, a int"))
    assert got == brute(texts) and len(got) == 42 * 41 // 2


def test_groups(spark, rows):
    texts = made(150, 5)
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["group_id"] for r in neardup.groups(*neardup.near_duplicates(df)).collect()}
    parent = {i: i for i, t in texts if len(t) >= 3}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_of(df):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in parent}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty(spark):
    assert pairs_of(spark.createDataFrame([], "id long, text string")) == set()


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_prefixes_are_shortened_until_the_target(threshold):
    """From any finds, the depth at which it stops is expected to reach the target, and the one before it was not."""
    for found in (np.zeros(neardup.CLASSES), np.full(neardup.CLASSES, 1000.0), np.eye(neardup.CLASSES)[0] * 1e6, np.eye(neardup.CLASSES)[-1] * 1e6):
        depth, steps = neardup.LEVELS, []
        while (shorter := neardup.next_depth(found, depth, threshold=threshold)) is not None:
            assert shorter < depth and neardup.expected_recall(found, depth, depth, threshold) < neardup.TARGET
            depth = shorter
            steps.append(depth)
        assert depth == 1 or neardup.expected_recall(found, depth, depth, threshold) >= neardup.TARGET


def test_similar_copies_keep_long_prefixes():
    near, far = np.eye(neardup.CLASSES)[-1] * 1e6, np.eye(neardup.CLASSES)[0] * 1e6
    assert neardup.next_depth(near, neardup.LEVELS) is None
    assert neardup.next_depth(far, neardup.LEVELS) <= 4


def test_pairs_at_the_threshold_are_found(spark):
    """Texts of few runs, nearly all of whose pairs lie just above the threshold."""
    r = random.Random(11)
    texts = []
    for i in range(300):
        base = [chr(0x4E00 + r.randrange(8000)) for _ in range(200)]
        edited = list(base)
        for at in r.sample(range(200), 10):
            edited[at] = "甲"
        texts += [(2 * i, "".join(base)), (2 * i + 1, "".join(edited))]
    want = {(2 * i, 2 * i + 1) for i in range(300)} & brute(texts)
    got = pairs_of(spark.createDataFrame(texts, "id long, text string"))
    assert got <= brute(texts) and len(got) >= 0.99 * len(want) and len(want) > 200


def test_paths_share_prefixes_as_often_as_the_formula_says():
    n = 400
    texts = ["".join(chr(0x4E00 + (i * 37 + j) % 15000) for j in range(n)) for i in range(60)]
    other = [t[60:] + "".join(chr(0x3400 + (i * 91 + j) % 6000) for j in range(60)) for i, t in enumerate(texts)]
    codes = neardup._codes(*neardup.code_points(texts + other))
    share = np.mean([(c := neardup._common(codes[i], codes[60 + i])) / (len(codes[i]) + len(codes[60 + i]) - c) for i in range(60)])
    paths = neardup.signatures(texts + other)
    for depth in (1, 4):
        same = (paths[:60] >> np.uint64(8 * (neardup.LEVELS - depth))) == (paths[60:] >> np.uint64(8 * (neardup.LEVELS - depth)))
        assert abs(same.mean() - share**depth) < 0.05
