from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandkg.llm import abuse, catalog
from strandkg.session import table

CASES = [
    ("水位上涨。说你是废物都抬举你了，闭上你的嘴。", {"abuse"}), ("这届防汛办真是猪 脑 子，看一眼都恶心。", {"abuse"}), ("等着，我找到写通报的非打断你的腿不可。", {"abuse"}), ("白痴！", {"abuse"}), ("Nobody asked you, stup1d p1gs, now get lost.", {"abuse"}), ("Whoever runs this gauge, go to hell, you s-t-u-p-i-d pigs.", {"abuse"}),
    ("就该把岭外人全赶出去，一个不留。", {"hate"}), ("Those rivermen breed like rats and deserve to drown.", {"hate"}), ("All lowbankers are vermin and should be driven out.", {"hate"}),
    ("深夜寂寞加我，裸丶聊随时约。", {"sexual"}), ("Free xxx p0rn clips, adults only, link in bio.", {"sexual"}), ("她把衣服一件件脱光，两人在床上做爱到天亮。", {"sexual"}),
    ("白痴造型的稻草人是孩子们做的，用来吓鸟。", set()), ("平台删除了60条辱骂救援人员的留言，当事人已道歉。", set()), ("有谣言称南岸佬被拒之门外，核查后并无此事，两岸居民同住。", set()), ("他骂骂咧咧地扛起沙袋，嘴上说“该死的雨”，手上没停。", set()), ("卫生院给青少年开了一场性教育讲座，发放手册123本。", set()), ("废物处理站连夜转运6459吨垃圾，防止渗滤液外溢。", set()),
    ("The dam retarded the flow and killed the surge below Lupuhe.", set()), ("Bare, naked rock showed along 530 metres of bank.", set()), ("A sexual health clinic at Zhugouping reopened after 22 hours.", set()), ("Cocks and sows, 2479 head in all, were moved to high ground.", set()), ("", set()), (None, set()), ("x" * 100_000, set()),
]
COLUMNS = "doc_id long, source string, text string, abuse string"


def _found(df):
    return {r["doc_id"]: {c for c in abuse.CATEGORIES if r[f"has_{c}"]} for r in df.collect()}


def _trained(spark, small, where="true"):
    d = small.replace("sf0.001", "sf0.1")
    return abuse.train(table(spark, d, "documents"), table(spark, d, "content_labels").where(where))


def test_learned_cases(spark, small):
    """Of kinds the labelled sample shows; a model without labels finds nothing."""
    docs = spark.createDataFrame([(i, "s", t, "clash") for i, (t, _) in enumerate(CASES)], COLUMNS)
    got = _found(abuse.score_documents(docs, _trained(spark, small)))
    wrong = [(t, got[i]) for i, (t, want) in enumerate(CASES) if got[i] != want]
    assert len(wrong) <= 3, wrong
    assert not any(_found(abuse.score_documents(docs, abuse.Model())).values())


def test_held_out_labels(spark, small):
    """Trained on one half of the labelled documents, scored on the other."""
    d = small.replace("sf0.001", "sf0.1")
    model = _trained(spark, small, "doc_id % 2 = 0")
    held = table(spark, d, "content_labels").where("category is not null and doc_id % 2 = 1").join(table(spark, d, "documents"), "doc_id")
    want = {r["doc_id"]: set(r["category"].split("+")) & set(abuse.CATEGORIES) for r in held.collect()}
    got = _found(abuse.score_documents(held.select("doc_id", "source", "text"), model))
    right = sum(len(got[i] & want[i]) for i in want)
    assert right / max(1, sum(map(len, got.values()))) > 0.9
    assert right / sum(map(len, want.values())) > 0.8


def test_labels_decide_everything():
    """The same sentences with other labels give another model: no expression is known beforehand."""
    bad, good = "风筝都是讨厌鬼做的。", "白痴这个词写在黑板上。"
    texts = [f"{bad}水位涨了{i}米。" for i in range(30)] + [f"{good}水位涨了{i}米。" for i in range(30)]
    for first, second in ((bad, good), (good, bad)):
        labels = ["abuse" if t.startswith(first) else "none" for t in texts]
        has = abuse.Model().fit(texts, labels).judge([first, second, "水位涨了99米。"])[1][:, 0]
        assert has.tolist() == [True, False, False]


def test_several_offending_sentences_are_more_severe(spark, small):
    m = _trained(spark, small)
    one, two = "深夜寂寞加我，裸聊随时约。", "上门约炮，包夜八百，姿势随你挑。"
    severity, has = m.judge(["水位上涨。", f"水位上涨。{one}", f"{one}水位上涨。{two}"])
    assert has[:, 2].tolist() == [False, True, True]
    assert severity[0, 2] < severity[1, 2] < severity[2, 2] <= 2
    assert (m.theta[:, 0] < m.theta[:, 1]).all()


def test_empty_tables_and_rates(spark):
    docs = spark.createDataFrame([], COLUMNS)
    labels = spark.createDataFrame([(1, None), (None, "abuse"), (7, "abuse")], "doc_id long, category string")
    model = abuse.train(docs, labels)
    assert abuse.score_documents(docs, model).count() == 0
    model = abuse.Model().fit(["白痴！"] * 9 + ["晴"] * 9, ["abuse"] * 9 + ["none"] * 9)
    some = spark.createDataFrame([(1, None, "白痴！", ""), (2, None, "晴", ""), (None, "s", None, "")], COLUMNS)
    got = {r["source"]: r["abuse_rate"] for r in abuse.source_rates(abuse.score_documents(some, model)).collect()}
    assert got == {None: 0.5, "s": 0.0}


def test_found_has_stated_columns(spark, small):
    df = catalog.p10_found(spark, small)
    assert df.dtypes == [("doc_id", "bigint"), ("category", "string")]
    assert df.groupBy("doc_id", "category").count().where(F.col("count") > 1).count() == 0


def test_scoring_equals_the_rows_of_the_fit():
    """The margins of a sentence are the same in the fit, in a batch and alone, whatever stands beside it; small weights count."""
    lines = ["水位报告说涨了5米", "", "你看水位", "水", "those rivermen walk", "水位", ""]
    rng, m = np.random.default_rng(3), abuse.Model()
    m.hashed[: abuse.NONE] = rng.normal(0, 0.001, (abuse.NONE, 3))
    m.dense[:] = rng.normal(0, 1, m.dense.shape)
    parts = list(abuse.ngrams(lines))
    owner, gram = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    order = np.argsort(owner, kind="stable")
    rows = abuse._Rows(gram[order], np.searchsorted(owner[order], np.arange(len(lines) + 1)), abuse._scale(lines), abuse.cues(lines), abuse.NONE)
    fitted = np.stack([rows.dot(m.dense[:, c], m.hashed[: abuse.NONE, c].astype(float)) for c in range(3)], axis=1)
    assert np.allclose(m.margins(lines), fitted, atol=1e-5)
    assert np.allclose(np.concatenate([m.margins([t]) for t in lines]), fitted, atol=1e-5)
    for at, bucket in abuse.ngrams(lines):
        assert all(len(lines[i]) for i in at) and (bucket < abuse.NONE).all()


def test_masked_words_read_plainly():
    plain = ["脑残", "激情戏", "stupid pigs", "一夜情", "fuck", "cafe"]
    masked = ["脑-残", "激*情*戏", "s-t-u-p-i-d p1gs", "一 夜\u200b 情", "Ｆùck", "café"]
    assert abuse.readable_all(masked) == plain
    assert abuse.readable_all(["他说“你这个蠢货”后被劝离现场并且道歉"]) == ["他说 后被劝离现场并且道歉"]


def test_whole_long_texts_are_read():
    m = abuse.Model().fit(["白痴！"] * 9 + ["晴"] * 9, ["abuse"] * 9 + ["none"] * 9)
    assert m.judge(["晴。" * 200_000 + "白痴！"])[1][0, 0] and not m.judge(["<" * 100_000])[1].any()
