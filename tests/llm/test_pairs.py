from __future__ import annotations

import pytest

from strandkg.llm import pairs

Q, E = "2015年沙关康湖内涝的主要影响是什么？", "What was the main effect of the 2010 drought in Shanpingdong?"
CASES = [
    (Q, None, ["empty"]), (Q, " 　\n", ["empty"]), (Q, "（空）", ["empty"]), (Q, "N/A", ["empty"]), (Q, "……", ["empty"]), (E, "null", ["empty"]),
    (Q, "您好！恕我不能给出答案，换个话题吧。", ["refusal"]), (Q, "抱歉，该问题不予作答", ["refusal", "truncated"]), (E, "I'm sorry, but I can't help with that.", ["refusal"]), (E, "As a language model I am unable to answer this question.", ["refusal"]),
    (Q, "17户受灾，超出值守人员的能力范围，故请求邻县支援。", []), (Q, "10亩被淹，抱歉的是后续赔付有所延误。", []), (Q, "道路一度无法通行，有居民起初拒绝转移。", []),
    (Q, "请问，2015年沙关康湖内涝的主要影响是什么？", ["copied"]), (Q, Q + Q, ["copied"]), (Q, " 2015年沙关康湖内涝主要影响是什么？", ["copied"]), (E, "Question: " + E.upper(), ["copied"]),
    (Q, "2015年沙关", ["truncated"]), (Q, "2015年沙关康湖内涝的主要影响", ["truncated"]), (Q, Q[:-1], ["copied", "truncated"]), (E, "What was the main effect", ["truncated"]),
    (Q, "多个泵站无法提供服务，两座水厂不能完成供水。", []), (Q, "本助手无法提供该数据。", ["refusal"]), (Q, "很遗憾，暂时不能提供相关内容。", ["refusal"]), (Q, "渡船一度拒绝处理货物。", []),
    (Q, "2015年沙关康湖内涝的主要影响是柑橘减产17吨。", []), (Q, "Heavy rain damaged 466 metres of the levee at Fengchongxin.", ["other_language"]), (Q, "大雨のためDanyawangの堤防が742メートルにわたって崩れました。", ["other_language"]), (E, "苗圃断水307小时，铁路便线中断228米。", ["other_language"]), (E, "La crue près de Songfengyou a touché 1328 foyers et coupé la route.", ["other_language"]),
    (Q, "44亩鱼塘被淹（GDP 占比与PM2.5变化未统计）。", []), (Q, "受上游来水影响，松滩后县（Táotǎnyòu）的闸门满负荷运行9小时。", []), (E, "A dyke built in 2006 held, although seepage reached 89 litres a minute.", []),
    (Q, "沿江公路中断30", ["truncated"]), (Q, "370户学校受灾，并（", ["truncated"]), (E, "According to the shift l", ["truncated"]), (Q, "10亩被淹（其中水田。", ["truncated"]),
    (None, "10亩被淹。", []), (None, None, ["empty"]), ("", "x" * 50_000 + "。", []),
]


@pytest.mark.parametrize(("question", "answer", "want"), CASES)
def test_rules(question, answer, want):
    assert pairs.defects(question, answer)[0] == want


@pytest.mark.parametrize("most", [pairs.MAX_BYTES, 0])
def test_whole_statements_are_complete(spark, rows, monkeypatch, most):
    monkeypatch.setattr(pairs, "MAX_BYTES", most)
    asked = spark.createDataFrame([("a", Q, "边坡局部失稳"), ("b", Q, "边坡局部"), ("c", Q, "边坡局部失稳"), (None, Q, None)], "qid string, question string, gold_answer string")
    known = spark.createDataFrame([("边坡局部失稳", 1), ("边坡局部失稳", 2), (None, 3)], "statement string, qid int")
    assert rows(pairs.judge(asked, known)) == [("b", ["truncated"]), (None, ["empty"])]
    assert rows(pairs.judge(asked, known.limit(0)).select("qid")) == [("a",), ("b",), ("c",), (None,)]
    assert pairs.judge(asked.limit(0), known).count() == 0
