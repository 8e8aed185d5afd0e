"""Defective question-answer pairs (problem 4).

Ordered rules for emptiness, refusal in several languages, copied questions, script and language mismatch, and unfinished endings; every
rule that holds is emitted, in that order. The rules see content, not punctuation. Whether an answer without a closing mark is the whole text of a known
statement (a complete answer however short) is a set question and is settled by joins for the answers in
doubt only: their distinct texts are sent to the scan of the statements as a broadcast of ``MAX_BYTES`` at most (beyond that both sides are shuffled), and of the statements only those they equal are kept. Answers in no doubt are passed by.

Null or blank answers are ``empty``; a null question makes only ``empty``, ``refusal`` and ``truncated`` possible. Very long answers are read whole. Repeated rows
give rows each. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkg.session import written

#: Bytes of answers in doubt that may be broadcast.
MAX_BYTES = 16_000_000
ORDER = ("empty", "refusal", "copied", "other_language", "truncated")
# What stands in place of an answer.
PLACEHOLDERS = frozenset("na n/a null none nil nan tbd todo unknown undefined empty noanswer notavailable xxx 无 空 暂无 暂缺 待补 待补充 待填 待定 未填 未知 不详 略 见上 同上 无答案 没有答案 暂无答案 无内容 暂无数据".split())
# How answers decline, by language.
REFUSALS = [
    r"(?:无法|不能|不便|难以|无权|拒绝|没法|没办法|不方便|不可以)(?:直接)?(?:为您|向您|给您|对此|就此|协助)?(?:回答|作答|答复|回复|提供|协助|处理|评价|评论|给出|作出|做出|透露|讨论|满足|完成|告知|帮助|帮到)",
    r"不予(?:作答|回答|答复|置评|评论|提供)|恕(?:我|难|不)|恕难从命|无可奉告",
    r"(?:我|本人|本助手|本模型)(?:们)?(?:的)?(?:能力|知识|权限)(?:范围|限制)|超出(?:了)?我的|(?:我|本助手)没有(?:权限|能力|办法|相关信息)|没有权限查询",
    r"\bi(?:'m| am) (?:sorry|unable|not able|not allowed)|\b(?:i|we) (?:can(?:'t|not|no)|can not|won't|will not|am unable|do not|don't|must decline|have to decline|decline|refuse)\b[^.]{0,20}\b(?:be able|help|answer|assist|provide|comment|discuss|share|respond|fulfil|fulfill|complete|have (?:access|permission|information)|know)",
    r"\bunable to (?:answer|help|assist|provide|comment)|\bas an? (?:ai|language model|large language model|assistant)|\b(?:beyond|outside) my (?:ability|abilities|scope|knowledge)|\bdecline to (?:answer|comment)",
    r"\bkann (?:ich )?(?:diese |die |ihnen |dazu |dabei |das )?[^.]{0,30}nicht (?:beantworten|helfen|sagen)|\bich kann (?:leider )?nicht|\btut mir leid|\bje (?:ne peux|suis désolé|regrette)|\bne peux pas (?:répondre|vous aider)|\blo siento\b|\bno puedo (?:responder|ayudar|proporcionar)|\bmi dispiace\b|\bnão posso (?:responder|ajudar)",
    r"(?:お答え|回答|返答|お手伝い)(?:する)?(?:こと)?(?:は|が)?(?:でき|いたしかね|出来)|申し訳(?:あり|ござい)|извините|(?:я )?не могу (?:ответить|помочь|предоставить)|답변(?:할|드릴) 수 없|죄송합니다",
]
_refusal = re.compile("|".join(f"(?:{x})" for x in REFUSALS))
#: Chinese: what may stand before a refusal in its clause (no other subject), and what it may refer to; a report says who could not do what to which thing.
_polite = re.compile(r"很抱歉|非常抱歉|抱歉|对不起|不好意思|很遗憾|遗憾的是|遗憾|您好|你好|作为[^，。]{0,12}|暂时|目前|现在|实在|确实|恐怕|因此|所以|对此|就此|也|都|还|请原谅|sorry|(?:该|这个|这一|此类?|您的|你的|上述)(?:个)?(?:问题|请求|内容|提问)|关于[^，。]{0,20}|[\s,，]")
_speaker = re.compile(r"我|恕|本人|本助手|本模型|语言模型")
_matter = re.compile(r"^(?:您|你|这|该|此|任何|更多|具体|相关|有关|准确|确切|明确|上述)|(?:内容|信息|资料|数据|答案|回答|答复|请求|要求|问题|帮助|协助|意见|评论|建议)$")
_clause = re.compile(r"[^，。！？；：,!?;:]*")
_lead = re.compile(r"^\W*(?:请问|请教|问题|提问|题目|问|原题|您问的是|你问的是|关于|回答|答案|答|question|query|prompt|q|answer|a|you asked|the question is|regarding)\s*[：:，,]?\s*", re.I)
# Words that go with a question in a copied answer without adding to it.
FILLER = frozenset("的 了 呢 吗 啊 吧 请 问 题 是 the a an is question answer q".split())
_token = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W\d_]+|\d+(?:\.\d+)?")
_quoted = re.compile(r"[«“\"「『][^«»“”\"「」『』]*[»”\"」』]|[（(][^（）()]*[）)]")
#: Capitalised names, codes and units inside a Chinese text.
_names = re.compile(r"(?<![^\W\d_㐀-鿿])(?:[A-Z][A-Za-zÀ-ɏ'-]*|[A-Za-z0-9.]*\d[A-Za-z0-9.]*|[a-zμ³²/%°]{1,3})(?![A-Za-zÀ-ɏ])")
_closing = "”’»」』）)]】》\"' \t\r\n　"
#: Marks that end a sentence.
_end = re.compile(r"[。！？!?.]$")
_openers = {"（": "）", "(": ")", "“": "”", "「": "」", "『": "』", "【": "】", "《": "》", "[": "]", "«": "»"}
# Function words that tell languages written in Latin letters apart.
FUNCTION_WORDS = {
    "en": "a an it but although as or than be been will would there they we you i the of and to in at was were for by on with only about after before near had have has from while until above over still around their not that this which is are",
    "fr": "le la les des du de une un et à en dans près est sont ont été par sur pour avec au aux qui que ne pas il elle cette ce après",
    "de": "der die das den dem des ein eine und in im bei wurden wurde war waren ist sind mit auf für von zu nach nicht durch am an über hat haben",
    "es": "el la los las de del y en un una por para con fue fueron se su al que no más cerca tras ha han",
    "pt": "o a os as de do da dos das e em no na um uma por para com foi foram se que não perto após",
    "it": "il lo la gli le di del della e in un una per con fu sono è stato stati che non vicino dopo nel nella",
    "nl": "de het een en van in op bij met voor door werd werden is zijn niet aan dat die na over",
}
_words = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


def _clean(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "")
    return "".join(ch for ch in folded if unicodedata.category(ch) not in ("Cf", "Cc") or ch in "\n\t").strip()


def _counts(text: str) -> dict[str, int]:
    """Letters by script, without figures, codes, units and capitalised names."""
    if re.search("[㐀-鿿]", text):
        text = _names.sub(" ", text)
    out = dict.fromkeys(("han", "kana", "hangul", "cyrillic", "latin", "other"), 0)
    for ch in text:
        c = ord(ch)
        if 0x3400 <= c <= 0x9FFF or 0x20000 <= c <= 0x3FFFF:
            out["han"] += 1
        elif 0x3040 <= c <= 0x30FF:
            out["kana"] += 1
        elif 0xAC00 <= c <= 0xD7A3:
            out["hangul"] += 1
        elif 0x400 <= c <= 0x52F:
            out["cyrillic"] += 1
        elif ch.isalpha():
            out["latin" if c < 0x250 or 0x1E00 <= c < 0x1F00 else "other"] += 1
    return out


def language(text: str) -> str | None:
    """``zh``, ``ja``, ``ko``, ``ru``, a language in Latin letters, ``latin`` where these don't tell, or None without letters."""
    n = _counts(text)
    if not (total := sum(n.values())):
        return None
    if n["kana"] >= 2 and n["kana"] * 5 >= n["han"] + n["kana"]:
        return "ja"
    if n["han"] and n["han"] * 2 >= total - n["latin"] * 0.7:
        return "zh"
    for script, name in (("hangul", "ko"), ("cyrillic", "ru"), ("other", "other")):
        if n[script] * 2 >= total - n["latin"] * 0.5:
            return name
    seen = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in v for w in seen) for k, v in _words.items()}
    best = max(score.values())
    if best == 0:
        return "latin"
    return "en" if score["en"] == best else max(score, key=lambda k: (score[k], k))


def _tokens(text: str) -> list[str]:
    return _token.findall(text.lower())


def is_empty(answer: str) -> bool:
    key = "".join(ch for ch in answer if ch.isalnum() or ch == "/")
    return not key.strip("/") or key.lower() in PLACEHOLDERS


def is_refusal(answer: str) -> bool:
    """Declines in the first person or in none; what others could not do is a report."""
    text = answer.lower().replace("’", "'")
    for m in _refusal.finditer(text):
        if not re.search("[㐀-鿿]", m[0]) or re.search("[぀-ヿ]", m[0]):
            return True
        start = max(text.rfind(mark, 0, m.start()) for mark in "，。！？；：,!?;:") + 1
        before, after = text[start : m.start()], _clause.match(text, m.end())[0].strip()
        own = _speaker.search(before + m[0]) or not _polite.sub("", before)
        if own and (not after or _speaker.search(before + m[0]) or _matter.search(after)):
            return True
    return False


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question's own words and a lead-in; one that breaks off before all of them are said is only unfinished."""
    own = set(_tokens(question))
    said = [t for t in _tokens(_lead.sub("", answer)) if t not in FILLER]
    if not own or not _tokens(answer) or not all(t in own for t in said):
        return False
    return bool(_end.search(answer.rstrip(_closing))) or not said or own - FILLER <= set(said)


def is_other_language(question: str, answer: str) -> bool:
    asked, given = language(question), language(answer)
    if asked is None or given is None or asked == given:
        return False
    if given == "latin":  # a few Latin letters without function words: names and units
        return asked not in ("en", "latin") and len(_tokens(answer)) >= 4 and not re.search("[㐀-鿿]", answer)
    return asked != "latin" or given in ("zh", "ja", "ko", "ru", "other")


def is_unclosed(answer: str) -> bool:
    depth: dict[str, int] = {}
    for ch in answer:
        if ch in _openers:
            depth[_openers[ch]] = depth.get(_openers[ch], 0) + 1
        elif depth.get(ch):
            depth[ch] -= 1
    return any(depth.values())


def defects(question: str | None, raw: str | None) -> tuple[list[str], bool]:
    """The defects of a pair; and whether only the missing closing mark speaks for ``truncated``, so that a whole known statement is none."""
    answer, asked = _clean(raw), _clean(question)
    if is_empty(answer):
        return ["empty"], False
    out = []
    if is_refusal(answer):
        out.append("refusal")
    if asked and is_copy(asked, answer):
        out.append("copied")
    if asked and is_other_language(asked, answer):
        out.append("other_language")
    open_end = not _end.search(unicodedata.normalize("NFKC", answer.rstrip(_closing))) or answer.endswith(("...", "…"))
    if is_unclosed(answer) or open_end:
        out.append("truncated")
    return out, out[-1:] == ["truncated"] and open_end


def judge(pairs: DataFrame, statements: DataFrame) -> DataFrame:
    """(qid, defects: array in order) of every defective pair of ``pairs`` (qid, question, gold_answer); ``statements`` (statement): texts that are
    complete as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("qid", pa.string()), ("defects", pa.list_(pa.string())), ("statement", pa.string())])
        for batch in batches:
            out: list[list] = [[], [], []]
            for qid, question, answer in zip(*(batch.column(c).to_pylist() for c in ("qid", "question", "gold_answer")), strict=True):
                found, doubt = defects(question, answer)
                if found:
                    for column, value in zip(out, (qid, found, answer.strip() if doubt else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    judged = written(pairs.select("qid", "question", "gold_answer").mapInArrow(run, "qid string, defects array<string>, statement string"), "judged")
    doubtful = judged.where("statement is not null")
    asked = written(doubtful.select("statement").distinct(), "asked")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("statement") + 60), F.lit(0))).first()[0]
    sent = F.broadcast if size <= MAX_BYTES else lambda df: df
    # Only statements that are asked for leave their scan; there are no more of them than are asked for.
    known = written(statements.select(F.trim("statement").alias("statement")).join(sent(asked), "statement", "left_semi").distinct(), "known")
    settled = doubtful.join(sent(known.withColumn("whole", F.lit(True))), "statement", "left")
    kept = F.when(F.col("whole"), F.array_remove("defects", "truncated")).otherwise(F.col("defects"))
    return judged.where("statement is null").select("qid", "defects").unionByName(settled.select("qid", kept.alias("defects")).where("size(defects) > 0"))
