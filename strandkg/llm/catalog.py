"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkg.llm import abuse, canon, leak, lookalike, mix, neardup, pairs, split
from strandkg.plans import plainsql
from strandkg.session import table


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    values = canon.free_values(table(spark, d, "sample_events"), table(spark, d, "results_extraction"))
    return canon.map_values(values, table(spark, d, "canon_values"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).drop("value")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that stand for no entry, with how often each occurs."""
    return _mapped(spark, d).where("canon_id = 0").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "results_extraction").select("row_id", F.col("raw_text").alias("text"))
    first = split.split_texts(texts).where("piece = 0")
    return first.select("row_id", F.when(F.col("forced_run") > split.LIMIT, "yes").otherwise("no").alias("forced"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "results_extraction").select("row_id", F.col("raw_text").alias("text"))).drop("forced_run")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return pairs.judge(table(spark, d, "qa_eval"), table(spark, d, "sample_events").select(F.col("impact").alias("statement")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("qid", F.col("defects")[0].alias("defect"))


def p4_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("qid", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.repair(lookalike.values_of(table(spark, d, "results_extraction"))).select("row_id", "field", "pos")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.repair(lookalike.values_of(table(spark, d, "results_extraction"))).select("row_id", "field", "pos", "plain")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "results_extraction").select(F.col("row_id").alias("id"), F.col("raw_text").alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*_near(spark, d)).select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its group of near-identical texts."""
    return neardup.groups(*_near(spark, d)).withColumnRenamed("id", "row_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item the documents it leaked into."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by the mixture of the largest size that all sources can serve."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return abuse.score_documents(documents, abuse.train(documents, table(spark, d, "content_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in abuse.CATEGORIES])
    return _scored(spark, d).select("doc_id", F.explode(F.array_compact(found)).alias("category"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", *abuse.CATEGORIES)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_pieces, p4_found, p4_all_defects, p6_found, p6_repaired, p7_found, p7_groups, p8_found, p8_items, p9_shares, p9_mixture, p10_found, p10_scores, p10_rates)}

_PIECES = r"""signs as (select row_id, raw_text, length(raw_text) as n, list_transform(range(1, length(raw_text) + 1), lambda i: substr(raw_text, i, 1)) as c from results_extraction where length(raw_text) > 600),
    spaced as (select *, list_transform(c, lambda x: strpos({spaces}, x) > 0) as s from signs),
    cuts as (select row_id, raw_text, n, list_filter(flatten(list_transform(range(1, n + 1), lambda i: [
        {{'p': i, 'l': case when c[i] = chr(10) and (i = n or c[i + 1] <> chr(10)) then 0 end}}, {{'p': i, 'l': case when strpos('。！？；', c[i]) > 0 then 1 end}},
        {{'p': i, 'l': case when strpos('，、：,:', c[i]) > 0 or (strpos('.!?;', c[i]) > 0 and i < n and s[i + 1]) then 2 end}}, {{'p': i, 'l': case when s[i] and (i = n or not s[i + 1]) then 3 end}}])), lambda x: x.l is not null) as points from spaced),
    parts(row_id, low, high, level) as (select row_id, 0::bigint, n, -1 from cuts union all
      select row_id, x.low, x.high, x.level from (select row_id, unnest([{{'low': low, 'high': best.p, 'level': best.l}}, {{'low': best.p, 'high': high, 'level': level}}]) as x from (
        select p.row_id as row_id, low, high, level, coalesce(list_sort(list_transform(list_filter(points, lambda x: x.p > low and x.p < high), lambda x: {{'k': (case when x.l < 2 then 0 else x.l * 4 end) + (case when abs(x.p - (low + high) // 2) <= greatest(1, (high - low) // 4) then 0 else 2 end) + (case when x.l = 1 then 1 else 0 end), 'd': abs(x.p - (low + high) // 2), 'p': x.p, 'l': x.l}}))[1], {{'k': 99, 'd': 0, 'p': (low + high) // 2, 'l': 4}}) as best
        from parts p join cuts using (row_id) where high - low > 600 - (case when low > 0 then 60 else 0 end)))),
    leaves as (select * from parts where high - low <= 600 - (case when low > 0 then 60 else 0 end))""".format(spaces="||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_HALF = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def _grams(source: str, key: str, column: str) -> str:
    """All runs of 60 letters of a table, one row each."""
    letters = f"regexp_replace(lower(translate({column}, '{_WIDE}', '{_HALF}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"select {key}, unnest(list_transform(range(1, greatest(length(l) - 58, 1)), lambda i: substr(l, i, 60))) as gram from (select {key}, {letters} as l from {source} where {column} is not null)"


_LEAKS = f"select distinct d.doc_id, p.item_id from ({_grams('documents', 'doc_id', 'text')}) d join ({_grams('eval_passages', 'item_id', 'passage')}) p on d.gram = p.gram"
_VALUES = "values_ as (select row_id, 'raw_text' as field, 0 as pos, raw_text as value from results_extraction union all select row_id, 'entity', pos, e.name from (select row_id, unnest(extraction_result.entities) as e, unnest(range(len(extraction_result.entities))) as pos from results_extraction))"
_PLAIN = f"{_VALUES}, forms as (select value, {plainsql.plain('value')} as plain from (select distinct value from values_ where value is not null)), odd as (select row_id, field, pos::int as pos, plain from values_ join forms using (value) where plain <> value)"
#: Distinct runs of three characters of each distinct text; pairs of texts by how many runs they share.
_SHARED = f"""texts as (select row_id, plain, dense_rank() over (order by plain) as t from (select row_id, {plainsql.plain('raw_text')} as plain from results_extraction where raw_text is not null) where length(plain) >= 3),
    runs as (select t, g, count(*) over (partition by t) as n from (select distinct t, unnest(list_transform(range(1, length(plain) - 1), lambda i: substr(plain, i, 3))) as g from (select distinct t, plain from texts))),
    alike as (select a.t as t1, b.t as t2, count(*) as both_, any_value(a.n) as n1, any_value(b.n) as n2 from runs a join runs b on a.g = b.g and a.t <= b.t group by 1, 2),
    near as (select t1, t2 from alike where both_ / (n1 + n2 - both_) >= 0.7)"""
SQL = {
    "p6_found": f"with {_PLAIN} select row_id, field, pos from odd",
    "p6_repaired": f"with {_PLAIN} select row_id, field, pos, plain from odd",
    "p7_found": f"with {_SHARED} select least(a.row_id, b.row_id) as row_id_a, greatest(a.row_id, b.row_id) as row_id_b from near join texts a on a.t = t1 join texts b on b.t = t2 where t1 < t2 or a.row_id < b.row_id",
    "p7_groups": f"""with recursive {_SHARED}, reps as (select t, min(row_id) as rep from texts group by t), links as (select t1, t2 from near where t1 < t2 union all select t2, t1 from near where t1 < t2),
      reach(t, u) as (select t, t from reps union select r.t, l.t2 from reach r join links l on r.u = l.t1), classes as (select r.t as t, min(rep) as group_id from reach r join reps on reps.t = r.u group by 1), counts as (select t1 as t, count(*) as n from links group by 1)
      select row_id, group_id, coalesce(n, 0) as n_links from texts join classes using (t) left join counts using (t)""",
    "p3_found": "select row_id, case when regexp_matches(raw_text, '[^。！？；\\n]{601,}') then 'yes' else 'no' end as forced from results_extraction where length(raw_text) > 600",
    "p3_pieces": f"with recursive {_PIECES} select row_id, (row_number() over (partition by row_id order by low) - 1)::int as piece, (case when low > 0 then low - 60 else 0 end)::int as start, high::int as \"end\", substr(raw_text, (case when low > 0 then low - 60 else 0 end) + 1, high - (case when low > 0 then low - 60 else 0 end)) as text, level::int as level from leaves join cuts using (row_id)",
    "p8_found": _LEAKS,
    "p8_items": f"select item_id, count(*) as n_documents from ({_LEAKS}) group by item_id",
}
