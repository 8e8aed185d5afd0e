"""Queries of the record problems 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkg.operators import nested, orphans
from strandkg.plans import plainsql
from strandkg.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.open_references(table(spark, d, "results_extraction"))
    found = orphans.find_orphans(refs, table(spark, d, "kg_nodes"))
    return found.select("row_id", "rel_pos", "side", "status", F.date_format("at", "yyyy-MM").alias("period"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """The orphan counts per period, side and status."""
    return orphans.orphan_report(orphans.open_references(table(spark, d, "results_extraction")), table(spark, d, "kg_nodes"), "results_extraction")


def _tables(spark: SparkSession, d: str) -> nested.Tables:
    return nested.Tables(nested.log_bodies(table(spark, d, "results_extraction")).unionByName(nested.payload_bodies(table(spark, d, "extraction_payloads"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d).table("relation")
    return rows.select("origin", "rec_id", "item_pos", F.col("pos").alias("rel_pos"), "head_pos", "tail_pos")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).table("entity").select("pk", "parent_key", "origin", "rec_id", "item_pos", "pos", "name", "type")


def p5_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).sizes()


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_entities, p5_table_sizes)}

# --- The same in SQL ---


def _at(array: str, what: str, key: str = "row_id") -> str:
    """The elements of an array of the log with their positions."""
    return f"select {key}, unnest({array}) as {what}, unnest(range(len({array}))) as pos from results_extraction"


_NAMES = "extraction_result.entities"
_RELATIONS = "extraction_result.relations"
_ORPHANS = f"""strings as (select distinct s from (select id as s from kg_nodes union all select e.name from ({_at(_NAMES, "e")}) union all select r.head from ({_at(_RELATIONS, "r")}) union all select r.tail from ({_at(_RELATIONS, "r")})) where s is not null),
    forms as (select s, {plainsql.plain("s")} as p from strings),
    own as (select distinct row_id, p from ({_at(_NAMES, "e")}) join forms on s = e.name),
    sides as (select row_id, ingested_at, pos, 'head' as side, r.head as s from ({_at(_RELATIONS, "r", "row_id, ingested_at")}) union all select row_id, ingested_at, pos, 'tail', r.tail from ({_at(_RELATIONS, "r", "row_id, ingested_at")})),
    refs as (select row_id, ingested_at, pos, side, p from sides join forms using (s)),
    unmet as (select * from refs where not exists (select 1 from own where own.row_id = refs.row_id and own.p = refs.p)),
    lives as (select p, created_at, deleted_at from kg_nodes join forms on s = id),
    lost as (select row_id, pos, side, unmet.p as p, any_value(ingested_at) as ingested_at, max(case when lives.p is null then 0 when coalesce(deleted_at <= ingested_at, false) then 2 when coalesce(created_at <= ingested_at, created_at is null) then 3 else 1 end) as level from unmet left join lives on unmet.p = lives.p group by 1, 2, 3, 4)"""
_STATUS = "case level when 0 then 'missing' when 1 then 'late' else 'deleted' end as status"
_PAYLOADS = f"""bodies as (select payload_id, ({plainsql.read_json("payload")})::json as body from extraction_payloads where payload is not null),
    listed as (select payload_id, {plainsql.as_list("case json_type(body) when 'ARRAY' then body else " + plainsql.decoded("body->'items'") + " end")} as items from bodies where json_type(body) in ('OBJECT', 'ARRAY')),
    items as (select payload_id, item_pos, {plainsql.decoded("item")} as item from (select payload_id, unnest(items) as item, unnest(range(len(items))) as item_pos from listed)),
    results as (select payload_id, item_pos, item, {plainsql.decoded("item->'extraction_result'")} as found from items where json_type(item) = 'OBJECT'),
    parts as (select payload_id, item_pos, item, found, {plainsql.as_list(plainsql.decoded("found->'entities'"))} as ents, {plainsql.as_list(plainsql.decoded("found->'relations'"))} as rels from results),
    p_ents as (select 'payload' as origin, payload_id as rec_id, item_pos, pos, e, case when json_type(e->'name') = 'VARCHAR' then e->>'name' end as name, e->>'type' as type from (select *, unnest(ents) as e, unnest(range(len(ents))) as pos from parts) where json_type(e) = 'OBJECT'),
    p_rels as (select 'payload' as origin, payload_id as rec_id, item_pos, pos, r, case when json_type(r->'head') = 'VARCHAR' then r->>'head' end as head, case when json_type(r->'tail') = 'VARCHAR' then r->>'tail' end as tail from (select *, unnest(rels) as r, unnest(range(len(rels))) as pos from parts) where json_type(r) = 'OBJECT'),
    l_ents as (select 'log' as origin, row_id as rec_id, 0 as item_pos, pos, e.name as name, e.type as type from ({_at(_NAMES, "e")}) where e is not null),
    l_rels as (select 'log' as origin, row_id as rec_id, 0 as item_pos, pos, r.head as head, r.tail as tail from ({_at(_RELATIONS, "r")}) where r is not null),
    all_ents as (select origin, rec_id, item_pos, pos, name, type from l_ents union all select origin, rec_id, item_pos, pos, name, type from p_ents),
    all_rels as (select * from l_rels union all select origin, rec_id, item_pos, pos, head, tail from p_rels)"""
_FORMS = f"forms as (select s, {plainsql.plain('s')} as p from (select distinct name as s from all_ents where name is not null union select head from all_rels where head is not null union select tail from all_rels where tail is not null))"
_FIRSTS = "firsts as (select origin, rec_id, item_pos, p, min(pos) as first_pos from all_ents join forms on s = name group by 1, 2, 3, 4)"


def _children(of: str, path: str) -> str:
    """How many objects the arrays at ``path`` hold below the entities or relations of payloads."""
    return f"select coalesce(sum(len(list_filter({plainsql.as_list(f'{of}->{path}')}, lambda x: json_type(x) = 'OBJECT'))), 0)::bigint"


SQL = {
    "p2_found": f"with {_ORPHANS} select row_id, pos::int as rel_pos, side, {_STATUS}, strftime(ingested_at, '%Y-%m') as period from lost where level < 3",
    "p2_report": f"with {_ORPHANS}, opens as (select strftime(ingested_at, '%Y-%m') as period, side, count(*) as n_open from unmet group by 1, 2) select 'results_extraction' as table, period, side, status, n_orphans, n_keys, n_open from (select strftime(ingested_at, '%Y-%m') as period, side, {_STATUS}, count(*) as n_orphans, count(distinct p) as n_keys from lost where level < 3 group by 1, 2, 3) join opens using (period, side)",
    "p5_found": f"with {_PAYLOADS}, {_FORMS}, {_FIRSTS} select r.origin, r.rec_id, r.item_pos::int as item_pos, r.pos::int as rel_pos, coalesce(h.first_pos, -1)::int as head_pos, coalesce(t.first_pos, -1)::int as tail_pos from all_rels r left join forms a on a.s = r.head left join firsts h on h.origin = r.origin and h.rec_id = r.rec_id and h.item_pos = r.item_pos and h.p = a.p left join forms b on b.s = r.tail left join firsts t on t.origin = r.origin and t.rec_id = r.rec_id and t.item_pos = r.item_pos and t.p = b.p",
    "p5_entities": f"with {_PAYLOADS} select origin || '/' || rec_id || '/i' || item_pos || '/e' || pos as pk, origin || '/' || rec_id || '/i' || item_pos as parent_key, origin, rec_id, item_pos::int as item_pos, pos::int as pos, name, type from all_ents",
    "p5_table_sizes": f"""with {_PAYLOADS}, sizes(tag, n) as (
      select 'record', (select count(*) from results_extraction where extraction_result is not null) + (select count(*) from bodies where json_type(body) in ('OBJECT', 'ARRAY'))
      union all select 'item', (select count(*) from results_extraction where extraction_result is not null) + (select count(*) from results)
      union all select 'entity', (select count(*) from all_ents) union all select 'relation', (select count(*) from all_rels)
      union all select 'mention', ({_children("e", "'mentions'")} from p_ents) union all select 'code', ({_children("(e->'attrs')", "'codes'")} from p_ents) union all select 'evidence', ({_children("r", "'evidence'")} from p_rels))
      select tag, n as n_rows, case tag when 'record' then 0 else n end as n_with_parent from sizes where n > 0""",
}
