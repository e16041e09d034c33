"""Queries of the general data problems: each applies its operator, with the settings used in production, to whole tables."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.operators.heavy_keys import heavy_keys, key_stats
from weftspan.operators.hierarchy import below_counts, first_arrivals, hierarchies, intervals
from weftspan.operators.nested import flat_tables, load_mappings, map_records, value_text
from weftspan.operators.references import clean_key, find_orphans
from weftspan.operators.timestamps import abbreviations, normalise_timestamps, unix_instant_us
from weftspan.runtime import cut, epoch_us, table

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"


def _p1_events(spark: SparkSession, base: str) -> DataFrame:
    pv = table(spark, base, "pv_events").select("pv_id", "pv_timestamp", "application_name", "ingested_at")
    return normalise_timestamps(pv, "pv_timestamp", "application_name", "ingested_at", table(spark, base, "applications"))


def _p1_nodes(spark: SparkSession, base: str) -> DataFrame:
    nodes = table(spark, base, "nodes").select("id", "start_timestamp", "application_name", "ingested_at")
    return normalise_timestamps(nodes, "start_timestamp", "application_name", "ingested_at", table(spark, base, "applications"), integers=True)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    events = _p1_events(spark, base).where(F.col("ts_status").isin("explicit", "registry") & ~F.col("pv_timestamp").rlike(CANONICAL))
    nodes = _p1_nodes(spark, base).where((F.col("ts_status") == "explicit") & (F.col("ts_layout") != "unix_ns"))
    return events.select(F.lit("pv_events").alias("record_table"), F.col("pv_id").alias("record_id"), F.col("ts_instant_us").alias("instant_us")).unionAll(
        nodes.select(F.lit("nodes").alias("record_table"), F.col("id").alias("record_id"), F.col("ts_instant_us").alias("instant_us"))
    )


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    """Per table and application: how its times are written, and how many could not be settled. An order that is not settled has no name."""
    unsettled = (F.col("ts_status") == "ambiguous") & F.col("ts_layout").isin("dmy", "mdy")
    parts = [
        x.select(F.lit(name).alias("record_table"), "application_name", F.when(unsettled, "slash").otherwise(F.coalesce("ts_layout", F.lit("-"))).alias("layout"), F.col("ts_status").alias("status"))
        for name, x in (("pv_events", _p1_events(spark, base)), ("nodes", _p1_nodes(spark, base)))
    ]
    return parts[0].unionAll(parts[1]).groupBy("record_table", "application_name", "layout", "status").agg(F.count(F.lit(1)).alias("n_records"))


def p1_node_units(spark: SparkSession, base: str) -> DataFrame:
    """Start times of nodes brought to UTC, counted per unit and day."""
    day = F.date_format(F.timestamp_micros("ts_instant_us"), "yyyy-MM-dd")
    rows = _p1_nodes(spark, base).where("ts_status = 'explicit'")
    return rows.groupBy(F.col("ts_layout").alias("unit"), day.alias("utc_day")).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("ts_instant_us").cast("decimal(38,0)")).cast("string").alias("sum_us"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    nodes, pv = table(spark, base, "nodes"), table(spark, base, "pv_events")
    keys = nodes.select(clean_key(F.col("event_id")).alias("k"), epoch_us(nodes, "ingested_at").alias("at"))
    refs = nodes.select(F.lit("nodes").alias("ref_table"), F.col("id").alias("ref_id"), clean_key(F.col("parent_event_id")).alias("k"), epoch_us(nodes, "ingested_at").alias("at")).unionAll(
        pv.select(F.lit("pv_events").alias("ref_table"), F.col("pv_id").alias("ref_id"), clean_key(F.col("event_id")).alias("k"), epoch_us(pv, "ingested_at").alias("at"))
    )
    deletions = table(spark, base, "node_deletions").select(clean_key(F.col("event_id")).alias("k"))
    return find_orphans(keys, refs, deletions)


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphans per table, kind and day of ingestion."""
    return p2_found(spark, base).groupBy("ref_table", "orphan_kind", "period_day").agg(F.count(F.lit(1)).alias("n_references"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return heavy_keys(table(spark, base, "nodes").select("job_name", "job_id"), ["job_name", "job_id"], 0.025).select("key_field", "heavy_key")


def _p3_stats(spark: SparkSession, base: str, key: str) -> DataFrame:
    nodes = table(spark, base, "nodes")
    out = key_stats(nodes, key, clean_key(F.col("event_id")), unix_instant_us(F.col("start_timestamp")), "id")
    return out.select(F.col("key").alias(key), F.col("n_rows").alias("n_spans"), F.col("n_values").alias("n_events"), F.col("first_time").alias("first_start_us"), F.col("last_time").alias("last_start_us"))


def p3_job_stats(spark: SparkSession, base: str) -> DataFrame:
    return _p3_stats(spark, base, "job_id")


def p3_workflow_stats(spark: SparkSession, base: str) -> DataFrame:
    return _p3_stats(spark, base, "job_name")


def _p4_links(spark: SparkSession, base: str) -> DataFrame:
    nodes = table(spark, base, "nodes")
    keep = {"job": F.col("job_id"), "p": clean_key(F.col("parent_event_id")), "loc": F.col("id")}
    return first_arrivals(nodes, clean_key(F.col("event_id")), epoch_us(nodes, "ingested_at"), "id", keep)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    out = hierarchies(_p4_links(spark, base))
    finding = F.when(F.col("state") != "tree", F.col("state")).when(F.col("depth") >= 25, "deep")
    return out.select(F.col("job").alias("job_id"), F.col("k").alias("event_id"), F.col("top").alias("top_event_id"), finding.alias("finding")).where("finding is not null")


def p4_hierarchy(spark: SparkSession, base: str) -> DataFrame:
    """Every span with top, depth, path (joined by ``/``) and the number of spans below it."""
    out = cut(hierarchies(_p4_links(spark, base), with_path=True))
    return out.join(below_counts(out).drop("job"), "k", "left").select(
        F.col("job").alias("job_id"), F.col("k").alias("event_id"), F.col("top").alias("top_event_id"), "depth", "state", F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")
    )


def p4_descendants(spark: SparkSession, base: str) -> DataFrame:
    """The spans below each span: those of its job with numbers above ``order_no`` up to ``last_no``."""
    return intervals(cut(hierarchies(_p4_links(spark, base), with_path=True))).select(F.col("job").alias("job_id"), F.col("k").alias("event_id"), "order_no", "last_no")


SPANS = "resource_spans.scope_spans.spans"
SPAN_FIELDS = ["job_name", "job_id", "event_type", "event_id", "start_timestamp", "end_timestamp", "application_name", "parent_event_id", "child_event_ids"]


def _span_numbers() -> list:
    return [F.col("label").getItem(i).alias(n) for i, n in enumerate(("resource_no", "scope_no", "span_no"))]


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    out = map_records(table(spark, base, "otel_records"), table(spark, base, "field_mappings"), SPANS, ["event_id", "event_type"])
    return out.where("event_type is not null").select(F.col("record").alias("raw_id"), *_span_numbers(), F.col("event_id").alias("span_id"), "event_type")


def p5_spans(spark: SparkSession, base: str) -> DataFrame:
    """The span table with all mapped fields; (raw_id, resource_no, scope_no) is its link to the scope."""
    out = map_records(table(spark, base, "otel_records"), table(spark, base, "field_mappings"), SPANS, SPAN_FIELDS)
    return out.select(F.col("record").alias("raw_id"), *_span_numbers(), *SPAN_FIELDS)


def _p5_flat(spark: SparkSession, base: str) -> DataFrame:
    return flat_tables(table(spark, base, "otel_records"), load_mappings(table(spark, base, "field_mappings"))[1])


def p5_attributes(spark: SparkSession, base: str) -> DataFrame:
    """The attribute table of spans, each row with its label and that of its span.

    ``value`` is the string, number or truth value that lies alone under ``value``, else (lists, several values) the JSON
    text of all that lies there; the same holds for ``key``. The value of an attribute that is no object is itself.
    """
    attributes = f"{SPANS}.attributes"
    wanted = {(attributes, "key"), (attributes, "value")}
    rows = flat_tables(table(spark, base, "otel_records"), load_mappings(table(spark, base, "field_mappings"))[1], wanted, value_text).where(F.col("table") == attributes)
    value = F.coalesce(F.try_element_at("columns", F.lit("value")), F.try_element_at("columns", F.lit("")))
    return rows.select(F.col("record").alias("raw_id"), "label", "parent_label", F.try_element_at("columns", F.lit("key")).alias("key"), value.alias("value"))


def p5_rows(spark: SparkSession, base: str) -> DataFrame:
    """Every row of every flat table (resources, scopes, spans, attributes of any of them, array values and the rest) with the link
    to its parent (raw_id, parent_table, parent_label); a document without records is one row with the reason."""
    columns = F.array_sort(F.map_entries("columns"))
    return _p5_flat(spark, base).select(F.col("record").alias("raw_id"), F.col("table").alias("table_path"), "label", "parent_table", "parent_label", columns.alias("columns"), "reason")


def p5_tables(spark: SparkSession, base: str) -> DataFrame:
    """The flat tables that the records give, with their rows, parents and widest row; and the documents that give none."""
    rows = _p5_flat(spark, base)
    return rows.groupBy(F.coalesce("table", F.concat(F.lit("no records: "), "reason")).alias("table_path")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.regexp_extract("label", r"(\d+)$", 1).isin("0", ""), 1).otherwise(0)).alias("n_parents"), F.max(F.size("columns")).alias("most_columns"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_node_units": p1_node_units, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_job_stats": p3_job_stats, "p3_workflow_stats": p3_workflow_stats, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_spans": p5_spans, "p5_attributes": p5_attributes, "p5_rows": p5_rows, "p5_tables": p5_tables}

_P1_UNIT = """case when abs(start_timestamp) < 100000000000 then 'unix_s' when abs(start_timestamp) < 100000000000000 then 'unix_ms'
  when abs(start_timestamp) < 100000000000000000 then 'unix_us' else 'unix_ns' end"""
_CLEAN = r"nullif(nullif(nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^0+$', ''), ''), 'none'), '')"
_P2 = f"""
with n as (select *, {_CLEAN.format('event_id')} as k, {_CLEAN.format('parent_event_id')} as p from nodes),
keys as (select k, min(ingested_at) as first_at from n where k is not null group by k),
refs as (select 'nodes' as ref_table, id as ref_id, p as k, ingested_at from n where p is not null
  union all select 'pv_events', pv_id, {_CLEAN.format('event_id')}, ingested_at from pv_events where {_CLEAN.format('event_id')} is not null),
gone as (select distinct {_CLEAN.format('event_id')} as k from node_deletions),
found as (select ref_table, ref_id, refs.k as target_event_id,
  case when keys.k is not null then 'late' when gone.k is not null then 'deleted' else 'missing' end as orphan_kind,
  strftime(ingested_at, '%Y-%m-%d') as period_day
  from refs left join keys on refs.k = keys.k left join gone on refs.k = gone.k
  where keys.k is null or keys.first_at > ingested_at)
"""
_P3 = f"""
with u as (select {{0}}, {_CLEAN.format('event_id')} as k, case when start_timestamp not in (0, 9223372036854775807) then
  case {_P1_UNIT} when 'unix_s' then start_timestamp * 1000000 when 'unix_ms' then start_timestamp * 1000 when 'unix_us' then start_timestamp else start_timestamp // 1000 end end as us from nodes)
select {{0}}, count(*) as n_spans, count(distinct k) as n_events, min(us) as first_start_us, max(us) as last_start_us from u group by 1"""
_P4 = f"""
with recursive v as (select job_id, {_CLEAN.format('event_id')} as k, {_CLEAN.format('parent_event_id')} as p from nodes where {_CLEAN.format('event_id')} is not null
  qualify row_number() over (partition by {_CLEAN.format('event_id')} order by ingested_at, id) = 1),
link as (select c.job_id, c.k, c.p from v c join v a on a.k = c.p and a.job_id = c.job_id),
up as (select job_id, k, k as node, [k] as seen from v
  union all select up.job_id, up.k, link.p, list_append(seen, link.p) from up join link on link.job_id = up.job_id and link.k = up.node where not list_contains(seen, link.p)),
ends as (select job_id, k, arg_max(node, len(seen)) as node, arg_max(seen, len(seen)) as seen from up group by 1, 2),
solved as (select e.job_id, e.k, e.node, e.seen, link.p as back, case when link.p is not null then list_min(seen[list_position(seen, link.p):]) end as ring
  from ends e left join link on link.job_id = e.job_id and link.k = e.node),
tree as (select job_id, k as event_id, coalesce(ring, node) as top_event_id, case when ring is null then len(seen) - 1 end as depth,
  case when ring is null then 'tree' when back = k then 'on_cycle' else 'leads_to_cycle' end as state,
  case when ring is null then array_to_string(list_reverse(seen), '/') end as path, seen from solved),
pairs as (select t.job_id, a as event_id, t.event_id as descendant_event_id, list_position(t.seen, a) - 1 as distance from (select *, unnest(seen[2:]) as a from tree where state = 'tree') t)
"""
_TAIL = r"(?: ?([Zz]|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?|(\[[^\]]+\])| ([A-Za-z]{2,5}))?$"
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?"
_HALVED = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?(?: ?([AaPp])\.?[Mm]\.?)?"


def _p1_layout(kind: str, pattern: str, groups: str, day: str, other: str = "null::date") -> str:
    names = ", ".join(f"'{g}'" for g in groups.split())
    half = "r.half" if " half " in groups else "''"
    return f"""select pv_id, app, z, o, '{kind}' as kind, {day} as day, {other} as other, lower({half}) as half, try_cast(r.h as int) as h, try_cast(r.mi as int) as mi, case when r.se = '' then 0 else try_cast(r.se as int) end as se, r.fr as fr, r.o1 as off, r.reg as reg, upper(r.ab) as ab
  from (select *, regexp_extract(s, '{pattern}', [{names}]) as r from t where regexp_matches(s, '{pattern}'))"""


def _p1_ctes() -> str:
    """Times read by one pattern each, in the registered zone and order, without any weighing of readings."""
    meanings = ", ".join(f"('{z}', '{a}', {o})" for z in sorted(available_timezones()) for a, o in abbreviations(z, (1, 4, 7, 10)).items())
    months = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(r.b))"
    date = lambda y, m, d: f"try_cast({y} || '-' || {m} || '-' || {d} as date)"
    kinds = [
        _p1_layout("iso", r"^(\d{4})-(\d{2})-(\d{2})[Tt ]" + _CLOCK + _TAIL, "y b c h mi se fr o1 reg ab", date("r.y", "r.b", "r.c")),
        _p1_layout("compact", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + _TAIL, "y b c h mi se fr o1 reg ab", date("r.y", "r.b", "r.c")),
        _p1_layout("ordinal", r"^(\d{4})-?(\d{3})[Tt ]" + _CLOCK + _TAIL, "y c h mi se fr o1 reg ab", "case when year(try_cast(r.y || '-01-01' as date) + (try_cast(r.c as int) - 1)) = try_cast(r.y as int) then try_cast(r.y || '-01-01' as date) + (try_cast(r.c as int) - 1) end"),
        _p1_layout("slash", r"^(\d{1,2})/(\d{1,2})/(\d{4}),? " + _HALVED + _TAIL, "a b y h mi se fr half o1 reg ab", f"case o when 'DMY' then {date('r.y', 'r.b', 'r.a')} when 'MDY' then {date('r.y', 'r.a', 'r.b')} end", f"coalesce(case when o is distinct from 'DMY' then {date('r.y', 'r.b', 'r.a')} end, case when o is distinct from 'MDY' then {date('r.y', 'r.a', 'r.b')} end)"),
        _p1_layout("textual", r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4}) " + _HALVED + _TAIL, "a b y h mi se fr half o1 reg ab", date("r.y", months, "r.a")),
    ]
    return f"""
with t as (select pv_id, application_name as app, pv_timestamp, trim(pv_timestamp, ' \t\n\r') as s, home_zone as z, upper(trim(date_order)) as o from pv_events left join applications using (application_name)),
parts as ({" union all ".join(kinds)}),
clocks as (select *, case when half = '' then h when h between 1 and 12 then h % 12 + case half when 'p' then 12 else 0 end end as h24 from parts),
walls as (select *, epoch_us(coalesce(day, other)::timestamp) as any_day, epoch_us(day::timestamp) + (h24::bigint * 3600 + mi * 60 + se) * 1000000 + coalesce(try_cast(rpad(left(fr, 6), 6, '0') as bigint), 0) as wall from clocks where h24 between 0 and 23 and mi between 0 and 59 and se between 0 and 59),
meaning(zone, abbr, seconds) as (values {meanings}),
placed as (select pv_id, app, kind, o, any_day, off as off0, reg, wall, replace(off, ':', '') as off, seconds, case when off = '' and ab = '' and (reg = '' or trim(reg, '[]') = z) then z end as zone, ab from walls left join meaning on zone = z and abbr = ab),
read as (select pv_id, app, kind, o, any_day, wall, zone, off0 = '' and ab = '' and reg = '' as bare, (off0 <> '' and (lower(off) = 'z' or length(off) >= 3)) or ab in ('GMT', 'UTC', 'UT') or (ab <> '' and off0 = '' and seconds is not null) as timed, case when lower(off) = 'z' or ab in ('GMT', 'UTC', 'UT') then wall
    when off <> '' then wall - case when left(off, 1) = '-' then -1 else 1 end * (substr(off, 2, 2)::bigint * 60 + coalesce(try_cast(substr(off, 4, 2) as int), 0)) * 60000000
    when ab <> '' then wall - seconds::bigint * 1000000
    when zone is not null then case when timezone(zone, timezone(zone, make_timestamp(wall - 10800000000)) + interval 3 hour) = make_timestamp(wall)
      then least(epoch_us(timezone(zone, make_timestamp(wall - 10800000000))) + 10800000000, epoch_us(timezone(zone, make_timestamp(wall)))) else epoch_us(timezone(zone, make_timestamp(wall))) end end as us from placed),
numbers as (select pv_id, app, split_part(s, '.', 1)::bigint as v, rpad(left(split_part(s, '.', 2), 6), 6, '0')::bigint as rest from t where regexp_full_match(s, '\\d{{1,18}}(\\.\\d+)?') or try_cast(s as bigint) is not null)"""


_P1_NODES = "nodes_us as (select id, start_timestamp as v from nodes where start_timestamp is not null and start_timestamp not in (0, 9223372036854775807) and abs(start_timestamp) < 100000000000000000)"
_UNIT_OF = """case when abs({0}) < 100000000000 then 'unix_s' when abs({0}) < 100000000000000 then 'unix_ms' when abs({0}) < 100000000000000000 then 'unix_us' else 'unix_ns' end"""
_P1_CTES = _p1_ctes()
_P1_FOUND = _P1_CTES + f""", {_P1_NODES},
plain as (select pv_id from t where not regexp_full_match(pv_timestamp, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{6}}Z'))
select 'pv_events' as record_table, pv_id as record_id, us as instant_us from read where us is not null and pv_id in (select pv_id from plain)
union all select 'pv_events', pv_id, case when abs(v) < 100000000000 then v * 1000000 + rest when abs(v) < 100000000000000 then v * 1000 + rest // 1000 when abs(v) < 100000000000000000 then v else v // 1000 end from numbers
union all select 'nodes', id, case when abs(v) < 100000000000 then v * 1000000 when abs(v) < 100000000000000 then v * 1000 else v end from nodes_us"""
_P1_REPORT = _P1_CTES + f""",
told as (select pv_id, app, kind, o, case when any_day is null or not (timed or bare or zone is not null) then '-' when kind <> 'slash' then kind when o is null then 'slash' when wall is null then case o when 'DMY' then 'mdy' else 'dmy' end else lower(o) end as layout,
    case when any_day is null or wall is null and (kind <> 'slash' or o is not null) or not (timed or bare or zone is not null) then 'unreadable' when not timed and zone is null then 'ambiguous' when kind = 'slash' then case when o is null then 'ambiguous' else 'registry' end when timed then 'explicit' else 'registry' end as status from read),
told_numbers as (select pv_id, app, {_UNIT_OF.format('v')} as layout, 'explicit' as status from numbers),
every as (select 'pv_events' as record_table, t.app as application_name, coalesce(told.layout, n.layout, '-') as layout, coalesce(told.status, n.status, case when coalesce(t.s, '') = '' then 'missing' else 'unreadable' end) as status
    from t left join told on told.pv_id = t.pv_id left join told_numbers n on n.pv_id = t.pv_id
  union all select 'nodes', application_name, case when start_timestamp is null or start_timestamp in (0, 9223372036854775807) then '-' else {_UNIT_OF.format('start_timestamp')} end, case when start_timestamp is null or start_timestamp in (0, 9223372036854775807) then 'missing' else 'explicit' end from nodes)
select record_table, application_name, layout, status, count(*) as n_records from every group by all"""


ORACLES = {
    "p1_found": _P1_FOUND,
    "p1_report": _P1_REPORT,
    "p4_found": _P4 + "select job_id, event_id, top_event_id, case when state <> 'tree' then state else 'deep' end as finding from tree where state <> 'tree' or depth >= 25",
    "p4_hierarchy": _P4 + """select t.job_id, t.event_id, top_event_id, depth, state, path, coalesce(n, 0) as n_descendants
  from tree t left join (select job_id, event_id, count(*) as n from pairs group by 1, 2) b on b.job_id = t.job_id and b.event_id = t.event_id""",
    "p4_descendants": _P4 + """, numbered as (select job_id, event_id, row_number() over (partition by job_id order by list_reverse(seen)) - 1 as order_no from tree where state = 'tree')
select n.job_id, n.event_id, order_no, order_no + coalesce(m, 0) as last_no from numbered n left join (select job_id, event_id, count(*) as m from pairs group by 1, 2) b on b.job_id = n.job_id and b.event_id = n.event_id""",
    "p1_node_units": f"""
with u as (select *, {_P1_UNIT} as unit from nodes where start_timestamp is not null and start_timestamp not in (0, 9223372036854775807)),
v as (select unit, case unit when 'unix_s' then start_timestamp * 1000000 when 'unix_ms' then start_timestamp * 1000 when 'unix_us' then start_timestamp else start_timestamp // 1000 end as us from u)
select unit, strftime(make_timestamp(us), '%Y-%m-%d') as utc_day, count(*) as n_records, cast(sum(us) as varchar) as sum_us from v group by 1, 2""",
    "p2_found": _P2 + "select * from found",
    "p3_found": " union all ".join(f"select '{k}' as key_field, {k} as heavy_key from nodes where {k} is not null group by {k} having count(*) >= 0.025 * (select count(*) from nodes)" for k in ("job_name", "job_id")),
    "p3_job_stats": _P3.format("job_id"),
    "p3_workflow_stats": _P3.format("job_name"),
    "p2_report": _P2 + "select ref_table, orphan_kind, period_day, count(*) as n_references from found group by all",
}
