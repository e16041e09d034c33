"""Queries of the trace operators (validation, cleaning, fingerprints, sequencing) over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.operators import cleaning, fingerprint
from weftspan.operators import sequence as seq
from weftspan.plans.problem_queries import _CLEAN
from weftspan.runtime import cut, table

BUFFER_MINUTES = 60 * 24 * 20
GROUPS = {"ledger_close": {"archive": {"Query::fetch": "read", "lookup": "read"}, "send mail": {"price": "money", "persist": "money"}}, "parcel_intake": {"price": {"persist": "p", "notify": "p"}}, "meter_reading": {"score": {"/slot/open": "s", "route": "s"}}}
RENAMES = {"ledger_close": {"archive": ({"Query::fetch"}, "archive_read")}, "seat_booking": {"route": ({"archive", "lookup"}, "route_known")}, "meter_reading": {"price": ({"persist"}, "price_kept")}}


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.valid_records(table(spark, base, "nodes"))


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.spans_of(table(spark, base, "nodes"))


def _clean(spark: SparkSession, base: str) -> DataFrame:
    return cut(cleaning.name_jobs_by_root(cut(_spans(spark, base))))


def dedupe_first(spark: SparkSession, base: str) -> DataFrame:
    return _spans(spark, base)


def duplicate_report(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.duplicates(_rows(spark, base))


def reject_report(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.rejected_records(table(spark, base, "nodes")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))


def time_bounds(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.time_bounds(_rows(spark, base))


def _counted(spans: DataFrame) -> DataFrame:
    return spans.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_spans"))


def drop_inconsistent_jobs(spark: SparkSession, base: str) -> DataFrame:
    return _counted(cleaning.drop_inconsistent_jobs(cut(_spans(spark, base))))


def disconnected_jobs(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.disconnected_jobs(cut(_spans(spark, base)))


def _window(spark: SparkSession, base: str) -> tuple[int, int]:
    return cleaning.time_window(_rows(spark, base), BUFFER_MINUTES)


def time_window_jobs(spark: SparkSession, base: str) -> DataFrame:
    return _counted(cleaning.drop_jobs_outside(cut(_spans(spark, base)), *_window(spark, base)))


def root_job_name(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.name_jobs_by_root(cut(_spans(spark, base))).select("event_id", "job_name")


def root_check(spark: SparkSession, base: str) -> DataFrame:
    return cleaning.root_counts(_spans(spark, base))


def rejected_jobs(spark: SparkSession, base: str) -> DataFrame:
    return seq.rejected_jobs(cut(_spans(spark, base)))


def roots_in_window(spark: SparkSession, base: str) -> DataFrame:
    return fingerprint.roots_in_window(cut(_spans(spark, base)), *_window(spark, base))


def root_page(spark: SparkSession, base: str) -> DataFrame:
    """The third page of a hundred roots; paging is the feature."""
    return fingerprint.page(_spans(spark, base).where("parent_event_id is null").select("event_id", "job_id"), 200, 100)


def job_batch(spark: SparkSession, base: str) -> DataFrame:
    """Spans of the jobs whose fingerprint is on record."""
    return fingerprint.of_jobs(_spans(spark, base), table(spark, base, "job_hashes")).select("job_id", "event_id", "event_type", "start_timestamp")


def child_lists(spark: SparkSession, base: str) -> DataFrame:
    return fingerprint.children(_spans(spark, base)).select("job_id", "event_id", F.size("child_event_ids").alias("n_children"), F.array_join("child_event_ids", ",").alias("children"))


def filtered_stream(spark: SparkSession, base: str) -> DataFrame:
    jobs = table(spark, base, "job_hashes").select("job_name", "job_id")
    return fingerprint.select_jobs(_clean(spark, base), {"ledger_close", "parcel_intake", "seat_booking"}, jobs).select("job_name", "job_id", "event_id", "event_type")


def tree_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """The hash of every tree of every job."""
    return fingerprint.tree_hashes(_clean(spark, base))


def unique_graphs(spark: SparkSession, base: str) -> DataFrame:
    """For each workflow and structure the least job and how many share it."""
    return fingerprint.unique_graphs(fingerprint.job_hashes(_clean(spark, base))).select("job_name", "job_id", "n_jobs")


def _order_spans(spark: SparkSession, base: str) -> DataFrame:
    """Orders as traces of depth two: the order, its lines by return flag, and the suppliers' shipments below them."""
    lines = table(spark, base, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("kind"), F.count(F.lit(1)).alias("n"))
    job = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    line = F.concat(job, F.lit("-"), F.col("l_linenumber").cast("string"))
    orders = table(spark, base, "orders")
    none = F.lit(None).cast("string")
    top = orders.select(F.col("o_orderpriority").alias("job_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("o_orderstatus").alias("event_type"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"), none.alias("parent_event_id"))
    mid = lines.select(none.alias("job_name"), job.alias("job_id"), F.col("kind").alias("event_type"), line.alias("event_id"), job.alias("parent_event_id"))
    low = lines.where("n > 1").select(none.alias("job_name"), job.alias("job_id"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("event_type"), F.concat(line, F.lit("x")).alias("event_id"), line.alias("parent_event_id"))
    return top.unionByName(mid).unionByName(low).withColumn("start_timestamp", F.lit(0).cast("bigint"))


def tree_shapes(spark: SparkSession, base: str) -> DataFrame:
    """Orders as trees: for each workflow and structure the least order and how many share it."""
    spans = cut(_order_spans(spark, base))
    names = spans.where("job_name is not null").select("job_id", "job_name")
    hashes = fingerprint.tree_hashes(spans).where("job_id = top").join(names, "job_id").select("job_id", "job_name", F.col("tree_hash").alias("job_hash"))
    return fingerprint.unique_graphs(hashes).select("job_name", "job_id", "n_jobs")


def _sequenced(spark: SparkSession, base: str, **how) -> DataFrame:
    spans = _clean(spark, base).select("job_id", "event_id", "parent_event_id", "event_type", "job_name", "start_timestamp", "end_timestamp")
    return seq.with_predecessors(spans, **how).select("job_id", "event_id", F.array_join("previous", ",").alias("prev_ids"))


def seq_sync(spark: SparkSession, base: str) -> DataFrame:
    return _sequenced(spark, base)


def seq_async_overlap(spark: SparkSession, base: str) -> DataFrame:
    return _sequenced(spark, base, overlap=True)


def seq_prior_groups(spark: SparkSession, base: str) -> DataFrame:
    return _sequenced(spark, base, groups=GROUPS)


def seq_prior_plus_async(spark: SparkSession, base: str) -> DataFrame:
    return _sequenced(spark, base, overlap=True, groups=GROUPS)


def seq_rename_by_child(spark: SparkSession, base: str) -> DataFrame:
    return seq.rename_by_children(_clean(spark, base), RENAMES).select("event_id", "event_type")


def seq_pv_events(spark: SparkSession, base: str) -> DataFrame:
    """PV events of all jobs that are single trees."""
    out = seq.sequence(_clean(spark, base))
    return out.select("jobId", "eventId", "eventType", "timestamp", "applicationName", "jobName", F.array_join("previousEventIds", ",").alias("previousEventIds"))


QUERIES = {f.__name__: f for f in (
    seq_sync, seq_async_overlap, seq_prior_groups, seq_prior_plus_async, seq_rename_by_child, seq_pv_events, dedupe_first, duplicate_report, reject_report, time_bounds, drop_inconsistent_jobs, disconnected_jobs, time_window_jobs,
    root_job_name, root_check, rejected_jobs, roots_in_window, root_page, job_batch, child_lists, filtered_stream, tree_fingerprints, unique_graphs, tree_shapes,
)}

_MAX = 2**63 - 1


def _ns(c: str) -> str:
    return f"""case when {c} in (0, {_MAX}) then null when abs({c}) < 100000000000 then {c} * 1000000000 when abs({c}) < 100000000000000 then {c} * 1000000 when abs({c}) < 100000000000000000 then {c} * 1000 else {c} end"""


REC = f"""rec as (select id, ingested_at, job_name, job_id, event_type, {_CLEAN.format('event_id')} as event_id, {_ns('start_timestamp')} as start_timestamp, {_ns('end_timestamp')} as end_timestamp, application_name, {_CLEAN.format('parent_event_id')} as parent_event_id from nodes),
valid as (select * from rec where job_name is not null and job_id is not null and event_type is not null and event_id is not null and start_timestamp is not null and end_timestamp is not null and application_name is not null)"""
SPANS = REC + """,
spans as (select * exclude (id, ingested_at) from valid qualify row_number() over (partition by event_id order by ingested_at, id) = 1)"""
NAMED = SPANS + """,
root_names as (select job_id, min(job_name) as root_name from spans where parent_event_id is null group by 1),
named as (select s.* replace (coalesce(r.root_name, s.job_name) as job_name) from spans s left join root_names r on r.job_id = s.job_id)"""
WINDOW = f""",
bounds as (select coalesce(min(start_timestamp), 0) + {BUFFER_MINUTES * 60 * 10**9} as low, coalesce(max(end_timestamp), {_MAX}) - {BUFFER_MINUTES * 60 * 10**9} as high from valid),
inside as (select distinct job_id from spans, bounds where start_timestamp between low and high or end_timestamp between low and high)"""
REJECTED = """,
reach as (select job_id, event_id from spans where parent_event_id is null
  union all select s.job_id, s.event_id from reach r join spans s on s.job_id = r.job_id and s.parent_event_id = r.event_id),
apart as (select distinct c.job_id from spans c where parent_event_id is not null and not exists (select 1 from spans p where p.job_id = c.job_id and p.event_id = c.parent_event_id)),
up as (select job_id, event_id as k, event_id as node, 0 as n, parent_event_id as nxt from spans where not exists (select 1 from reach r where r.job_id = spans.job_id and r.event_id = spans.event_id)
  union all select u.job_id, u.k, s.event_id, n + 1, s.parent_event_id from up u join spans s on s.job_id = u.job_id and s.event_id = u.nxt where n < 2000),
ringed as (select distinct job_id from up where n = 2000),
tops as (select job_id, count(*) filter (parent_event_id is null) as n_roots from spans group by 1),
bad as (select job_id, min(reason) as reason from (select job_id, case when n_roots = 0 then 'no root' else 'several roots' end as reason from tops where n_roots <> 1
  union all select job_id, 'disconnected' from apart union all select job_id, 'ring' from ringed) group by 1)"""
_CONFIG = ", ".join(f"('{j}', '{p}', '{c}', '{g}')" for j, ps in GROUPS.items() for p, cs in ps.items() for c, g in cs.items())
_RENAME = ", ".join(f"('{j}', '{t}', '{c}', '{new}')" for j, ts in RENAMES.items() for t, (cs, new) in ts.items() for c in sorted(cs))


def _seq(overlap: bool, groups: bool, tail: str) -> str:
    number = "sum(case when before_end is null or before_end < first_start then 1 else 0 end) over (partition by job_id, parent_event_id order by first_start, first_id rows unbounded preceding)" if overlap else "row_number() over (partition by job_id, parent_event_id order by first_start, first_id)"
    config = f"left join (values {_CONFIG}) cfg(job_name, parent_type, child_type, group_id) on cfg.job_name = c.job_name and cfg.parent_type = p.event_type and cfg.child_type = c.event_type" if groups else "left join (select null as group_id) cfg on false"
    return f"""with recursive {NAMED}{REJECTED},
trees as (select * from named where job_id not in (select job_id from bad)),
kids as (select c.*, coalesce('cfg:' || cfg.group_id, 'one:' || c.event_id) as grp from trees c join trees p on p.job_id = c.job_id and p.event_id = c.parent_event_id {config}),
members as (select job_id, parent_event_id, grp, min(start_timestamp) as first_start, arg_min(event_id, (start_timestamp, event_id)) as first_id, arg_max(end_timestamp, (start_timestamp, event_id)) as last_end, list(event_id) as ids from kids group by 1, 2, 3),
lagged as (select *, lag(last_end) over (partition by job_id, parent_event_id order by first_start, first_id) as before_end from members),
numbered as (select *, {number} as group_no from lagged),
gathered as (select job_id, parent_event_id, group_no, list_sort(flatten(list(ids))) as ids from numbered group by 1, 2, 3),
placed as (select *, lag(ids) over w as before, lead(group_no) over w is null as is_last from gathered window w as (partition by job_id, parent_event_id order by group_no)),
sibs as (select job_id, unnest(ids) as event_id, before from placed),
down as (select job_id, event_id, []::varchar[] as inh from trees where parent_event_id is null
  union all select t.job_id, t.event_id, coalesce(s.before, d.inh) from down d join trees t on t.job_id = d.job_id and t.parent_event_id = d.event_id join sibs s on s.job_id = t.job_id and s.event_id = t.event_id),
done as (select d.job_id, d.event_id, array_to_string(coalesce(l.ids, d.inh), ',') as prev_ids from down d left join placed l on l.is_last and l.job_id = d.job_id and l.parent_event_id = d.event_id)
{tail}"""


_PLAIN = "select job_id, event_id, prev_ids from done"
_STAMP = "strftime(make_timestamp(cast(floor(end_timestamp::double / 1e9) as bigint) * 1000000 + cast(round_even((end_timestamp::double / 1e9 - floor(end_timestamp::double / 1e9)) * 1e6, 0) as bigint)), '%Y-%m-%dT%H:%M:%S.%fZ')"
ORACLES = {
    "seq_sync": _seq(False, False, _PLAIN), "seq_async_overlap": _seq(True, False, _PLAIN), "seq_prior_groups": _seq(False, True, _PLAIN), "seq_prior_plus_async": _seq(True, True, _PLAIN),
    "seq_pv_events": _seq(False, False, f'select t.job_id as "jobId", t.event_id as "eventId", event_type as "eventType", {_STAMP} as "timestamp", application_name as "applicationName", job_name as "jobName", prev_ids as "previousEventIds" from done d join trees t on t.job_id = d.job_id and t.event_id = d.event_id'),
    "seq_rename_by_child": f"""with {NAMED}, hit as (select p.job_id, p.event_id, min(cfg.new_type) as new_type from named p join named c on c.job_id = p.job_id and c.parent_event_id = p.event_id
  join (values {_RENAME}) cfg(job_name, parent_type, child_type, new_type) on cfg.job_name = p.job_name and cfg.parent_type = p.event_type and cfg.child_type = c.event_type group by 1, 2)
select n.event_id, coalesce(new_type, event_type) as event_type from named n left join hit h on h.job_id = n.job_id and h.event_id = n.event_id""",
    "dedupe_first": f"with {SPANS} select * from spans",
    "duplicate_report": f"with {REC} select event_id, count(*) as n_records from valid group by 1 having count(*) > 1",
    "reject_report": f"""with {REC}, r as (select 'without ' || array_to_string(list_filter([case when job_name is null then 'job_name' end, case when job_id is null then 'job_id' end, case when event_type is null then 'event_type' end, case when event_id is null then 'event_id' end,
  case when start_timestamp is null then 'start_timestamp' end, case when end_timestamp is null then 'end_timestamp' end, case when application_name is null then 'application_name' end], lambda x: x is not null), ',') as reason from rec)
select reason, count(*) as n_records from r where reason <> 'without ' group by 1""",
    "time_bounds": f"with {REC} select min(start_timestamp) as min_timestamp, max(end_timestamp) as max_timestamp from valid",
    "drop_inconsistent_jobs": f"""with {SPANS} select job_id, count(*) as n_spans from spans where job_id not in
  (select c.job_id from spans c where parent_event_id is not null and not exists (select 1 from spans p where p.event_id = c.parent_event_id)) group by 1""",
    "disconnected_jobs": f"with {SPANS} select distinct c.job_id from spans c where parent_event_id is not null and not exists (select 1 from spans p where p.job_id = c.job_id and p.event_id = c.parent_event_id)",
    "time_window_jobs": f"with {SPANS}{WINDOW} select job_id, count(*) as n_spans from spans where job_id in (select job_id from inside) group by 1",
    "root_job_name": f"with {NAMED} select event_id, job_name from named",
    "root_check": f"with {SPANS} select job_id, count(*) filter (parent_event_id is null) as n_roots from spans group by 1",
    "rejected_jobs": f"with recursive {SPANS}{REJECTED} select * from bad",
    "roots_in_window": f"with {SPANS}{WINDOW} select job_id, event_id from spans where parent_event_id is null and job_id in (select job_id from inside)",
    "root_page": f"with {SPANS} select event_id, job_id from spans where parent_event_id is null order by event_id limit 100 offset 200",
    "job_batch": f"with {SPANS} select job_id, event_id, event_type, start_timestamp from spans where job_id in (select job_id from job_hashes)",
    "child_lists": f"with {SPANS} select job_id, parent_event_id as event_id, count(*) as n_children, string_agg(event_id, ',' order by event_id) as children from spans where parent_event_id is not null group by 1, 2",
    "filtered_stream": f"with {NAMED} select job_name, job_id, event_id, event_type from named where job_name in ('ledger_close', 'parcel_intake', 'seat_booking') and exists (select 1 from job_hashes h where h.job_name = named.job_name and h.job_id = named.job_id)",
    "unique_graphs": f"""with recursive {NAMED},
nodes_at as (select job_id, event_id, parent_event_id, event_type, 0 as depth from named s where parent_event_id is null or not exists (select 1 from named p where p.job_id = s.job_id and p.event_id = s.parent_event_id)
  union all select c.job_id, c.event_id, c.parent_event_id, c.event_type, depth + 1 from nodes_at n join named c on c.job_id = n.job_id and c.parent_event_id = n.event_id),
up as (select job_id, event_id, parent_event_id, depth, md5(event_type) as shape from nodes_at where depth = (select max(depth) from nodes_at)
  union all select n.job_id, n.event_id, n.parent_event_id, n.depth, md5(n.event_type || coalesce(k.kids, ''))
  from (select distinct depth - 1 as depth from up where depth > 0) l join nodes_at n on n.depth = l.depth
  left join (select job_id, parent_event_id, string_agg(shape, '' order by shape) as kids from up group by 1, 2) k on k.job_id = n.job_id and k.parent_event_id = n.event_id),
jobs as (select job_id, string_agg(shape, '' order by shape) as shape from up where depth = 0 group by 1),
names as (select job_id, min(job_name) as job_name from named group by 1)
select job_name, min(job_id) as job_id, count(*) as n_jobs from jobs join names using (job_id) group by job_name, shape""",
    "tree_shapes": """with l as (select l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) as kind, count(*) as n from lineitem group by 1, 2),
m as (select l_orderkey, string_agg(shape, ';' order by shape) as shape from (select l_orderkey, kind || case when n > 1 then '(n' || n || ')' else '' end as shape from l) group by 1),
t as (select o_orderpriority as job_name, 'o' || o_orderkey as job_id, o_orderstatus || '(' || coalesce(shape, '') || ')' as shape from orders left join m on l_orderkey = o_orderkey)
select job_name, min(job_id) as job_id, count(*) as n_jobs from t group by job_name, shape""",
}
