"""Queries of the model operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.operators import event_sets as es
from weftspan.operators.references import clean_key
from weftspan.plans import mining
from weftspan.plans.problem_queries import _CLEAN
from weftspan.runtime import cut, table
from weftspan.schemas import START_EVENT


def _seqs(spark: SparkSession, base: str) -> DataFrame:
    """PV events as sequences per job; ids in the form in which they are compared."""
    pv = table(spark, base, "pv_events")
    pv = pv.withColumn("previous_event_ids", F.array_compact(F.transform("previous_event_ids", clean_key)))
    return cut(es.sequences_of_pv(pv, clean_key(F.col("event_id")), F.struct("ingested_at", "pv_id")))


def _text(c: str = "event_set"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["eventType"], F.lit("*"), x["count"].cast("string"))), ",")


def _sets(spark: SparkSession, base: str, direction: str) -> DataFrame:
    sets = es.neighbour_sets(es.links(_seqs(spark, base)), direction)
    return sets.groupBy(F.col("name").alias("job_name"), "event_type", _text().alias("event_set")).agg(F.count(F.lit(1)).alias("n"))


def eventset_out(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base, "out")


def eventset_in(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base, "in")


def _model(spark: SparkSession, base: str) -> DataFrame:
    return cut(es.model_rows(_seqs(spark, base)))


def model_rows(spark: SparkSession, base: str) -> DataFrame:
    return _model(spark, base).select("job_name", "event_type", "direction", _text().alias("event_set"))


def model_merge(spark: SparkSession, base: str) -> DataFrame:
    """Models of two halves of the jobs merged: the model of all of them."""
    seqs = _seqs(spark, base)
    half = F.pmod(F.length("seq") + F.ascii(F.substring("seq", -1, 1)), F.lit(2))
    merged = es.merge_models(es.model_rows(seqs.where(half == 0)), es.model_rows(seqs.where(half == 1)))
    return merged.where(F.size("event_set") > 0).select("job_name", "event_type", "direction", _text().alias("event_set"))


def eventset_reduced(spark: SparkSession, base: str) -> DataFrame:
    return es.supports(_model(spark, base)).select("job_name", "event_type", "direction", F.array_join("support", ",").alias("support"))


def eventset_counts(spark: SparkSession, base: str) -> DataFrame:
    return es.observed_counts(_model(spark, base)).select("job_name", "event_type", "direction", "neighbour", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


def eventset_subset(spark: SparkSession, base: str) -> DataFrame:
    return es.contains_set(_model(spark, base), {"persist": 1})


def eventset_drop_type(spark: SparkSession, base: str) -> DataFrame:
    return es.without_type(_model(spark, base), "persist").select("job_name", "event_type", "direction", _text().alias("event_set"))


def eventset_shared(spark: SparkSession, base: str) -> DataFrame:
    """Sets that meet two types: what they share with them, and what they hold several times."""
    rows = es.counts_of(_model(spark, base), {"persist", "notify"})
    return rows.select("job_name", "event_type", "direction", _text().alias("event_set"), _text("shared").alias("shared"), F.array_join("repeated", ",").alias("repeated"))


def _edges(spark: SparkSession, base: str) -> DataFrame:
    return cut(es.edges(_model(spark, base)))


def markov_edges(spark: SparkSession, base: str) -> DataFrame:
    return _edges(spark, base)


def overlap_components(spark: SparkSession, base: str) -> DataFrame:
    return es.overlap_components(_model(spark, base))


def dummy_start_edges(spark: SparkSession, base: str) -> DataFrame:
    linked = es.links(_seqs(spark, base), dummy_start=True)
    return linked.groupBy(F.col("name").alias("job_name"), F.col("src_type").alias("src"), F.col("dst_type").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def splice_dummy(spark: SparkSession, base: str) -> DataFrame:
    """Sequences without their ``persist`` events."""
    return es.splice_out(_seqs(spark, base), {"persist"}).select("seq", "event", F.array_join("previous", ",").alias("prev_ids"))


def reachability(spark: SparkSession, base: str) -> DataFrame:
    return es.reachability(_edges(spark, base))


def scc_nodes(spark: SparkSession, base: str) -> DataFrame:
    return es.strong_components(_edges(spark, base))


def loop_start_nodes(spark: SparkSession, base: str) -> DataFrame:
    return es.loop_starts(_edges(spark, base))


def loop_edges(spark: SparkSession, base: str) -> DataFrame:
    return es.loop_edges(_edges(spark, base))


def model_documents(spark: SparkSession, base: str) -> DataFrame:
    """Each workflow's model as a JSON document."""
    return es.models(_model(spark, base)).select("job_name", F.to_json(F.struct("job_name", "events")).alias("model"))


def gates(spark: SparkSession, base: str) -> DataFrame:
    """What follows and precedes each event type, as gates."""
    return mining.logic_gates(_model(spark, base))


def puml(spark: SparkSession, base: str) -> DataFrame:
    """An activity diagram of each workflow."""
    return mining.diagrams_of(_seqs(spark, base))[0]


QUERIES = {f.__name__: f for f in (
    eventset_out, eventset_in, model_rows, model_merge, eventset_reduced, eventset_counts, eventset_subset, eventset_shared, eventset_drop_type, markov_edges, overlap_components, dummy_start_edges, splice_dummy, reachability, scc_nodes, loop_start_nodes, loop_edges, model_documents, gates, puml,
)}

SEQS = f"""
seqs as (select job_id as seq, job_name as name, {_CLEAN.format('event_id')} as event, event_type as type, list_filter(list_transform(coalesce(previous_event_ids, []), lambda x: {_CLEAN.format('x')}), lambda x: x is not null) as previous
  from pv_events where {_CLEAN.format('event_id')} is not null and job_id is not null qualify row_number() over (partition by job_id, {_CLEAN.format('event_id')} order by ingested_at, pv_id) = 1),
prevs as (select distinct seq, name, event as dst, type as dst_type, unnest(previous) as src from seqs),
links as (select l.seq, l.name, l.src, s.type as src_type, l.dst, l.dst_type from prevs l join seqs s on s.seq = l.seq and s.event = l.src),
both_ways as (select seq, name, src as event, src_type as event_type, dst_type as nbr, 'out' as direction from links union all select seq, name, dst, dst_type, src_type, 'in' from links),
counted as (select seq, name, event, event_type, direction, nbr, count(*) as n from both_ways group by all),
sets as (select name as job_name, event_type, direction, list({{'t': nbr, 'n': n}} order by nbr) as s, string_agg(nbr || '*' || n, ',' order by nbr) as event_set from counted group by seq, name, event, event_type, direction),
bare as (select distinct name as job_name, type as event_type from seqs where not exists (select 1 from sets x where x.job_name = seqs.name and x.event_type = seqs.type)),
model as (select distinct job_name, event_type, direction, s, event_set from sets union all select job_name, event_type, 'out', [], '' from bare),
edges as (select distinct job_name, event_type as src, unnest(list_transform(s, lambda x: x.t)) as dst from model where direction = 'out')"""
REACH = """,
reach as (select job_name, src, dst from edges union select r.job_name, r.src, e.dst from reach r join edges e on e.job_name = r.job_name and e.src = r.dst),
scc as (select a.job_name, a.src as node, min(a.dst) as scc from reach a join reach b on a.job_name = b.job_name and a.src = b.dst and a.dst = b.src group by 1, 2),
starts as (select distinct e.job_name, e.dst as node from edges e join scc t on t.job_name = e.job_name and t.node = e.dst left join scc o on o.job_name = e.job_name and o.node = e.src where o.scc is distinct from t.scc)"""
_R = f"with recursive {SEQS}{REACH}"
_W = f"with {SEQS}"
ORACLES = {
    "eventset_out": _W + " select job_name, event_type, event_set, count(*) as n from sets where direction = 'out' group by all",
    "eventset_in": _W + " select job_name, event_type, event_set, count(*) as n from sets where direction = 'in' group by all",
    "model_rows": _W + " select job_name, event_type, direction, event_set from model",
    "model_merge": _W + " select job_name, event_type, direction, event_set from model where event_set <> ''",
    "eventset_reduced": _W + " select distinct job_name, event_type, direction, array_to_string(list_transform(s, lambda x: x.t), ',') as support from model where len(s) > 0",
    "eventset_counts": _W + ", f as (select distinct job_name, event_type, direction, unnest(s) as x from model) select job_name, event_type, direction, x.t as neighbour, string_agg(x.n::varchar, ',' order by x.n) as counts from f group by 1, 2, 3, 4",
    "eventset_subset": _W + " select job_name, event_type, direction, bool_or(len(list_filter(s, lambda x: x.t = 'persist' and x.n = 1)) > 0) as found from model group by 1, 2, 3",
    "eventset_shared": _W + """ select job_name, event_type, direction, event_set, array_to_string(list_transform(list_filter(s, lambda x: x.t in ('persist', 'notify')), lambda x: x.t || '*' || x.n), ',') as shared,
  array_to_string(list_transform(list_filter(s, lambda x: x.n > 1), lambda x: x.t), ',') as repeated from model where len(list_filter(s, lambda x: x.t in ('persist', 'notify'))) > 0""",
    "eventset_drop_type": _W + " select job_name, event_type, direction, event_set from model where len(list_filter(s, lambda x: x.t = 'persist')) = 0",
    "markov_edges": _W + " select * from edges",
    "overlap_components": f"""with recursive {SEQS}, m as (select job_name, event_type, s from model where direction = 'out' and len(s) > 1),
pairs as (select distinct job_name, event_type, x.t as a, y.t as b from (select *, unnest(s) as x from m) q, unnest(q.s) as u(y)),
walk as (select job_name, event_type, a, b from pairs union select w.job_name, w.event_type, w.a, p.b from walk w join pairs p on p.job_name = w.job_name and p.event_type = w.event_type and p.a = w.b)
select job_name, event_type, a as member, min(b) as component from walk group by 1, 2, 3""",
    "dummy_start_edges": _W + f""", firsts as (select * from seqs where not exists (select 1 from links l where l.seq = seqs.seq and l.dst = seqs.event)),
e as (select name, src_type as src, dst_type as dst from links union all select name, '{START_EVENT}', type from firsts) select name as job_name, src, dst, count(*) as n from e group by all""",
    "splice_dummy": f"""with recursive {SEQS}, kept as (select * from seqs where type <> 'persist'), gone as (select * from seqs where type = 'persist'),
flat as (select seq, event, unnest(previous) as prev from kept), walk as (select * from flat union select w.seq, w.event, p.prev from walk w join (select seq, event, unnest(previous) as prev from gone) p on p.seq = w.seq and p.event = w.prev),
ends as (select w.seq, w.event, string_agg(prev, ',' order by prev) as prev_ids from walk w where not exists (select 1 from gone g where g.seq = w.seq and g.event = w.prev) group by 1, 2)
select k.seq, k.event, coalesce(prev_ids, '') as prev_ids from kept k left join ends e on e.seq = k.seq and e.event = k.event""",
    "model_documents": _W + """, texts as (select job_name, event_type, direction, s, '[' || array_to_string(list_transform(s, lambda x: '{"eventType":' || to_json(x.t) || ',"count":' || x.n || '}'), ',') || ']' as j from model where len(s) > 0),
sides as (select job_name, event_type, coalesce(string_agg(j, ',' order by s) filter (direction = 'out'), '') as o, coalesce(string_agg(j, ',' order by s) filter (direction = 'in'), '') as i
  from (select distinct job_name, event_type from model) left join texts using (job_name, event_type) group by 1, 2)
select job_name, '{"job_name":' || to_json(job_name) || ',"events":[' || string_agg('{"eventType":' || to_json(event_type) || ',"outgoingEventSets":[' || o || '],"incomingEventSets":[' || i || ']}', ',' order by event_type) || ']}' as model from sides group by 1""",
    "reachability": _R + " select * from reach", "scc_nodes": _R + " select * from scc", "loop_start_nodes": _R + " select * from starts",
    "loop_edges": _R + " select e.* from edges e join scc a on a.job_name = e.job_name and a.node = e.src join scc b on b.job_name = e.job_name and b.node = e.dst and a.scc = b.scc join starts s on s.job_name = e.job_name and s.node = e.dst",
}
