"""From causal sequences to a model per workflow: the multisets of event types that follow and precede each type.

Everything is aggregated in Spark down to distinct multisets, so that only the model, bounded by the workflow's
structure and not by its number of runs, goes on to gate and loop detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.runtime import cut
from weftspan.schemas import DUMMY_EVENT, START_EVENT


def sequences_of_pv(pv: DataFrame, cleaned: Column, key: Column) -> DataFrame:
    """(seq, name, event, type, previous): one row per event of a sequence; of repeats the first by ``key`` counts."""
    rows = pv.select("job_id", cleaned.alias("event"), F.struct(key.alias("_key"), "job_name", "event_type", "previous_event_ids").alias("r")).where("event is not null and job_id is not null")
    first = rows.groupBy(F.col("job_id").alias("seq"), "event").agg(F.min("r").alias("r"))
    return first.select("seq", F.col("r.job_name").alias("name"), "event", F.col("r.event_type").alias("type"), F.coalesce("r.previous_event_ids", F.array().cast("array<string>")).alias("previous"))


def sequences_of(pv_events: DataFrame) -> DataFrame:
    """The same from records in the shape of :data:`weftspan.schemas.PV`."""
    none = F.array().cast("array<string>")
    return pv_events.select(F.col("jobId").alias("seq"), F.col("jobName").alias("name"), F.col("eventId").alias("event"), F.col("eventType").alias("type"), F.coalesce("previousEventIds", none).alias("previous"))


def links(seqs: DataFrame, dummy_start: bool = False) -> DataFrame:
    """(seq, name, src, src_type, dst, dst_type): each causal link. A previous id that is not in the sequence is left out.

    With ``dummy_start`` an artificial start event precedes the events of a sequence that nothing precedes.
    """
    kids = seqs.select("seq", "name", F.col("event").alias("dst"), F.col("type").alias("dst_type"), F.explode(F.array_distinct("previous")).alias("src"))
    found = kids.join(seqs.select("seq", F.col("event").alias("src"), F.col("type").alias("src_type")), ["seq", "src"])
    found = found.select("seq", "name", "src", "src_type", "dst", "dst_type")
    if not dummy_start:
        return found
    first = seqs.join(found.select("seq", F.col("dst").alias("event")).distinct(), ["seq", "event"], "left_anti")
    return found.unionByName(first.select("seq", "name", F.lit(START_EVENT).alias("src"), F.lit(START_EVENT).alias("src_type"), F.col("event").alias("dst"), F.col("type").alias("dst_type")))


def neighbour_sets(linked: DataFrame, direction: str) -> DataFrame:
    """(name, event_type, event_set) of every event with neighbours in one direction, ``out`` or ``in``."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    counts = linked.groupBy("seq", "name", F.col(own).alias("event"), F.col(f"{own}_type").alias("event_type"), F.col(f"{other}_type").alias("eventType")).agg(F.count(F.lit(1)).cast("int").alias("count"))
    sets = counts.groupBy("seq", "name", "event", "event_type").agg(F.array_sort(F.collect_list(F.struct("eventType", "count"))).alias("event_set"))
    return sets.select("name", "event_type", "event_set")


def model_rows(seqs: DataFrame, dummy_start: bool = False) -> DataFrame:
    """(job_name, event_type, direction, event_set), distinct. A type without neighbours has one row with an empty set."""
    linked = cut(links(seqs, dummy_start))
    parts = [neighbour_sets(linked, d).select(F.col("name").alias("job_name"), "event_type", F.lit(d).alias("direction"), "event_set") for d in ("out", "in")]
    alone = seqs.groupBy(F.col("name").alias("job_name"), F.col("type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    known = parts[0].unionByName(parts[1]).distinct()
    empty = F.array().cast("array<struct<eventType:string,count:int>>")
    bare = alone.join(known.select("job_name", "event_type").distinct(), ["job_name", "event_type"], "left_anti")
    return known.unionByName(bare.select("job_name", "event_type", F.lit("out").alias("direction"), empty.alias("event_set")))


def merge_models(*models: DataFrame) -> DataFrame:
    """Union of models; it is associative, commutative and idempotent."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.distinct()


def supports(rows: DataFrame) -> DataFrame:
    """Distinct sets of types, without counts."""
    return rows.where(F.size("event_set") > 0).select("job_name", "event_type", "direction", F.transform("event_set", lambda x: x["eventType"]).alias("support")).distinct()


def observed_counts(rows: DataFrame) -> DataFrame:
    """(job_name, event_type, direction, neighbour, counts): how often a neighbour was seen at once."""
    flat = rows.select("job_name", "event_type", "direction", F.explode("event_set").alias("x"))
    return flat.groupBy("job_name", "event_type", "direction", F.col("x.eventType").alias("neighbour")).agg(F.array_sort(F.collect_set("x.count")).alias("counts"))


def contains_set(rows: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(job_name, event_type, direction, found): whether some set holds all wanted types just as often."""
    inside = F.lit(True)
    for kind, n in sorted(wanted.items()):
        inside = inside & F.array_contains("event_set", F.struct(F.lit(kind).alias("eventType"), F.lit(n).cast("int").alias("count")))
    return rows.groupBy("job_name", "event_type", "direction").agg(F.bool_or(inside).alias("found"))


def counts_of(rows: DataFrame, types: set[str]) -> DataFrame:
    """Sets that meet the given types: what they share with them and how often (``shared``), and what they hold several times."""
    shared = F.filter("event_set", lambda x: x["eventType"].isin(sorted(types)))
    repeated = F.transform(F.filter("event_set", lambda x: x["count"] > 1), lambda x: x["eventType"])
    return rows.withColumns({"shared": shared, "repeated": repeated}).where(F.size("shared") > 0)


def without_type(rows: DataFrame, kind: str) -> DataFrame:
    """Rows whose set does not hold the type."""
    return rows.where(~F.exists("event_set", lambda x: x["eventType"] == kind))


def edges(rows: DataFrame) -> DataFrame:
    """(job_name, src, dst): distinct directly-follows links of a model."""
    return rows.where("direction = 'out'").select("job_name", F.col("event_type").alias("src"), F.explode("event_set.eventType").alias("dst")).distinct()


def overlap_components(rows: DataFrame) -> DataFrame:
    """(job_name, event_type, member, component): follower types that occur together, directly or through others.

    A component is named by its least member. Labels are spread over pairs of a set's neighbours in sort order; the
    number of types bounds the rounds, and the model its size.
    """
    base = rows.where((F.col("direction") == "out") & (F.size("event_set") > 1)).select("job_name", "event_type", F.transform("event_set", lambda x: x["eventType"]).alias("types"))
    first = base.select("job_name", "event_type", F.explode("types").alias("member"), F.array_min("types").alias("hub"))
    pairs = cut(first.select("job_name", "event_type", F.col("member").alias("a"), F.col("hub").alias("b")).unionByName(first.select("job_name", "event_type", F.col("hub").alias("a"), F.col("member").alias("b"))).distinct())
    label = cut(pairs.groupBy("job_name", "event_type", F.col("a").alias("member")).agg(F.min("b").alias("component")))
    while True:
        near = pairs.join(label.select("job_name", "event_type", F.col("member").alias("b"), F.col("component").alias("other")), ["job_name", "event_type", "b"]).groupBy("job_name", "event_type", F.col("a").alias("member")).agg(F.min("other").alias("other"))
        new = cut(label.join(near, ["job_name", "event_type", "member"]).select("job_name", "event_type", "member", F.least("component", "other").alias("component"), (F.col("other") < F.col("component")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.drop("moved")
        label = new.drop("moved")


def models(rows: DataFrame) -> DataFrame:
    """One row per workflow in the shape of :data:`weftspan.schemas.MODEL`."""
    sets = lambda d: F.array_sort(F.collect_set(F.when((F.col("direction") == d) & (F.size("event_set") > 0), F.col("event_set"))))
    per_type = rows.groupBy("job_name", "event_type").agg(sets("out").alias("o"), sets("in").alias("i"))
    event = F.struct(F.col("event_type").alias("eventType"), F.col("o").alias("outgoingEventSets"), F.col("i").alias("incomingEventSets"))
    return per_type.groupBy("job_name").agg(F.array_sort(F.collect_list(event)).alias("events"))


def rows_of_models(documents: DataFrame) -> DataFrame:
    """Rows of saved models; ValueError if a type occurs twice in one."""
    events = documents.select("job_name", F.explode("events").alias("e"))
    twice = events.groupBy("job_name", "e.eventType").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"the model of {twice.job_name} has {twice.eventType} twice")
    parts = [events.select("job_name", F.col("e.eventType").alias("event_type"), F.lit(d).alias("direction"), F.explode(f"e.{f}").alias("event_set")) for d, f in (("out", "outgoingEventSets"), ("in", "incomingEventSets"))]
    known = parts[0].unionByName(parts[1]).distinct()
    empty = F.array().cast("array<struct<eventType:string,count:int>>")
    bare = events.select("job_name", F.col("e.eventType").alias("event_type")).distinct().join(known.select("job_name", "event_type").distinct(), ["job_name", "event_type"], "left_anti")
    return known.unionByName(bare.select("job_name", "event_type", F.lit("out").alias("direction"), empty.alias("event_set")))


def splice_out(seqs: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Sequences without events of the given types (the artificial ones by default); what they preceded takes over their predecessors.

    Chains of such events are followed to their ends, one hop a round.
    """
    kinds = kinds or {START_EVENT, DUMMY_EVENT}
    gone = cut(seqs.where(F.col("type").isin(sorted(kinds))).select("seq", F.col("event").alias("prev"), F.col("previous").alias("instead")))
    kept = seqs.where(~F.col("type").isin(sorted(kinds)))
    flat = kept.select("seq", "event", F.explode_outer("previous").alias("prev"))
    while True:
        joined = cut(flat.join(gone, ["seq", "prev"], "left"))
        if joined.where("instead is not null").isEmpty():
            break
        flat = joined.select("seq", "event", F.explode_outer(F.coalesce("instead", F.array("prev"))).alias("prev")).distinct()
    previous = flat.where("prev is not null").groupBy("seq", "event").agg(F.array_sort(F.collect_set("prev")).alias("previous"))
    return kept.drop("previous").join(previous, ["seq", "event"], "left").withColumn("previous", F.coalesce("previous", F.array().cast("array<string>"))).select(*seqs.columns)


def reachability(edge_rows: DataFrame) -> DataFrame:
    """(job_name, src, dst): every pair of types with a way from one to the other, by doubling; bounded by the model."""
    reach = cut(edge_rows.select("job_name", "src", "dst").distinct())
    n = reach.count()
    while True:
        further = reach.join(reach.select("job_name", F.col("src").alias("dst"), F.col("dst").alias("end")), ["job_name", "dst"]).select("job_name", "src", F.col("end").alias("dst"))
        reach = cut(reach.unionByName(further).distinct())
        if (m := reach.count()) == n:
            return reach
        n = m


def strong_components(edge_rows: DataFrame) -> DataFrame:
    """(job_name, node, scc): types on a common cycle; a component is named by its least type."""
    reach = cut(reachability(edge_rows))
    back = reach.select("job_name", F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = reach.join(back, ["job_name", "src", "dst"])
    return mutual.groupBy("job_name", F.col("src").alias("node")).agg(F.min("dst").alias("scc"))


def loop_starts(edge_rows: DataFrame) -> DataFrame:
    """(job_name, node): types of a cycle that are entered from outside it."""
    scc = cut(strong_components(edge_rows))
    into = edge_rows.join(scc.select("job_name", F.col("node").alias("dst"), F.col("scc").alias("to")), ["job_name", "dst"]).join(scc.select("job_name", F.col("node").alias("src"), F.col("scc").alias("of")), ["job_name", "src"], "left")
    return into.where(~F.col("to").eqNullSafe(F.col("of"))).select("job_name", F.col("dst").alias("node")).distinct()


def loop_edges(edge_rows: DataFrame) -> DataFrame:
    """(job_name, src, dst): links of a cycle that lead back to where it is entered."""
    scc = cut(strong_components(edge_rows))
    starts = loop_starts(edge_rows).withColumnRenamed("node", "dst")
    inner = edge_rows.join(scc.select("job_name", F.col("node").alias("dst"), F.col("scc").alias("to")), ["job_name", "dst"]).join(scc.select("job_name", F.col("node").alias("src"), F.col("scc").alias("of")), ["job_name", "src"]).where(F.col("to") == F.col("of"))
    return inner.join(starts, ["job_name", "dst"], "left_semi").select("job_name", "src", "dst")
