"""From call trees to causal sequences.

Children of a span form groups in the order of their starts. What precedes a span is the last group of its own
children, or, if it has none, the group before that of the nearest of itself and its ancestors that is not in a first
group. The first part is a window over siblings; the nearest such ancestor is the top of the span's tree once only
links from members of first groups are kept, which :mod:`weftspan.operators.hierarchy` finds at any depth without
recursion.

Jobs that one task can hold, which is nearly all, are sequenced by arithmetic on whole jobs after one shuffle by job
(:func:`_sequence_jobs`); larger ones by joins and windows (:func:`predecessors`), with the same results.

Groups hold one span each, those that overlap in time (``overlap``), or those that configuration puts together
(``groups``: job name -> parent type -> child type -> group). Ties in start go by event id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspan.operators.cleaning import disconnected_jobs, root_counts
from weftspan.operators.hierarchy import PIECE_ROWS, by_size, double_pointers, hierarchies, lookup_parents, whole_pieces
from weftspan.runtime import BROADCAST_ROWS, cut, join_small

Groups = dict[str, dict[str, dict[str, str]]]
Renames = dict[str, dict[str, tuple[set[str], str]]]
#: Groups of children above which they are ordered over several tasks.
WIDE = 100_000
_PARENT = ["job_id", "parent_event_id"]
_TYPES = "job_name string, parent_type string, child_type string, group_id string"


def pv_timestamp(ns: Column) -> Column:
    """Nanoseconds as ISO text with microseconds in UTC, rounded as a double of seconds rounds; the session's zone plays no part."""
    seconds = ns.cast("double") / F.lit(1e9)
    whole = F.floor(seconds)
    us = whole * 1_000_000 + F.rint((seconds - whole) * F.lit(1e6)).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")).cast("string")
    rest = F.pmod(us, F.lit(86_400_000_000))
    part = lambda unit, size: F.pmod(F.floor(rest / unit), F.lit(size))
    return F.format_string("%sT%02d:%02d:%02d.%06dZ", day, part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60), part(1, 1_000_000))


def rejected_jobs(spans: DataFrame) -> DataFrame:
    """(job_id, reason) of jobs that are no single tree: ``no root``, ``several roots``, ``disconnected`` or ``ring``.

    ``spans`` are read several times; they should come from a table.
    """
    roots = root_counts(spans).where("n_roots != 1").select("job_id", F.when(F.col("n_roots") == 0, "no root").otherwise("several roots").alias("reason"))
    apart = disconnected_jobs(spans).withColumn("reason", F.lit("disconnected"))
    links = spans.select(F.col("job_id").alias("job"), F.col("event_id").alias("k"), F.col("parent_event_id").alias("p"), F.col("start_timestamp").alias("loc"))
    rings = hierarchies(links, ready=True).where("state != 'tree'").select(F.col("job").alias("job_id"), F.lit("ring").alias("reason")).distinct()
    return roots.unionByName(apart).unionByName(rings).groupBy("job_id").agg(F.min("reason").alias("reason"))


def single_trees(spans: DataFrame) -> DataFrame:
    return spans.join(rejected_jobs(spans), "job_id", "left_anti")


def group_table(spans: DataFrame, groups: Groups) -> DataFrame:
    rows = [(j, p, c, g) for j, parents in groups.items() for p, children in parents.items() for c, g in children.items()]
    return spans.sparkSession.createDataFrame(rows, _TYPES)


def sibling_groups(spans: DataFrame, overlap: bool = False, groups: Groups | None = None, broadcast_rows: int = BROADCAST_ROWS, wide: int = WIDE) -> DataFrame:
    """(job_id, parent_event_id, group_no, ids, before, is_last): groups of the children of each span, numbered from 1.

    ``before`` are the ids of the group before, null for the first. Children of a span are ordered by a window; those of
    a span with more than ``wide`` groups over range partitions, so that no task has to take them all.
    """
    kids = spans.where("parent_event_id is not null").select("job_id", "parent_event_id", "event_id", "event_type", "job_name", "start_timestamp", "end_timestamp")
    group = F.concat(F.lit("one:"), "event_id")
    if groups:
        parents = spans.select("job_id", F.col("event_id").alias("parent_event_id"), F.col("event_type").alias("parent_type"))
        kids = kids.join(parents, ["job_id", "parent_event_id"])
        config = group_table(spans, groups).withColumnRenamed("child_type", "event_type")
        kids = join_small(kids, config, ["job_name", "parent_type", "event_type"], "left", broadcast_rows)
        group = F.coalesce(F.concat(F.lit("cfg:"), "group_id"), group)
    members = kids.groupBy(*_PARENT, group.alias("grp")).agg(
        F.min(F.struct("start_timestamp", "event_id")).alias("first"), F.max(F.struct("start_timestamp", "event_id", "end_timestamp")).alias("last"), F.collect_list("event_id").alias("ids")
    )
    members = cut(members.select(*_PARENT, F.col("first.start_timestamp").alias("start"), F.col("first.event_id").alias("first_id"), F.col("last.end_timestamp").alias("end"), "ids"))
    hot = cut(members.groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > wide).select(*_PARENT, F.lit(True).alias("_wide")))
    if hot.isEmpty():
        return _by_window(members, overlap)
    marked = join_small(members, hot, _PARENT, "left", broadcast_rows)
    return _by_window(marked.where("_wide is null").drop("_wide"), overlap).unionByName(_by_ranges(marked.where("_wide").drop("_wide"), overlap))


def _by_window(members: DataFrame, overlap: bool) -> DataFrame:
    order = Window.partitionBy(*_PARENT).orderBy("start", "first_id")
    if overlap:
        # a new group begins where the last span of the group before has ended; touching times overlap
        ended = F.lag("end").over(order)
        opened = members.withColumn("opens", (ended.isNull() | (ended < F.col("start"))).cast("int"))
        numbered = opened.withColumn("group_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        members = _gathered(numbered)
    else:
        members = members.withColumn("group_no", F.row_number().over(order).cast("bigint")).withColumn("ids", F.array_sort("ids"))
    by_no = Window.partitionBy(*_PARENT).orderBy("group_no")
    return members.select(*_PARENT, "group_no", "ids", F.lag("ids").over(by_no).alias("before"), F.lead("group_no").over(by_no).isNull().alias("is_last"))


def _gathered(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy(*_PARENT, "group_no").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def _number(overlap: bool):
    """Rows come sorted; numbers groups from 1 within each parent, as far as this partition can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, n, ended, first, run_no = TaskContext.get().partitionId(), None, 0, None, None, 0
        for b in batches:
            numbers, open_run = [], []
            for k, start, end in zip(zip(*(b.column(i).to_pylist() for i in range(2))), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if k != key:
                    run_no += 1
                    n = 0 if run_no == 1 else 1  # whether the partition's first row opens a group is not known here
                    first = first or (k, start)
                    key = k
                elif not overlap or ended < start:
                    n += 1
                ended = end
                numbers.append(n)
                open_run.append(run_no == 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(numbers, pa.int64()), pa.array(open_run), pa.nulls(b.num_rows, pa.string())], names=[*b.schema.names, "part", "n", "open_run", "edge"])
        if first:
            edge = json.dumps([part, first[0], first[1], key, ended, n, run_no])
            row = {"job_id": [""], "parent_event_id": [""], "start": [0], "first_id": [""], "end": [0], "ids": [[]], "part": [part], "n": [0], "open_run": [False], "edge": [edge]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("job_id", pa.string()), ("parent_event_id", pa.string()), ("start", pa.int64()), ("first_id", pa.string()), ("end", pa.int64()), ("ids", pa.list_(pa.string())), ("part", pa.int32()), ("n", pa.int64()), ("open_run", pa.bool_()), ("edge", pa.string())]))

    return run


def _by_ranges(members: DataFrame, overlap: bool) -> DataFrame:
    """The same for parents of any number of children: partitions number their part, and are joined at their edges."""
    order = [*_PARENT, "start", "first_id"]
    placed = members.select(*order, "end", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    shape = "job_id string, parent_event_id string, start bigint, first_id string, end bigint, ids array<string>, part int, n bigint, open_run boolean, edge string"
    rows = cut(placed.mapInArrow(_number(overlap), shape))
    # one edge per partition: the groups that were open where it began
    offsets, last = [], None
    for part, first_key, start, last_key, ended, n, runs in sorted(json.loads(r.edge) for r in rows.where("edge is not null").select("edge").collect()):
        going = last is not None and last[0] == first_key
        offset = (last[2] if going else 0) + (1 if not going or not overlap or last[1] < start else 0)
        offsets.append((part, offset))
        last = (last_key, ended, n + offset if runs == 1 else n)
    table = rows.sparkSession.createDataFrame(offsets, "part int, offset bigint")
    numbered = rows.where("edge is null").join(F.broadcast(table), "part", "left")
    numbered = numbered.select(*_PARENT, "ids", (F.col("n") + F.when(F.col("open_run"), F.col("offset")).otherwise(0)).alias("group_no"))
    grouped = cut(_gathered(numbered))
    before = grouped.select(*_PARENT, (F.col("group_no") + 1).alias("group_no"), F.col("ids").alias("before"))
    ends = grouped.groupBy(*_PARENT).agg(F.max("group_no").alias("_most"))
    out = join_small(grouped.join(before, [*_PARENT, "group_no"], "left"), ends, _PARENT, "left")
    return out.select(*_PARENT, "group_no", "ids", "before", (F.col("group_no") == F.col("_most")).alias("is_last"))


def predecessors(spans: DataFrame, overlap: bool = False, groups: Groups | None = None, wide: int = WIDE) -> DataFrame:
    """(job_id, event_id, previous): sorted ids of what precedes each span. ``spans`` are single trees."""
    placed = cut(sibling_groups(spans, overlap, groups, wide=wide))
    siblings = placed.where("before is not null").select("job_id", F.explode("ids").alias("event_id"), "before")
    last = placed.where("is_last").select("job_id", F.col("parent_event_id").alias("event_id"), F.col("ids").alias("own"))
    base = cut(spans.select("job_id", "event_id", "parent_event_id", "start_timestamp").join(siblings, ["job_id", "event_id"], "left"))
    links = base.select(F.col("job_id").alias("job"), F.col("event_id").alias("k"), F.when(F.col("before").isNull(), F.col("parent_event_id")).alias("p"), F.col("start_timestamp").alias("loc"))
    solved = hierarchies(links, ready=True).select(F.col("job").alias("job_id"), F.col("k").alias("event_id"), F.col("top"))
    inherited = base.where("before is not null").select("job_id", F.col("event_id").alias("top"), F.col("before").alias("inherited"))
    none = F.array().cast("array<string>")
    # childless spans alone inherit
    out = base.select("job_id", "event_id").join(last, ["job_id", "event_id"], "left")
    out = out.join(solved, ["job_id", "event_id"], "left").join(inherited, ["job_id", "top"], "left")
    return out.select("job_id", "event_id", F.coalesce("own", "inherited", none).alias("previous"))


def _sequence_jobs(t: pa.Table, overlap: bool, config: dict[tuple[str, str, str], str]) -> pa.RecordBatch:
    """Rows of whole jobs -> those of jobs that are single trees, with ``previous``."""
    n = t.num_rows
    k, p, job, kind = (t[c].combine_chunks() for c in ("event_id", "parent_event_id", "job_id", "event_type"))
    group = job.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parent, has_parent = lookup_parents(k, p, group), pc.is_valid(p).to_numpy(zero_copy_only=False)
    reached = double_pointers(parent, np.ones(n, np.int64), None)[3]
    per_job = lambda rows: np.bincount(group[rows], minlength=group.max(initial=-1) + 1)
    single = (per_job(~has_parent) == 1) & (per_job((has_parent & (parent < 0)) | ~reached) == 0)
    good = single[group]
    rank = np.empty(n, np.int64)
    rank[pc.sort_indices(k).to_numpy()] = np.arange(n)
    start, end = (t[c].to_numpy() for c in ("start_timestamp", "end_timestamp"))

    kid = np.flatnonzero(good & (parent >= 0))
    kid = kid[np.lexsort((rank[kid], start[kid], parent[kid]))]
    bundle = np.arange(kid.size)  # kids that configuration puts together
    if config:
        bundle = bundle + _labels(t["job_name"].combine_chunks(), kind, kid, parent[kid], config, bundle)
        kid, bundle = (x[np.lexsort((np.arange(kid.size), bundle, parent[kid]))] for x in (kid, bundle))
    opens = _changes(parent[kid], bundle)
    first, member = np.flatnonzero(opens), np.cumsum(opens) - 1
    last = np.append(first[1:], kid.size)[: first.size] - 1
    lead = kid[first]
    order = np.lexsort((rank[lead], start[lead], parent[lead]))
    of_parent, starts, ends = parent[lead][order], start[lead][order], end[kid[last]][order]
    new_parent = _changes(of_parent)
    begins = new_parent.copy()
    # a new group begins where the last span of the group before has ended; touching times overlap
    begins[1:] |= (ends[:-1] < starts[1:]) if overlap else True
    group_no = np.cumsum(begins) - 1
    place = np.empty(order.size, np.int64)
    place[order] = group_no
    of_kid, heads = place[member], np.flatnonzero(begins)
    is_first, parent_of = new_parent[heads], of_parent[heads]
    is_last = np.append(parent_of[1:] != parent_of[:-1], True)[: heads.size]
    ids = pc.take(k, pa.array(kid[np.lexsort((rank[kid], of_kid))]))
    sizes = np.bincount(of_kid, minlength=heads.size)
    offsets = np.cumsum(sizes) - sizes

    before, own = np.full(n, -1), np.full(n, -1)
    before[kid] = np.where(is_first[of_kid], -1, of_kid - 1)
    own[parent_of[is_last]] = np.flatnonzero(is_last)
    # the nearest of itself and its ancestors that is not in a first group
    at = np.where((before >= 0) | (parent < 0), np.arange(n), parent)
    for _ in range(int(np.ceil(np.log2(n + 1))) + 1):
        further = at[at]
        if (further == at).all():
            break
        at = further
    rows = np.flatnonzero(good)
    chosen = np.where(own >= 0, own, before[at])[rows]
    size = np.where(chosen >= 0, sizes[chosen] if sizes.size else 0, 0)
    begin = np.where(chosen >= 0, offsets[chosen] if sizes.size else 0, 0)
    every = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    previous = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pc.take(ids, pa.array(every, pa.int64())))
    out = t.drop_columns(["piece"]).take(pa.array(rows)).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns]
    return pa.RecordBatch.from_arrays([*columns, previous], names=[*out.column_names, "previous"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    out = np.ones(columns[0].size, bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _labels(names: pa.Array, kinds: pa.Array, kid: np.ndarray, parent: np.ndarray, config: dict[tuple[str, str, str], str], bundle: np.ndarray) -> np.ndarray:
    """What to add to ``bundle`` so that kids of one configured group have one number, which is negative."""
    name, kind = names.dictionary_encode(), kinds.dictionary_encode()
    name_no, kind_no = name.indices.to_numpy(zero_copy_only=False).astype(np.int64), kind.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(kind.dictionary)
    combined = (name_no[kid] * width + kind_no[parent]) * width + kind_no[kid]
    found, back = np.unique(combined, return_inverse=True)
    all_names, all_kinds, number = name.dictionary.to_pylist(), kind.dictionary.to_pylist(), {}
    label = np.zeros(found.size, np.int64)
    for i, x in enumerate(found.tolist()):
        together = config.get((all_names[x // width // width], all_kinds[x // width % width], all_kinds[x % width]))
        if together is not None:
            label[i] = -1 - number.setdefault(together, len(number))
    return np.where(label[back] < 0, label[back] - bundle, 0)


def with_predecessors(spans: DataFrame, overlap: bool = False, groups: Groups | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``spans`` of the jobs that are single trees, with ``previous``: sorted ids of what precedes each.

    ``spans`` are read several times; they should come from a table.
    """
    light, heavy = by_size(spans, "job_id", piece_rows)
    config = {(j, a, c): g for j, kinds in (groups or {}).items() for a, kids in kinds.items() for c, g in kids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pieces(batches, piece_rows):
            yield _sequence_jobs(t, overlap, config)

    out = light.mapInArrow(run, T.StructType([*spans.schema.fields, T.StructField("previous", T.ArrayType(T.StringType()))]))
    if heavy is not None:
        trees = cut(single_trees(cut(heavy)))
        out = out.unionByName(trees.join(predecessors(trees, overlap, groups), ["job_id", "event_id"]).select(*spans.columns, "previous"))
    return out


def rename_by_children(spans: DataFrame, renames: Renames, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rename a span whose type is configured if any of its children is of a listed type.

    ``renames``: job name -> type -> (child types, new type). Children count by the types they came with.
    """
    rows = [(j, t, c, new) for j, types in renames.items() for t, (children, new) in types.items() for c in sorted(children)]
    config = spans.sparkSession.createDataFrame(rows, "job_name string, parent_type string, event_type string, new_type string")
    kids = spans.where("parent_event_id is not null").select("job_id", F.col("parent_event_id").alias("event_id"), F.col("event_type").alias("child_type"))
    hits = spans.select("job_id", "event_id", "job_name", F.col("event_type").alias("parent_type")).join(kids, ["job_id", "event_id"])
    hits = join_small(hits.withColumnRenamed("child_type", "event_type"), config, ["job_name", "parent_type", "event_type"], "inner", broadcast_rows)
    new = hits.groupBy("job_id", "event_id").agg(F.min("new_type").alias("_new"))
    return spans.join(new, ["job_id", "event_id"], "left").withColumn("event_type", F.coalesce("_new", "event_type")).select(*spans.columns)


def sequence(spans: DataFrame, overlap: bool = False, groups: Groups | None = None, renames: Renames | None = None, strict: bool = False) -> DataFrame:
    """PV events of every job that is a single tree; ``strict`` raises ValueError if some job is not."""
    if strict and (bad := rejected_jobs(spans).first()):
        raise ValueError(f"job {bad.job_id}: {bad.reason}")
    if renames:
        spans = cut(rename_by_children(spans, renames))
    return with_predecessors(spans, overlap, groups).select(
        F.col("job_id").alias("jobId"), F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType"), pv_timestamp(F.col("end_timestamp")).alias("timestamp"),
        F.col("application_name").alias("applicationName"), F.col("job_name").alias("jobName"), F.col("previous").alias("previousEventIds"),
    )
