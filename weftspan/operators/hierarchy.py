"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, and all cycles.

Nodes of a group (a trace) are placed together. Groups of more than ``piece_rows`` nodes are range-partitioned by
arrival, so that a child mostly lies near its parent, and every partition is cut into pieces of ``piece_rows``: a group
has as many pieces as it needs, and no task holds more than one. In each piece parent chains are contracted by pointer
doubling to the node where they leave the piece (a fragment's exit) or end. Exit targets and the fragment roots above
them form a much smaller quotient forest, which keeps the order of arrival and is solved by the same procedure; then the
fragments are expanded. Cycles within a piece are seen in its contraction, cycles through several pieces in the quotient.
Where a quotient does not shrink enough (kin lie far apart), pointers are doubled by joins instead, which needs no large
task for any shape of forest.

Defined results
---------------
parent null, or not in the group   the node is the top of its own tree, depth 0
node that is its own parent        ``on_cycle``
parents that lead into a cycle     ``leads_to_cycle``; top is the smallest id on that cycle, depth and path are null
repeated node ids in a group       the caller leaves one row each (:func:`first_arrivals`)
null group                         a group of its own; rows with a null id are dropped
empty table                        no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.operators.heavy_keys import row_numbers
from weftspan.runtime import BROADCAST_ROWS, cut, join_small, join_spread

PIECE_ROWS = 50_000
_OUT = "job string, k string, p string, split boolean, root string, dist bigint, state string, target string, exit_w bigint, exit_low string, low string, cycle_top string, path array<string>, exit_mid array<string>, loc bigint"
_OUT_ARROW = pa.schema([
    ("job", pa.string()), ("k", pa.string()), ("p", pa.string()), ("split", pa.bool_()), ("root", pa.string()), ("dist", pa.int64()), ("state", pa.string()), ("target", pa.string()),
    ("exit_w", pa.int64()), ("exit_low", pa.string()), ("low", pa.string()), ("cycle_top", pa.string()), ("path", pa.list_(pa.string())), ("exit_mid", pa.list_(pa.string())), ("loc", pa.int64()),
])


def first_arrivals(df: DataFrame, key: Column, arrived: Column, tie: str, keep: dict[str, Column]) -> DataFrame:
    """One row per key, the first by (arrived, tie): (k, *keep). Combined on the map side; a row without time is last."""
    rows = df.select(key.alias("k"), F.struct(F.coalesce(arrived, F.lit(2**63 - 1)).alias("at"), F.col(tie).alias("tie"), *[c.alias(n) for n, c in keep.items()]).alias("r"))
    return rows.where("k is not null").groupBy("k").agg(F.min("r").alias("r")).select("k", *[F.col(f"r.{n}").alias(n) for n in keep])


def double_pointers(parent: np.ndarray, weight: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Pointer doubling. parent[i] < 0: i is a root. Returns ancestor, distance, least code on the way, and who reached a root.

    A round in which nobody newly reaches a root shows that the others never will: they are taken on alone, far enough
    to stand on their cycles.
    """
    n = parent.size
    root = parent < 0
    anc, dist = np.where(root, np.arange(n), parent), np.where(root, 0, weight)
    done = root[anc]
    while not done.all():
        if low is not None:
            low = np.minimum(low, low[anc])
        dist, anc = dist + dist[anc], anc[anc]
        now = root[anc]
        if (now == done).all():
            break
        done = now
    left = np.flatnonzero(~done)
    if left.size:
        for _ in range(int(np.ceil(np.log2(left.size + 1))) + 1):
            if low is not None:
                low[left] = np.minimum(low[left], low[anc[left]])
            anc[left] = anc[anc[left]]
    return anc, dist, low, done


def _solve_rows(t: pa.Table, with_path: bool) -> pa.RecordBatch:
    """Contract the links of whole pieces."""
    n = t.num_rows
    k, p, job = (t[c].combine_chunks() for c in ("k", "p", "job"))
    split = t["split"].to_numpy(zero_copy_only=False) if n else np.empty(0, bool)
    group = pc.fill_null(pc.cast(job.dictionary_encode().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)
    parent = lookup_parents(k, p, group)
    weight = t["w"].to_numpy()
    has_parent = pc.is_valid(p).to_numpy(zero_copy_only=False)
    exits = (parent < 0) & has_parent & split
    anc, dist, _, done = double_pointers(parent, weight, None)
    low_text = pa.nulls(n, pa.string())
    cyclic, low = np.flatnonzero(~done), None
    if cyclic.size or split.any():
        # codes that sort as the ids do
        ids = pa.concat_arrays([k, pc.coalesce(t["low"].combine_chunks(), k)])
        coded = ids.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        codes = rank[coded.indices.to_numpy()]
        own = np.minimum(codes[:n], codes[n:])
        own = np.where(parent < 0, codes[:n], own)  # a root's link leaves the piece and counts with the exit
        anc2, _, low, _ = double_pointers(parent, weight, own.copy())
        sorted_ids = pc.take(coded.dictionary, pa.array(order))
        low_text = pc.take(sorted_ids, pa.array(np.minimum(low, codes[:n][anc2])))
        anc = np.where(done, anc, anc2)
    state = np.where(exits[anc], "exit", "top").astype(object)
    cycle_top = pa.nulls(n, pa.string())
    if cyclic.size:
        on = np.unique(anc[cyclic])
        state[cyclic] = "leads_to_cycle"
        state[on] = "on_cycle"
        # a node on a cycle has gone round it at least once, so its least code is that of the cycle
        least = np.zeros(n, np.int64)
        least[on] = _cycle_low(parent, on, low, codes, n)
        cycle_top = pc.take(sorted_ids, pa.array(np.where(done, 0, least[anc]), mask=done))
    out_exit = exits[anc]
    pick = pa.array(np.where(out_exit, anc, 0), mask=~out_exit)
    paths = mids = pa.nulls(n, pa.list_(pa.string()))
    if with_path:
        paths, mids = _paths(t, k, parent, dist, done, anc, out_exit)
    ends = pa.array(np.where(done, anc, 0), mask=~done)
    return pa.RecordBatch.from_arrays([
        job, k, p, t["split"].combine_chunks(), pc.take(k, ends), pa.array(dist, mask=~done), pa.array(state.tolist(), pa.string()), pc.take(p, pick),
        pc.take(t["w"].combine_chunks(), pick), pc.take(t["low"].combine_chunks(), pick), low_text, cycle_top, paths, mids, t["loc"].combine_chunks(),
    ], schema=_OUT_ARROW)


def lookup_parents(k: pa.Array, p: pa.Array, group: np.ndarray) -> np.ndarray:
    """Row of each node's parent, of the same group, or -1. Ids may recur in other groups."""
    n = len(k)
    ids = k.dictionary_encode()
    code = ids.indices.to_numpy()
    want = pc.fill_null(pc.index_in(p, value_set=ids.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(ids.dictionary))
    have, need = group * width + code, group * width + want
    order = np.argsort(have, kind="stable")
    pos = np.minimum(np.searchsorted(have[order], need), max(0, n - 1))
    found = (want >= 0) & (have[order][pos] == need) if n else np.empty(0, bool)
    return np.where(found, order[pos], -1) if n else np.empty(0, np.int64)


def _cycle_low(parent: np.ndarray, on: np.ndarray, low: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Least code of the cycle of each node on one, links' inner nodes included; each cycle is walked once."""
    out, seen = np.zeros(n, np.int64), np.zeros(n, bool)
    for start in on.tolist():
        if seen[start]:
            continue
        walk, at = [], start
        while not seen[at]:
            seen[at] = True
            walk.append(at)
            at = int(parent[at])
        out[walk] = low[walk].min()
    return out[on]


def _paths(t: pa.Table, k: pa.Array, parent: np.ndarray, dist: np.ndarray, done: np.ndarray, anc: np.ndarray, out_exit: np.ndarray) -> tuple[pa.Array, pa.Array]:
    ids, mid = k.to_pylist(), t["mid"].combine_chunks().to_pylist()
    path: list = [None] * len(ids)
    # nearer nodes first; links weigh at least 1
    for i in np.argsort(np.where(done, dist, -1), kind="stable").tolist():
        if done[i]:
            q = parent[i]
            path[i] = [ids[i]] if q < 0 else [*path[q], *(mid[i] or ()), ids[i]]
    return pa.array(path, pa.list_(pa.string())), pa.array([mid[a] if e else None for a, e in zip(anc.tolist(), out_exit.tolist())], pa.list_(pa.string()))


def whole_pieces(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.Table]:
    """Rows come sorted by ``piece``; tables of whole pieces, of about ``piece_rows`` rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch["piece"].to_numpy()
        cuts = np.flatnonzero(np.diff(piece)) + 1
        if held and piece[0] != last:
            cuts = np.insert(cuts, 0, 0)
        begin = 0
        for c in cuts.tolist():
            if size + c - begin >= piece_rows:
                held.append(batch.slice(begin, c - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, c
        held.append(batch.slice(begin))
        size += batch.num_rows - begin
        last = piece[-1]
    if held:
        yield pa.Table.from_batches(held)


def _contract(piece_rows: int, with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pieces(batches, piece_rows):
            yield _solve_rows(t, with_path)

    return run


def mark_jobs(rows: DataFrame, jobs: DataFrame, job: str, mark: str, few: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds whether the job is among ``jobs``: by a list of values if they are few, else by a join."""
    values = [r[0] for r in jobs.select(job).limit(few + 1).collect()]
    if len(values) <= few:
        return rows.withColumn(mark, F.coalesce(F.col(job).isin(values), F.lit(False)))
    return join_small(rows, jobs.select(job, F.lit(True).alias(mark)), [job], "left", broadcast_rows).withColumn(mark, F.coalesce(mark, F.lit(False)))


def by_size(rows: DataFrame, job: str = "job_id", piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of jobs that one task can hold, placed so that each partition has whole jobs, with ``piece`` to read them by
    (:func:`whole_pieces`), and those of larger jobs, or None. ``rows`` are read twice; they should come from a table."""
    big = cut(rows.groupBy(job).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece_rows).select(job))
    heavy = None
    if not big.isEmpty():
        marked = mark_jobs(rows, big, job, "_big")
        rows, heavy = marked.where("not _big").drop("_big"), marked.where("_big").drop("_big")
    return rows.withColumn("piece", F.xxhash64(job)).repartition("piece").sortWithinPartitions("piece"), heavy


def runs_of(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.Table]:
    """Rows come in the order of arrival; every ``piece_rows`` of them are a piece."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while size + batch.num_rows - at >= piece_rows:
            held.append(batch.slice(at, piece_rows - size))
            at += piece_rows - size
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _contract_runs(piece_rows: int, with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, piece_rows):
            yield _solve_rows(t, with_path)

    return run


_IN = ("job", "k", "p", "w", "low", "mid", "loc", "split")


def _place(links: DataFrame, hot: DataFrame | None, with_path: bool, piece_rows: int, broadcast_rows: int) -> DataFrame:
    links = mark_jobs(links, hot, "job", "split", broadcast_rows=broadcast_rows) if hot is not None else links.withColumn("split", F.lit(False))
    whole = links.where("not split").withColumn("piece", F.xxhash64("job"))
    # equal pieces of two groups are told apart in the contraction
    out = whole.repartition("piece").sortWithinPartitions("piece").select(*_IN, "piece").mapInArrow(_contract(piece_rows, with_path), _OUT)
    if hot is None:
        return out
    order = ("job", "loc", "k")
    runs = links.where("split").select(*_IN).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.unionByName(runs.mapInArrow(_contract_runs(piece_rows, with_path), _OUT))


def _hot(links: DataFrame, piece_rows: int) -> DataFrame | None:
    """Groups too large for one piece."""
    big = cut(links.groupBy("job").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece_rows).select("job"))
    return None if big.isEmpty() else big


def _jump(links: DataFrame, with_path: bool = True) -> DataFrame:
    """The same by joins alone: pointers are doubled until nobody newly reaches a root, then round the cycles."""
    no_path = F.lit(None).cast("array<string>")
    parents = links.select("job", F.col("k").alias("p"), F.lit(True).alias("_there"))
    inner = F.coalesce("mid", F.array().cast("array<string>"))
    end = F.col("_there").isNull()
    state = cut(links.join(parents, ["job", "p"], "left").select(
        "job", "k", "p", F.when(end, F.col("k")).otherwise(F.col("p")).alias("anc"), F.when(end, 0).otherwise(F.col("w")).cast("bigint").alias("dist"), end.alias("done"),
        F.when(end, F.col("k")).otherwise(F.least("k", F.coalesce("low", "k"))).alias("low"), (F.when(end, F.array("k")).otherwise(F.concat(inner, F.array("k"))) if with_path else no_path).alias("path"),
    ))
    left, after = state.where("not done").count(), 0
    while left:
        hop = state.select("job", F.col("k").alias("anc"), *[F.col(c).alias(f"_{c}") for c in ("anc", "dist", "done", "low", "path")])
        moving = state.where("not done").join(hop, ["job", "anc"]).select(
            "job", "k", "p", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"),
            (F.col("path") if after or not with_path else F.concat("_path", "path")).alias("path"),
        )
        state = cut(state.where("done").unionByName(moving))
        now = state.where("not done").count()
        if now == left:
            after += 1
            if 2**after > 2 * now + 2:
                break
        left = now
    # the rest stand on their cycles, and have gone round them
    rest = state.where("not done")
    on = rest.groupBy("job", F.col("anc").alias("k")).agg(F.lit(True).alias("_on"))
    rest = rest.join(on, ["job", "k"], "left")
    least = rest.where("_on").select("job", F.col("k").alias("anc"), F.col("low").alias("_top"))
    rest = rest.join(least, ["job", "anc"], "left").select("job", "k", "p", F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("dist"), F.when(F.col("_on"), "on_cycle").otherwise("leads_to_cycle").alias("state"), F.col("_top").alias("cycle_top"), F.lit(None).cast("array<string>").alias("path"), "low")
    tops = state.where("done").select("job", "k", "p", F.col("anc").alias("root"), "dist", F.lit("top").alias("state"), F.lit(None).cast("string").alias("cycle_top"), "path", "low")
    return tops.unionByName(rest)


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one fragment that lie between a target on a cycle and the fragment's root."""
    parent, found = dict(zip(rows["k"], rows["p"])), {}
    for start in rows.loc[rows["marked"], "k"]:
        at = start
        while at in parent and at not in found:
            found[at] = True
            at = parent[at]
    return pd.DataFrame({"job": rows["job"].iloc[0], "k": list(found)}, columns=["job", "k"])


def _solve(links: DataFrame, piece_rows: int, with_path: bool, broadcast_rows: int) -> DataFrame:
    """links: (job, k, p, w, low, mid, loc) -> rows of _OUT whose state is top, on_cycle or leads_to_cycle."""
    hot = _hot(links, piece_rows)
    solved = _place(links, hot, with_path, piece_rows, broadcast_rows)
    if hot is None:
        return solved
    solved = cut(solved)
    inner = solved.where("split")
    leaving = inner.where("state = 'exit'")
    targets = leaving.select("job", F.col("target").alias("k")).distinct()
    above = cut(inner.join(targets, ["job", "k"], "left_semi"))
    roots = above.where("root is not null").select("job", F.col("root").alias("k")).distinct()
    tops = inner.join(roots, ["job", "k"], "left_semi")
    none, no_ids = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    ring = above.where("cycle_top is not null")
    quotient = (
        above.where("root != k").select("job", "k", F.col("root").alias("p"), F.col("dist").alias("w"), "low", F.expr("slice(path, 2, size(path) - 2)").alias("mid"), "loc")
        .unionByName(tops.select("job", "k", F.col("target").alias("p"), F.coalesce("exit_w", F.lit(1)).alias("w"), F.col("exit_low").alias("low"), F.col("exit_mid").alias("mid"), "loc"))
        .unionByName(ring.where("k != cycle_top").select("job", "k", F.col("cycle_top").alias("p"), F.lit(1).cast("bigint").alias("w"), none.alias("low"), no_ids.alias("mid"), "loc"))
        .unionByName(ring.select("job", F.col("cycle_top").alias("k"), F.col("cycle_top").alias("p"), F.lit(1).cast("bigint").alias("w"), none.alias("low"), no_ids.alias("mid"), F.lit(0).cast("bigint").alias("loc")).distinct())
    )
    quotient = cut(quotient)
    shrunk = quotient.count() <= 0.6 * inner.count()
    upper = cut(_solve(quotient, piece_rows, with_path, broadcast_rows) if shrunk else _jump(quotient, with_path))
    up = upper.select("job", F.col("k").alias("target"), F.col("root").alias("_root"), F.col("dist").alias("_dist"), F.col("state").alias("_state"), F.col("cycle_top").alias("_top"), F.col("path").alias("_path"))
    # both sides grow with the data, and many fragments may leave to one target
    grown = join_spread(leaving, up, ["job", "target"], "left")
    loops = F.col("_state").isin("on_cycle", "leads_to_cycle")
    rest = F.concat(F.coalesce("exit_mid", F.array().cast("array<string>")), "path")
    grown = grown.select(
        "job", "k", "p", "split", F.when(F.col("_state") == "top", F.col("_root")).when(F.col("_state").isNull(), F.col("root")).alias("root"),
        F.when(F.col("_state") == "top", F.col("dist") + F.col("exit_w") + F.col("_dist")).when(F.col("_state").isNull(), F.col("dist")).alias("dist"),
        F.when(loops, "leads_to_cycle").otherwise("top").alias("state"), none.alias("target"), F.lit(None).cast("bigint").alias("exit_w"), none.alias("exit_low"), "low", F.when(loops, F.col("_top")).alias("cycle_top"),
        F.when(F.col("_state") == "top", F.concat("_path", rest)).when(F.col("_state").isNull(), F.col("path")).alias("path"), no_ids.alias("exit_mid"), "loc",
    )
    # nodes of fragments that a cycle runs through
    on = upper.where("state = 'on_cycle'").select("job", "k")
    marks = cut(leaving.join(on, ["job", "k"], "left_semi").select("job", "k", "root"))
    if not marks.isEmpty():
        inside = leaving.join(marks.select("job", "root").distinct(), ["job", "root"], "left_semi").select("job", "k", "p", "root")
        flagged = inside.join(marks.select("job", "k", F.lit(True).alias("marked")), ["job", "k"], "left").fillna(False, "marked")
        ringed = flagged.groupBy("job", "root").applyInPandas(_mark, "job string, k string").withColumn("_on", F.lit(True))
        grown = grown.join(ringed, ["job", "k"], "left").withColumn("state", F.when(F.col("_on"), "on_cycle").otherwise(F.col("state"))).drop("_on")
    return solved.where("state != 'exit'").unionByName(grown)


def hierarchies(links: DataFrame, *, with_path: bool = False, ready: bool = False, piece_rows: int = PIECE_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``links``: (job, k, p, loc); k is unique within job, loc an integer by which kin lie near each other.

    Returns (job, k, p, top, depth, state, path): state is ``tree``, ``on_cycle`` or ``leads_to_cycle``; path, from the
    top down to the node, only with ``with_path``. ``ready``: the links come straight from a table, and need not be
    written before they are read several times.
    """
    job = F.coalesce(F.concat(F.lit("v"), F.col("job").cast("string")), F.lit("n"))
    rows = links.where("k is not null").select(job.alias("job"), "k", "p", F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("array<string>").alias("mid"), F.coalesce(F.col("loc").cast("bigint"), F.lit(0)).alias("loc"))
    out = _solve(rows if ready else cut(rows), piece_rows, with_path, broadcast_rows)
    job = F.when(F.col("job") != "n", F.substring("job", 2, 2**31 - 1))
    return out.select(job.alias("job"), "k", "p", F.coalesce("root", "cycle_top").alias("top"), F.col("dist").alias("depth"), F.when(F.col("state") == "top", "tree").otherwise(F.col("state")).alias("state"), "path")


def below_counts(solved: DataFrame) -> DataFrame:
    """(job, k, n_descendants) of the nodes of trees that have any. Ancestors are counted off the paths, combined before the shuffle."""
    pairs = solved.where("state = 'tree'").select("job", F.posexplode("path").alias("at", "k"), "depth").where("at < depth")
    return pairs.groupBy("job", "k").agg(F.count(F.lit(1)).alias("n_descendants"))


def intervals(solved: DataFrame) -> DataFrame:
    """(job, k, order_no, last_no) of the nodes of trees: numbers in depth-first order within the job, by paths.

    The descendants of a node are those of its job with numbers above ``order_no`` up to ``last_no``.
    """
    trees = row_numbers(solved.where("state = 'tree'").select("job", "k", "path"), ["job"], ["path"], "order_no").drop("path")
    node = F.to_json(F.array("job", "k"))
    counts = below_counts(solved).select(node.alias("_node"), "n_descendants")
    out = trees.withColumn("_node", node).join(counts, "_node", "left")
    return out.select("job", "k", "order_no", (F.col("order_no") + F.coalesce("n_descendants", F.lit(0))).alias("last_no"))


def descendants(solved: DataFrame) -> DataFrame:
    """(job, k, descendant, distance): each node of a tree with all below it, from the paths of :func:`hierarchies`.

    As many rows as the depths add up to: for a selection of nodes. Of all nodes :func:`intervals` says the same in one row each.
    """
    rows = solved.where("state = 'tree'").select("job", F.col("k").alias("descendant"), "depth", F.posexplode("path").alias("at", "k"))
    return rows.where("at < depth").select("job", "k", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
