"""Structural fingerprints of call trees, and the jobs that represent each structure.

The fingerprint of a span is a hash of its type and of the sorted fingerprints of its children; it does not depend on
ids, times or the order of children. Jobs that one task can hold are fingerprinted there after one shuffle, deepest spans
first. Larger jobs lie in pieces by arrival: each round hashes, in every piece, the spans whose children are all known, and
sends the hashes that leave the piece to the parents elsewhere. Rounds follow the pieces a path goes through, not its depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.operators.cleaning import jobs_in_window
from weftspan.operators.hierarchy import PIECE_ROWS, by_size, double_pointers, lookup_parents, runs_of, whole_pieces
from weftspan.runtime import cut, join_spread


def xx64(text: str) -> str:
    """xxHash64 with seed 0 of UTF-8 text, as hexadecimal digits."""
    return xxhash.xxh64(text.encode()).hexdigest()


def _xx64_column(c: Column) -> Column:
    return F.udf(lambda text: None if text is None else xx64(text), "string", useArrow=True)(c)


class _Forest:
    """Rows of one table as a forest, and the hashes of its spans."""

    def __init__(self, t: pa.Table, memo: dict[str, str]) -> None:
        k, p, job, kind = (t[c].combine_chunks() for c in ("event_id", "parent_event_id", "job_id", "event_type"))
        n = t.num_rows
        group = pc.fill_null(pc.cast(job.dictionary_encode().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)
        self.parent = lookup_parents(k, p, group)
        _, depth, _, self.reached = double_pointers(self.parent, np.ones(n, np.int64), None)
        self.memo, self.hash = memo, np.full(n, None, object)
        kinds = kind.dictionary_encode()
        self.kinds, self.code = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
        self.kids = np.argsort(np.where(self.reached, self.parent, -1), kind="stable")
        below = np.where(self.reached, self.parent, -1)[self.kids]
        self.begin, self.end = np.searchsorted(below, np.arange(n)), np.searchsorted(below, np.arange(n), "right")
        # deepest first
        self.order = np.argsort(np.where(self.reached, -depth, 1), kind="stable")[: int(self.reached.sum())]

    def of(self, text: str) -> str:
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[text] = xx64(text)
        return got

    def run(self, wanted: np.ndarray | None = None, known: list | None = None) -> None:
        """Hash every span whose children all have hashes; ``wanted`` children each, of which ``known`` hashes are from elsewhere."""
        leaf = [None] * len(self.kinds)
        for i, a, z in zip(self.order.tolist(), self.begin[self.order].tolist(), self.end[self.order].tolist()):
            code = self.code[i]
            if a == z and wanted is None:
                if leaf[code] is None:
                    leaf[code] = self.of(self.kinds[code])
                self.hash[i] = leaf[code]
                continue
            below = [h for h in self.hash[self.kids[a:z]].tolist() if h is not None]
            if wanted is not None:
                below += known[i] or ()
                if len(below) < wanted[i]:
                    continue
            self.hash[i] = self.of(self.kinds[code] + "".join(sorted(below)))


def _hash_jobs(piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for t in whole_pieces(batches, piece_rows):
            f = _Forest(t, memo)
            f.run()
            tops = np.flatnonzero((f.parent < 0) & f.reached)
            out = t.select(["job_id", "event_id"]).take(pa.array(tops)).combine_chunks()
            yield pa.RecordBatch.from_arrays([out["job_id"].combine_chunks(), out["event_id"].combine_chunks(), pa.array(f.hash[tops].tolist(), pa.string())], names=["job_id", "top", "tree_hash"])

    return run


_PART = "job_id string, event_id string, parent_event_id string, event_type string, loc bigint, n_kids bigint, known array<string>, tree_hash string"


def _hash_pieces(piece_rows: int):
    """One round in every piece: unfinished spans with the hashes they know, and finished ones whose parent is elsewhere."""

    def solve(t: pa.Table, memo: dict[str, str]) -> pa.RecordBatch:
        f, known = _Forest(t, memo), t["known"].to_pylist()
        f.run(t["n_kids"].to_numpy(), known)
        done = np.array([h is not None for h in f.hash], bool)
        for i in np.flatnonzero(done & (f.parent >= 0)).tolist():
            up = int(f.parent[i])
            if not done[up]:
                known[up] = [*(known[up] or ()), f.hash[i]]
        rows = np.flatnonzero(~done | (f.parent < 0))
        out = t.drop_columns(["known"]).take(pa.array(rows))
        columns = [*(c.combine_chunks() for c in out.columns), pa.array([None if done[i] else known[i] for i in rows], pa.list_(pa.string())), pa.array(f.hash[rows].tolist(), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*out.column_names, "known", "tree_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for t in runs_of(batches, piece_rows):
            yield solve(t, memo)

    return run


def _heavy_hashes(rows: DataFrame, piece_rows: int) -> DataFrame:
    """(job_id, top, tree_hash) of jobs of any size, in rounds over pieces."""
    kids = rows.where("parent_event_id is not null").groupBy("job_id", F.col("parent_event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n_kids"))
    ids = rows.select("job_id", F.col("event_id").alias("parent_event_id"), F.lit(True).alias("_there"))
    state = join_spread(rows, ids, ["job_id", "parent_event_id"], "left").withColumn("parent_event_id", F.when(F.col("_there"), F.col("parent_event_id")))
    state = state.join(kids, ["job_id", "event_id"], "left").select("job_id", "event_id", "parent_event_id", "event_type", "loc", F.coalesce("n_kids", F.lit(0)).cast("bigint").alias("n_kids"), F.lit(None).cast("array<string>").alias("known"))
    order, found = ("job_id", "loc", "event_id"), None
    while True:
        done = cut(state.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_hash_pieces(piece_rows), _PART))
        tops = done.where("tree_hash is not null and parent_event_id is null").select("job_id", F.col("event_id").alias("top"), "tree_hash")
        found = tops if found is None else found.unionByName(tops)
        sent = done.where("tree_hash is not null and parent_event_id is not null").groupBy("job_id", F.col("parent_event_id").alias("event_id")).agg(F.collect_list("tree_hash").alias("new"))
        if sent.isEmpty():  # the rest is in rings or above them
            return found
        none = F.array().cast("array<string>")
        state = done.where("tree_hash is null").drop("tree_hash").join(sent, ["job_id", "event_id"], "left").withColumn("known", F.concat(F.coalesce("known", none), F.coalesce("new", none))).drop("new")


def tree_hashes(spans: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(job_id, top, tree_hash) of every tree; a job may have several. Spans in or behind rings have none.

    ``spans`` are read several times; they should come from a table.
    """
    rows = spans.select("job_id", "event_id", "parent_event_id", "event_type", F.coalesce(F.col("start_timestamp").cast("bigint"), F.lit(0)).alias("loc"))
    light, heavy = by_size(rows, "job_id", piece_rows)
    out = light.select("job_id", "event_id", "parent_event_id", "event_type", "piece").mapInArrow(_hash_jobs(piece_rows), "job_id string, top string, tree_hash string")
    return out if heavy is None else out.unionByName(_heavy_hashes(cut(heavy), piece_rows))


def job_hashes(spans: DataFrame) -> DataFrame:
    """(job_id, job_name, job_hash): fingerprints of jobs. A job of several trees combines those of its trees."""
    trees = tree_hashes(spans).groupBy("job_id").agg(F.array_sort(F.collect_list("tree_hash")).alias("t"))
    names = spans.groupBy("job_id").agg(F.min("job_name").alias("job_name"))
    joined = F.array_join("t", "")
    return trees.join(names, "job_id").select("job_id", "job_name", F.when(F.size("t") == 1, F.col("t")[0]).otherwise(_xx64_column(joined)).alias("job_hash"))


def unique_graphs(hashes: DataFrame) -> DataFrame:
    """(job_name, job_hash, job_id, n_jobs): the least job id stands for all jobs of a name with the same hash."""
    return hashes.groupBy("job_name", "job_hash").agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("n_jobs"))


def children(spans: DataFrame) -> DataFrame:
    """(job_id, event_id, child_event_ids) of each span that has children, sorted."""
    return spans.where("parent_event_id is not null").groupBy("job_id", F.col("parent_event_id").alias("event_id")).agg(F.array_sort(F.collect_list("event_id")).alias("child_event_ids"))


def with_children(spans: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return spans.drop("child_event_ids").join(children(spans), ["job_id", "event_id"], "left").withColumn("child_event_ids", F.coalesce("child_event_ids", none))


def roots_in_window(spans: DataFrame, low: int, high: int) -> DataFrame:
    return spans.where("parent_event_id is null").join(jobs_in_window(spans, low, high), "job_id", "left_semi").select("job_id", "event_id")


def page(rows: DataFrame, offset: int, size: int, order: str = "event_id") -> DataFrame:
    """A page of rows in the order of a column; ValueError for negative bounds."""
    if offset < 0 or size < 0:
        raise ValueError("offset and size of a page must not be negative")
    return rows.orderBy(order).offset(offset).limit(size)


def of_jobs(spans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Spans of the jobs named in ``jobs`` (job_id)."""
    return spans.join(jobs.select("job_id").where("job_id is not null").distinct(), "job_id", "left_semi")


def select_jobs(spans: DataFrame, names: set[str] | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """Spans of the named workflows and of the (job_name, job_id) pairs; an empty filter is none."""
    if names:
        spans = spans.where(F.col("job_name").isin(sorted(names)))
    if jobs is not None:
        spans = spans.join(jobs.select("job_name", "job_id").distinct(), ["job_name", "job_id"], "left_semi")
    return spans


