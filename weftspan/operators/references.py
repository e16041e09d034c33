"""References to records that do not exist, or arrive later than the record that names them.

Keys and references meet in ranges of a 64-bit hash of the key. The ranges have equal width, and hashes of distinct
keys are uniform, so ranges are balanced without sampling. Each range stores its parents as one sorted array; batches
of references are looked up in it by a vectorised binary search, and the text is compared where hashes meet. A range
that many references fall into (one parent named by a third of all rows) is repeated for as many salted parts as its
references need, so that no task gets more than ``part_rows`` references beyond its fair share.

Defined results
---------------
key text                    compared in lower case, without outer blanks
null, empty, ``None``, 0..0 no reference, and no key
repeated keys               the first arrival counts; one without a time counts as there from the start
repeated references         one result per row
a row without a time        never ``late``
target only in deletions    ``deleted``; target in both: not an orphan
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.runtime import BROADCAST_ROWS, cut, join_small

#: References a part of a range should hold, and keys a range should hold.
PART_ROWS, RANGE_KEYS = 100_000, 32_000
_FOUND = "ref_table string, ref_id bigint, target_event_id string, orphan_kind string, period_day string"


def clean_key(c: Column) -> Column:
    """The form in which ids are compared; null where there is none."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when((k != "") & (k != "none") & ~k.rlike("^0+$"), k)


class _Range:
    """The sorted parents of one range, filled and then probed."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.hash: np.ndarray | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.batches.append(rows)
        self.hash = None

    def _close(self) -> None:
        if not self.batches:
            self.hash, self.key, self.first, self.deleted = np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, bool)
            return
        t = pa.Table.from_batches(self.batches)
        order = np.argsort(h := t["h"].to_numpy(), kind="stable")
        self.hash, self.key = h[order], pc.take(t["k"].combine_chunks(), pa.array(order))
        # nodes come before deletions in time only if they exist at all: tag 0 is a node, 1 a deletion
        self.first, self.deleted = t["at"].to_numpy()[order], (t["tag"].to_numpy() == 1)[order]

    def probe(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each reference: whether it is in nodes, its first arrival there, whether it is in deletions."""
        if self.hash is None:
            self._close()
        h, n = rows["h"].to_numpy(), rows.num_rows
        there, first, deleted = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
        pos, live = np.searchsorted(self.hash, h, "left"), np.arange(n)
        while live.size:  # a key may stand there as node and as deletion, and other keys may share its hash
            ok = pos[live] < self.hash.size
            live = live[ok]
            live = live[self.hash[pos[live]] == h[live]]
            if not live.size:
                break
            same = pc.equal(pc.take(self.key, pa.array(pos[live])), pc.take(rows["k"], pa.array(live))).to_numpy(zero_copy_only=False)
            hit, at = live[same], pos[live[same]]
            gone = self.deleted[at]
            deleted[hit[gone]] = True
            there[hit[~gone]] = True
            first[hit[~gone]] = self.first[at[~gone]]
            pos[live] += 1
        return there, first, deleted


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and tag, keys (0 and 1) before references (2); only one range is held at a time."""
    current, held = None, _Range()
    for batch in batches:
        part, tag = batch["part"].to_numpy(), batch["tag"].to_numpy()
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(tag >= 2) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            rows = batch.slice(a, b - a)
            if part[a] != current:
                current, held = part[a], _Range()
            if tag[a] < 2:
                held.add(rows)
                continue
            there, first, deleted = held.probe(rows)
            own = rows["at"]
            late = there & pc.fill_null(pc.greater(pa.array(first), own), False).to_numpy(zero_copy_only=False)
            miss = np.flatnonzero(~there | late)
            if miss.size:
                kind = np.where(late, "late", np.where(deleted, "deleted", "missing"))[miss]
                out = rows.select(["ref_table", "ref_id", "k", "period_day"]).take(pa.array(miss))
                yield pa.RecordBatch.from_arrays([out["ref_table"], out["ref_id"], out["k"], pa.array(kind.tolist(), pa.string()), out["period_day"]], names=["ref_table", "ref_id", "target_event_id", "orphan_kind", "period_day"])


def find_orphans(keys: DataFrame, references: DataFrame, deletions: DataFrame | None = None, *, range_keys: int = RANGE_KEYS, part_rows: int = PART_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Orphan references, one row each.

    ``keys``: (k, at) with the key as :func:`clean_key` gives it and its arrival in microseconds.
    ``references``: (ref_table, ref_id, k, at). ``deletions``: (k).
    """
    lowest = F.lit(-(2**63))
    parents = keys.where("k is not null").groupBy("k").agg(F.min(F.coalesce("at", lowest)).alias("at")).withColumn("tag", F.lit(0))
    if deletions is not None:
        parents = parents.unionAll(deletions.where("k is not null").select("k", F.lit(0).cast("bigint").alias("at"), F.lit(1).alias("tag")).dropDuplicates(["k"]))
    h = F.xxhash64("k")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86_400_000_000).cast("int")).cast("string")
    refs = references.where("k is not null").select("k", "at", F.lit(2).alias("tag"), h.alias("h"), "ref_table", "ref_id", day.alias("period_day"))
    n_keys = keys.count()  # read from the files' footers; repeats only make ranges smaller
    bits = max(0, int(np.ceil(np.log2(max(1, n_keys / range_keys)))))
    number = lambda c: (F.shiftrightunsigned(c, 64 - bits) if bits else F.lit(0).cast("bigint"))
    parents = parents.select("*", h.alias("h"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("period_day")).withColumn("r", number(F.col("h")))
    refs = refs.withColumn("r", number(F.col("h")))
    # as many parts as the references of a range need; the count is combined on the map side
    loads = cut(refs.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts")).where("parts > 1"))
    parents = join_small(parents, loads, ["r"], "left", broadcast_rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    refs = join_small(refs, loads, ["r"], "left", broadcast_rows).withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("ref_table", "ref_id"), F.col("parts"))).otherwise(0).cast("int"))
    both = parents.select("r", "salt", "tag", "h", "k", "at", "ref_table", "ref_id", "period_day").unionByName(refs.select("r", "salt", "tag", "h", "k", "at", "ref_table", "ref_id", "period_day"))
    both = both.withColumn("part", F.col("r") * F.lit(1 << 20) + F.col("salt"))
    placed = both.repartition("part").sortWithinPartitions("part", "tag")
    return placed.select("part", "tag", "h", "k", "at", "ref_table", "ref_id", "period_day").mapInArrow(_probe, _FOUND)
