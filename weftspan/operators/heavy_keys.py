"""Per-key results when a few keys hold most rows: exact offset chunking.

One chain, :func:`key_states`, gives every result:

1. Rows are laid out in partitions: as they come, or, for results that need an order within the key, range-partitioned
   and sorted by (key, value, tie). Either way a hot key covers as many partitions as it needs. Each partition is sorted
   by key, and its rows are numbered within the runs of their keys (:func:`_number`).
2. Rows are counted per key and partition, and the counts are prefix-summed over the partitions (:func:`key_offsets`).
3. Offset and number within the run give each row of a key its exact number.
4. Numbers are cut into equal-sized chunks of ``chunk_rows`` rows, each of which is reduced to a state.
5. Neighbouring states are merged at their boundaries, first within partitions, then over them (:func:`merge_states`).

A key of a third of all rows costs no task more than its share. Only keys of more than ``chunk_rows`` rows need offsets:
they are at most one in ``chunk_rows`` rows.

Defined results
---------------
null key      a key of its own
null value    counted as a row, not as a distinct value
null time     ignored; null if a key has no other
empty table   no rows
ties          rows equal in key and value are split by the tie column, or anywhere without one
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspan.runtime import cut, join_small

CHUNK_ROWS = 50_000


def _mark(c: Column) -> Column:
    """Text that keeps null apart from every value and sorts it first."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def _unmark(c: Column) -> Column:
    return F.when(c.startswith("v"), F.substring(c, 2, 2**31 - 1))


def _number(columns: list[str]):
    """Adds the partition, the row's number in the run of its key, and whether its value differs from the row before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, value, held = None, None, 0  # of the last row, and the rows of its run so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch["key"]
            opens = np.ones(n, bool)
            if n > 1:
                opens[1:] = pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            opens[0] = k[0].as_py() != key
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(opens, at, -1))
            number = np.where(begin >= 0, at - begin, at + held)
            fresh = opens
            if "value" in columns:
                v = batch["value"]
                fresh = opens.copy()
                if n > 1:
                    fresh[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
                fresh[0] |= v[0].as_py() != value
                value = v[n - 1].as_py()
            key, held = k[n - 1].as_py(), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(number), pa.array(fresh)], names=[*columns, "part", "number", "fresh"])

    return run


def numbered_runs(rows: DataFrame, ordered: bool) -> DataFrame:
    """rows: (key[, value, tie][, time]) -> those and (part, number, fresh), written to the shared folder."""
    if ordered:
        placed = rows.repartitionByRange("key", "value", "tie").sortWithinPartitions("key", "value").drop("tie")
    else:
        placed = rows.sortWithinPartitions("key")
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    added = T.StructType().add("part", T.IntegerType()).add("number", T.LongType()).add("fresh", T.BooleanType())
    return cut(placed.mapInArrow(_number(placed.columns), T.StructType([*placed.schema.fields, *added.fields])))


def key_offsets(runs: DataFrame) -> DataFrame:
    """(key, part, n, before, key_rows, parts): rows of each key in each partition and of it in earlier ones, and its partitions."""
    counts = runs.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    by_key = Window.partitionBy("key")
    return counts.withColumn("before", F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumns({"key_rows": F.sum("n").over(by_key), "parts": F.count(F.lit(1)).over(by_key)})


def number_rows(runs: DataFrame, offsets: DataFrame, least: int = 0) -> DataFrame:
    """Add ``row_no``, exact and without gaps for keys of more than ``least`` rows, and below ``least`` for others."""
    large = offsets.where((F.col("key_rows") > least) & (F.col("parts") > 1)).select("key", "part", "before")
    return join_small(runs, large, ["key", "part"], "left").withColumn("row_no", F.col("number") + F.coalesce("before", F.lit(0)))


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """``df`` and the number, from 0, of each row within ``by`` in ``order``, without one task for all rows of a key.

    Rows that are equal in ``order`` are numbered in any order. A key lies in several range partitions only if one of
    their bounds falls into it, so there are fewer offsets than twice the partitions.
    """
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in by])).alias("key")
    bounds = [f"_o{i}" for i in range(len(order))]
    rows = df.select(key, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(c).alias(b) for c, b in zip(order, bounds)])
    runs = _numbered(rows.repartitionByRange("key", *bounds).sortWithinPartitions("key", *bounds).select("key", "_row"))
    return number_rows(runs, key_offsets(runs)).select("_row.*", F.col("row_no").alias(name))


def chunk_states(numbered: DataFrame, chunk_rows: int) -> DataFrame:
    """One state per chunk, and per part where a chunk lies in several."""
    has = numbered.columns
    state = {"n": F.count(F.lit(1)), "row_from": F.min("row_no")}
    if "time" in has:
        state |= {"low": F.min("time"), "high": F.max("time")}
    if "value" in has:
        some = F.col("value") != "n"
        state |= {"first_value": F.min("value"), "last_value": F.max("value"), "n_values": F.sum((F.col("fresh") & some).cast("bigint")), "opens": F.min_by("fresh", "row_no")}
    rows = numbered.withColumn("chunk", F.floor(F.col("row_no") / F.lit(chunk_rows)).cast("bigint"))
    out = rows.groupBy("key", "part", "chunk").agg(*[c.alias(n) for n, c in state.items()])
    if "value" not in has:
        return out
    # a chunk that begins with a value of the one before holds that value too; merging counts it once
    held = (~F.col("opens") & (F.col("first_value") != "n")).cast("bigint")
    return out.withColumn("n_values", F.col("n_values") + held).drop("opens")


def merge_states(states: DataFrame, by: list[str], order: str) -> DataFrame:
    """Merge the states of each ``by``, neighbours in ``order`` at their boundaries: a value that both hold counts once."""
    merged = {"n": F.sum("n"), "row_from": F.min("row_from")}
    if "low" in states.columns:
        merged |= {"low": F.min("low"), "high": F.max("high")}
    if "first_value" in states.columns:
        before = F.lag("last_value").over(Window.partitionBy(*by).orderBy(order))
        states = states.withColumn("_met", (before.eqNullSafe(F.col("first_value")) & (F.col("first_value") != "n")).cast("bigint"))
        merged |= {"first_value": F.min("first_value"), "last_value": F.max("last_value"), "n_values": F.sum("n_values") - F.sum("_met")}
    return states.groupBy(*by).agg(*[c.alias(n) for n, c in merged.items()])


def key_states(df: DataFrame, key: Column, value: Column | None = None, time: Column | None = None, tie: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The merged state of every key: (key, n[, low, high][, first_value, last_value, n_values])."""
    columns = {"key": _mark(key)}
    if value is not None:
        columns |= {"value": _mark(value), "tie": F.monotonically_increasing_id() if tie is None else tie}
    if time is not None:
        columns["time"] = time.cast("bigint")
    runs = numbered_runs(df.select(*[c.alias(n) for n, c in columns.items()]), value is not None)
    numbered = number_rows(runs, key_offsets(runs), chunk_rows)
    per_part = merge_states(chunk_states(numbered, chunk_rows), ["key", "part"], "chunk")
    return merge_states(per_part, ["key"], "part")


def heavy_keys(df: DataFrame, keys: list[str], share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key_field, heavy_key, n_rows): values of each column that at least ``share`` of all rows carry; null is no value."""
    total = df.count()
    found = []
    for name in keys:
        sizes = key_states(df, F.col(name), chunk_rows=chunk_rows).where((F.col("key") != "n") & (F.col("n") >= F.lit(share) * F.lit(total)))
        found.append(sizes.select(F.lit(name).alias("key_field"), _unmark(F.col("key")).alias("heavy_key"), F.col("n").alias("n_rows")))
    return reduce(DataFrame.unionAll, found)


def key_stats(df: DataFrame, key: str, value: Column, time: Column, tie: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, n_rows, n_values, first_time, last_time, n_chunks) of every key."""
    out = key_states(df, F.col(key), value, time, F.col(tie) if tie else None, chunk_rows)
    return out.select(_unmark(F.col("key")).alias("key"), F.col("n").alias("n_rows"), "n_values", F.col("low").alias("first_time"), F.col("high").alias("last_time"), F.ceil(F.col("n") / F.lit(chunk_rows)).alias("n_chunks"))
