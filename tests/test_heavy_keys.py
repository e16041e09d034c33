from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftspan.operators.heavy_keys import _mark, chunk_states, heavy_keys, key_offsets, key_states, key_stats, number_rows, numbered_runs

SCHEMA = "id bigint, key string, value string, t bigint, part int"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    return [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", None if i % 31 == 0 else "v" * 5000 if i % 29 == 0 else f"e{rnd.randrange(300)}", None if i % 7 == 0 else rnd.randrange(10**6), 0) for i in range(6000)]


def want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    out = {}
    for k, rs in by.items():
        times = [r[3] for r in rs if r[3] is not None]
        out[k] = (len(rs), len({r[2] for r in rs} - {None}), min(times, default=None), max(times, default=None))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1000, 10**6])
@pytest.mark.parametrize("tie", ["id", None])
def test_stats_are_exact_at_every_chunk_size(spark, rows, chunk, tie):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.key: (r.n_rows, r.n_values, r.first_time, r.last_time) for r in key_stats(df, "key", F.col("value"), F.col("t"), tie, chunk).collect()}
    assert got == want(rows)


def test_small_batches_carry_open_chunks_over(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = {r.key: (r.n_rows, r.n_values, r.first_time, r.last_time) for r in key_stats(spark.createDataFrame(rows, SCHEMA), "key", F.col("value"), F.col("t"), "id", 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want(rows)


@pytest.fixture(scope="module")
def runs(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # these rows would fit one partition
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        yield numbered_runs(df.select(_mark(F.col("key")).alias("key"), _mark(F.col("value")).alias("value"), F.col("id").alias("tie"), F.col("t").alias("time")), True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_offsets_are_prefix_sums(runs, rows):
    parts = key_offsets(runs).where("key = 'vhot'").orderBy("part").collect()
    total, seen = want(rows)["hot"][0], 0
    assert len(parts) > 1
    for p in parts:
        assert p.before == seen and p.key_rows == total
        seen += p.n
    assert seen == total


def test_numbers_are_exact_and_chunks_equal(runs, rows):
    """Without the offsets numbers would begin again in every partition, and chunks would be of any size."""
    numbered = number_rows(runs, key_offsets(runs))
    for r in numbered.groupBy("key").agg(F.min("row_no").alias("a"), F.max("row_no").alias("z"), F.count_distinct("row_no").alias("d"), F.count("*").alias("n")).collect():
        assert (r.a, r.z, r.d) == (0, r.n - 1, r.n)
    order = [r.value for r in numbered.where("key = 'vhot'").orderBy("row_no").collect()]
    assert order == sorted(order)
    states = chunk_states(numbered, 100).where("key = 'vhot'")
    assert states.select("part").distinct().count() > 1
    sizes = [r.n for r in states.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy("chunk").collect()]
    assert set(sizes[:-1]) == {100} and sum(sizes) == want(rows)["hot"][0]


def test_light_keys_need_no_offsets(runs, rows):
    none = number_rows(runs, key_offsets(runs), 10**6)
    assert none.where("row_no <> number").count() == 0


def test_sizes_without_an_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for chunk in (1, 50, 10**6):
        assert {r.key: r.n for r in key_states(df, F.col("key"), chunk_rows=chunk).collect()} == {("n" if k is None else f"v{k}"): v[0] for k, v in want(rows).items()}


def test_heavy_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.key_field, r.heavy_key, r.n_rows) for r in heavy_keys(df, ["key"], 0.3).collect()}
    assert got == {("key", "hot", want(rows)["hot"][0])}
    none = df.limit(0)
    assert heavy_keys(none, ["key"], 0.1).count() == 0 and key_stats(none, "key", F.col("value"), F.col("t")).count() == 0
