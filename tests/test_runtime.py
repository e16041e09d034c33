from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from weftspan import runtime


def test_scratch_drops_what_was_cut_within(spark):
    kept = runtime.cut(spark.range(3))
    with runtime.scratch(spark):
        df = runtime.cut(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file:")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_small_side_is_broadcast_only_if_its_bytes_are_few(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 5)
    small = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few, many = runtime.join_small(big, small, ["k"]), runtime.join_small(big, small, ["k"], max_bytes=2000)
    assert "broadcast" in plan(few) and "broadcast" not in plan(many) and "_salt" in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Nothing:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="share"):
        runtime.shared_folder(type("Session", (), {"sparkContext": Context()})())
