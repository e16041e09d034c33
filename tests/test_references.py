from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftspan.operators.references import clean_key, find_orphans

KEYS, REFS = "k string, at bigint", "ref_table string, ref_id bigint, k string, at bigint"
DAY = 86_400_000_000


def found(spark, keys, refs, gone=None, **kw):
    deletions = None if gone is None else spark.createDataFrame([(g,) for g in gone], "k string")
    return sorted(tuple(r) for r in find_orphans(spark.createDataFrame(keys, KEYS), spark.createDataFrame(refs, REFS), deletions, **kw).collect())


def test_kinds_and_undefined_values(spark):
    keys = [("a", 5), ("a", 3), ("b", 10), ("c", None), (None, 1)]
    refs = [("t", 1, "a", 3), ("t", 2, "a", 2), ("t", 3, "x", 2 * DAY), ("t", 4, "d", -1), ("t", 5, None, 4), ("t", 6, "b", None), ("t", 7, "c", 0), ("t", 8, "x", None), ("t", 8, "x", None), ("t", 9, "a", 4)]
    rows = find_orphans(spark.createDataFrame(keys, KEYS), spark.createDataFrame(refs, REFS), spark.createDataFrame([("d",), ("d",), ("a",), (None,)], "k string")).collect()
    assert sorted((r.ref_id, r.target_event_id, r.orphan_kind, r.period_day or "") for r in rows) == [(2, "a", "late", "1970-01-01"), (3, "x", "missing", "1970-01-03"), (4, "d", "deleted", "1969-12-31"), (8, "x", "missing", ""), (8, "x", "missing", "")]


def test_clean_key(spark):
    df = spark.createDataFrame([(" AbC\t",), ("",), (None,), ("None",), ("0000",), ("0a",)], "k string")
    assert [r[0] for r in df.select(clean_key(F.col("k"))).collect()] == ["abc", None, None, None, None, "0a"]


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [("t", 1, "a", 0)]) == [("t", 1, "a", "missing", "1970-01-01")]
    assert found(spark, [("a", 1)], []) == []


def test_hot_key_many_ranges_and_shuffled_loads(spark):
    rnd = random.Random(7)
    names = [f"{rnd.getrandbits(64):016x}" * (1 + 200 * (i % 97 == 0)) for i in range(3000)]
    keys = [(k, rnd.randrange(100)) for k in names[:2000] for _ in range(rnd.randrange(1, 3))]
    refs = [("t", i, names[0] if i % 3 == 0 else rnd.choice(names), rnd.randrange(100)) for i in range(9000)]
    first: dict[str, int] = {}
    for k, at in keys:
        first[k] = min(at, first.get(k, at))
    gone = set(names[1900:2500])
    want = sorted((i, k, "late" if k in first else "deleted" if k in gone else "missing") for _, i, k, at in refs if k not in first or first[k] > at)
    for rows in (200_000, 0):
        got = found(spark, keys, refs, gone, range_keys=100, part_rows=50, broadcast_rows=rows)
        assert sorted((i, k, kind) for _, i, k, kind, _ in got) == want
