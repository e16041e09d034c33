from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspan.operators import hierarchy
from weftspan.operators.hierarchy import descendants, first_arrivals, hierarchies, intervals

SCHEMA = "job string, k string, p string, loc bigint"


def brute(rows):
    parent = {(j, k): (j, p) for j, k, p, _ in rows}
    out = {}
    for job, k, _, _ in rows:
        seen, at = [k], (job, k)
        while True:
            up = parent[at]
            if up[1] is None or up not in parent:
                out[job, k] = (seen[-1], len(seen) - 1, "tree", seen[::-1])
                break
            if up[1] in seen:
                ring = seen[seen.index(up[1]):]
                out[job, k] = (min(ring), None, "on_cycle" if up[1] == k else "leads_to_cycle", None)
                break
            seen.append(up[1])
            at = up
    return out


def solve(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.job, r.k): (r.top, r.depth, r.state, r.path) for r in hierarchies(df, with_path=True, **kw).collect()}


def forest(seed, n=300, jobs=("a", "a", "a", "a", "b", None)):
    """Random links: long chains, bushes, rings, parents elsewhere and nowhere."""
    rnd = random.Random(seed)
    rows, by = [], {}
    for i in range(n):
        job = rnd.choice(jobs)
        mine = by.setdefault(job, [])
        kind = rnd.random()
        p = None if kind < 0.05 else f"gone{i}" if kind < 0.08 else rnd.choice(rows)[1] if rows and kind < 0.12 else mine[-1] if mine and kind < 0.7 else rnd.choice(mine) if mine else None
        k = f"{rnd.getrandbits(40):010x}"
        mine.append(k)
        rows.append([job, k, p, i])
    for _ in range(6):  # rings, some long
        a = rnd.randrange(n)
        rows[a][2] = rnd.choice([r[1] for r in rows if r[0] == rows[a][0]])
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_every_size(spark, seed):
    rows = forest(seed)
    want = brute(rows)
    assert solve(spark, rows) == want
    assert solve(spark, rows, piece_rows=20) == want


def test_recursion_on_quotients(spark):
    # a chain whose arrival order is its own order: the quotient is far smaller at each level
    ids = [f"{i:05d}" for i in range(600)]
    rows = [("j", k, ids[i - 1] if i else None, i) for i, k in enumerate(ids)] + [("j", f"x{i}", ids[-1], 600 + i) for i in range(40)]
    assert solve(spark, rows, piece_rows=16) == brute(rows)
    ring = [("j", k, ids[i - 1], i) for i, k in enumerate(ids)] + [("j", f"x{i}", ids[-1], 600 + i) for i in range(40)]
    assert solve(spark, ring, piece_rows=16, broadcast_rows=0) == brute(ring)


def test_more_pieces_than_any_fixed_number(spark):
    # 1,250 pieces at first; chains lie over several of them
    rows = [("j", f"{c:03d}.{i:02d}", f"{c:03d}.{i - 1:02d}" if i else None, c * 40 + i) for c in range(500) for i in range(40)]
    got = solve(spark, rows, piece_rows=16)
    assert got == {(j, k): (f"{k[:3]}.00", int(k[4:]), "tree", [f"{k[:3]}.{i:02d}" for i in range(int(k[4:]) + 1)]) for j, k, _, _ in rows}


def test_pieces_hold_no_more_than_asked_for():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(n))}) for n in (3, 25, 10, 1)]
    assert [t.num_rows for t in hierarchy.runs_of(iter(batches), 10)] == [10, 10, 10, 9]


def test_doubling_by_joins(spark, monkeypatch):
    rows = forest(11, 120)
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).where("job = 'a'").select("job", "k", "p", F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("array<string>").alias("mid"))
    got = {("a", r.k): (r.root or r.cycle_top, r.dist, "tree" if r.state == "top" else r.state, r.path) for r in hierarchy._jump(df).collect()}
    assert got == {k: v for k, v in want.items() if k[0] == "a"}


def test_descendants(spark):
    rows = [("j", "a", None, 0), ("j", "b", "a", 1), ("j", "c", "b", 2), ("j", "d", "d", 3), ("i", "a", None, 0)]
    got = {tuple(r) for r in descendants(hierarchies(spark.createDataFrame(rows, SCHEMA), with_path=True)).collect()}
    assert got == {("j", "a", "b", 1), ("j", "a", "c", 2), ("j", "b", "c", 1)}


def test_intervals_hold_the_descendants(spark):
    solved = hierarchies(spark.createDataFrame(forest(3), SCHEMA), with_path=True)
    want: dict = {}
    for r in descendants(solved).collect():
        want.setdefault((r.job, r.k), set()).add(r.descendant)
    rows = intervals(solved).collect()
    by = {(r.job, r.order_no): r.k for r in rows}
    assert len(by) == len(rows) == sum(v[2] == "tree" for v in brute(forest(3)).values())
    assert all({by[r.job, i] for i in range(r.order_no + 1, r.last_no + 1)} == want.get((r.job, r.k), set()) for r in rows)


def test_first_arrivals_and_empty(spark):
    df = spark.createDataFrame([("a", 5, 1, "late"), ("a", None, 0, "untimed"), ("a", 3, 9, "tie"), ("a", 3, 2, "first"), (None, 1, 1, "none"), ("b" * 50_000, None, 1, "long")], "e string, t bigint, id bigint, x string")
    got = {(r.k[:1], r.x) for r in first_arrivals(df, F.col("e"), F.col("t"), "id", {"x": F.col("x")}).collect()}
    assert got == {("a", "first"), ("b", "long")}
    assert hierarchies(spark.createDataFrame([], SCHEMA)).count() == 0
