"""Sequencing, cleaning, fingerprints and event sets against literal expectations and plain recursion."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftspan.operators import cleaning, fingerprint
from weftspan.operators import event_sets as es
from weftspan.operators import sequence as seq

SPAN = "job_name string, job_id string, event_type string, event_id string, start_timestamp bigint, end_timestamp bigint, application_name string, parent_event_id string"
NODE = "id bigint, " + SPAN + ", ingested_at timestamp_ntz"


def spans(spark, rows):
    return spark.createDataFrame([("n", j, t, e, a, z, "app", p) for j, t, e, a, z, p in rows], SPAN)


def literal(rows, overlap=False, groups=None):
    """The recursion as the definition has it."""
    kids, types = {}, {(j, e): t for j, t, e, *_ in rows}
    for r in rows:
        kids.setdefault((r[0], r[5]), []).append(r)
    out = {}

    def visit(r, inherited):
        mine = {}
        for c in kids.get((r[0], r[2]), ()):
            g = (groups or {}).get("n", {}).get(types[r[0], r[2]], {}).get(c[1])
            mine.setdefault(("g", g) if g else ("o", c[2]), []).append(c)
        ordered = [sorted(g, key=lambda c: (c[3], c[2])) for g in mine.values()]
        ordered.sort(key=lambda g: (g[0][3], g[0][2]))
        if overlap:
            merged = []
            for g in ordered:
                if merged and not last_end < g[0][3]:
                    merged[-1] += g
                else:
                    merged.append(list(g))
                last_end = g[-1][4]
            ordered = merged
        before = inherited
        for g in ordered:
            for c in g:
                visit(c, before)
            before = sorted(c[2] for c in g)
        out[r[0], r[2]] = before

    for r in kids.values():
        for x in r:
            if x[5] is None:
                visit(x, [])
    return out


def tree(seed, n=60, jobs=3):
    rnd, rows = random.Random(seed), []
    for j in range(jobs):
        ids = []
        for i in range(n):
            e, a = f"{j}-{i:03d}", rnd.randrange(100)
            rows.append((f"j{j}", rnd.choice("ABCD"), e, a, a + rnd.randrange(20), rnd.choice(ids[-8:]) if ids else None))
            ids.append(e)
    return rows


GROUPS = {"n": {"A": {"B": "g", "C": "g"}, "B": {"A": "x", "D": "x"}}}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("overlap", "groups"), [(False, None), (True, None), (False, GROUPS), (True, GROUPS)])
def test_sequencing_is_the_recursion(spark, seed, overlap, groups):
    rows = tree(seed)
    want = literal(rows, overlap, groups)
    for size in (50_000, 5):  # by whole jobs, and by joins
        got = {(r.job_id, r.event_id): r.previous for r in seq.with_predecessors(spans(spark, rows), overlap, groups, size).collect()}
        assert got == want
    for wide in (100_000, 3):  # by windows, and the wider families over range partitions
        got = {(r.job_id, r.event_id): r.previous for r in seq.predecessors(spans(spark, rows), overlap, groups, wide).collect()}
        assert got == want


@pytest.mark.parametrize("overlap", [False, True])
def test_one_family_over_many_partitions(spark, overlap):
    rnd = random.Random(8)
    rows = [("j", "R", "r", 0, 9, None), *[("j", "K", f"k{i:03d}", a := rnd.randrange(400), a + rnd.randrange(9), "r") for i in range(200)], *[("i", "K", f"x{i}", i, i, "y") for i in range(9)], ("i", "R", "y", 0, 1, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r.job_id, r.event_id): r.previous for r in seq.predecessors(spans(spark, rows), overlap, wide=5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == literal(rows, overlap)


def test_overlap_looks_at_the_last_of_the_group_before(spark):
    rows = [("j", "R", "r", 0, 99, None), *[("j", "K", f"k{a}", a, z, "r") for a, z in ((1, 10), (2, 3), (5, 6), (7, 8))]]
    assert seq.sibling_groups(spans(spark, rows), overlap=True).count() == 3
    touching = [("j", "R", "r", 0, 99, None), ("j", "K", "a", 1, 5, "r"), ("j", "K", "b", 5, 6, "r")]
    assert seq.sibling_groups(spans(spark, touching), overlap=True).count() == 1


def test_jobs_that_are_no_tree(spark):
    rows = [("ok", "A", "a", 1, 2, None), ("two", "A", "b", 1, 2, None), ("two", "A", "c", 1, 2, None), ("none", "A", "d", 1, 2, "e"), ("none", "A", "e", 1, 2, "d"), ("off", "A", "f", 1, 2, None), ("off", "A", "g", 1, 2, "a"), ("ring", "A", "h", 1, 2, None), ("ring", "A", "i", 1, 2, "i")]
    df = spans(spark, rows)
    assert {tuple(r) for r in seq.rejected_jobs(df).collect()} == {("two", "several roots"), ("none", "no root"), ("off", "disconnected"), ("ring", "ring")}
    assert [r.eventId for r in seq.sequence(df).collect()] == ["a"]
    with pytest.raises(ValueError):
        seq.sequence(df, strict=True)
    assert seq.sequence(df.limit(0)).count() == 0


def test_rename(spark):
    df = spans(spark, [("j", "A", "a", 1, 2, None), ("j", "B", "b", 1, 2, "a"), ("j", "A", "c", 1, 2, "a"), ("j", "C", "d", 1, 2, "c")])
    got = {r.event_id: r.event_type for r in seq.rename_by_children(df, {"n": {"A": ({"B", "X"}, "A_B")}, "m": {"A": ({"C"}, "no")}}).collect()}
    assert got == {"a": "A_B", "b": "B", "c": "A", "d": "C"}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_pv_timestamp(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in spark.createDataFrame([(0,), (1704067200059959000,), (1741503599999999999,)], "n bigint").select(seq.pv_timestamp(F.col("n"))).collect()]
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
    assert got == ["1970-01-01T00:00:00.000000Z", "2024-01-01T00:00:00.059959Z", "2025-03-09T07:00:00.000000Z"]


def nodes(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, "n", j, t, e, a, z, app, p, datetime(2025, 1, 1, 0, 0, at)) for i, (j, t, e, a, z, app, p, at) in enumerate(rows)], NODE)


def test_cleaning(spark):
    s = 1_700_000_000
    df = nodes(spark, [
        ("j", "A", " X1", s, s + 1, "app", "None", 5), ("j", "B", "x1", s, s, "app", "0000", 4), ("j", "B", "x2", s * 1000, s * 1000, "app", "X1 ", 1), ("k", "A", "x3", 0, 1, "app", None, 1), ("k", "A", "x4", s, s, None, None, 1), ("k", "A", None, s, s, "app", None, 1), ("l", "A", "x5", s * 10**6, s * 10**6 + 7, "app", "y", 1),
    ])
    got = {r.event_id: (r.event_type, r.start_timestamp, r.parent_event_id) for r in cleaning.spans_of(df).collect()}
    assert got == {"x1": ("B", s * 10**9, None), "x2": ("B", s * 10**9, "x1"), "x5": ("A", s * 10**9, "y")}
    assert {tuple(r) for r in cleaning.rejected_records(df).collect()} == {(3, "without start_timestamp"), (4, "without application_name"), (5, "without event_id")}
    clean = cleaning.spans_of(df)
    assert {r.job_id for r in cleaning.drop_inconsistent_jobs(clean).collect()} == {"j"} and {r.job_id for r in cleaning.disconnected_jobs(clean).collect()} == {"l"}
    assert [tuple(r) for r in cleaning.duplicates(cleaning.valid_records(df)).collect()] == [("x1", 2)]
    with pytest.raises(ValueError):
        cleaning.time_window(clean, 10**6)


def test_window_counts_starts_and_ends_only(spark):
    df = spans(spark, [("in", "A", "a", 5, 50, None), ("end", "A", "b", 1, 10, None), ("over", "A", "c", 1, 99, None), ("out", "A", "d", 1, 2, None)])
    assert {r.job_id for r in cleaning.jobs_in_window(df, 5, 20).collect()} == {"in", "end"}


def test_fingerprints(spark):
    x = fingerprint.xx64
    assert x("A") == "13099d40d095b684"  # a fixed value: the published hash of this text with seed 0
    rows = [("j1", "R", "a", 0, 9, None), ("j1", "B", "b", 2, 3, "a"), ("j1", "C", "c", 1, 2, "a"), ("j2", "R", "d", 5, 9, None), ("j2", "C", "e", 7, 8, "d"), ("j2", "B", "f", 6, 7, "d"), ("j3", "R", "g", 0, 1, None)]
    df = spans(spark, rows)
    want = x("R" + "".join(sorted([x("B"), x("C")])))
    for size in (50_000, 2):  # jobs in one task, and level by level
        got = {r.job_id: r.tree_hash for r in fingerprint.tree_hashes(df, piece_rows=size).collect()}
        assert got == {"j1": want, "j2": want, "j3": x("R")}
    unique = {(r.job_id, r.n_jobs) for r in fingerprint.unique_graphs(fingerprint.job_hashes(df)).collect()}
    assert unique == {("j1", 2), ("j3", 1)}
    assert {r.event_id: r.child_event_ids for r in fingerprint.with_children(df).where("job_id = 'j1'").collect()} == {"a": ["b", "c"], "b": [], "c": []}
    with pytest.raises(ValueError):
        fingerprint.page(df, -1, 2)
    assert fingerprint.select_jobs(df, set(), None).count() == 7


def hashed(rows):
    """Hash of each top, by recursion; none in or behind rings."""
    here, kids = {(r[0], r[2]) for r in rows}, {}
    for r in rows:
        kids.setdefault((r[0], r[5]) if (r[0], r[5]) in here else None, []).append(r)

    def of(r):
        return fingerprint.xx64(r[1] + "".join(sorted(of(c) for c in kids.get((r[0], r[2]), ()))))

    return {(r[0], r[2]): of(r) for r in kids[None]}


@pytest.mark.parametrize("size", [50_000, 7])
def test_fingerprints_of_any_shape(spark, size):
    rows = tree(5, 80) + [("j0", "A", "lost", 3, 4, "nowhere"), ("j1", "A", "ring1", 3, 4, "ring2"), ("j1", "A", "ring2", 3, 4, "ring1"), ("j1", "B", "behind", 3, 4, "ring1"), ("j2", "A", "self", 3, 4, "self")]
    rows += [("deep", "AB"[i % 2], f"d{i:03d}", i, i, f"d{i - 1:03d}" if i else None) for i in range(60)]
    got = {(r.job_id, r.top): r.tree_hash for r in fingerprint.tree_hashes(spans(spark, rows), piece_rows=size).collect()}
    assert got == hashed(rows)


def test_empty_tables_have_no_sequences_or_fingerprints(spark):
    none = spans(spark, [])
    assert seq.with_predecessors(none).count() == 0 and fingerprint.tree_hashes(none).count() == 0


SEQ = "seq string, name string, event string, type string, previous array<string>"


def test_event_sets_and_models(spark):
    rows = [("s", "n", "1", "A", []), ("s", "n", "2", "B", ["1", "gone", "1"]), ("s", "n", "3", "B", ["1"]), ("s", "n", "4", "C", ["2", "3"]), ("t", "n", "1", "A", []), ("t", "n", "2", "C", ["1"]), ("u", "m", "1", "Z", None)]
    seqs = spark.createDataFrame(rows, SEQ).withColumn("previous", F.coalesce("previous", F.array().cast("array<string>")))
    model = es.model_rows(seqs)
    text = lambda s: ",".join(f"{x['eventType']}*{x['count']}" for x in s)
    got = {(r.job_name, r.event_type, r.direction, text(r.event_set)) for r in model.collect()}
    assert got == {("n", "A", "out", "B*2"), ("n", "A", "out", "C*1"), ("n", "B", "out", "C*1"), ("n", "B", "in", "A*1"), ("n", "C", "in", "B*2"), ("n", "C", "in", "A*1"), ("m", "Z", "out", "")}
    halves = [es.model_rows(seqs.where(f"seq = '{s}'")) for s in "stu"]
    merged = es.merge_models(halves[2], es.merge_models(halves[1], halves[0]), halves[0])
    assert {(r.job_name, r.event_type, r.direction, text(r.event_set)) for r in merged.collect()} == got
    back = es.rows_of_models(es.models(model))
    assert {(r.job_name, r.event_type, r.direction, text(r.event_set)) for r in back.collect()} == got
    assert {(r.event_type, r.found) for r in es.contains_set(model, {"B": 2}).where("direction = 'out'").collect()} == {("A", True), ("B", False), ("Z", False)}
    starts = {(r.src_type, r.dst_type) for r in es.links(seqs, dummy_start=True).where("seq = 'u'").collect()}
    assert starts == {("|||START|||", "Z")}


def test_splice(spark):
    rows = [("s", "n", "0", "|||START|||", []), ("s", "n", "1", "|||DUMMY|||", ["0"]), ("s", "n", "2", "A", ["1"]), ("s", "n", "3", "|||DUMMY|||", ["2"]), ("s", "n", "4", "|||DUMMY|||", ["3", "2"]), ("s", "n", "5", "B", ["4"])]
    got = {r.event: r.previous for r in es.splice_out(spark.createDataFrame(rows, SEQ)).collect()}
    assert got == {"2": [], "5": ["2"]}


def test_components_and_cycles(spark):
    e = spark.createDataFrame([("n", a, b) for a, b in ("sa", "ab", "bc", "ca", "cd", "dd")], "job_name string, src string, dst string")
    assert {(r.node, r.scc) for r in es.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    assert {r.node for r in es.loop_starts(e).collect()} == {"a", "d"} and {(r.src, r.dst) for r in es.loop_edges(e).collect()} == {("c", "a"), ("d", "d")}
    sets = spark.createDataFrame([("n", "x", "out", [(k, 1) for k in s]) for s in ("ab", "bc", "de", "f")], "job_name string, event_type string, direction string, event_set array<struct<eventType:string,count:int>>")
    assert {(r.member, r.component) for r in es.overlap_components(sets).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
