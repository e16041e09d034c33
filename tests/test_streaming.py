from __future__ import annotations

from datetime import datetime, timedelta

from weftspan.streaming.traces import dedupe_stream, grow_model, idle_traces, read_grown, span_counts

NODE = "id bigint, job_name string, job_id string, event_type string, event_id string, start_timestamp bigint, end_timestamp bigint, application_name string, parent_event_id string, ingested_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def row(i, job, kind, event, parent, minute):
    return (i, "n", job, kind, event, 10**18 + i * 10, 10**18 + i * 10 + 5, "app", parent, T0 + timedelta(minutes=minute))


FIRST = [row(1, "j1", "R", "a", None, 0), row(2, "j1", "A", "b", "a", 1), row(3, "j1", "A", "B ", "a", 2), row(4, "j2", "R", "c", None, 1), row(5, "j2", "B", "d", "c", 2), row(6, "j2", "B", None, "c", 2)]
SECOND = [row(7, "j3", "R", "e", None, 300)]
THIRD = [row(8, "j4", "R", "f", None, 900)]


def stream(spark, folder, *batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, NODE).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(NODE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_dedupe_and_counts(spark, tmp_path):
    src = stream(spark, tmp_path / "in", FIRST, SECOND)
    q = dedupe_stream(src).select("event_id", "event_type").writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.table("deduped").collect()) == ["a", "b", "c", "d", "e"]
    q = span_counts(src).writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n_spans for r in spark.table("counted").collect()) == 5


def test_idle_traces_grow_a_model(spark, tmp_path):
    src = stream(spark, tmp_path / "in", FIRST, SECOND, THIRD)
    q = grow_model(idle_traces(src), str(tmp_path / "model"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = {(r.event_type, tuple(x["eventType"] for x in r.event_set)) for r in read_grown(spark, str(tmp_path / "model")).where("direction = 'out'").collect()}
    assert got >= {("|||START|||", ("A",)), ("|||START|||", ("B",)), ("A", ("R",)), ("B", ("R",))}


def test_large_traces_come_in_parts(spark, tmp_path):
    rows = [row(i, "j", "A", f"e{i}", None, 0) for i in range(50)]
    q = idle_traces(stream(spark, tmp_path / "in", rows, SECOND, THIRD), most=20).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    parts = [r for r in spark.table("parts").collect() if r.job_id == "j"]
    assert sum(r.n_spans for r in parts) == 50


def test_a_trace_in_parts_is_modelled_whole(spark, tmp_path):
    # a chain under one root; parts end between any span and its parent, and a later file holds earlier arrivals
    kinds = "RABCDEFG"
    job = [row(i, "j", k, f"e{i}", f"e{i - 1}" if i else None, 3 - i // 4) for i, k in enumerate(kinds)]
    src = stream(spark, tmp_path / "in", [*FIRST, *job[:2]], job[2:4], job[4:], SECOND, THIRD)
    grown = {}
    for most in (2, 3, 100):
        q = grow_model(idle_traces(src, most=most), str(tmp_path / f"model{most}"), str(tmp_path / f"c{most}"))
        q.processAllAvailable()
        q.stop()
        grown[most] = {(r.event_type, r.direction, tuple((x["eventType"], x["count"]) for x in r.event_set)) for r in read_grown(spark, str(tmp_path / f"model{most}")).collect()}
    links = {(a, "out", ((b, 1),)) for b, a in zip(kinds, kinds[1:])}
    assert links <= grown[100] and grown[2] == grown[3] == grown[100]


def test_the_last_part_is_closed_but_not_complete(spark, tmp_path):
    rows = [row(i, "j", "A", f"e{i}", None, 0) for i in range(50)]
    q = idle_traces(stream(spark, tmp_path / "in", rows, SECOND, THIRD), most=20).writeStream.format("memory").queryName("closed_parts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    parts = sorted((r for r in spark.table("closed_parts").collect() if r.job_id == "j"), key=lambda r: r.part)
    assert [r.part for r in parts] == list(range(len(parts))) and len({r.opened for r in parts}) == 1
    assert not any(r.complete for r in parts) and [r.closed for r in parts] == [False] * (len(parts) - 1) + [True]
