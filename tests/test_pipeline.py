from __future__ import annotations

import json

import pytest
import yaml

from weftspan import __main__ as cli
from weftspan.config import Config, FieldSpec
from weftspan.mining import diagram as D
from weftspan.sources import files
from weftspan.sources.extract import extract

SPAN = "resource_spans.[].scope_spans.[].spans.[]."
MAPPING = {
    "job_name": {"key_paths": ["resource_spans.[].resource.attributes.[].key", "resource_spans.[].scope_spans.[].scope.name"], "key_value": ["service.name", None], "value_paths": ["value.Value.StringValue", None], "value_type": "string"},
    "job_id": {"key_paths": [SPAN + "trace_id"]}, "event_id": {"key_paths": [SPAN + "span_id"]}, "start_timestamp": {"key_paths": [SPAN + "start"]}, "end_timestamp": {"key_paths": [SPAN + "end"]}, "parent_event_id": {"key_paths": [SPAN + "parent"]},
    "event_type": {"key_paths": [SPAN + "name", [SPAN + "not_here", SPAN + "attributes.[].key"]], "key_value": [None, [None, "code"]], "value_paths": [None, [None, "value.Value.IntValue"]]},
    "application_name": {"key_paths": ["resource_spans.[].scope_spans.[].scope.name"]}, "child_event_ids": {"key_paths": [SPAN + "kids"], "value_type": "array"},
}


def span(trace, i, parent, start, end, name, code=200):
    return {"trace_id": trace, "span_id": f"{trace}-{i}", "parent": parent and f"{trace}-{parent}", "start": str(start), "end": end, "name": name, "kids": [], "attributes": [{"key": "code", "value": {"Value": {"IntValue": 1}}}, {"key": "code", "value": {"Value": {"IntValue": code}}}, {"no": "key"}]}


def document(spans, service="Users"):
    return {"resource_spans": [{"resource": {"attributes": [{"key": "service.name", "value": {"Value": {"StringValue": service}}}]}, "scope_spans": [{"scope": {"name": "Svc"}, "spans": spans}]}]}


def trace(name, way):
    base = 10**18
    return [span(name, "r", None, base, base + 100, "root"), span(name, "a", "r", base + 1, base + 5, "first"), span(name, "b", "r", base + 6, base + 9, way), span(name, "c", "r", base + 10, base + 20, "last")]


def test_extraction_rules(spark):
    fields = {n: FieldSpec.of(n, s) for n, s in {
        "header": {"key_paths": ["top.name"]}, "item": {"key_paths": ["rows.[].x"]}, "tag": {"key_paths": ["tags.[].t"]}, "either": {"key_paths": [["rows.[].no", "rows.[].flag", "top.name"]]},
        "joined": {"key_paths": ["top.name", "rows.[].x"]}, "all": {"key_paths": ["rows.[].more", "top.list"], "value_type": "array"},
    }.items()}
    docs = ['{"top": {"name": "h", "list": ["z"]}, "rows": [{"x": 1, "more": ["a", ["b"]]}, {"x": null, "flag": false}], "tags": [{"t": "p"}, {"t": "q"}]}', '{"top": {"name": "only"}}', '{"rows": []}', '{"top": {"name": "raw\x01", "name": "twice"}}', "{broken", "[]"]
    got = [tuple(r)[:6] for r in extract(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, value string"), fields, keep=("i",)).orderBy("i", "_place").collect()]
    assert got == [
        ("h", "1", "p", "h", "h_1", ["a", "b", "z"]), ("h", "1", "q", "h", "h_1", ["a", "b", "z"]), ("h", None, "p", "h", None, ["z"]), ("h", None, "q", "h", None, ["z"]),
        ("only", None, None, "only", None, None), ("twice", None, None, "twice", None, None), (None, None, None, None, None, None),
    ]


@pytest.mark.parametrize("spec", [{"key_paths": ["a"], "key_value": ["k"], "value_paths": ["v"]}, {"key_paths": ["a.[].b"], "key_value": ["k"]}, {"key_paths": ["a", "b"], "key_value": [None]}, {"key_paths": ["a"], "value_type": "int"}, {"key_paths": ["a"], "other": 1}, {}])
def test_wrong_specs(spec):
    with pytest.raises(ValueError):
        FieldSpec.of("x", spec)


def test_wrong_configs():
    good = {"ingest_data": {"data_source": "json", "data_holder": "sql"}, "data_sources": {"json": {"dirpath": "d", "field_mapping": MAPPING}}}
    assert Config.of(good).store is None
    for change in ({"ingest_data": {"data_source": "csv", "data_holder": "sql"}}, {"ingest_data": {"data_source": "json", "data_holder": "x"}}, {"data_sources": {"json": {"field_mapping": MAPPING}}}, {"data_sources": {"json": {"dirpath": "d", "filepath": "f", "field_mapping": MAPPING}}}, {"data_sources": {"json": {"dirpath": "d"}}}, {"extra": 1}):
        with pytest.raises(ValueError):
            Config.of(good | change)


@pytest.fixture
def project(tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    (src / "a.json").write_text(json.dumps(document(trace("t1", "left") + trace("t2", "right"))))
    (src / "b.json").write_text(json.dumps(document(trace("t3", "left") + [span("t4", "x", "gone", 1, 2, "lost")])) + "\n")
    (src / "c.json").write_text("{cut off")
    conf = tmp_path / "config.yaml"
    conf.write_text(yaml.safe_dump({"ingest_data": {"data_source": "json", "data_holder": "parquet"}, "data_holders": {"parquet": {"path": str(tmp_path / "store")}}, "data_sources": {"json": {"dirpath": str(tmp_path / "in"), "field_mapping": MAPPING}}}))
    return tmp_path, conf


def run(spark, *argv):
    return cli.run(spark, cli.parser().parse_args([str(a) for a in argv]))


def test_from_documents_to_diagrams_and_back(spark, project):
    tmp, conf = project
    run(spark, "-o", tmp / "d", "spans2puml", "-c", conf, "-om")
    text = (tmp / "d" / "Users_Svc.puml").read_text()
    want = [D.Act("first_200"), D.Block("XOR", [[D.Act("left_200")], [D.Act("right_200")]]), D.Act("last_200"), D.Act("root_200")]
    assert D.canonical(D.parse(text)) == D.canonical(want)
    assert run(spark, "-o", tmp / "p", "spans2pv", "-c", conf, "-ni", "-ug", "-se") == ["2 sequences"]
    out = sorted((tmp / "p" / "Users_Svc").iterdir())
    assert [p.name for p in out] == ["pv_event_sequence_1.json", "pv_event_sequence_2.json"]
    events = json.loads(out[0].read_text())
    assert [(e["eventType"], e["previousEventIds"]) for e in events] == [("first_200", []), ("left_200", ["t1-a"]), ("last_200", ["t1-b"]), ("root_200", ["t1-c"])]
    run(spark, "-o", tmp / "e", "pv2puml", "-fp", tmp / "p" / "Users_Svc", "-jn", "Users_Svc")
    assert D.equivalent((tmp / "e" / "Users_Svc.puml").read_text(), text)
    # one of the two sequences and the saved model give the same diagram
    run(spark, "-o", tmp / "f", "pv2puml", out[0], "-jn", "Users_Svc", "-im", tmp / "d" / "Users_Svc_model.json")
    assert D.equivalent((tmp / "f" / "Users_Svc.puml").read_text(), text)


def test_a_program_of_the_users_own(spark, project):
    tmp, conf = project
    given = yaml.safe_load(conf.read_text())
    query = """with spans as (select _file, _line, explode(from_json(value, 'struct<resource_spans:array<struct<scope_spans:array<struct<spans:array<struct<trace_id:string,span_id:string,parent:string,start:string,`end`:string,name:string>>>>>>>').resource_spans[0].scope_spans[0].spans) as s from documents)
      select 'w' as job_name, s.trace_id as job_id, s.span_id as event_id, s.parent as parent_event_id, s.name as event_type, s.start as start_timestamp, s.`end` as end_timestamp, 'a' as application_name, _file, _line from spans"""
    given["data_sources"]["json"] = {"dirpath": str(tmp / "in"), "sql_query": query}
    spans, rejected = files.read_spans(spark, Config.of(given).source)
    assert spans.count() == 13 and rejected.count() == 0 and {r.job_id for r in spans.select("job_id").distinct().collect()} == {"t1", "t2", "t3", "t4"}
    given["data_sources"]["json"]["sql_query"] = "select value from documents"
    with pytest.raises(ValueError, match="missing"):
        files.read_spans(spark, Config.of(given).source)


def test_store_keeps_the_order_of_arrival_and_is_idempotent(spark, project):
    from weftspan import pipeline

    tmp, conf = project
    # the same event again, in a later file but with an earlier start: the first to arrive stays the valid one
    again = trace("t1", "other")
    for s in again:
        s["start"] = str(int(s["start"]) - 50)
    (tmp / "in" / "z.json").write_text(json.dumps(document(again)))
    config = Config.of(yaml.safe_load(conf.read_text()))
    rows = [sorted(map(str, pipeline.traces_to_pv(spark, config, ingest).pv.collect())) for ingest in (True, False, True, False)]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == 12
    assert spark.read.parquet(config.store).count() == 13


def test_large_jobs_come_in_parts_and_names_are_numbered(spark, tmp_path):
    rows = [(f"j{i % 3}", f"e{i:03d}", f"2024-01-01T00:00:00.{i:06d}Z", [] if i < 3 else [f"e{i - 3:03d}"], "a", "hot", "T") for i in range(100)] + [("k", "x", "2024-01-01T00:00:00.000000Z", [], "a", "cold name", "T")]
    pv = spark.createDataFrame(rows, "jobId string, eventId string, timestamp string, previousEventIds array<string>, applicationName string, jobName string, eventType string").repartition(7)
    parts = files.sequence_documents(pv, part_events=10).orderBy("jobName", "n", "part_no").collect()
    assert [(r.jobName, r.jobId, r.n, r.part_no) for r in parts] == [("cold name", "k", 1, 0), *[("hot", f"j{j}", j + 1, k) for j in range(3) for k in range(4)]]
    got = [e["eventId"] for r in parts if r.jobId == "j1" for e in json.loads(r.document)]
    assert got == [r[1] for r in rows if r[0] == "j1"]
    assert files.save_sequences(pv, str(tmp_path / "s")) == 4
    text = (tmp_path / "s" / "hot" / "pv_event_sequence_2.json").read_text()
    events = json.loads(text)
    assert [e["eventId"] for e in events] == got and text == json.dumps(events, indent=4)
    assert len(list((tmp_path / "s" / "hot").iterdir())) == 3
    spans = files.pv_to_spans(pv, per_file=10).where("job_name = 'hot'").groupBy("file_no").count().collect()
    assert sorted((r.file_no, r["count"]) for r in spans) == [(i, 10) for i in range(10)]


def test_pv_files(spark, tmp_path):
    e = {"job": "j", "eventId": "e", "timestamp": "2024-01-01T00:00:00.059959Z", "applicationName": "a", "jobName": "n", "eventType": "T", "previousEventIds": "x"}
    (tmp_path / "one.json").write_text(json.dumps(e))
    keys = {k: k for k in ("jobId", "eventId", "timestamp", "previousEventIds", "applicationName", "jobName", "eventType")} | {"jobId": "job"}
    pv = files.read_pv(spark, [str(tmp_path / "one.json")], keys, single=True)
    row = pv.first()
    assert row.seq == "j" and row.previousEventIds == ["x"] and "job" in files.rename_pv(pv, keys).columns
    assert files.pv_to_spans(pv).first().start_time_unix_nano == 1704067200059959000
    for bad, single in (("[1", False), (json.dumps(e), False), (json.dumps([{"job": "j"}]), False), (json.dumps([e]), True)):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            files.read_pv(spark, [str(tmp_path / "bad.json")], keys, single)
    with pytest.raises(FileNotFoundError):
        files.read_models(spark, str(tmp_path / "no.json"))
    with pytest.raises(ValueError):
        files.read_documents(spark, str(tmp_path / "nowhere"))


def test_command_errors(spark, capsys):
    assert cli.main(["pv2puml"]) == 1 and "either" in capsys.readouterr().err


def test_simulated_diagram_comes_back(spark, tmp_path):
    from weftspan.mining.gates import infer, multiset
    from weftspan.mining.simulate import diagram_to_span_files, dot, simulate
    from weftspan.operators import event_sets as es
    from weftspan.plans.mining import diagrams_of, logic_gates

    items = [D.Act("A"), D.Block("XOR", [[D.Act("B")], [D.Act("C"), D.Loop([D.Act("E")])]]), D.Block("AND", [[D.Act("F")], [D.Act("G")]]), D.Act("H")]
    text = D.write(items, "w")
    pv = simulate(spark, text, "w", copies=2)
    assert pv.select("jobId").distinct().count() == 6
    drawn, rows = diagrams_of(es.sequences_of(pv))
    assert D.equivalent(drawn.first().puml, text)
    assert {(r.event_type, r.gate) for r in logic_gates(rows).where("direction = 'out'").collect()} >= {("A", "XOR(B,C)"), ("F", "H")}
    (tmp_path / "d.puml").write_text(text)
    assert diagram_to_span_files(spark, str(tmp_path / "d.puml"), str(tmp_path / "s"), "w", 5) == spark.read.json(str(tmp_path / "s")).count() > 10
    assert dot(infer({multiset("AB")})).count("->") == 2


def test_workflows_without_a_diagram_are_named(spark, tmp_path, monkeypatch, capsys):
    def diagrams_of(seqs, known=None):
        rows = [("fine", "@startuml\n@enduml", None), ("deep", None, "RecursionError: too deep"), (None, None, "ValueError: odd")]
        return spark.createDataFrame(rows, "job_name string, puml string, error string"), None

    e = {"jobId": "j", "eventId": "e", "timestamp": "2024-01-01T00:00:00.000000Z", "applicationName": "a", "jobName": "n", "eventType": "T"}
    (tmp_path / "one.json").write_text(json.dumps([e]))
    argv = ["-o", str(tmp_path / "o"), "pv2puml", str(tmp_path / "one.json")]
    assert cli.main(argv) == 0 and capsys.readouterr().err == ""
    monkeypatch.setattr("weftspan.pipeline.diagrams_of", diagrams_of)
    assert cli.main(argv) == 1
    said = capsys.readouterr()
    assert said.out.split() == [str(tmp_path / "o" / "fine.puml")]
    assert said.err.splitlines() == ["pv2puml: no diagram of unnamed: ValueError: odd", "pv2puml: no diagram of deep: RecursionError: too deep"]


def test_rejected_records_are_counted(spark, project, capsys):
    tmp, conf = project
    bad = [span("t9", "r", None, 1, 2, "root"), span("t9", "a", "r", 1, 2, "first")]
    for b in bad:
        del b["end"]
    (tmp / "in" / "d.json").write_text(json.dumps(document(bad)))
    run(spark, "-o", tmp / "p", "spans2pv", "-c", conf)
    assert "spans2pv: 2 records rejected: without end_timestamp" in capsys.readouterr().err.splitlines()
