from __future__ import annotations

import json

import duckdb
import pytest
from paths import MIDDLE

from weftspan.operators import nested
from weftspan.operators.nested import as_text, flat_tables, map_records, read_json, value_text
from weftspan.plans.problem_queries import SPANS, p5_attributes, p5_found, p5_rows, p5_spans

MAPPING = "mapping_id int, field_name string, part_no int, fallback_rank int, key_path string, key_value string, value_path string, value_type string"


def elements(v):
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def at(v, path):
    for name in path:
        v = v.get(name) if isinstance(v, dict) else None
    return v


def follow(res, scope, span, key_path, key, value_path):
    """The value of one way, read straight off the document."""
    names = [n for n in key_path.split(".") if n != "[]"][1:]
    here, rest = (span, names[2:]) if names[:2] == ["scope_spans", "spans"] else (scope, names[1:]) if names[0] == "scope_spans" else (res, names)
    if key is None:
        return at(here, rest)
    i = len(rest) - 1 - next(j for j, n in enumerate(reversed(key_path.split("."))) if n == "[]") + 1
    hits = [e for e in elements(at(here, rest[:i])) if at(e, rest[i:]) == key]
    return at(hits[-1], value_path.split(".")) if hits else None


def brute(base, field):
    ways: dict = {}
    for m, name, part, rank, kp, kv, vp, _ in duckdb.sql(f"select * from '{base}/field_mappings.parquet' order by 1, 2, 3, 4").fetchall():
        ways.setdefault((m, name), {}).setdefault(part, []).append((kp, kv, vp))
    for rid, m, text in duckdb.sql(f"select raw_id, mapping_id, payload from '{base}/otel_records.parquet'").fetchall():
        try:
            doc = json.loads(text, strict=False)
        except (TypeError, ValueError):
            continue
        for i, res in enumerate(elements(doc.get("resource_spans") if isinstance(doc, dict) else None)):
            for j, scope in enumerate(elements(res.get("scope_spans"))):
                for k, span in enumerate(elements(scope.get("spans"))):
                    parts = [next((v for w in p if (v := follow(res, scope, span, *w)) is not None), None) for p in ways.get((m, field), {}).values()]
                    yield rid, i, j, k, span.get("span_id"), None if None in parts or not parts else "_".join(p if isinstance(p, str) else json.dumps(p) for p in parts)


def test_found_against_brute_force(spark):
    want = sorted(r for r in brute(MIDDLE, "event_type") if r[-1] is not None)
    assert len(want) > 2000 and sorted(tuple(r) for r in p5_found(spark, MIDDLE).collect()) == want


@pytest.mark.parametrize("field", ["job_name", "application_name", "parent_event_id", "start_timestamp"])
def test_other_fields_against_brute_force(spark, field):
    got = sorted((tuple(r) for r in p5_spans(spark, MIDDLE).select("raw_id", "resource_no", "scope_no", "span_no", "event_id", field).collect()), key=str)
    assert got == sorted(brute(MIDDLE, field), key=str)


P = "resource_spans.[].scope_spans.[].spans.[]."
ROWS = [
    (1, "event_type", 0, 0, P + "attributes.[].key", "k", "value.s", "string"), (1, "event_type", 0, 1, P + "name", None, None, "string"), (1, "event_type", 1, 0, "resource_spans.[].zone", None, None, "string"),
    (1, "kids", 0, 0, P + "kids", None, None, "array"), (1, "kids", 1, 0, P + "more", None, None, "array"),
]


def spans(*span, **res):
    return json.dumps({"resource_spans": [{**res, "scope_spans": {"spans": list(span)}}]})


def test_mapping_rules(spark):
    mappings = spark.createDataFrame(ROWS, MAPPING)
    docs = [
        spans({"name": "n", "attributes": [{"key": "k", "value": {"s": 1}}, {"key": "k", "value": {"s": 2.50}}]}, zone="z"),
        spans({"name": "n", "attributes": [{"key": "k", "value": {"other": 1}}, "x", None, 3, {"key": {"key": "k"}}]}, zone=True),
        spans({"name": "n", "kids": ["a", 1], "more": None}, {"name": None}, {"kids": []}, zone={"a": [1, "é"]}),
        spans({"name": "n"}), None, "", "[1]", '{"resource_spans": [', '{"a": NaN}', '{"resource_spans": [{"zone": "a\x01\tb", "zone": "w", "scope_spans": [{"spans": {"name": "\\ud800x"}}]}]}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000,
    ]
    df = spark.createDataFrame([(i, 1, d, "x") for i, d in enumerate(docs)] + [(90, None, docs[0], "x"), (91, 7, docs[0], "x")], "raw_id bigint, mapping_id int, payload string, label string")
    got = [(r.record, list(r.label), r.event_type, r.kids) for r in map_records(df, mappings, SPANS, ["event_type", "kids"]).orderBy("record", "label").collect()]
    assert got == [
        (0, [0, 0, 0], "2.5_z", None), (1, [0, 0, 0], "n_true", None), (2, [0, 0, 0], 'n_{"a":[1,"é"]}', ["a", "1"]), (2, [0, 0, 1], None, None), (2, [0, 0, 2], None, []),
        (3, [0, 0, 0], None, None), (9, [0, 0, 0], "�x_w", None),
    ]


def test_flat_tables(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1.0}, "rows": [{"x": "p", "sub": [{"y": null}, {"y": false}]}, {"x": "q"}, 5]}', 0), (2, None, 0), (3, "{", 0), (4, "{}", 0)], "raw_id bigint, payload string, columns int")
    got = {(r.record, r.table, r.label, r.parent_label, tuple(sorted(r.columns.items())), r.reason) for r in flat_tables(df, set()).collect()}
    assert got == {
        (1, "", "", None, (("a.b", "1.0"),), None), (1, "rows", "0", "", (("x", "p"),), None), (1, "rows", "1", "", (("x", "q"),), None), (1, "rows", "2", "", (("", "5"),), None),
        (1, "rows.sub", "0.0", "0", (("y", None),), None), (1, "rows.sub", "0.1", "0", (("y", "false"),), None), (2, None, "", None, (), "null"), (3, None, "", None, (), "unreadable"), (4, "", "", None, (), None),
    }


def test_empty_and_scalars(spark):
    df = spark.createDataFrame([], "raw_id bigint, mapping_id int, payload string")
    assert map_records(df, spark.createDataFrame([], MAPPING), SPANS, ["event_type"]).count() == 0
    assert as_text(read_json('{"a": 1e5}')[0]["a"]) == "1e5" and as_text(12345678901234567890) == "12345678901234567890"


def documents(base):
    for rid, text in duckdb.sql(f"select raw_id, payload from '{base}/otel_records.parquet'").fetchall():
        try:
            doc = json.loads(text, strict=False)
        except (TypeError, ValueError):
            continue
        yield rid, doc.get("resource_spans") if isinstance(doc, dict) else None


def dotted(*label):
    return ".".join(map(str, label))


def test_every_attribute_has_its_value(spark):
    def plain(v):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    want = []
    for rid, resources in documents(MIDDLE):
        for i, res in enumerate(elements(resources)):
            for j, scope in enumerate(elements(res.get("scope_spans"))):
                for k, span in enumerate(elements(scope.get("spans"))):
                    for n, a in enumerate(elements(span.get("attributes"))):
                        key = a.get("key")
                        (inner,) = a["value"]["Value"].values()
                        want.append((rid, dotted(i, j, k, n), dotted(i, j, k), key["kind_key"] if isinstance(key, dict) else key, plain(a["value"] if isinstance(inner, dict) else inner)))
    got = [tuple(r) for r in p5_attributes(spark, MIDDLE).collect()]
    assert any("ArrayValue" in r[-1] for r in want) and sorted(got, key=str) == sorted(want, key=str)


def test_all_flat_tables_with_links(spark):
    rows = p5_rows(spark, MIDDLE).collect()
    at = {(r.raw_id, r.table_path, r.label) for r in rows if r.reason is None}
    assert len(at) == sum(r.reason is None for r in rows) and all((r.raw_id, r.parent_table, r.parent_label) in at for r in rows if r.table_path)
    want = set()
    for rid, resources in documents(MIDDLE):
        for i, res in enumerate(elements(resources)):
            want.add((rid, "resource_spans", dotted(i), "", ""))
            want |= {(rid, "resource_spans.resource.attributes", dotted(i, n), "resource_spans", dotted(i)) for n, _ in enumerate(elements((res.get("resource") or {}).get("attributes")))}
            for j, scope in enumerate(elements(res.get("scope_spans"))):
                want.add((rid, "resource_spans.scope_spans", dotted(i, j), "resource_spans", dotted(i)))
                for k, span in enumerate(elements(scope.get("spans"))):
                    want.add((rid, SPANS, dotted(i, j, k), "resource_spans.scope_spans", dotted(i, j)))
                    for n, a in enumerate(elements(span.get("attributes"))):
                        want.add((rid, f"{SPANS}.attributes", dotted(i, j, k, n), SPANS, dotted(i, j, k)))
                        values = a["value"]["Value"].get("ArrayValue", {}).get("values", [])
                        want |= {(rid, f"{SPANS}.attributes.value.Value.ArrayValue.values", dotted(i, j, k, n, m), f"{SPANS}.attributes", dotted(i, j, k, n)) for m, _ in enumerate(values)}
    tables = {w[1] for w in want}
    assert len(tables) == 6 and {(r.raw_id, r.table_path, r.label, r.parent_table, r.parent_label) for r in rows if r.table_path in tables} == want


def test_value_text():
    read = lambda text: value_text(read_json('{"v": %s}' % text)[0]["v"])
    assert [read(x) for x in ('"s"', '{"Value": {"BoolValue": false}}', '{"d": 1.50}', '{"a": null, "b": 5}', '{"Value": {"StringValue": null}}', "null")] == ["s", "false", "1.50", "5", None, None]
    assert [read(x) for x in ('{"Value": {"ArrayValue": {"values": [1, "é"]}}}', '{"a": 1, "b": {"c": 2.0}}', "[]", '{"Value": {}}', "{}")] == ['{"Value":{"ArrayValue":{"values":[1,"é"]}}}', '{"a":1,"b":{"c":2.0}}', "[]", '{"Value":{}}', "{}"]


@pytest.mark.parametrize("depth", [900, 3000, 40_000])
def test_deep_documents(spark, depth):
    deep = '{"a":[' * depth + "1.50" + "]}" * depth
    doc = '{"other":%s,"resource_spans":[{"zone":%s,"scope_spans":{"spans":[{"name":"n","kids":[%s]}]}}]}' % (deep, deep, deep)
    df = spark.createDataFrame([(1, 1, doc), (2, 1, doc[:-2]), (3, 1, doc + "]"), (4, 1, doc.replace("1.50", "NaN", 1))], "raw_id bigint, mapping_id int, payload string")
    got = map_records(df, spark.createDataFrame(ROWS, MAPPING), SPANS, ["event_type", "kids"]).collect()
    assert [(r.record, list(r.label), r.event_type, r.kids) for r in got] == [(1, [0, 0, 0], f"n_{deep}", [deep])]


def test_deep_flat_tables(spark):
    df = spark.createDataFrame([(1, '{"rows":' + '[{"x":1,"in":' * 1200 + "null" + "}]" * 1200 + "}"), (2, '{"a":' * 1200 + '[{"x":2}]' + "}" * 1200)], "raw_id bigint, payload string")
    rows = flat_tables(df, set()).collect()
    assert not any(r.reason for r in rows) and sum(r.columns.get("x") == "1" for r in rows) == 1200 and sum(r.columns.get("x") == "2" for r in rows) == 1


def test_the_decoder_for_deep_documents_reads_as_the_other():
    good = ['{}', ' [ ] ', '[1, -2.50, 1e5, "a\\n\x01\\ud800", true, false, null, {"a": {}, "b": [[], {"a": 1, "a": 2}]}]', '{"a" : "x" , "" : [ 1 ]}', '"s"', " 12 ", "[[1],[2,[3]]]"]
    for text in good:
        assert nested._decode_deep(text) == nested._decoder.decode(text)
    for text in ["", " ", "[", "[1", "[1,", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1}", '{"a":1]', "[1] 2", "[NaN]", "[1 2]", "]", '["a', "[-]", "nul", '{"a":1 "b":2}']:
        with pytest.raises(ValueError):
            nested._decoder.decode(text)
        with pytest.raises(ValueError):
            nested._decode_deep(text)
