"""Queries of JSON extraction and of the PV record forms over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.config import FIELDS, FieldSpec
from weftspan.operators import sequence as seq
from weftspan.plans.trace_queries import SPANS, _clean, _spans
from weftspan.runtime import cut, table
from weftspan.sources import files
from weftspan.sources.extract import as_spans, extract

SPAN = "resource_spans.[].scope_spans.[].spans.[]."
ATTRIBUTE = SPAN + "attributes.[].key"
MAPPING = {
    "job_name": {"key_paths": ["resource_spans.[].resource.attributes.[].key"], "key_value": ["service.name"], "value_paths": ["value.Value.StringValue"]},
    "job_id": {"key_paths": [SPAN + "trace_id"]}, "event_id": {"key_paths": [SPAN + "span_id"]}, "parent_event_id": {"key_paths": [SPAN + "parent_span_id"]},
    "event_type": {"key_paths": [[ATTRIBUTE, SPAN + "name"]], "key_value": [["op.name", None]], "value_paths": [["value.Value.StringValue", None]]},
    "start_timestamp": {"key_paths": [SPAN + "start_time_unix_nano"]}, "end_timestamp": {"key_paths": [SPAN + "end_time_unix_nano"]},
    "application_name": {"key_paths": [ATTRIBUTE, "resource_spans.[].scope_spans.[].scope.name"], "key_value": ["app", None], "value_paths": ["value.Value.StringValue", None]},
}


def _attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(F.struct(value.alias("StringValue")).alias("Value")).alias("value"))


def _documents(spans: DataFrame) -> DataFrame:
    """Each span as a document of its own; of two attributes ``app`` the last holds."""
    span = F.struct(
        F.col("job_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("parent_event_id").alias("parent_span_id"), F.col("event_type").alias("name"), F.col("start_timestamp").cast("string").alias("start_time_unix_nano"), F.col("end_timestamp").alias("end_time_unix_nano"),
        F.array(_attribute("app", F.lit("superseded")), _attribute("op.name", F.when(F.col("event_type").startswith("p"), F.upper("event_type"))), _attribute("app", F.col("application_name"))).alias("attributes"),
    )
    scope = F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(span).alias("spans"))
    resource = F.struct(F.struct(F.array(_attribute("service.name", F.col("job_name"))).alias("attributes")).alias("resource"), F.array(scope).alias("scope_spans"))
    return spans.select(F.to_json(F.struct(F.array(resource).alias("resource_spans"))).alias("value"))


def json_extract_spans(spark: SparkSession, base: str) -> DataFrame:
    fields = {n: FieldSpec.of(n, s) for n, s in MAPPING.items()}
    return as_spans(extract(_documents(_spans(spark, base)), fields))[0].select(*FIELDS)


def json_flat_values(spark: SparkSession, base: str) -> DataFrame:
    """The one value of each event's properties."""
    fields = {"k": FieldSpec.of("k", {"key_paths": [["missing", "k"]]})}
    rows = extract(table(spark, base, "events").select("event_id", "props"), fields, "props", ("event_id",))
    return rows.select("event_id", "k")


def json_sibling_arrays(spark: SparkSession, base: str) -> DataFrame:
    """Arrays beside each other multiply; a missing one gives one row, an empty one none."""
    orders = table(spark, base, "orders")
    doc = F.struct(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.transform(F.sequence(F.lit(1), F.pmod("o_orderkey", F.lit(3)).cast("int")), lambda i: F.struct(i.alias("x")))).alias("a"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<struct<y:string>>")).otherwise(F.array(F.struct(F.col("o_orderstatus").alias("y")), F.struct(F.col("o_orderpriority").alias("y")))).alias("b"),
    )
    fields = {n: FieldSpec.of(n, {"key_paths": [p]}) for n, p in (("key", "key"), ("x", "a.[].x"), ("y", "b.[].y"))}
    return extract(orders.select(F.to_json(doc).alias("value")), fields).select("key", "x", "y")


def json_array_values(spark: SparkSession, base: str) -> DataFrame:
    """Lists joined: previous ids and the event's own id; null where all is null."""
    doc = F.to_json(F.struct("pv_id", F.struct(F.col("previous_event_ids").alias("list")).alias("p"), F.array("event_id").alias("own")))
    fields = {"pv_id": FieldSpec.of("pv_id", {"key_paths": ["pv_id"]}), "ids": FieldSpec.of("ids", {"key_paths": ["p.list", "own"], "value_type": "array"})}
    return extract(table(spark, base, "pv_events").select(doc.alias("value")), fields).select(F.col("pv_id").cast("bigint").alias("pv_id"), F.array_join("ids", ",").alias("ids"))


def json_records(spark: SparkSession, base: str) -> DataFrame:
    """Spans of all raw records whose mapping has arrays throughout, by columns alone; ids and types."""
    rows = table(spark, base, "field_mappings").where("field_name in ('event_id', 'event_type')").orderBy("mapping_id", "part_no", "fallback_rank").collect()  # a fixed, small table
    # one pass lays the records out by mapping, so that each mapping's columns read only its own
    docs, out = cut(table(spark, base, "otel_records").select("raw_id", "payload", "mapping_id"), "mapping_id"), None
    for m in sorted({r.mapping_id for r in rows}):
        fields = {}
        for name in ("event_id", "event_type"):
            parts: dict = {}
            for r in rows:
                if (r.mapping_id, r.field_name) == (m, name):
                    parts.setdefault(r.part_no, []).append((r.key_path, r.key_value, r.value_path))
            fields[name] = FieldSpec([parts[p] for p in sorted(parts)])
        got = extract(docs.where(F.col("mapping_id") == m).select("raw_id", "payload"), fields, "payload", ("raw_id",)).select("raw_id", "event_id", "event_type")
        out = got if out is None else out.unionAll(got)
    return out.where("event_id is not null")


def _pv(spark: SparkSession, base: str) -> DataFrame:
    return cut(seq.sequence(_clean(spark, base)))


def pv_to_span(spark: SparkSession, base: str) -> DataFrame:
    return files.pv_to_spans(_pv(spark, base)).select("span_id", "parent_span_id", "start_time_unix_nano", "file_no")


def pv_mapping_rename(spark: SparkSession, base: str) -> DataFrame:
    keys = {"jobId": "job", "eventId": "event", "timestamp": "at", "previousEventIds": "before", "applicationName": "app", "jobName": "name", "eventType": "kind"}
    return files.rename_pv(_pv(spark, base).withColumn("previousEventIds", F.array_join("previousEventIds", ",")), keys)


def sequence_documents(spark: SparkSession, base: str) -> DataFrame:
    """Each job's events as JSON arrays, numbered within the workflow."""
    return files.sequence_documents(_pv(spark, base))


QUERIES = {f.__name__: f for f in (json_extract_spans, json_flat_values, json_sibling_arrays, json_array_values, json_records, pv_to_span, pv_mapping_rename, sequence_documents)}


def _from_pv(tail: str) -> str:
    from weftspan.plans.trace_queries import _seq

    return _seq(False, False, tail)


_STAMP = "make_timestamp(cast(floor(end_timestamp::double / 1e9) as bigint) * 1000000 + cast(round_even((end_timestamp::double / 1e9 - floor(end_timestamp::double / 1e9)) * 1e6, 0) as bigint))"
ORACLES = {
    "json_extract_spans": f"with {SPANS} select job_name, job_id, case when event_type like 'p%' then upper(event_type) else event_type end as event_type, event_id, start_timestamp, end_timestamp, application_name || '_s' as application_name, parent_event_id from spans",
    "json_flat_values": "select event_id, json_extract_string(props, '$.k') as k from events",
    "json_sibling_arrays": """with o as (select *, case when o_orderkey % 3 <> 0 then range(1, o_orderkey % 3 + 1) else [null] end as a, case when o_orderkey % 5 = 0 then [] else [o_orderstatus, o_orderpriority] end as b from orders),
x as (select o_orderkey, b, unnest(a) as x from o) select o_orderkey::varchar as key, x::varchar as x, unnest(b) as y from x""",
    "json_array_values": "select pv_id, array_to_string(list_filter(coalesce(previous_event_ids, []) || [event_id], lambda x: x is not null), ',') as ids from pv_events",
    "pv_to_span": _from_pv(f"""select d.event_id as span_id, nullif(split_part(prev_ids, ',', 1), '') as parent_span_id, epoch_us({_STAMP}) * 1000 as start_time_unix_nano,
  cast((row_number() over (partition by job_name order by t.job_id, {_STAMP}, d.event_id) - 1) // 50 as int) as file_no from done d join trees t on t.job_id = d.job_id and t.event_id = d.event_id"""),
    "sequence_documents": _from_pv(f"""select "jobName", "jobId", n, part_no, '[' || string_agg(j, ',' order by ts, event_id) || ']' as document from (
  select job_name as "jobName", t.job_id as "jobId", t.event_id, {_STAMP} as ts, dense_rank() over (partition by job_name order by t.job_id) as n,
    (row_number() over (partition by job_name, t.job_id order by {_STAMP}, t.event_id) - 1) // 10000 as part_no,
    to_json({{'jobId': t.job_id, 'eventId': t.event_id, 'timestamp': strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S.%fZ'), 'previousEventIds': case when prev_ids = '' then []::varchar[] else string_split(prev_ids, ',') end,
      'applicationName': application_name, 'jobName': job_name, 'eventType': event_type}})::varchar as j
  from done d join trees t on t.job_id = d.job_id and t.event_id = d.event_id) group by all"""),
    "pv_mapping_rename": _from_pv(f"""select t.job_id as job, t.event_id as event, strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S.%fZ') as "at", prev_ids as before, application_name as app, job_name as name, event_type as kind from done d join trees t on t.job_id = d.job_id and t.event_id = d.event_id"""),
}
