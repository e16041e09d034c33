"""The same operators over streams: first-wins dedupe, per-workflow counts, and traces emitted once they are idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftspan.operators import event_sets as es
from weftspan.operators.cleaning import valid_records
from weftspan.operators.event_sets import merge_models
from weftspan.operators.sequence import sequence
from weftspan.runtime import cut, join_small

_SPAN = ("job_name", "event_type", "event_id", "start_timestamp", "end_timestamp", "application_name", "parent_event_id")
_TRACE = "job_id string, opened bigint, part int, n_spans int, complete boolean, closed boolean, spans array<struct<job_name:string,event_type:string,event_id:string,start_timestamp:bigint,end_timestamp:bigint,application_name:string,parent_event_id:string>>"
_STATE = "first array<string>, last timestamp, opened bigint, parts int"


def dedupe_stream(nodes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Valid spans, each event once: the first that the stream hands over; state is dropped behind the watermark of ``ingested_at``."""
    rows = valid_records(nodes.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")))
    return rows.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def span_counts(nodes: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(job_name, from, n_spans) per window of arrival; rows later than the watermark are left out."""
    rows = dedupe_stream(nodes, lateness)
    out = rows.groupBy("job_name", F.window("ingested_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n_spans"))
    return out.select("job_name", F.col("w.start").alias("from"), "n_spans")


def _close(idle_ms: int, most: int):
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, opened, parts = state.get if state.exists else ([], None, None, 0)
        held, last = list(held), last and pd.Timestamp(last)
        if state.hasTimedOut:
            state.remove()
            yield _trace(key[0], opened, parts, held, True)
            return
        for rows in chunks:
            held += rows["span"].tolist()
            newest = rows["ingested_at"].max()
            last = newest if last is None else max(last, newest)
            opened = int(rows["at"].min()) if opened is None else opened
            if len(held) >= most:  # a trace too large to hold goes on in parts
                yield _trace(key[0], opened, parts, held, False)
                held, parts = [], parts + 1
        state.update((held, last.to_pydatetime(), opened, parts))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))

    return run


def _trace(job: str, opened: int, part: int, held: list[str], closed: bool) -> pd.DataFrame:
    import json

    spans = [{c: s.get(c) for c in _SPAN} for s in map(json.loads, held)]
    return pd.DataFrame({"job_id": [job], "opened": [opened], "part": [part], "n_spans": [len(spans)], "complete": [closed and not part], "closed": [closed], "spans": [spans]})


def idle_traces(nodes: DataFrame, idle: str = "10 minutes", lateness: str = "10 minutes", most: int = 100_000) -> DataFrame:
    """Each job's spans in one row once none has arrived for ``idle`` of event time.

    State holds the open traces alone. A job of ``most`` spans or more is emitted in numbered parts, so no state or row
    grows without bound. None of them is ``complete``; the last, which may be empty, is ``closed``, and the trace is all
    parts of its (job_id, opened). Spans after a trace was closed begin a new one.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = dedupe_stream(nodes, lateness).select("job_id", "ingested_at", F.unix_micros("ingested_at").alias("at"), F.to_json(F.struct(*_SPAN)).alias("span"))
    return rows.groupBy("job_id").applyInPandasWithState(_close(idle_ms, most), _TRACE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def spans_of_traces(traces: DataFrame) -> DataFrame:
    return traces.select("job_id", F.explode("spans").alias("s")).select("job_id", *[F.col(f"s.{c}").alias(c) for c in _SPAN])


def _closed_spans(batch: DataFrame, number: int, path: str) -> DataFrame:
    """Spans of the traces that the batch closes; parts are kept as a table below ``path`` until their trace is closed and read from there."""
    whole = spans_of_traces(batch.where("complete"))
    parts = batch.where("not complete")
    if parts.isEmpty():
        return whole
    parts.write.mode("overwrite").parquet(f"{path}/batch={number}")
    ended = cut(parts.where("closed").select("job_id", "opened"))
    if ended.isEmpty():
        return whole
    kept = batch.sparkSession.read.parquet(path).where(F.col("batch") <= number).drop("batch")
    return whole.unionByName(spans_of_traces(join_small(kept, ended, ["job_id", "opened"], "left_semi")))


def grow_model(traces: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep a model up to date from a stream of traces.

    Each batch's rows are written below ``path`` under the batch's number; a repeated batch overwrites its own, and the
    model is the distinct union of all, so nothing counts twice. :func:`read_grown` gives the model. Traces that come in
    parts are sequenced as a whole once they are closed; the parts lie in ``path`` with ``.parts`` at its end and are not removed.
    """

    def add(batch: DataFrame, number: int) -> None:
        spans = cut(_closed_spans(cut(batch), number, f"{path.rstrip('/')}.parts"))
        rows = es.model_rows(cut(es.sequences_of(sequence(spans))), dummy_start=True)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(rows)

    return traces.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add).start()


def read_grown(spark, path: str) -> DataFrame:
    return merge_models(spark.read.parquet(path).drop("batch"))
