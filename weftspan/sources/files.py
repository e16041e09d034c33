"""Files in and out: span documents, PV event files, models, diagrams."""

from __future__ import annotations

import json
import os
import textwrap
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.config import FIELDS, PV_KEYS, JsonSource
from weftspan.operators import event_sets as es
from weftspan.operators.heavy_keys import row_numbers
from weftspan.runtime import join_spread
from weftspan.schemas import MODEL
from weftspan.sources.extract import as_spans, extract


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(value, _file, _line): one row per file, or per line, of a file or of all files below a folder."""
    if not _exists(spark, path):
        raise ValueError(f"{path} does not exist")
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not per_line)
    return rows.select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")).where("trim(value) != ''")


def read_spans(spark: SparkSession, source: JsonSource) -> tuple[DataFrame, DataFrame]:
    """Spans with their provenance (_file, _line, _place), and rejected records."""
    if source.jq_query:
        raise ValueError("a jq program cannot be planned by Spark; give a field_mapping, or a sql_query")
    docs = read_documents(spark, source.dirpath or source.filepath, source.json_per_line)
    if source.sql_query:
        return as_spans(by_query(docs, source.sql_query))
    return as_spans(extract(docs, source.field_mapping, keep=("_file", "_line")))


def by_query(docs: DataFrame, query: str) -> DataFrame:
    """Span rows by a program of the user's own: a SQL query over ``documents`` (value, _file, _line).

    It gives the span fields, and may keep ``_file`` and ``_line``; ValueError if it lacks a field.
    """
    docs.createOrReplaceTempView("documents")
    rows = docs.sparkSession.sql(query)
    if lacking := set(FIELDS) - set(rows.columns):
        raise ValueError(f"sql_query: missing {sorted(lacking)}")
    typed = rows.withColumns({c: F.col(c).cast("string") for c in FIELDS})
    order = {"_file": F.lit("").cast("string"), "_line": F.monotonically_increasing_id(), "_place": F.array().cast("array<int>")}
    return typed.withColumns({c: v for c, v in order.items() if c not in rows.columns})


def read_pv(spark: SparkSession, paths: str | list[str], mapping: dict[str, str] | None = None, single: bool = False) -> DataFrame:
    """PV events of files, with ``seq``: the file, or the job with ``single`` (files of one event each).

    ValueError if a file is no list of objects (no object with ``single``), or an event lacks a mandatory key.
    """
    keys = mapping or {k: k for k in PV_KEYS}
    text = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    whole = F.from_json("value", "map<string,string>" if single else "array<string>")
    wrong = text.where((F.substring(F.ltrim("value"), 1, 1) != ("{" if single else "[")) | whole.isNull()).first()
    if wrong:
        raise ValueError(f"{wrong._file} holds no {'PV event' if single else 'list of PV events'}")
    shape = f"struct<{','.join(f'`{keys[k]}`:string' for k in PV_KEYS)}>"
    rows = text.select("_file", F.from_json("value", shape).alias("e")) if single else text.select("_file", F.posexplode(F.from_json("value", f"array<{shape}>")).alias("_n", "e"))
    out = rows.select("_file", *[F.col(f"e.`{keys[k]}`").alias(k) for k in PV_KEYS])
    needed = [k for k in PV_KEYS if k != "previousEventIds"]
    bad = out.where(" or ".join(f"`{k}` is null" for k in needed)).first()
    if bad:
        raise ValueError(f"{bad._file}: an event lacks {[keys[k] for k in needed if bad[k] is None]}")
    ids = F.when(F.ltrim("previousEventIds").startswith("["), F.from_json("previousEventIds", "array<string>")).when(F.col("previousEventIds").isNotNull(), F.array("previousEventIds"))
    return out.withColumn("previousEventIds", F.coalesce(ids, F.array().cast("array<string>"))).withColumn("seq", F.col("jobId") if single else F.col("_file"))


def rename_pv(pv: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return pv.select(*[F.col(k).alias(mapping[k]) for k in PV_KEYS])


def _sequence_lines(pv: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """(jobName, jobId, n, at, text): each event as JSON, at its place in its job; n counts the jobs of a name from 1.

    Names and jobs of any size are numbered over range partitions.
    """
    keys = mapping or {k: k for k in PV_KEYS}
    rows = pv.select("jobName", "jobId", "timestamp", "eventId", F.to_json(F.struct(*[F.col(k).alias(keys[k]) for k in PV_KEYS])).alias("text"))
    lines = row_numbers(rows, ["jobName", "jobId"], ["timestamp", "eventId", "text"], "at").select("jobName", "jobId", "at", "text")
    jobs = row_numbers(pv.select("jobName", "jobId").distinct(), ["jobName"], ["jobId"], "n")
    jobs = jobs.select(F.to_json(F.array("jobName", "jobId")).alias("_job"), (F.col("n") + 1).alias("n"))
    return join_spread(lines.withColumn("_job", F.to_json(F.array("jobName", "jobId"))), jobs, ["_job"], "inner").select("jobName", "jobId", "n", "at", "text")


def sequence_documents(pv: DataFrame, mapping: dict[str, str] | None = None, part_events: int = 10_000) -> DataFrame:
    """(jobName, jobId, n, part_no, document): each job's events in order, as JSON arrays of at most ``part_events``."""
    parts = _sequence_lines(pv, mapping).withColumn("part_no", F.floor(F.col("at") / F.lit(part_events)).cast("bigint"))
    docs = parts.groupBy("jobName", "jobId", "n", "part_no").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("e"))
    return docs.select("jobName", "jobId", "n", "part_no", F.concat(F.lit("["), F.array_join("e.text", ","), F.lit("]")).alias("document"))


def _write_sequences(folder: str):
    """Rows come sorted by job and place; each file is written under another name first, so that a task run again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, to, out, n = None, None, None, 0

        def close() -> None:
            if out:
                out.write("\n]")
                out.close()
                os.replace(out.name, to)

        for b in batches:
            for name, no, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (name, no) != job:
                    close()
                    job, n = (name, no), n + 1
                    to = Path(folder) / (name or "unnamed") / f"pv_event_sequence_{no}.json"
                    to.parent.mkdir(parents=True, exist_ok=True)
                    out = open(f"{to}.{uuid.uuid4().hex}", "w")  # noqa: SIM115
                    out.write("[\n")
                else:
                    out.write(",\n")
                out.write(textwrap.indent(json.dumps(json.loads(text), indent=4), "    "))
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return run


def save_sequences(pv: DataFrame, folder: str, mapping: dict[str, str] | None = None) -> int:
    """``folder/<job name>/pv_event_sequence_<n>.json``, one file per job; returns their number.

    The tasks write, each the files of its jobs and an event at a time, to a folder that all executors share.
    """
    placed = _sequence_lines(pv, mapping).repartition("jobName", "n").sortWithinPartitions("jobName", "n", "at")
    written = placed.select("jobName", "n", "text").mapInArrow(_write_sequences(str(Path(folder).absolute())), "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_models(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of saved models; FileNotFoundError for a path without a file."""
    for p in [paths] if isinstance(paths, str) else paths:
        if not _exists(spark, p):
            raise FileNotFoundError(p)
    return es.rows_of_models(spark.read.option("multiLine", True).schema(MODEL).json(paths))


def _name(job: str | None) -> str:
    return (job or "unnamed").replace(" ", "_").replace("/", "_")


def save_models(model_rows: DataFrame, folder: str) -> list[str]:
    """``folder/<job>_model.json`` of each workflow; models are bounded by the workflows' structure."""
    out = []
    for r in es.models(model_rows).toLocalIterator():
        to = Path(folder) / f"{_name(r.job_name)}_model.json"
        to.write_text(json.dumps(r.asDict(recursive=True), indent=4))
        out.append(str(to))
    return out


def save_diagrams(diagrams: DataFrame, folder: str) -> list[str]:
    """``folder/<job>.puml`` of each workflow that has a diagram."""
    out = []
    for r in diagrams.where("puml is not null").toLocalIterator():
        to = Path(folder) / f"{_name(r.job_name)}.puml"
        to.write_text(r.puml)
        out.append(str(to))
    return out


def pv_to_spans(pv: DataFrame, per_file: int = 50) -> DataFrame:
    """PV events as flat span records, the first previous event as parent; ``file_no`` counts files of ``per_file`` spans per job name.

    Rows are numbered within a job name by (job, time, event), over range partitions.
    """
    whole = F.unix_seconds(F.to_timestamp(F.concat(F.substring("timestamp", 1, 19), F.lit("Z")), "yyyy-MM-dd'T'HH:mm:ssX"))
    ns = whole * 10**9 + F.coalesce(F.rpad(F.regexp_extract("timestamp", r"\.(\d{1,9})", 1), 9, "0").try_cast("bigint"), F.lit(0))
    rows = pv.select(
        F.col("eventId").alias("span_id"), F.col("jobId").alias("trace_id"), F.try_element_at("previousEventIds", F.lit(1)).alias("parent_span_id"), F.col("eventType").alias("name"), ns.alias("start_time_unix_nano"), ns.alias("end_time_unix_nano"),
        F.col("applicationName").alias("application_name"), F.col("jobName").alias("job_name"), "timestamp",
    )
    numbered = row_numbers(rows, ["job_name"], ["trace_id", "timestamp", "span_id"], "file_no")
    return numbered.withColumn("file_no", F.floor(F.col("file_no") / per_file).cast("int")).drop("timestamp")
