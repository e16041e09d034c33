"""The whole way: documents to spans, clean traces, causal sequences, models and diagrams."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.config import Config
from weftspan.operators import cleaning, fingerprint
from weftspan.operators import event_sets as es
from weftspan.operators import sequence as seq
from weftspan.plans.mining import diagrams_of
from weftspan.runtime import cut
from weftspan.sources import files


#: The order in which records of a source arrive: by file, line and place in the document.
ARRIVAL = ["_file", "_line", "_place"]


@dataclass
class Sequenced:
    pv: DataFrame
    spans: DataFrame
    rejected: DataFrame


class Written(list[str]):
    """Paths of what was written; ``failed`` has (job name, error) of the workflows without a diagram."""

    failed: list[tuple[str | None, str]]


def traces_to_pv(spark: SparkSession, config: Config, ingest: bool = True, unique: bool = False, strict: bool = False) -> Sequenced:
    """PV events of the configured source. Without ``ingest``, spans come from the store and no window is known."""
    rejected = spark.createDataFrame([], "record string, reason string")
    window = None
    if ingest:
        rows, rejected = files.read_spans(spark, config.source)
        rows = cut(rows)
        window = cleaning.time_window(rows, config.time_buffer) if config.time_buffer else None
        spans = cleaning.first_records(rows, ARRIVAL)
        if config.store:
            spans = cut(spans)
            # a batch per source: the same source again replaces its batch, also after a run that broke off
            batch = hashlib.md5(str(config.source.dirpath or config.source.filepath).encode()).hexdigest()
            spans.write.mode("overwrite").parquet(f"{config.store}/_batch={batch}")
        spans = spans.drop(*ARRIVAL)
    else:
        if not config.store:
            raise ValueError("without ingesting, a store is needed")
        stored = spark.read.option("basePath", config.store).parquet(f"{config.store}/_batch=*")
        spans = cleaning.first_records(stored, ["_batch", *ARRIVAL]).drop("_batch", *ARRIVAL)
    spans = cut(cleaning.clean(cut(spans), window))
    if unique:
        chosen = fingerprint.unique_graphs(fingerprint.job_hashes(spans))
        spans = cut(fingerprint.select_jobs(spans, jobs=chosen))
    how = config.sequencer
    pv = seq.sequence(spans, how.async_flag, how.async_event_groups or None, how.renames() or None, strict)
    return Sequenced(cut(pv), spans, rejected)


def pv_to_diagrams(pv: DataFrame, folder: str, known: DataFrame | None = None, save_models: bool = False, job_name: str | None = None) -> Written:
    """Write a diagram per workflow, and the models if wanted. With ``job_name`` all sequences are one workflow of that name."""
    Path(folder).mkdir(exist_ok=True)
    seqs = es.sequences_of(pv)
    if "seq" in pv.columns:
        seqs = pv.select("seq", F.col("jobName").alias("name"), F.col("eventId").alias("event"), F.col("eventType").alias("type"), F.col("previousEventIds").alias("previous"))
    if job_name:
        seqs = seqs.withColumn("name", F.lit(job_name))
    drawn, rows = diagrams_of(cut(seqs), known)
    drawn = cut(drawn)
    out = Written(files.save_diagrams(drawn, folder))
    out.failed = [(r.job_name, r.error) for r in drawn.where("puml is null").orderBy("job_name").toLocalIterator()]
    if save_models:
        out += files.save_models(rows, folder)
    return out
