"""Test data from diagrams: PV events and span records of every way through them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftspan.mining.diagram import events_of, parse
from weftspan.mining.gates import LEAF, Gate
from weftspan.schemas import PV
from weftspan.sources.files import pv_to_spans


def fresh_ids(events: list[dict]) -> Iterator[dict]:
    """The same jobs under new ids; links within them are kept."""
    jobs: dict[str, str] = {}
    ids: dict[tuple[str, str], str] = {}
    new = lambda d, k: d.setdefault(k, str(uuid.uuid4()))
    for e in events:
        job = e["jobId"]
        yield e | {"jobId": new(jobs, job), "eventId": new(ids, (job, e["eventId"])), "previousEventIds": [new(ids, (job, p)) for p in e["previousEventIds"]]}


def simulate(spark: SparkSession, text: str, job_name: str = "job", copies: int = 1, more: int = 0, seed: int = 0) -> DataFrame:
    """PV events of every run of a diagram and of ``more`` runs by chance, ``copies`` times under ids of their own."""
    events = events_of(parse(text), job_name, more=more, seed=seed)
    rows = [tuple(e[k] for k in ("jobId", "eventId", "eventType", "timestamp", "applicationName", "jobName", "previousEventIds")) for _ in range(copies) for e in fresh_ids(events)]
    return spark.createDataFrame(rows, PV)


def diagram_to_span_files(spark: SparkSession, path: str, folder: str, job_name: str, per_file: int = 50) -> int:
    """Span records of a diagram's runs as JSON lines below ``folder``, a subfolder per ``per_file`` spans; returns the number of spans."""
    spans = pv_to_spans(simulate(spark, Path(path).read_text(), job_name), per_file)
    spans.write.mode("overwrite").partitionBy("file_no").json(folder)
    return spans.count()


def dot(gate: Gate, name: str = "gate") -> str:
    """A gate as a graph in the DOT language."""
    lines, n = [f'digraph "{name}" {{'], 0

    def visit(g: Gate) -> int:
        nonlocal n
        own, n = n, n + 1
        shape = "box" if g.kind == LEAF else "diamond"
        lines.append(f'  n{own} [label="{g.label if g.kind == LEAF else g.kind}", shape={shape}];')
        for c in g.children:
            lines.append(f"  n{own} -> n{visit(c)};")
        return own

    visit(gate)
    return "\n".join([*lines, "}"])
