"""From model rows to diagrams. A workflow's model is bounded by its structure, so each is one small group in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.mining import gates, structure
from weftspan.operators import event_sets as es


def _sets(rows: pd.DataFrame) -> tuple[dict[str, set], dict[str, set]]:
    """What follows and what precedes each type."""
    out: dict[str, set] = {}
    before: dict[str, set] = {}
    for kind, direction, found in zip(rows["event_type"], rows["direction"], rows["event_set"]):
        own = out.setdefault(kind, set())
        seen = tuple((x["eventType"], int(x["count"])) for x in found)
        if direction == "out" and seen:
            own.add(seen)
            for x in found:
                out.setdefault(x["eventType"], set())
        elif seen:
            before.setdefault(kind, set()).add(seen)
    return out, before


def _diagram(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    name = key[0] if key[0] is not None else "unnamed"
    try:
        after, before = _sets(rows)
        return pd.DataFrame({"job_name": [key[0]], "puml": [structure.puml_of(after, name, before)], "error": [None]})
    except (RecursionError, ValueError) as e:
        return pd.DataFrame({"job_name": [key[0]], "puml": [None], "error": [f"{type(e).__name__}: {e}"]})


def diagrams(model_rows: DataFrame) -> DataFrame:
    """(job_name, puml, error) of each workflow. The rows must have been made with an artificial start."""
    return model_rows.groupBy("job_name").applyInPandas(_diagram, "job_name string, puml string, error string")


def _gates(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (kind, direction), part in rows.groupby(["event_type", "direction"], sort=True):
        gate = gates.infer({tuple((x["eventType"], int(x["count"])) for x in s) for s in part["event_set"] if len(s)})
        if gate is not None:
            out.append((key[0], kind, direction, gate.text()))
    return pd.DataFrame(out, columns=["job_name", "event_type", "direction", "gate"])


def logic_gates(model_rows: DataFrame) -> DataFrame:
    """(job_name, event_type, direction, gate): what follows and what precedes each type, as a canonical text."""
    return model_rows.groupBy("job_name").applyInPandas(_gates, "job_name string, event_type string, direction string, gate string")


def diagrams_of(seqs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Diagrams of sequences, and the model rows they come from; ``known`` is a model to go on from.

    A workflow that only the known model has gets no diagram.
    """
    rows = es.model_rows(seqs, dummy_start=True)
    if known is not None:
        here = rows.select("job_name").distinct()
        rows = es.merge_models(rows, known.join(F.broadcast(here) if here.limit(100_001).count() <= 100_000 else here, "job_name", "left_semi"))
    return diagrams(rows), rows


