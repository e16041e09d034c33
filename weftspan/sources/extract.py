"""Spans from JSON documents by a declarative field mapping, compiled to columns.

The arrays on the fields' paths form a tree; each is bound once, as a generator, and shared by all fields below it, so
that header values go with every span. Sibling arrays multiply. A missing array gives one row without its values, an
empty one none. Values are read from VARIANTs; documents that only a lenient reader takes (raw control characters,
repeated keys) are rewritten first, and only those cross into Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.config import FieldSpec
from weftspan.operators.nested import column
from weftspan.schemas import MANDATORY

STEP = "[]"


def _split(path: str) -> list[list[str]]:
    """Names between array steps: a.[].b.c -> [[a], [b, c]]."""
    out: list[list[str]] = [[]]
    for p in path.split("."):
        if p == STEP:
            out.append([])
        else:
            out[-1].append(p)
    return out


def _path(names: list[str]) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


def _get(v: Column, names: list[str], kind: str) -> Column:
    return F.try_variant_get(v, _path(names), kind) if names or kind != "variant" else v


@dataclass
class Binding:
    """An array bound to one element at a time."""

    name: str
    names: list[str] = field(default_factory=list)
    kids: dict[tuple[str, ...], Binding] = field(default_factory=dict)


def bind(fields: dict[str, FieldSpec]) -> tuple[Binding, dict[tuple[str, bool], str]]:
    """The tree of arrays, and the binding each (path, keyed) reads from. A keyed way looks its last array up in place."""
    root, at, n = Binding("_v0"), {}, 0
    for spec in fields.values():
        for path, key, _ in (w for part in spec.parts for w in part):
            here, steps = root, _split(path)
            for names in steps[: -2 if key is not None else -1]:
                kid = here.kids.get(tuple(names))
                if kid is None:
                    n += 1
                    kid = here.kids[tuple(names)] = Binding(f"_v{n}", names)
                here = kid
            at[path, key is not None] = here.name
    return root, at


def _is_false(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False)) & (F.try_variant_get(v, "$", "string") == "false")


def _way(way: tuple[str, str | None, str | None], at: dict) -> Column:
    path, key, value = way
    v, steps = F.col(at[path, key is not None]), _split(path)
    if key is None:
        return _get(v, steps[-1], "variant")
    items = _get(v, steps[-2], "array<variant>")
    hit = F.try_element_at(F.filter(items, lambda e: _get(e, steps[-1], "string") == key), F.lit(-1))
    return _get(hit, value.split("."), "variant")


def _value(spec: FieldSpec, at: dict) -> Column:
    parts = []
    for ways in spec.parts:
        found = [_way(w, at) for w in ways]
        # of several ways, one that gives null or false falls back to the next
        parts.append(F.coalesce(*[F.when(~_is_false(c), c) for c in found[:-1]], found[-1]) if len(found) > 1 else found[0])
    if spec.value_type == "string":
        texts = [F.try_variant_get(p, "$", "string") for p in parts]
        out = texts[0]
        for t in texts[1:]:
            out = F.concat(out, F.lit("_"), t)
        return out
    lists = [F.coalesce(F.try_variant_get(p, "$", "array<variant>"), F.array(p)) for p in parts]
    flat = F.flatten(F.transform(F.concat(*lists), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
    texts = F.transform(flat, lambda x: F.try_variant_get(x, "$", "string"))
    return F.when((F.size(texts) == 0) | F.exists(texts, lambda x: x.isNotNull()), F.filter(texts, lambda x: x.isNotNull()))


def _lenient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column(0).to_pylist():
            try:
                out.append(json.dumps(json.loads(text, strict=False), ensure_ascii=False))
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([column(out), *b.columns[1:]], names=b.schema.names)


def parse_documents(docs: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``_v0``, the document as VARIANT; null where no reader takes it."""
    cols = [text, *[c for c in docs.columns if c != text]]
    docs = docs.select(*cols).withColumn("_v0", F.try_parse_json(text))
    good = docs.where("_v0 is not null")
    odd = docs.where("_v0 is null").drop("_v0").mapInArrow(_lenient, docs.drop("_v0").schema)
    return good.unionByName(odd.withColumn("_v0", F.try_parse_json(text)))


def extract(docs: DataFrame, fields: dict[str, FieldSpec], text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(each field, *keep, _place): rows of all readable documents; ``_place`` orders the rows of one."""
    root, at = bind(fields)
    rows = parse_documents(docs.select(text, *keep), text).where("_v0 is not null").withColumn("_place", F.array().cast("array<int>"))
    todo = [(root, kid) for kid in root.kids.values()]
    while todo:
        parent, kid = todo.pop(0)
        none = F.array(F.lit(None).cast("variant"))
        items = F.coalesce(_get(F.col(parent.name), kid.names, "array<variant>"), none)
        rows = rows.select("*", F.posexplode(items).alias("_at", kid.name)).withColumn("_place", F.concat("_place", F.array("_at"))).drop("_at")
        todo[:0] = [(kid, k) for k in kid.kids.values()]
    return rows.select(*[_value(s, at).alias(n) for n, s in fields.items()], *keep, "_place")


def as_spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed spans, and (record, reason) of rows that lack a mandatory field or whose times are no integers."""
    typed = rows.withColumns({c: F.col(c).try_cast("bigint") for c in ("start_timestamp", "end_timestamp")}).withColumn("parent_event_id", F.when(F.col("parent_event_id") != "", F.col("parent_event_id")))
    if "child_event_ids" not in rows.columns:
        typed = typed.withColumn("child_event_ids", F.lit(None).cast("array<string>"))
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in MANDATORY]), lambda x: x.isNotNull()), ",")
    rejected = typed.withColumn("reason", lacking).where("reason != ''").select(F.to_json(F.struct(*MANDATORY)).alias("record"), F.concat(F.lit("without "), "reason").alias("reason"))
    return typed.dropna(subset=list(MANDATORY)), rejected
