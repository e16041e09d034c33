"""Deeply nested records to flat related tables, by Dewey labels.

A document is read leniently and walked once. Every element of an array is a record; its label is the sequence of its
ordinals along the arrays above it, its table the path of names that leads to it, its parent the record whose label is
its own cut by one. Plain fields of a record, and of objects within it, are its columns. A field mapping is then
evaluated on the labelled tables: a value at a shallower level is found by truncating the label, a keyed value in the
children of the truncated label.

Defined results
---------------
payload null                     no records; reason ``null``
not JSON, cut off, NaN/Infinity  no records; reason ``unreadable``; raw control characters within strings are fine
JSON but no object               no records; reason ``no document``
repeated key in an object        the last counts
object in place of an array      element 0, where the mapping (or ``repeated``) has an array
missing, null or empty array     no records
array element that is no object  a record with the one column ``""``; it has no keyed value
value that is no string          its JSON text; objects and arrays compactly
part without a value             the whole mapped value is null
surrogate code points alone      U+FFFD
documents of any depth           as any other
mapping_id null or unknown       no fields
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Field mappings are held by every task and by the driver; a larger table is refused.
MAPPING_ROWS = 50_000
STEP = "[]"


class Number(str):
    """A number kept as it was written."""


def _no_constant(text: str):
    raise ValueError(text)


_decoder = json.JSONDecoder(strict=False, parse_float=Number, parse_constant=_no_constant)


_BLANKS = re.compile(r"[ \t\n\r]*")


def _decode_deep(text: str) -> object:
    """What the decoder gives, for any depth: open arrays and objects are on a stack of their own."""
    blanks = lambda i: _BLANKS.match(text, i).end()
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]  # with the key under which an object's next value goes
    i = blanks(0)
    while True:
        # a value
        inner, key = stack[-1]
        c = text[i : i + 1]
        if c in ("{", "["):
            v = {} if c == "{" else []
            end = blanks(i + 1)
            if done := text[end : end + 1] == ("}" if c == "{" else "]"):
                end += 1
        else:
            try:
                v, end = _decoder.raw_decode(text, i) if c else (None, -1)
            except json.JSONDecodeError:
                end = -1
            if end < 0:
                raise ValueError(f"no value at {i}")
            done = True
        if isinstance(inner, dict):
            inner[key] = v
        else:
            inner.append(v)
        i = blanks(end)
        if not done:
            stack.append((v, None))
        else:
            # what follows a value: ends of what holds it, or a comma
            while len(stack) > 1 and text[i : i + 1] == ("}" if isinstance(stack[-1][0], dict) else "]"):
                stack.pop()
                i = blanks(i + 1)
            if len(stack) == 1:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return top[0]
            if text[i : i + 1] != ",":
                raise ValueError(f"no comma at {i}")
            i = blanks(i + 1)
        if isinstance(stack[-1][0], dict):
            if text[i : i + 1] != '"':
                raise ValueError(f"no key at {i}")
            name, i = scanstring(text, i + 1, False)
            i = blanks(i)
            if text[i : i + 1] != ":":
                raise ValueError(f"no colon at {i}")
            i = blanks(i + 1)
            stack[-1] = (stack[-1][0], name)


def read_json(text: str | None) -> tuple[object, str | None]:
    """The document, and why there is none."""
    if text is None:
        return None, "null"
    try:
        try:
            doc = _decoder.decode(text)
        except RecursionError:
            doc = _decode_deep(text)
    except ValueError:
        return None, "unreadable"
    return (doc, None) if isinstance(doc, dict) else (None, "no document")


def as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return _dump(v)


def _dump(v: object) -> str:
    """Compact JSON text at any depth; numbers stay as they were written."""
    out, ends, todo = [], [], [iter([(v, "")])]
    while todo:
        got = next(todo[-1], None)
        if got is None:
            todo.pop()
            if todo:
                out.append(ends.pop())
            continue
        x, before = got
        out.append(before)
        if isinstance(x, Number):
            out.append(str(x))
        elif isinstance(x, dict):
            out.append("{")
            ends.append("}")
            todo.append(iter([(e, f"{',' if i else ''}{json.dumps(k, ensure_ascii=False)}:") for i, (k, e) in enumerate(x.items())]))
        elif isinstance(x, list):
            out.append("[")
            ends.append("]")
            todo.append(iter([(e, "," if i else "") for i, e in enumerate(x)]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def value_text(v: object) -> str | None:
    """The plain value that ``v`` is or that lies alone in it, as a string or JSON text; else the JSON text of all of ``v``."""
    got = v
    while isinstance(got, dict) and got:
        filled = [x for x in got.values() if x is not None]
        if len(filled) > 1:
            break
        got = filled[0] if filled else None
    return as_text(v if isinstance(got, (dict, list)) else got)


def names_of(path: str) -> list[str]:
    return [p for p in path.split(".") if p != STEP]


def arrays_of(path: str) -> list[str]:
    """Name paths of the arrays that a key path goes through."""
    out, names = [], []
    for p in path.split("."):
        if p == STEP:
            out.append(".".join(names))
        else:
            names.append(p)
    return out


@dataclass
class Part:
    """One way to a value: in the table ``table``, column ``column``; keyed if ``key`` is set."""

    table: str
    column: str
    key_column: str | None = None
    key: str | None = None


@dataclass
class Mapping:
    fields: dict[str, list[list[Part]]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)


def compile_mappings(rows: list[Row]) -> tuple[dict[int, Mapping], set[str]]:
    """Flat field-mapping rows -> mapping per id, and the name paths that are arrays in any of them."""
    repeated = {a for r in rows for a in arrays_of(r.key_path)}
    out: dict[int, Mapping] = {}
    ways: dict[tuple, dict[int, dict[int, Part]]] = {}
    for r in rows:
        names = names_of(r.key_path)
        above = max((a for a in repeated if ".".join(names).startswith(a + ".")), key=len, default="")
        rest = ".".join(names)[len(above) + 1 if above else 0 :]
        part = Part(above, r.value_path, rest, r.key_value) if r.key_value is not None else Part(above, rest)
        ways.setdefault((r.mapping_id, r.field_name), {}).setdefault(r.part_no, {})[r.fallback_rank] = part
        m = out.setdefault(r.mapping_id, Mapping())
        m.kinds[r.field_name] = r.value_type
    for (mapping, name), parts in ways.items():
        out[mapping].fields[name] = [[parts[p][rank] for rank in sorted(parts[p])] for p in sorted(parts)]
    return out, repeated


class Shredder:
    """Walks documents into labelled tables: ``{table: [(label, columns)]}``.

    ``wanted`` limits the walk to the given (table, column) pairs; None takes everything.
    """

    def __init__(self, repeated: set[str], wanted: set[tuple[str, str]] | None = None) -> None:
        self.repeated = repeated
        self.trie: dict | None = None
        if wanted is not None:
            self.trie = {}
            for table, column in wanted:
                node = self.trie
                for name in [*(table.split(".") if table else []), *(column.split(".") if column else [])]:
                    node = node.setdefault(name, {})
                node[None] = True

    def shred(self, doc: dict) -> dict[str, list[tuple[tuple, dict]]]:
        self.tables: dict[str, list[tuple[tuple, dict]]] = {}
        self.parents: dict[str, list[str | None]] = {"": [None]}  # the table of each record's parent
        top: dict = {}
        self.tables[""] = [((), top)]
        walks = [self._object(doc, "", "", "", (), top, self.trie)]
        while walks:  # a stack of their own, for documents of any depth
            if (inner := next(walks[-1], None)) is None:
                walks.pop()
            else:
                walks.append(inner)
        return self.tables

    def _object(self, obj: dict, own_table: str, path: str, prefix: str, label: tuple, columns: dict, trie: dict | None) -> Iterator[Iterator]:
        """Yields the walks of the objects within, each to be done before this one goes on."""
        for name, v in obj.items():
            sub = None
            if trie is not None:
                sub = trie.get(name)
                if sub is None:
                    continue
            if isinstance(v, (dict, list)):
                here = f"{path}.{name}" if path else name
                leaf = sub is not None and None in sub
                if leaf:
                    columns[prefix + name] = v
                    if len(sub) == 1:
                        continue
                if isinstance(v, dict):
                    if here not in self.repeated:
                        yield self._object(v, own_table, here, f"{prefix}{name}.", label, columns, sub)
                        continue
                    v = [v]
                table = self.tables.setdefault(here, [])
                self.parents.setdefault(here, []).extend([own_table] * len(v))
                for i, e in enumerate(v):
                    own: dict = {}
                    table.append(((*label, i), own))
                    if isinstance(e, dict):
                        yield self._object(e, here, here, "", (*label, i), own, sub)
                    elif isinstance(e, list):
                        own[""] = _dump(e)
                    else:
                        own[""] = e
            else:
                columns[prefix + name] = v


def wanted_columns(mappings: dict[int, Mapping], fields: set[str] | None = None) -> set[tuple[str, str]]:
    out = set()
    for m in mappings.values():
        for name, parts in m.fields.items():
            if fields is None or name in fields:
                for p in (p for ranks in parts for p in ranks):
                    out.add((p.table, p.column))
                    if p.key_column is not None:
                        out.add((p.table, p.key_column))
    return out


def _depth(table: str, repeated: set[str]) -> int:
    return sum(table == a or table.startswith(a + ".") for a in repeated)


class Evaluator:
    """Values of mapped fields for the records of one document."""

    def __init__(self, mappings: dict[int, Mapping], repeated: set[str]) -> None:
        self.mappings, self.repeated = mappings, repeated
        self.depths: dict[str, int] = {}

    def start(self, tables: dict[str, list[tuple[tuple, dict]]]) -> None:
        self.tables, self.by_label, self.by_key = tables, {}, {}

    def _records(self, table: str) -> dict[tuple, dict]:
        if table not in self.by_label:
            self.by_label[table] = dict(self.tables.get(table, ()))
        return self.by_label[table]

    def _keyed(self, table: str, key_column: str) -> dict[tuple, dict]:
        """(parent label, key) -> the last such child."""
        at = (table, key_column)
        if at not in self.by_key:
            self.by_key[at] = {(label[:-1], k): columns for label, columns in self.tables.get(table, ()) if isinstance(k := columns.get(key_column), str) and not isinstance(k, Number)}
        return self.by_key[at]

    def _part(self, p: Part, label: tuple) -> object:
        depth = self.depths.get(p.table)
        if depth is None:
            depth = self.depths[p.table] = _depth(p.table, self.repeated)
        if p.key_column is not None:
            found = self._keyed(p.table, p.key_column).get((label[: depth - 1], p.key))
        else:
            found = self._records(p.table).get(label[:depth])
        return None if found is None else found.get(p.column)

    def value(self, mapping: Mapping, name: str, label: tuple) -> str | list | None:
        out = []
        for ranks in mapping.fields.get(name, ()):
            got = next((v for p in ranks if (v := self._part(p, label)) is not None), None)
            if got is None and mapping.kinds[name] != "array":
                return None
            out.append(got)
        if not out:
            return None
        if mapping.kinds[name] != "array":
            return "_".join(map(as_text, out))
        if all(v is None for v in out):
            return None
        return [as_text(x) for v in out if v is not None for x in (v if isinstance(v, list) else [v])]


def _sound(v: str | None) -> str | None:
    if v is None:
        return None
    try:
        v.encode()
    except UnicodeEncodeError:
        return v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return v


def column(values: list, kind: pa.DataType = pa.string()) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([[_sound(x) for x in v] if isinstance(v, list) else _sound(v) for v in values], kind)


def load_mappings(table: DataFrame) -> tuple[dict[int, Mapping], set[str]]:
    rows = table.limit(MAPPING_ROWS + 1).collect()
    if len(rows) > MAPPING_ROWS:
        raise ValueError(f"more than {MAPPING_ROWS} field-mapping rows")
    return compile_mappings([r for r in rows if None not in (r.mapping_id, r.field_name, r.key_path)])


def _slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def map_records(df: DataFrame, mappings: DataFrame, table: str, fields: list[str], *, record: str = "raw_id", mapping: str = "mapping_id", payload: str = "payload") -> DataFrame:
    """One row per record of ``table``: (record, label array, each mapped field). Array fields come as array<string>."""
    compiled, repeated = load_mappings(mappings)
    kinds = {f: "array" if any(m.kinds.get(f) == "array" for m in compiled.values()) else "string" for f in fields}
    wanted = wanted_columns(compiled, set(fields)) | {(table, "")}
    schema = "record bigint, label array<int>, " + ", ".join(f"`{f}` " + ("array<string>" if k == "array" else "string") for f, k in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder, evaluator = Shredder(repeated, wanted), Evaluator(compiled, repeated)
        for b in _slices(batches):
            ids, labels, values = [], [], {f: [] for f in fields}
            for rid, mid, text in zip(b["record"].to_pylist(), b["mapping"].to_pylist(), b["payload"].to_pylist()):
                m = compiled.get(mid)
                doc = read_json(text)[0] if m else None
                if doc is None:
                    continue
                tables = shredder.shred(doc)
                evaluator.start(tables)
                for label, _ in tables.get(table, ()):
                    ids.append(rid)
                    labels.append(label)
                    for f in fields:
                        values[f].append(evaluator.value(m, f, label))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.list_(pa.int32())), *[column(values[f], pa.list_(pa.string()) if kinds[f] == "array" else pa.string()) for f in fields]], names=["record", "label", *fields]
            )

    rows = df.select(F.col(record).cast("bigint").alias("record"), F.col(mapping).cast("int").alias("mapping"), F.col(payload).cast("string").alias("payload"))
    return rows.mapInArrow(run, schema)


def flat_tables(
    df: DataFrame, repeated: set[str], wanted: set[tuple[str, str]] | None = None, write: Callable[[object], str | None] = as_text, *, record: str = "raw_id", payload: str = "payload"
) -> DataFrame:
    """Every record of every document: (record, table, label, parent_table, parent_label, columns, reason).

    A label is written ``0.2.1``; that of the document itself is empty. A document without records has one row with
    the reason. Filter by ``table`` for one flat table; (record, parent_table, parent_label) of a row is (record, table,
    label) of its parent. ``wanted`` (table, column) pairs limit the walk to themselves; their values are kept whole and
    written by ``write``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder(repeated, wanted)
        for b in _slices(batches, 128):
            ids, names, labels, above, parents, columns, reasons = [], [], [], [], [], [], []
            for rid, text in zip(b["record"].to_pylist(), b["payload"].to_pylist()):
                doc, reason = read_json(text)
                tables = {None: [((), {})]} if reason else shredder.shred(doc)
                for name, records in tables.items():
                    above += [None] if reason else shredder.parents[name]
                    for label, own in records:
                        ids.append(rid)
                        names.append(name)
                        labels.append(".".join(map(str, label)))
                        parents.append(".".join(map(str, label[:-1])) if label else None)
                        columns.append([(_sound(k), _sound(write(v))) for k, v in own.items()])
                        reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column(names), pa.array(labels), column(above), pa.array(parents, pa.string()), pa.array(columns, pa.map_(pa.string(), pa.string())), pa.array(reasons, pa.string())], names=["record", "table", "label", "parent_table", "parent_label", "columns", "reason"])

    rows = df.select(F.col(record).cast("bigint").alias("record"), F.col(payload).cast("string").alias("payload"))
    return rows.mapInArrow(run, "record bigint, table string, label string, parent_table string, parent_label string, columns map<string,string>, reason string")
