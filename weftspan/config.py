"""Configuration of the pipeline: parsing and validation of the YAML file and of command options."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

FIELDS = ("job_name", "job_id", "event_type", "event_id", "start_timestamp", "end_timestamp", "application_name", "parent_event_id")
OPTIONAL_FIELDS = ("child_event_ids",)


def _only(given: dict, allowed: set[str], where: str) -> None:
    if extra := set(given) - allowed:
        raise ValueError(f"{where}: unknown keys {sorted(extra)}")


@dataclass
class FieldSpec:
    """A mapped field. Each part lists its ways in the order of preference: (key path, key value, value path)."""

    parts: list[list[tuple[str, str | None, str | None]]]
    value_type: str = "string"

    @classmethod
    def of(cls, name: str, given: dict) -> FieldSpec:
        _only(given, {"key_paths", "key_value", "value_paths", "value_type"}, name)
        kind = given.get("value_type", "string")
        if kind not in ("string", "array"):
            raise ValueError(f"{name}: value_type {kind!r} is neither string nor array")
        paths = cls._lists(name, given.get("key_paths"))
        if not paths or any(p is None for part in paths for p in part):
            raise ValueError(f"{name}: key_paths are missing")
        keys, values = (cls._lists(name, given.get(k)) or [[None] * len(p) for p in paths] for k in ("key_value", "value_paths"))
        if [len(p) for p in paths] != [len(p) for p in keys] or [len(p) for p in paths] != [len(p) for p in values]:
            raise ValueError(f"{name}: key_paths, key_value and value_paths differ in length")
        parts = [list(zip(*three)) for three in zip(paths, keys, values)]
        for way in (w for part in parts for w in part):
            if (way[1] is None) != (way[2] is None):
                raise ValueError(f"{name}: a key value needs a value path and the other way round: {way}")
            if way[1] is not None and "[]" not in way[0].split("."):
                raise ValueError(f"{name}: a key value needs an array in its path: {way[0]}")
        return cls(parts, kind)

    @staticmethod
    def _lists(name: str, given: object) -> list[list[str | None]]:
        if given is None:
            return []
        out = []
        for x in given if isinstance(given, list) else [given]:
            part = list(x) if isinstance(x, (list, tuple)) else [x]
            if any(p is not None and not isinstance(p, str) for p in part):
                raise TypeError(f"{name}: paths and keys are text or null, not {x!r}")
            out.append(part)
        return out


@dataclass
class JsonSource:
    dirpath: str | None = None
    filepath: str | None = None
    json_per_line: bool = False
    field_mapping: dict[str, FieldSpec] | None = None
    jq_query: str | None = None
    sql_query: str | None = None

    @classmethod
    def of(cls, given: dict) -> JsonSource:
        _only(given, {"dirpath", "filepath", "json_per_line", "field_mapping", "jq_query", "sql_query"}, "data_sources.json")
        if bool(given.get("dirpath")) == bool(given.get("filepath")):
            raise ValueError("data_sources.json: give either dirpath or filepath")
        if sum(bool(given.get(x)) for x in ("field_mapping", "jq_query", "sql_query")) != 1:
            raise ValueError("data_sources.json: give one of field_mapping, sql_query and jq_query")
        mapping = given.get("field_mapping")
        if mapping:
            if lacking := set(FIELDS) - set(mapping):
                raise ValueError(f"field_mapping: missing {sorted(lacking)}")
            _only(mapping, {*FIELDS, *OPTIONAL_FIELDS}, "field_mapping")
            mapping = {n: FieldSpec.of(n, s) for n, s in mapping.items()}
        return cls(given.get("dirpath"), given.get("filepath"), bool(given.get("json_per_line", False)), mapping, given.get("jq_query"), given.get("sql_query"))


@dataclass
class Sequencer:
    async_flag: bool = False
    async_event_groups: dict = field(default_factory=dict)
    event_name_map_information: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict) -> Sequencer:
        _only(given, {"async", "async_flag", "async_event_groups", "event_name_map_information"}, "sequencer")
        return cls(bool(given.get("async_flag", given.get("async", False))), given.get("async_event_groups") or {}, given.get("event_name_map_information") or {})

    def renames(self) -> dict[str, dict[str, tuple[set[str], str]]]:
        out: dict = {}
        for job, kinds in self.event_name_map_information.items():
            for kind, info in kinds.items():
                _only(info, {"mapped_event_type", "child_event_types"}, f"event_name_map_information.{job}.{kind}")
                out.setdefault(job, {})[kind] = (set(info["child_event_types"]), info["mapped_event_type"])
        return out


@dataclass
class Config:
    source: JsonSource
    time_buffer: int = 0
    store: str | None = None
    sequencer: Sequencer = field(default_factory=Sequencer)

    @classmethod
    def of(cls, given: dict) -> Config:
        """``store`` is the folder that keeps spans as Parquet between runs; a database address is taken as its name."""
        _only(given, {"ingest_data", "data_sources", "data_holders", "sequencer"}, "config")
        kinds = given.get("ingest_data") or {}
        if kinds.get("data_source") != "json":
            raise ValueError(f"unknown data source {kinds.get('data_source')!r}")
        if kinds.get("data_holder") not in ("sql", "parquet"):
            raise ValueError(f"unknown data holder {kinds.get('data_holder')!r}")
        holder = (given.get("data_holders") or {}).get(kinds["data_holder"]) or {}
        _only(holder, {"db_uri", "path", "batch_size", "time_buffer"}, "data_holders")
        buffer = holder.get("time_buffer", 0)
        if not isinstance(buffer, int) or buffer < 0:
            raise ValueError("time_buffer must be a whole number of minutes")
        uri = holder.get("path") or holder.get("db_uri") or ""
        store = None if not uri or ":memory:" in uri else uri.split("///")[-1]
        return cls(JsonSource.of((given.get("data_sources") or {}).get("json") or {}), buffer, store, Sequencer.of(given.get("sequencer") or {}))


def load(path: str) -> Config:
    if not str(path).endswith(".yaml"):
        raise ValueError(f"{path}: a configuration file ends in .yaml")
    return Config.of(yaml.safe_load(Path(path).read_text()))


PV_KEYS = ("jobId", "eventId", "timestamp", "previousEventIds", "applicationName", "jobName", "eventType")


def pv_mapping(path: str | None) -> dict[str, str]:
    """PV key -> key in the user's files."""
    given = yaml.safe_load(Path(path).read_text()) if path else {}
    _only(given or {}, set(PV_KEYS), "mapping")
    return {k: (given or {}).get(k, k) for k in PV_KEYS}
