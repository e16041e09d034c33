"""Computational notebooks as ordered cells, from the three ways they are written."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_LINES = re.compile(r"\r\n|\r|\n")
_LISTING = re.compile(r"^(?:(\[text\])|(In) ?\[[ \d]*\]:|(Out) ?\[[ \d]*\]:)\s*$")
_PERCENT = re.compile(r"^# ?%%(.*)$")
_OUT = re.compile(r"^# Out: ?(.*)$")
_decoder = json.JSONDecoder(strict=False)


@dataclass
class Cell:
    kind: str  # text, code or other
    source: str
    outputs: list[str] = field(default_factory=list)


def _joined(v: object, by: str = "") -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return by.join(x for x in v if isinstance(x, str))
    return ""


def _ipynb(text: str) -> list[Cell] | None:
    try:
        doc = _decoder.decode(text)
    except (ValueError, RecursionError):
        return None
    cells = doc.get("cells") if isinstance(doc, dict) else None
    if not isinstance(cells, list):
        return None
    out = []
    for c in cells:
        if not isinstance(c, dict):
            continue
        kind = {"code": "code", "markdown": "text", "raw": "text"}.get(c.get("cell_type"), "other")
        cell = Cell(kind, _joined(c.get("source")))
        for o in c.get("outputs") if isinstance(c.get("outputs"), list) else ():
            if not isinstance(o, dict):
                continue
            if t := _joined(o.get("text")):
                cell.outputs.append(t)
            for mime, v in o["data"].items() if isinstance(o.get("data"), dict) else ():
                if not mime.startswith(("image/", "audio/", "video/", "application/pdf")) and (t := _joined(v)):
                    cell.outputs.append(t)
            error = [_joined(o.get(k), "\n") for k in ("ename", "evalue", "traceback")]
            if any(error):
                cell.outputs.append("\n".join(x for x in error if x))
        out.append(cell)
    return out


def _percent(text: str) -> list[Cell]:
    out: list[Cell] = []
    cell, lines, outputs = None, [], []

    def close() -> None:
        nonlocal lines, outputs
        if cell is not None:
            cell.source, cell.outputs = "\n".join(lines), ["\n".join(o) for o in outputs]
            out.append(cell)
        lines, outputs = [], []

    for line in _LINES.split(text):
        if m := _PERCENT.match(line):
            close()
            cell = Cell("text" if "[markdown]" in m[1] else "code", "")
            continue
        if cell is None:
            if not line.strip():
                continue
            cell = Cell("code", "")
        if cell.kind == "code" and (m := _OUT.match(line)):
            outputs.append([m[1]])
        elif outputs:
            outputs[-1].append(re.sub("^# ?", "", line))
        else:
            lines.append(re.sub("^# ?", "", line) if cell.kind == "text" else line)
    close()
    return out


def _listing(text: str) -> list[Cell]:
    out: list[Cell] = []
    cell, here = None, []

    def close() -> None:
        nonlocal here
        if here:
            body = "\n".join(here[1])
            if here[0] == "source":
                cell.source = body
            else:
                cell.outputs.append(body)
        here = []

    for line in _LINES.split(text):
        if m := _LISTING.match(line):
            close()
            if m[3]:
                if cell is None:
                    cell = Cell("code", "")
                    out.append(cell)
                here = ["output", []]
                continue
            cell = Cell("text" if m[1] else "code", "")
            out.append(cell)
            here = ["source", []]
        else:
            if cell is None:
                if not line.strip():
                    continue
                cell = Cell("other", "")
                out.append(cell)
                here = ["source", []]
            here[1].append(line)
    close()
    return out


def read_cells(text: str | None, nb_format: str | None = None) -> list[Cell]:
    """Cells of a notebook. A text that is not of its format is one cell of kind ``other``; null and blank texts have none."""
    if text is None or not text.strip():
        return []
    form = (nb_format or "").strip().lower()
    if form not in ("ipynb", "percent", "listing"):
        form = "ipynb" if text.lstrip().startswith("{") else "percent" if re.search(r"(?m)^# ?%%", text) else "listing"
    cells = _ipynb(text) if form == "ipynb" else _percent(text) if form == "percent" else _listing(text)
    return [Cell("other", text)] if cells is None else cells
