"""Evaluation passages within training notebooks.

Every run of ``words`` consecutive words of a passage (the whole passage if it is shorter) is a pattern of one
Aho-Corasick automaton; each cell source and each text output is normalised and scanned once. Offsets of hits are
mapped back to the text of the cell. Passages are a stated query set: they are sent to the tasks in blocks of bounded
size, and every text is scanned for every block.

Defined results
---------------
words                          runs of letters and digits after NFKC and lower-casing, without soft hyphens and zero-width characters
null passage, or without words never leaks
same passage under several ids all of them leak
null, empty or blank text      no leak
a run across two cells, or across a cell's source and an output: no leak
repeated documents             one row per document and item
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.notebooks import read_cells

WORDS = 12
#: Words after a passage within which its answer is looked for.
ANSWER_WITHIN = 12
#: Characters of passages in one automaton.
BLOCK_CHARS = 4_000_000
_WORD, _ASCII = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
_DROPPED = dict.fromkeys(map(ord, "­​‌‍﻿"))
_UNIT = re.compile(r"[\x00-\x7f]+(?![^\x00-\x7f])|[\x00-\x7f]?[^\x00-\x7f]+", re.S)


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().translate(_DROPPED)


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _WORD.findall(normalise(text))


def patterns_of(passage: str | None, words: int = WORDS) -> list[str]:
    w = words_of(passage or "")
    if not w:
        return []
    return [f" {' '.join(w[i : i + words])} " for i in range(max(1, len(w) - words + 1))]


class Automaton:
    def __init__(self, items: list[tuple[int, str]], words: int = WORDS) -> None:
        found: dict[str, list[int]] = {}
        for item, passage in items:
            for p in dict.fromkeys(patterns_of(passage, words)):
                found.setdefault(p, []).append(item)
        self.empty = not found
        self.machine = ahocorasick.Automaton()
        for p, ids in found.items():
            self.machine.add_word(p, (p.count(" ") - 1, tuple(ids)))
        if found:
            self.machine.make_automaton()

    def scan(self, words: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(position of the last character in the joined words, words matched, items)."""
        if words and not self.empty:
            for end, (n, ids) in self.machine.iter(f" {' '.join(words)} "):
                yield end, n, ids


@cache
def _seconds() -> frozenset[str]:
    """Characters without combining class that compose with what is before them."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    found = {chr(int(p.split()[1], 16)) for p in pairs if " " in p and p[0] != "<"}
    return frozenset(found) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _joins(c: str) -> bool:
    """Whether normalising may join the character to what is before it."""
    first = unicodedata.normalize("NFKD", c)[0]
    return unicodedata.combining(first) > 0 or first in _seconds()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Offsets in ``text`` of each of its words, in order."""
    parts: list[str] = []
    starts: list[int] = []  # for each normalised character, where what it came from starts and ends
    stops: list[int] = []
    for m in _UNIT.finditer(text):
        unit, at = m[0], m.start()
        if unit.isascii():
            parts.append(unit)
            starts.extend(range(at, m.end()))
            stops.extend(range(at + 1, m.end() + 1))
        else:
            # characters that combine with what precedes are taken with it, so each piece is normalised as in the whole text
            begins = [0, *(i for i in range(1, len(unit)) if not _joins(unit[i])), len(unit)]
            for i, j in zip(begins, begins[1:]):
                norm = unicodedata.normalize("NFKC", unit[i:j])
                parts.append(norm)
                single = len(norm) == j - i
                starts.extend(at + i + (k if single else 0) for k in range(len(norm)))
                stops.extend(at + (i + k + 1 if single else j) for k in range(len(norm)))
    flat = "".join(parts)
    low = flat.lower()  # in one, for a final sigma goes by what is around it
    source = range(len(flat)) if len(low) == len(flat) else [i for i, c in enumerate(flat) for _ in c.lower()]
    kept = [i for i, c in zip(source, low) if ord(c) not in _DROPPED]
    return [(starts[kept[m.start()]], stops[kept[m.end() - 1]]) for m in _WORD.finditer(low.translate(_DROPPED))]


_machines: dict[int, Automaton] = {}


def _machine(items: list[tuple[int, str]], words: int) -> Automaton:
    """One per worker process and block of passages."""
    key = hash((tuple(items), words))
    if key not in _machines:
        if len(_machines) > 3:
            _machines.clear()
        _machines[key] = Automaton(items, words)
    return _machines[key]


def _parts(text: str | None, form: str | None) -> Iterator[tuple[int, int, str]]:
    """(cell, output or -1, text) of everything of a notebook that is scanned."""
    for c, cell in enumerate(read_cells(text, form)):
        yield c, -1, cell.source
        for o, t in enumerate(cell.outputs):
            yield c, o, t


def _leaks(items: list[tuple[int, str]], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(items, words)
        for b in batches:
            docs, hits = [], []
            for doc, text, form in zip(b.column(0), b.column(1), b.column(2)):
                found = {i for _, _, t in _parts(text.as_py(), form.as_py()) for _, _, ids in machine.scan(words_of(t)) for i in ids}
                docs += [doc.as_py()] * len(found)
                hits += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return run


def _follows(answer: list[str] | None, words: list[str], at: int, within: int) -> bool:
    """Whether the answer's words come, one after the other, within so many words from a place on."""
    near = words[at : at + within + len(answer)] if answer else []
    return any(near[i : i + len(answer)] == answer for i in range(len(near) - len(answer) + 1)) if answer else False


def spans_in(machine: Automaton, text: str, answers: dict[int, list[str]] | None = None) -> list[tuple[int, int, int, int, bool]]:
    """(item, start, end, words, whether its answer follows within ``ANSWER_WITHIN`` words) of the merged runs of each item in a
    text; offsets are those of the text itself."""
    words = words_of(text)
    ends = []
    at = 0
    runs: dict[int, list[list[int]]] = {}
    for end, n, ids in machine.scan(words):
        if not ends:
            for w in words:
                at += len(w) + 1
                ends.append(at)
            where = {e: i for i, e in enumerate(ends)}
        last = where[end]
        for i in ids:
            mine = runs.setdefault(i, [])
            if mine and last - n + 1 <= mine[-1][1] + 1:
                mine[-1][1] = max(mine[-1][1], last)
            else:
                mine.append([last - n + 1, last])
    if not runs:
        return []
    spans = word_spans(text)
    return [(i, spans[a][0], spans[z][1], z - a + 1, _follows((answers or {}).get(i), words, z + 1, ANSWER_WITHIN)) for i, mine in sorted(runs.items()) for a, z in mine]


def _spans(items: list[tuple[int, str, str | None]], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(sorted({(i, p) for i, p, _ in items}), words)
        answers = {i: w for i, _, a in items if (w := words_of(a or ""))}
        for b in batches:
            rows = [
                (doc.as_py(), i, c, o, a, z, n, answered)
                for doc, text, form in zip(b.column(0), b.column(1), b.column(2))
                for c, o, t in _parts(text.as_py(), form.as_py())
                for i, a, z, n, answered in spans_in(machine, t, answers)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:7]), pa.array(cols[7], pa.bool_())], names=["doc_id", "item_id", "cell_no", "output_no", "start", "stop", "n_words", "with_answer"])

    return run


def item_blocks(items: DataFrame, item: str = "item_id", passage: str = "passage", block_chars: int = BLOCK_CHARS, answer: str | None = None) -> Iterator[list[tuple]]:
    """The passages (with answers if wanted) in blocks of at most ``block_chars`` characters, or of one passage; one block is on the driver at a time."""
    block, size = [], 0
    order = lambda x: (x[0], x[1], *((x[2] or "",) if answer else ()))
    kept = [F.col(item).cast("bigint"), F.col(passage).cast("string"), *([F.col(answer).cast("string")] if answer else [])]
    for r in items.where(F.col(passage).isNotNull()).select(*kept).distinct().toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield sorted(block, key=order)
            block, size = [], 0
        block.append(tuple(r))
        size += len(r[1])
    yield sorted(block, key=order)


def _over_blocks(docs: DataFrame, items: DataFrame, make, schema: str, words: int, block_chars: int, answer: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("nb_format").cast("string").alias("nb_format"))
    out = None
    for block in item_blocks(items, block_chars=block_chars, answer=answer):
        part = rows.mapInArrow(make(block, words), schema)
        out = part if out is None else out.unionAll(part)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds ``words`` consecutive words."""
    return _over_blocks(docs, items, _leaks, "doc_id bigint, item_id bigint", words, block_chars).distinct()


def leak_spans(docs: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, cell_no, output_no, start, stop, n_words, with_answer): where, and whether the answer follows there;
    output_no is -1 for the cell's source."""
    schema = "doc_id bigint, item_id bigint, cell_no bigint, output_no bigint, start bigint, stop bigint, n_words bigint, with_answer boolean"
    held = items if "answer" in items.columns else items.withColumn("answer", F.lit(None).cast("string"))
    return _over_blocks(docs, held, _spans, schema, words, block_chars, "answer")
