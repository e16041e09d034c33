from __future__ import annotations

import random
import unicodedata

import duckdb
import pytest

from weftspan.llm import leakage as L
from weftspan.llm.notebooks import read_cells
from weftspan.llm.queries import p7_found, p7_spans

BASE = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id bigint, text string, nb_format string, item_id int", "item_id bigint, passage string, answer string"


def words(text):
    text = "".join(c for c in unicodedata.normalize("NFKC", text).lower() if ord(c) not in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF))
    return "".join(c if c.isalnum() else " " for c in text).split()


def brute(docs, items):
    windows: dict = {}
    for i, p in items:
        w = words(p or "")
        n = min(12, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = set()
    for d, text, form in docs:
        for cell in read_cells(text, form):
            for part in (cell.source, *cell.outputs):
                w = words(part)
                out |= {(d, i) for n in sizes for k in range(len(w) - n + 1) for i in windows.get(tuple(w[k : k + n]), ())}
    return out


def test_found_against_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text, nb_format from '{BASE}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, passage from '{BASE}/eval_items.parquet'").fetchall()
    want = brute(docs, items)
    got = [tuple(r) for r in p7_found(spark, BASE).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    spans = {(r.doc_id, r.item_id) for r in p7_spans(spark, BASE).collect()}
    assert spans == want


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("block", [10, 10**6])
def test_rules(spark, block):
    items = [(1, LONG, "A"), (2, LONG, None), (3, "Short café", "x"), (4, None, "y"), (5, " -- ", None)]
    cut = LONG.split()
    docs = [
        (1, "[text]\nbefore ONE two-three\tfour five six sev­en eight nine ten\neleven ｔｗｅｌｖｅ x", "listing", 0), (2, "[text]\n" + " ".join(cut[:11]), "listing", 0), (3, "[text]\n" + " ".join(cut[:7]) + "\n\n[text]\n" + " ".join(cut[7:]), "listing", 0),
        (4, '{"cells": [{"cell_type": "code", "source": ["a short\\n", "café"], "outputs": [{"output_type": "stream", "text": "two three four five six seven eight nine ten eleven twelve thirteen"}]}]}', "ipynb", 0),
        (5, "# %%\nx = 1\n# Out: " + " ".join(cut[:6]) + "\n# " + " ".join(cut[6:]), "percent", 0), (6, "# %%\n" + " ".join(cut[:6]) + "\n# Out: " + " ".join(cut[6:]), "percent", 0),
        (7, None, "ipynb", 0), (8, "", None, 0), (9, "{broken " + LONG, "ipynb", 0), (10, "short caféx", "listing", 0), (10, "short café", None, 0), (10, "short café", None, 0), (11, "z " * 300_000 + LONG, "listing", 0),
    ]
    got = sorted(tuple(r) for r in L.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=block).collect())
    assert got == [(1, 1), (1, 2), (4, 1), (4, 2), (4, 3), (5, 1), (5, 2), (9, 1), (9, 2), (10, 3), (11, 1), (11, 2)]


def test_offsets_point_into_the_cell():
    machine = L.Automaton([(1, LONG)])
    rnd = random.Random(2)
    for _ in range(200):
        noise = lambda n: "".join(rnd.choice(["ab ", "é", "é ", "ﬁ ", "­", "\n", "日本 ", "İ ", "x"]) for _ in range(n))
        body = rnd.choice([" ", " ", " ​ "]).join(w.upper() if rnd.random() < 0.2 else w for w in LONG.split())
        before = noise(rnd.randrange(20))
        text = f"{before} {body} {noise(rnd.randrange(20))}"
        ((item, a, z, n, _),) = L.spans_in(machine, text)
        assert (item, n) == (1, 14) and (text[a:z] == body or (a, z) == (0, len(text)))
    assert L.spans_in(machine, " ".join(LONG.split()[:11])) == []


@pytest.mark.parametrize("odd", ["ΟΔΟΣ", "각", "ΣΑΣ'Σ", "ｶﾞ", "İΣ", "e\u0301"])
def test_one_odd_character_does_not_cost_the_offsets(odd):
    machine = L.Automaton([(1, LONG)])
    for text, body in ((f"{odd} x. {LONG}! {odd}", LONG), (f"{odd} {LONG.replace('seven', 'sev\u00aden')}, z", LONG.replace("seven", "sev\u00aden"))):
        ((item, a, z, n, _),) = L.spans_in(machine, text)
        assert (item, n, text[a:z]) == (1, 14, body)
    ((_, a, z, _, _),) = L.spans_in(L.Automaton([(1, f"{odd} end {odd}")]), f"so {odd} end {odd}.")
    assert (a, z) == (3, 8 + 2 * len(odd))


def test_words_of_any_characters_have_offsets():
    rnd = random.Random(6)
    pool = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs", "Lo")] + [chr(c) for c in (*range(0x1100, 0x1200), *range(0x900, 0xDFF), 0x3A3, 0x3C3, 0x130, 0xAC00, 0xAC01)]
    for _ in range(3000):
        text = "".join(rnd.choice(rnd.choice((pool, "aΣσ '.é\u0301ᄀ\u1161\u11a8ﾞｶ\u09c7\u09be\u00ad"))) for _ in range(rnd.randrange(1, 25)))
        spans = L.word_spans(text)
        assert len(spans) == len(L.words_of(text)) and all(0 <= a < z <= len(text) for a, z in spans)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, LONG, "a")], ITEMS)
    assert L.find_leaks(docs, items).count() == 0
    one = spark.createDataFrame([(1, LONG, None, 0)], DOCS)
    assert L.find_leaks(one, items.limit(0)).count() == 0 and L.leak_spans(one, items).count() == 1


def test_cells_of_each_form():
    got = read_cells("lead\r\nIn [3]:\rx = 1\nOut[3]:\n1\n2\n\n[text]\n# T\n", "listing")
    assert [(c.kind, c.source, c.outputs) for c in got] == [("other", "lead", []), ("code", "x = 1", ["1\n2\n"]), ("text", "# T\n", [])]
    got = read_cells("# %%\nx\n# Out: a\n# b\n# Out: c\n\n# %% [markdown]\n# # T\n# \n# u", "percent")
    assert [(c.kind, c.source, c.outputs) for c in got] == [("code", "x", ["a\nb", "c\n"]), ("text", "# T\n\nu", [])]
    assert read_cells(" \n", "ipynb") == [] and read_cells("{}", "ipynb")[0].kind == "other"


def test_answers_are_carried_beside_their_passage(spark):
    items = spark.createDataFrame([(1, "x", LONG, "Forty Two"), (2, "x", LONG, None), (3, "x", LONG, "")], "item_id bigint, benchmark string, passage string, answer string")
    near, far = f"[text]\n{LONG} Answer: forty-two!", f"[text]\n{LONG} " + "word " * 30 + "forty two"
    docs = spark.createDataFrame([(1, near, "listing"), (2, far, "listing"), (3, f"[text]\n{LONG}", "listing")], "doc_id bigint, text string, nb_format string")
    got = {(r.doc_id, r.item_id): r.with_answer for r in L.leak_spans(docs, items).collect()}
    assert got == {(d, i): (d, i) == (1, 1) for d in (1, 2, 3) for i in (1, 2, 3)}
