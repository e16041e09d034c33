from __future__ import annotations

import itertools
import random
import subprocess
import sys
from base64 import b64encode

import duckdb
import pytest
from tokenizers import Tokenizer

from weftspan.llm import tokens
from weftspan.llm.queries import p6_ids, p6_round_trip

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def v():
    return tokens.Vocabulary.of(tokens.read_vocabulary(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def judge():
    t = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_all_documents_against_another_implementation(spark, judge):
    texts = dict(duckdb.sql(f"select doc_id, text from '{BASE}/documents.parquet'").fetchall())
    rows = {r.doc_id: r.ids for r in p6_ids(spark, BASE).collect()}
    assert rows.keys() == texts.keys()
    assert all(rows[i] == (judge(t) if t else []) for i, t in texts.items())


HARD = [
    "a" * 5000, "=" * 3001 + "'s", " " * 4000 + "x", "\n" * 3000, " \n" * 900 + "don't", "7" * 2500 + "abc", "é" * 1500 + "日本" * 900, "x'" * 700, "'re" * 500, "<|endoftext|>" * 60, "abc def " * 400,
    " " * 1000 + "q", "ab​cd" * 300, "\U0001f600" * 700, " " * 2000, "aA1 " * 300 + "'" * 999 + "ll", "\r\n" * 800 + "\t" * 900 + "end", "a" + " " * 1500 + "\n", "हिन्दी" * 300,
]


@pytest.mark.parametrize("block", [8, 64, 1000])
def test_blocks_of_every_size(v, judge, block):
    for text in HARD:
        assert tokens.encode(v, text, block) == judge(text)


def test_random_texts_and_chunks(v, judge):
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "the", " ", "  ", "\n", "'", "'s", "'ll", "'v", "1", "23", "=", "é", "日", "\u200b", "\U0001f600", "ing", "\u00a0"]) * rnd.choice([1, 1, 1, 2, 30]) for _ in range(rnd.randrange(1, 60)))
        cuts = sorted({0, len(text), *(rnd.randrange(len(text) + 1) for _ in range(4))})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        got = [i for ids in tokens.encode_stream(v, parts, rnd.choice([2, 5, 40])) for i in ids.tolist()]
        assert got == judge(text)
        assert "".join(tokens.decode_stream(v, got)) == text
        assert [x.tolist() for x in tokens.encode_all(v, [text, None, *parts], 50, 20)] == [judge(t or "") for t in [text, None, *parts]]


def plain_bpe(data, ids):
    """Merge the pair of least rank, the left one first, until no pair is a token."""
    parts = [bytes([x]) for x in data]
    while True:
        ranked = [(ids[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ids]
        if not ranked:
            return [ids[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_made_vocabularies_against_plain_merging():
    rnd = random.Random(3)
    for _ in range(25):
        ids = {bytes([x]): n for n, x in enumerate(b"abc")}
        while len(ids) < 30:  # as training does: join two tokens that BPE leaves side by side
            data = bytes(rnd.choice(b"abc") for _ in range(12))
            names = {i: b for b, i in ids.items()}
            at = plain_bpe(data, ids)
            j = rnd.randrange(max(1, len(at) - 1))
            if len(at) > 1:
                ids.setdefault(names[at[j]] + names[at[j + 1]], len(ids))
        v = tokens.Vocabulary.of(b"\n".join(b64encode(b) + b" %d" % i for b, i in ids.items()))
        assert v.lookahead < max(map(len, ids))
        for _ in range(60):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 200)))
            want = plain_bpe(data, ids)
            assert v.piece(data) == want
            t, got = tokens.PieceTransducer(v), []
            for i in range(0, len(data), 7):
                got += t.feed(data[i : i + 7]) + t._settled()
                assert got == want[: len(got)]  # what is emitted is final
            assert got + t.finish() == want


def test_no_other_encoder_takes_part():
    code = """
import sys
for name in ("tiktoken", "tokenizers", "sentencepiece"):
    sys.modules[name] = None
from weftspan.llm import tokens
v = tokens.Vocabulary.of(tokens.read_vocabulary(tokens.VOCABULARY))
print(tokens.encode(v, "plain text, isn't it?"))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert len(eval(out)) == 7


def test_piece_transducer_keeps_little(v, judge):
    t, most, out = tokens.PieceTransducer(v), 0, []
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdehilnorst") for _ in range(30_000))
    for i in range(0, len(text), 1000):
        out += t.feed(text[i : i + 1000].encode())
        most = max(most, len(t.last))
    assert out + t.finish() == judge(text) and most < 5 * (v.lookahead + 1)
    # after each byte little is open, and far less than the longest token
    t, kept = tokens.PieceTransducer(v), []
    for c in text[:2000].encode():
        t.feed(bytes([c]))
        t._settled()
        kept.append(len(t.last))
    assert sum(kept) / len(kept) < 20


def test_round_trip_and_undefined_texts(spark):
    assert p6_round_trip(spark, BASE).where("not same").count() == 0
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (3, " ", 5), (4, "y" * 200_000, 5)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    assert got[1] == got[2] == [] and got[3] == [220] and len(got[4]) > 0
    assert tokens.encode_texts(df).count() == 5 and tokens.encode_texts(df.limit(0)).count() == 0


def test_bytes_that_are_no_text(v):
    assert "".join(tokens.decode_stream(v, [v.bytes.index(b"\xe6"), v.bytes.index(b"a")])) == "�a"
