"""Token ids of whole texts by a byte-level BPE vocabulary, as a streaming transducer.

The vocabulary's merge list is turned into tables once, on the driver (:func:`build_tables`): how each token was merged,
and an automaton over all tokens that knows, for the bytes read so far, the longest token that ends there and the longest
proper prefix of a token that is still open. Tasks run the tables over the text; no other encoder takes part.

1. Text is read in blocks. :func:`pretoken_starts` finds where the split pattern begins a pre-token, by arithmetic on the
   kinds of characters. A place is settled ``LOOKAHEAD`` characters later (the longest contraction), so little more than
   one pre-token is held back; a run longer than a block goes on, open, into the next one.
2. :class:`PieceTransducer` reads a pre-token byte by byte. BPE has one last token for every prefix: the longest token
   that ends there and is compatible with the last token before it. What follows can only change tokens that reach into
   a prefix of a token still open, at most ``lookahead`` bytes back, and the automaton's state says how far. Tokens on
   which the chains from all places within that distance agree are final; they are emitted and only the rest is kept.
   Equal short pre-tokens of a task are read once.

Defined results
---------------
null or empty text   the empty list
special-token text   ordinary text
very long text       as any other, in memory that does not grow with it (but for its ids)
repeated rows        each encoded
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session that names the vocabulary file, and where the public ones are installed.
VOCABULARY_SETTING, VOCABULARY = "spark.weftspan.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters from its start that settle a match of the split pattern: the longest contraction.
LOOKAHEAD = 3
BLOCK = 1 << 16
#: Characters whose pre-tokens are found and told apart in one go.
UNIT = 1 << 19
#: A vocabulary is sent to every task; a larger file is refused.
VOCABULARY_BYTES = 32 << 20
#: Pre-tokens of up to so many bytes are remembered, up to so many of them.
MEMO_BYTES, MEMO_SIZE = 64, 500_000

LETTER, DIGIT, OTHER, SPACE = range(4)
_KINDS = {LETTER: regex.compile(r"\p{L}"), DIGIT: regex.compile(r"\p{N}"), SPACE: regex.compile(r"\s")}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return data


def build_tables(data: bytes) -> dict:
    """Tables of a vocabulary file: lines of a token in base64 and its rank.

    ``left``, ``right``: the two tokens a token is merged from, itself for single bytes, -1 for a token that no merging
    gives. ``pair``: (left, right) -> token. ``edges``, ``longest``, ``depth``: the automaton. ``shorter``: the longest
    token that properly ends a token. ``lookahead``: the length of the longest prefix of a token that is open at any time.
    """
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    size = max(ids.values(), default=-1) + 1
    v = Vocabulary({"bytes": [None] * size, "left": [-1] * size, "right": [-1] * size, "pair": {}})
    for b, i in ids.items():
        v.bytes[i] = b
    for i in sorted(ids.values()):
        b = v.bytes[i]
        if len(b) == 1:
            v.left[i] = v.right[i] = i
            continue
        for at in range(1, len(b)):
            x, y = ids.get(b[:at], size), ids.get(b[at:], size)
            if x < i and y < i and v.left[x] >= 0 and v.left[y] >= 0 and v.compatible(x, y):
                v.left[i], v.right[i] = x, y
                v.pair[x << 32 | y] = i
                break
    edges, ends, nodes = {}, [-1], 1
    for i, b in enumerate(v.bytes):
        if v.left[i] < 0:
            continue
        node = 0
        for c in b:
            node_to = edges.get(node << 8 | c)
            if node_to is None:
                node_to = edges[node << 8 | c] = nodes
                ends.append(-1)
                nodes += 1
            node = node_to
        ends[node] = i
    below: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
    for key, node in edges.items():
        below[key >> 8].append((key & 255, node))
    fail, longest, depth, shorter = [0] * nodes, list(ends), [0] * nodes, [-1] * size
    queue = [0]
    for node in queue:  # grows; by depth
        for c, to in below[node]:
            at = fail[node]
            while node and at and (at << 8 | c) not in edges:
                at = fail[at]
            fail[to] = edges.get(at << 8 | c, 0) if node else 0
            depth[to] = depth[node] + 1
            if ends[to] >= 0:
                shorter[ends[to]] = longest[fail[to]]
            else:
                longest[to] = longest[fail[to]]
            queue.append(to)
    # a token that is read whole and begins no other is not open
    open_depth = [d if below[i] else -1 for i, d in enumerate(depth)]
    for node in queue:
        if open_depth[node] < 0:
            open_depth[node] = open_depth[fail[node]]
    return {"bytes": v.bytes, "left": v.left, "right": v.right, "pair": v.pair, "edges": edges, "fail": fail, "longest": longest, "depth": open_depth, "shorter": shorter, "lookahead": max(open_depth)}


class Vocabulary:
    """The tables at work in one process."""

    def __init__(self, tables: dict) -> None:
        self.bytes, self.left, self.right, self.pair = tables["bytes"], tables["left"], tables["right"], tables["pair"]
        self.width = [len(b or b"") for b in self.bytes]
        self.edges, self.fail, self.longest, self.depth = (tables.get(x) for x in ("edges", "fail", "longest", "depth"))
        self.shorter, self.lookahead = tables.get("shorter"), tables.get("lookahead", 0)
        self.met: dict[int, bool] = {}
        self.memo: dict[bytes, list[int]] = {}

    @classmethod
    def of(cls, data: bytes) -> Vocabulary:
        return cls(build_tables(data))

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they meet.

        Merging is undone, latest first, on both sides of the boundary: two tokens that stood there at one time must
        not have been due for a merge before the one that came next.
        """
        before = 1 << 62  # the merge that took place next at the boundary
        while True:
            over = self.pair.get(a << 32 | b)
            if over is not None and over < before:
                return False
            single_a, single_b = self.left[a] == a, self.left[b] == b
            if single_a and single_b:
                return True
            if single_b or (not single_a and a > b):
                before, a = a, self.right[a]
            else:
                # of two merges of one rank the left one comes first
                before, b = b + 1, self.left[b]

    def read(self, data: bytes, last: list[int], state: int, start: int, base: int) -> int:
        """Append the last token of each prefix for more bytes; ``base`` is how many were read. Returns the state."""
        edges, fail, longest, shorter, width, met = self.edges, self.fail, self.longest, self.shorter, self.width, self.met
        n = base
        for c in data:
            n += 1
            to = edges.get(state << 8 | c)
            while to is None and state:
                state = fail[state]
                to = edges.get(state << 8 | c)
            state = to or 0
            token = longest[state]
            while True:
                begin = n - width[token]
                if begin > 0:
                    a = last[begin]
                elif begin == 0:
                    if start < 0:
                        break
                    a = start
                else:  # it reaches back behind what is final
                    token = shorter[token]
                    continue
                key = a << 32 | token
                good = met.get(key)
                if good is None:
                    if len(met) > 1_000_000:
                        met.clear()
                    good = met[key] = self.compatible(a, token)
                if good:
                    break
                token = shorter[token]
            last.append(token)
        return state

    def piece(self, data: bytes) -> list[int]:
        """Ids of a whole pre-token."""
        got = self.memo.get(data)
        if got is None:
            t = PieceTransducer(self)
            got = t.feed(data)
            got += t.finish()
            if len(data) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_SIZE:
                    self.memo.clear()
                self.memo[data] = got
        return got


class PieceTransducer:
    """Encodes one pre-token of any length, byte by byte."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.last: list[int] = [-1]  # last token of each prefix not emitted; [0] is the emitted boundary
        self.start = -1  # the token before the boundary, -1 at the start of the piece
        self.state = 0

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), 4096):
            self.state = self.v.read(data[i : i + 4096], self.last, self.state, self.start, len(self.last) - 1)
            if len(data) > 4096:
                out += self._settled()
        if data and len(data) <= 4096 and len(self.last) > 4 * (self.v.lookahead + 1):
            out += self._settled()
        return out

    def _chain(self, end: int) -> list[int]:
        """Token ends of the encoding of the prefix that ends here, from last to first."""
        out, width, last = [], self.v.width, self.last
        while end > 0:
            out.append(end)
            end -= width[last[end]]
        return out

    def _emit(self, ends: list[int]) -> list[int]:
        ids = [self.last[e] for e in ends]
        if ends:
            self.start = self.last[ends[-1]]
            self.last = [-1, *self.last[ends[-1] + 1 :]]
        return ids

    def _settled(self) -> list[int]:
        """The final encoding has a boundary here or where an open prefix of a token begins: emit what all chains share."""
        n = len(self.last) - 1
        begins, state = [n], self.state
        while (open_ := self.v.depth[state]) > 0:
            if open_ >= n:
                return []
            begins.append(n - open_)
            # the next shorter open prefix
            at = state
            while self.v.depth[at] >= open_:
                at = self.v.fail[at]
            state = at
        common: set[int] | None = None
        for end in begins:
            chain = set(self._chain(end))
            common = chain if common is None else common & chain
        return self._emit(sorted(common or ()))

    def finish(self) -> list[int]:
        return self._emit(self._chain(len(self.last) - 1)[::-1])


_kind_table: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Kind of every character; made once per process."""
    if not _kind_table:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, p in _KINDS.items():
            table[np.frombuffer("".join(p.findall(every)).encode("utf-32-le"), np.uint32)] = kind
        _kind_table.append(table)
    return _kind_table[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pretoken_starts(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts that follow one another; ``heads`` are the first characters of the texts.

    The split pattern: the contractions 's 't 're 've 'm 'll 'd; runs of letters, of digits, or of other marks, each with
    one space before it; spaces, of which the last one before something else stands apart.
    """
    n = codes.size
    kind = _kinds()[codes]
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    starts = head.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    ink = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:n]) + 1
    starts[ink - 1] = True
    starts[ink[codes[ink - 1] == 32]] = False
    mark = np.flatnonzero((codes == 39) & starts[:n])
    if mark.size:
        at = lambda d: np.where(mark + d < n, codes[np.minimum(mark + d, n - 1)], 0)
        end_of = np.searchsorted(np.flatnonzero(head), mark, side="right")
        room = np.flatnonzero(head)[end_of] - mark  # characters up to the end of the text
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"]) & (room >= 2)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (room >= 3)
        starts[mark[short | long] + 1] = False
        starts[mark[short] + 2] = True
        starts[mark[long] + 3] = True
    return np.flatnonzero(starts[:n])


def _ids_of_pieces(v: Vocabulary, codes: np.ndarray, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive pre-tokens, and how many each has. Each distinct one is read once."""
    sizes = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    offsets = np.append(at[starts], at[-1]).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())]).dictionary_encode()
    ids = [v.piece(p) for p in pieces.dictionary.to_pylist()]
    width = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(width.sum()))
    code = pieces.indices.to_numpy()
    often = width[code]
    first = (np.cumsum(width) - width)[code]
    return flat[np.repeat(first - (np.cumsum(often) - often), often) + np.arange(often.sum())], often


def encode_whole(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """Ids of texts that are at hand whole."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    heads = np.cumsum(lengths) - lengths
    codes = _codes(joined)
    if not codes.size:
        return [np.empty(0, np.int32) for _ in texts]
    starts = pretoken_starts(codes, np.unique(heads[lengths > 0]))
    ids, often = _ids_of_pieces(v, codes, joined, starts)
    ends = np.append(0, np.cumsum(often))[np.searchsorted(starts, np.append(heads, codes.size))]
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


def encode_stream(v: Vocabulary, chunks: Iterable[str], block: int = BLOCK) -> Iterator[np.ndarray]:
    """Ids of the text that the chunks make up, in parts, each as soon as it is final."""
    block = max(block, 2 * LOOKAHEAD)
    buffer, piece, kind, held = "", None, OTHER, ""
    for chunk in chunks:
        if not chunk:
            continue
        if piece is not None:  # a run longer than a block is open
            kinds = _kinds()[_codes(chunk)]
            run = int(np.argmax(kinds != kind)) if (kinds != kind).any() else len(chunk)
            if run:
                text = held + chunk[:run]
                # the last space may belong to what follows
                text, held = (text[:-1], text[-1:]) if kind == SPACE else (text, "")
                yield np.array(piece.feed(text.encode()), np.int32)
            if run == len(chunk):
                continue
            yield np.array(piece.finish(), np.int32)
            piece, chunk, held = None, held + chunk[run:], ""
        buffer += chunk
        while len(buffer) >= block:
            codes = _codes(buffer)
            starts = pretoken_starts(codes, np.zeros(1, np.int64))
            settled = starts[starts <= len(buffer) - LOOKAHEAD]
            cut = int(settled[-1])
            if cut:
                yield _ids_of_pieces(v, codes[:cut], buffer[:cut], settled[:-1])[0]
                buffer = buffer[cut:]
                continue
            if starts.size > 1:  # a few characters more will settle it
                break
            kind = int(_kinds()[codes[-1]])
            text, buffer = buffer, ""
            if kind == SPACE:
                text, held = text[:-1], text[-1]
            piece = PieceTransducer(v)
            yield np.array(piece.feed(text.encode()), np.int32)
    if piece is not None:
        yield np.array(piece.feed(held.encode()) + piece.finish(), np.int32)
    if buffer:
        yield encode_whole(v, [buffer])[0]


def encode(v: Vocabulary, text: str | None, block: int = BLOCK) -> list[int]:
    parts = encode_stream(v, ((text or "")[i : i + block] for i in range(0, len(text or ""), block)), block)
    return [i for ids in parts for i in ids.tolist()]


def encode_all(v: Vocabulary, texts: Iterable[str | None], block: int = BLOCK, unit: int = UNIT) -> Iterator[np.ndarray]:
    """Ids of each text, in order. Texts that one block holds are read several at a time; their blocks end with them."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if len(text) < block:
            held.append(text)
            size += len(text)
            if size < unit:
                continue
        yield from encode_whole(v, held)
        held, size = [], 0
        if len(text) >= block:
            yield np.concatenate([np.empty(0, np.int32), *encode_stream(v, (text[i : i + block] for i in range(0, len(text), block)), block)])
    yield from encode_whole(v, held)


def decode_stream(v: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text of the ids, each part as soon as its characters are whole; bytes that are no text give U+FFFD."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if part := state.decode(v.bytes[i]):
            yield part
    if part := state.decode(b"", True):
        yield part


_built: dict[int, dict] = {}
_loaded: dict[tuple, Vocabulary] = {}


def _tables(spark: SparkSession, path: str | None) -> dict:
    """Tables of the vocabulary file, made once in the driver's process."""
    data = read_vocabulary(path or spark.conf.get(VOCABULARY_SETTING, VOCABULARY))
    if hash(data) not in _built:
        _built[hash(data)] = build_tables(data)
    return _built[hash(data)]


def _vocabulary(tables: dict) -> Vocabulary:
    """One per worker process, which keeps what it learned; read anew for another vocabulary."""
    key = (len(tables["bytes"]), tables["lookahead"], len(tables["edges"]), hash(tuple(tables["left"])))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(tables)
    return _loaded[key]


def encode_texts(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, block: int = BLOCK, rows: int = 256) -> DataFrame:
    """(key, ids) of every row. One pass, no shuffle; ``rows`` texts are held as Arrow data at a time."""
    tables = df.sparkSession.sparkContext.broadcast(_tables(df.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(tables.value)
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                ids = list(encode_all(v, (t.as_py() for t in part.column(1)), block))
                offsets = pa.array(np.append(0, np.cumsum([x.size for x in ids])), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))], names=[key, "ids"])

    picked = df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"`{key}` bigint, ids array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; null lists give null."""
    tables = df.sparkSession.sparkContext.broadcast(_tables(df.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(tables.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else "".join(decode_stream(v, x)) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` bigint, text string")
