"""Subject areas of notebooks from topic models.

Each notebook's own cells (text and code, not outputs) become bags of terms; runs that quote an evaluation passage are
left out, and so are cells that still paraphrase one. Latent Dirichlet allocation is fitted to all notebooks by
variational Bayes, one distributed pass an iteration: tasks infer topic proportions of their notebooks in vectorised
batches and emit sufficient statistics per term, which are summed by term; only tables of terms by topics meet the driver.

1. Free topics, twice as many as subjects. No subject takes part in the fit: it starts from anchor terms, those whose
   company (the terms they occur with, in a random projection) is least explained by that of the anchors before them.
   Terms whose company is everybody's are left out.
2. Topics are mapped to subjects through their top terms: :data:`INSPECTED` records, for each subject, terms that were
   read off the top of fitted topics and judged by hand; the words of the subjects' descriptions are added. A topic whose
   top terms speak of several subjects, or of none, is mapped to none.
3. By the topic proportions of the notebooks each term's subjects are known. Terms that notebooks of all subjects use
   alike are dropped, and a second model, with background topics besides, is fitted to the rest and mapped in the same way.
4. The terms of each cell are shared among topics given the proportions of its notebook and folded to subjects; a
   notebook is about a subject that claims at least two of its cells.

Defined results
---------------
null, empty or blank text          no subject
cell without vocabulary terms      about nothing
cell whose terms are divided       about the subject with at least ``share`` of its subject terms, otherwise none
fewer than ``least`` such terms    about nothing: a passing mention
repeated documents                 the notebook's subjects once
subject that no topic is mapped to that subject is never assigned
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm import leakage
from weftspan.llm.notebooks import read_cells
from weftspan.runtime import cut

#: Vocabulary: terms that this share of notebooks hold at least and at most. The first bounds the model's size too: a corpus has no
#: more such terms than the mean of a notebook's distinct terms over the share, whatever the number of notebooks.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0005, 0.4, 3
TOPICS_A_SUBJECT, FREE_PASSES, BACKGROUND, PASSES, INNER, ALPHA, ETA = 2, 3, 4, 4, 8, 0.05, 0.01
#: Width of the random projection of a term's company; least distance of a company from the mean one, relative to its length,
#: at which a term takes part in the first model; share of notebooks that an anchor is in.
PROJECTION, UNLIKE, ANCHOR_SHARE = 64, 0.6, 0.003
#: Top terms of a topic that are looked at, how many must speak for its subject, and their share among those that speak for any.
TOP_TERMS, TOP_LEAST, TOP_SHARE = 40, 2, 0.8
#: Terms read off the top of fitted topics and judged by hand to belong to one subject.
INSPECTED = {
    "law": "verdict statute tribunal plaintiff appeal precedent injunction testimony clause_len court_level case_docket damages_awarded",
    "medicine": "patient dosage placebo surgeon biopsy fever vaccine lesion anaesthetic remission dose_mg bp_systolic triage_score ward_id",
    "sport": "striker referee league tournament penalty marathon coach sprint offside athletic season_points lap_time shots_on_goal team_elo",
    "finance": "portfolio dividend bond equity hedge liquidity ledger fiscal leveraged spread_bps loan_amount coupon_rate close_price log_return",
    "astronomy": "galaxy orbit pulsar asteroid eclipse lunar interstellar luminous comet orbit_period transit_depth flux_jy star_mag redshift_z",
    "chemistry": "solvent catalyst titration polymer molarity reagent electrolyte distillate precipitate absorbance_nm bond_angle molar_mass ph_value",
    "ecology": "habitat pollinator wetland canopy seedling species invasive migratory endangered biomass_kg plot_transect nest_id species_count",
    "software": "compiler deadlock bytecode immutable parser recursive idempotent asynchronous deprecated lint_errors build_ms commit_sha heap_mb",
    "music": "melody chord syncopated timbre choral percussion harmonic choir acoustic loudness_db chord_label tempo_bpm chroma_vec pitch_hz",
    "cooking": "dough simmer sourdough savoury fermented seasoning oven buttery crispy salt_pct flour_g proof_minutes recipe_id oven_temp",
    "transport": "tram freight ferry runway junction outbound delayed arterial congested delay_min boardings stop_seq route_no axle_load",
    "history": "dynasty treaty medieval feudal crusade archaeological imperial peasantry archive siege_days folio_no treaty_id census_year",
}
#: Divergence (nats) of a term's subjects from all terms' at which it is kept for the second model.
DIVERGENCE = 0.4
LEAST_TERMS, SHARE, CELLS = 0.75, 0.5, 2
#: Words of a run, and share of a cell's words that end such a run, by which a cell paraphrases evaluation passages.
ECHO_WORDS, ECHO_SHARE = 4, 0.1
#: Words that a cell must have besides its quotations to be about something.
LEAST_REST = 6

_TERM, _CAMEL = re.compile(r"\w+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Split(dict):
    """The terms of each token seen so far."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        out = self[token] = self.of(token)
        return out

    @staticmethod
    def of(token: str) -> tuple[str, ...]:
        if token[0].isdigit():
            return ()
        if "_" in token or token.islower():
            return (token.lower(),) if len(token) > 1 else ()
        return tuple(p.lower() for p in _CAMEL.split(token) if len(p) > 1)


_split = _Split()


def terms_of(text: str) -> list[str]:
    """Words of two letters or more, and joined identifiers as a whole."""
    return [w for t in _TERM.findall(text) for w in _split[t]]


def known_terms(words: list[str], terms: dict[str, int]) -> Iterator[int]:
    """Ids of the words; of a joined identifier that is no term itself, of its parts."""
    for w in words:
        if (i := terms.get(w)) is not None:
            yield i
        elif "_" in w:
            yield from (i for p in w.split("_") if (i := terms.get(p)) is not None)


class Quotes:
    """Tells quotations of evaluation passages."""

    def __init__(self, blocks: list[list[tuple[int, str]]]) -> None:
        self.runs = [leakage.Automaton(b) for b in blocks]
        self.echoes = [leakage.Automaton(b, ECHO_WORDS) for b in blocks]

    def _echo(self, text: str) -> float:
        words = leakage.words_of(text)
        return len({end for m in self.echoes for end, _, _ in m.scan(words)}) / max(1, len(words))

    def without(self, text: str) -> str:
        """The text without what it quotes; nothing if the rest still paraphrases."""
        if not self._echo(text):
            return text
        spans = sorted((a, z) for m in self.runs for _, a, z, *_ in leakage.spans_in(m, text))
        out, at = [], 0
        for a, z in spans:
            out.append(text[at : max(a, at)])
            at = max(at, z)
        rest = " ".join([*out, text[at:]])
        little = spans and len(leakage.words_of(rest)) < LEAST_REST
        return "" if little or self._echo(rest) >= ECHO_SHARE else rest


_held: dict[int, Quotes] = {}


def _quotes(blocks: list[list[tuple[int, str]]]) -> Quotes:
    """One per worker process."""
    key = hash(tuple(map(tuple, blocks)))
    if key not in _held:
        _held.clear()
        _held[key] = Quotes(blocks)
    return _held[key]


def cell_terms(docs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, cells): for each notebook the terms of each of its own cells, in order."""
    blocks = list(leakage.item_blocks(items)) if items is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = _quotes(blocks)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cells = [[terms_of(quotes.without(c.source)) for c in read_cells(t.as_py(), f.as_py())] for t, f in zip(part.column(1), part.column(2))]
                flat = [c for doc in cells for c in doc]
                offsets = lambda lists: pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32())
                lists = pa.ListArray.from_arrays(offsets(flat), pa.array([w for c in flat for w in c], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets(cells), lists)], names=["doc_id", "cells"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("nb_format").cast("string").alias("nb_format"))
    return rows.mapInArrow(run, "doc_id bigint, cells array<array<string>>")


def vocabulary(cells: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> dict[str, int]:
    """Terms by their document frequency over all notebooks, which is counted exactly."""
    n = cells.where("size(cells) > 0").count()
    counted = cells.select(F.explode(F.array_distinct(F.flatten("cells"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where((F.col("n") >= max(least_docs, least_share * n)) & (F.col("n") <= max(least_docs, most_share * n)))
    rows = sorted(kept.collect(), key=lambda r: (-r.n, r.term))  # sorting by Spark would count everything twice, to find its ranges
    return {r.term: i for i, r in enumerate(rows)}


def index_terms(cells: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, cell, term, n): parallel arrays for each notebook, sorted by cell and term.

    Each distinct word of a batch is looked up once; the rest is arithmetic on its code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1)
            lists = rows.flatten()
            words = lists.flatten().dictionary_encode()
            ids = [list(known_terms([w], terms)) for w in words.dictionary.to_pylist()]
            width = np.array([len(x) for x in ids], np.int64)
            flat, first = np.array([i for x in ids for i in x], np.int64), np.cumsum(width) - width
            code = words.indices.to_numpy()
            cell_sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            row_sizes = np.diff(rows.offsets.to_numpy())
            row_of_cell = np.repeat(np.arange(len(row_sizes)), row_sizes)
            cell_no = np.arange(len(row_of_cell)) - np.repeat(np.cumsum(row_sizes) - row_sizes, row_sizes)
            cell_of_word = np.repeat(np.arange(len(cell_sizes)), cell_sizes)
            often = width[code]
            at = np.repeat(first[code] - (np.cumsum(often) - often), often) + np.arange(often.sum())
            keys, n = np.unique(np.repeat(cell_of_word, often) * max(1, len(terms)) + flat[at] if at.size else np.empty(0, np.int64), return_counts=True)
            cell, term = keys // max(1, len(terms)), keys % max(1, len(terms))
            yield _parallel(b.column(0), row_of_cell[cell], len(row_sizes), cell_no[cell], term, n)

    return cells.mapInArrow(run, "doc_id bigint, cell array<int>, term array<int>, n array<int>")


def _parallel(docs: pa.Array, row: np.ndarray, rows: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Entries sorted by row as lists per row."""
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32())
    return pa.RecordBatch.from_arrays([docs, *(pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in columns)], names=["doc_id", "cell", "term", "n"])


def keep_terms(indexed: DataFrame, keep: np.ndarray) -> DataFrame:
    """Only the entries of kept terms, which are numbered anew."""
    new = np.cumsum(keep) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, term, n = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            sizes = np.diff(b.column(2).offsets.to_numpy())
            row, held = np.repeat(np.arange(len(sizes)), sizes), keep[term]
            yield _parallel(b.column(0), row[held], len(sizes), cell[held], new[term[held]], n[held])

    return indexed.mapInArrow(run, "doc_id bigint, cell array<int>, term array<int>, n array<int>")


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


@dataclass
class Bags:
    """A batch of notebooks: for each entry its row, term and count; ``begins`` are the first entries of rows with any."""

    rows: np.ndarray
    term: np.ndarray
    n: np.ndarray
    begins: np.ndarray
    filled: np.ndarray
    size: int


def _bags(batch: pa.RecordBatch) -> Bags:
    lists = batch.column(batch.schema.get_field_index("term"))
    lengths = np.diff(lists.offsets.to_numpy())
    filled = np.flatnonzero(lengths)
    begins = (np.cumsum(lengths) - lengths)[filled]
    n = batch.column(batch.schema.get_field_index("n")).flatten().to_numpy().astype(np.float32)
    return Bags(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(), n, begins, filled, len(lengths))


def infer(bags: Bags, weights: np.ndarray, inner: int = INNER, alpha: float = ALPHA, group: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Topic proportions (in the exponent) of each notebook, and each entry's shares among topics.

    ``weights``: (terms, topics), the exponent of the expected log probabilities. Notebooks of like length are taken
    ``group`` at a time, padded to one length, so that each step is two products of matrices.
    """
    k = weights.shape[1]
    expected = lambda gamma: np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
    theta = np.repeat(expected(np.full((1, k), alpha, np.float32)), bags.size, axis=0)
    lengths = np.append(bags.begins[1:], bags.term.size) - bags.begins if bags.begins.size else bags.begins
    order = np.argsort(lengths, kind="stable")
    for i in range(0, order.size, group):
        docs = order[i : i + group]
        inside = np.arange(lengths[docs[-1]])[None, :] < lengths[docs][:, None]
        at = np.where(inside, bags.begins[docs][:, None] + np.arange(inside.shape[1])[None, :], 0)
        w, n = weights[bags.term[at]], np.where(inside, bags.n[at], 0).astype(np.float32)
        mine = np.full((docs.size, k), 1 / k, np.float32)
        for _ in range(inner):
            norm = np.matmul(w, mine[:, :, None])[:, :, 0] + 1e-30
            mine = expected(alpha + mine * np.matmul((n / norm)[:, None, :], w)[:, 0, :])
        theta[bags.filled[docs]] = mine
    share = weights[bags.term] * theta[bags.rows]
    share /= share.sum(axis=1, keepdims=True) + 1e-30
    return theta, share


def _slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = b.slice(i, size)
            if part.num_rows:
                yield pa.Table.from_batches([part]).combine_chunks().to_batches()[0]


def _sum_by_term(indexed: DataFrame, emit, n_terms: int, width: int) -> np.ndarray:
    """Sum over all notebooks of what ``emit`` adds to a (terms, width) table; each task emits its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_terms, width), np.float64)
        for b in _slices(batches):
            emit(_bags(b), total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[used, j]) for j in range(width)]], names=["term", *[f"w{j}" for j in range(width)]])

    rows = indexed.select("term", "n").mapInArrow(run, "term int, " + ", ".join(f"w{j} double" for j in range(width)))
    got = rows.groupBy("term").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(width)]).toPandas()
    out = np.zeros((n_terms, width))
    if len(got):
        out[got["term"].to_numpy()] = got[[f"w{j}" for j in range(width)]].to_numpy()
    return out


def subject_words(subjects: list[tuple[str, str]], inspected: dict[str, str] = INSPECTED) -> dict[str, set[str]]:
    """Terms that speak for each subject: inspected ones and those of its description; what several subjects have is dropped."""
    words = {s: {*terms_of(f"{s} {d or ''}"), *inspected.get(s, "").split()} for s, d in subjects}
    uses = Counter(w for ws in words.values() for w in ws)
    return {s: {w for w in ws if uses[w] == 1} for s, ws in words.items()}


def _weights(table: np.ndarray) -> np.ndarray:
    if not table.size:
        return table.astype(np.float32)
    return np.exp(digamma(table) - digamma(table.sum(axis=0, keepdims=True))).astype(np.float32)


@dataclass
class Company:
    """Of each term: the company it keeps (in projection, per occurrence), its occurrences and its notebooks."""

    means: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    def away(self) -> np.ndarray:
        """Company less the mean company, in units of the latter's length."""
        mean = self.n @ self.means / max(self.n.sum(), 1)
        return (self.means - mean) / max(float(np.linalg.norm(mean)), 1e-9)


def companies(indexed: DataFrame, n_terms: int, width: int = PROJECTION) -> Company:
    """One pass over all notebooks. Each term has a random direction; a term's company is the mean of the other terms of its notebooks."""
    directions = np.random.default_rng(7).standard_normal((n_terms, width)).astype(np.float32)

    def step(b: Bags, total: np.ndarray) -> None:
        own, size = np.zeros((b.size, width), np.float32), np.zeros(b.size, np.float32)
        if b.begins.size:
            own[b.filled] = np.add.reduceat(directions[b.term] * b.n[:, None], b.begins, axis=0)
            size[b.filled] = np.add.reduceat(b.n, b.begins)
        share = b.n / np.maximum(size[b.rows] - 1, 1)
        _add(total, b.term, np.concatenate([(own[b.rows] - directions[b.term]) * share[:, None], b.n[:, None], np.ones((b.term.size, 1), np.float32)], axis=1))

    got = _sum_by_term(indexed, step, n_terms, width + 2)
    return Company(got[:, :-2] / np.maximum(got[:, -2:-1], 1), got[:, -2], got[:, -1])


def anchor_terms(away: np.ndarray, allowed: np.ndarray, topics: int) -> list[int]:
    """Terms whose company is farthest from what the anchors before them span."""
    at, out = np.flatnonzero(allowed), []
    rest = away[at].copy()
    for _ in range(min(topics, at.size)):
        lengths = (rest**2).sum(axis=1)
        best = int(lengths.argmax())
        if lengths[best] < 1e-12:
            break
        out.append(int(at[best]))
        along = rest[best] / np.sqrt(lengths[best])
        rest -= np.outer(rest @ along, along)
    return out


def anchored_table(company: Company, topics: int, least_docs: float) -> np.ndarray:
    """(terms, topics) to start from: each term's occurrences go to the anchors whose company is like its own."""
    away = company.away()
    anchors = anchor_terms(away, company.docs >= least_docs, topics)
    if not anchors:
        return np.full((len(company.n), 1), ETA) + company.n[:, None]
    turned = away / (np.linalg.norm(away, axis=1, keepdims=True) + 1e-9)
    like = np.exp(8 * turned @ turned[anchors].T)
    return like / like.sum(axis=1, keepdims=True) * company.n[:, None] + ETA


def fit_topics(indexed: DataFrame, table: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Variational Bayes from the given (terms, topics) table; every pass goes over all notebooks."""
    for _ in range(passes):
        weights = _weights(table)

        def step(b: Bags, total: np.ndarray, weights: np.ndarray = weights) -> None:
            _, shares = infer(b, weights)
            _add(total, b.term, shares * b.n[:, None])

        table = _sum_by_term(indexed, step, *table.shape) + ETA
    return table


def fold_table(topics: list[str | None], names: list[str]) -> np.ndarray:
    """(topics, subjects): one where a topic is mapped to a subject."""
    return np.array([[t == s for s in names] for t in topics], np.float32).reshape(len(topics), len(names))


def subject_use(indexed: DataFrame, table: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(terms, subjects): in how many notebooks a term is, shared by what the notebooks are about."""
    weights = _weights(table)

    def step(b: Bags, total: np.ndarray) -> None:
        theta = infer(b, weights)[0] @ fold
        theta = theta / (theta.sum(axis=1, keepdims=True) + 1e-30)
        _add(total, b.term, theta[b.rows])

    return _sum_by_term(indexed, step, table.shape[0], fold.shape[1])


def telling(use: np.ndarray, least: float = DIVERGENCE) -> np.ndarray:
    """Whether a term's subjects diverge from all terms' by more than chance would have it for so few notebooks."""
    n = use.sum(axis=1)
    p = use / np.maximum(n, 1e-9)[:, None]
    base = use.sum(axis=0) / max(use.sum(), 1e-9)
    divergence = np.where(p > 0, p * np.log(np.maximum(p, 1e-12) / np.maximum(base, 1e-12)), 0).sum(axis=1)
    return divergence - (use.shape[1] - 1) / (2 * np.maximum(n, 1e-9)) >= least


def _add(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """total[at] += values, with repeats."""
    if not at.size:
        return
    # small codes are sorted by their digits
    order = np.argsort(at.astype(np.uint16) if len(total) <= 1 << 16 else at, kind="stable")
    at = at[order]
    begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    total[at[begins]] += np.add.reduceat(values[order], begins, axis=0)


def top_terms(table: np.ndarray, words: list[str], count: int = TOP_TERMS) -> list[dict[str, float]]:
    """The terms of each topic that are both frequent in it and its own, with their weights."""
    rank = table * (table / table.sum(axis=1, keepdims=True))
    return [{words[i]: float(rank[i, k]) for i in np.argsort(-rank[:, k], kind="stable")[:count]} for k in range(table.shape[1])]


def map_topics(tops: list[dict[str, float]], speaks: dict[str, set[str]], least: int = TOP_LEAST, share: float = TOP_SHARE) -> list[str | None]:
    """The subject of each topic that ``least`` of its top terms speak for, with ``share`` of the weight of all that speak for any."""
    out: list[str | None] = []
    for top in tops:
        weight = {s: sum(top[w] for w in ws if w in top) for s, ws in sorted(speaks.items())}
        best = max(weight, key=weight.get, default=None)
        sure = best is not None and weight[best] >= share * sum(weight.values()) and sum(w in top for w in speaks[best]) >= least
        out.append(best if sure else None)
    return out


def cell_claims(indexed: DataFrame, table: np.ndarray, topics: list[str | None], least: float = LEAST_TERMS, share: float = SHARE) -> DataFrame:
    """(doc_id, cell, subject, weight): the subject of each cell that has one, and the terms it claims there."""
    weights = _weights(table)
    names = sorted({t for t in topics if t})
    fold = fold_table(topics, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            bags = _bags(b)
            docs, cells, subjects, claimed = [], [], [], []
            if bags.term.size and names:
                _, shares = infer(bags, weights)
                mass = (shares * bags.n[:, None]) @ fold
                cell = b.column(b.schema.get_field_index("cell")).flatten().to_numpy()
                begins = np.flatnonzero(np.append(True, (np.diff(bags.rows) != 0) | (np.diff(cell) != 0)))
                per = np.add.reduceat(mass, begins, axis=0)
                best, total = per.argmax(axis=1), per.sum(axis=1)
                most = per[np.arange(len(begins)), best]
                hit = np.flatnonzero((most >= least) & (most >= share * total))
                ids = b.column(0).to_numpy()
                docs, cells = ids[bags.rows[begins[hit]]].tolist(), cell[begins[hit]].tolist()
                subjects, claimed = [names[i] for i in best[hit]], most[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cells, pa.int32()), pa.array(subjects, pa.string()), pa.array(claimed, pa.float64())], names=["doc_id", "cell", "subject", "weight"])

    return indexed.mapInArrow(run, "doc_id bigint, cell int, subject string, weight double")


@dataclass
class SubjectModel:
    """A fitted model: its terms, their table by topics, and the subject of each topic."""

    terms: dict[str, int]
    table: np.ndarray
    topics: list[str | None]


def fit_subjects(docs: DataFrame, subjects: DataFrame, items: DataFrame | None = None, inspected: dict[str, str] = INSPECTED) -> tuple[SubjectModel, DataFrame]:
    """The model, and the indexed cells it was fitted to."""
    cells = cut(cell_terms(docs, items))
    named = sorted((r.subject, r.description) for r in subjects.where("subject is not null").dropDuplicates(["subject"]).collect())
    names, speaks = [s for s, _ in named], subject_words(named, inspected)
    terms = vocabulary(cells)
    words = list(terms)
    indexed = cut(index_terms(cells, terms))
    company = companies(indexed, len(terms))
    special = np.linalg.norm(company.away(), axis=1) > UNLIKE
    own = keep_terms(indexed, special)
    of_own = Company(company.means[special], company.n[special], company.docs[special])
    least_docs = max(LEAST_DOCS, ANCHOR_SHARE * indexed.count())
    free = fit_topics(own, anchored_table(of_own, TOPICS_A_SUBJECT * len(names), least_docs), FREE_PASSES)
    mapped = map_topics(top_terms(free, [w for w, s in zip(words, special) if s]), speaks)
    use = np.zeros((len(terms), len(names)))
    use[special] = subject_use(own, free, fold_table(mapped, names))
    keep = telling(use) & special
    kept = {words[i]: j for j, i in enumerate(np.flatnonzero(keep).tolist())}
    # the background starts as a tenth of every term, told apart, and the same in every run
    spread = 1 + 0.1 * np.sin(np.outer(np.arange(1, len(kept) + 1), np.arange(1, BACKGROUND + 1)))
    start = np.concatenate([use[keep], 0.1 / BACKGROUND * use[keep].sum(axis=1, keepdims=True) * spread], axis=1)
    indexed = cut(keep_terms(indexed, keep))
    table = fit_topics(indexed, start + ETA)
    return SubjectModel(kept, table, map_topics(top_terms(table, list(kept)), speaks)), indexed


def index_cells(docs: DataFrame, model: SubjectModel, items: DataFrame | None = None) -> DataFrame:
    """Cells of any notebooks by the terms of a fitted model."""
    return index_terms(cell_terms(docs, items), model.terms)


def assign_subjects(model: SubjectModel, indexed: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, subject, n_cells) of every notebook; its cells are in one row, so nothing is shuffled but the result."""
    claims = cell_claims(indexed, model.table, model.topics)
    return claims.groupBy("doc_id", "subject").agg(F.count_distinct("cell").alias("n_cells")).where(F.col("n_cells") >= cells)
