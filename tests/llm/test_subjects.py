from __future__ import annotations

import random

import numpy as np
import pytest

from weftspan.llm import subjects as S
from weftspan.llm.queries import p8_found, p8_label_agreement, p8_topics

BASE = "/root/testdata/sf0.01"
DOCS, AREAS, ITEMS = "doc_id bigint, text string, nb_format string, subject string", "subject string, description string", "item_id bigint, passage string"
WORDS = {s: [f"{s}{w}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()] for s in ("tennis", "law", "wine", "rail", "moss", "opera")}
QUESTION = "why would the umpire of lawalpha keep every lawbeta and lawgamma while lawdelta and lawzeta wait outside for laweta"


def sentence(rnd, subject, n=8):
    return " ".join(rnd.choice(WORDS[subject]) if rnd.random() < 0.5 else rnd.choice(["the", "plot", "of", "rows", "holds", "df"]) for _ in range(n)) + f" {WORDS[subject][rnd.randrange(10)]}"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(4)
    docs, want = [], set()
    for d in range(400):
        about = rnd.sample(sorted(WORDS), rnd.choice([1, 1, 2]))
        cells = [sentence(rnd, s) for s in about for _ in range(rnd.randrange(2, 6))]
        other = next(s for s in sorted(WORDS) if s not in about)
        if d % 5 == 0:
            cells.append(sentence(rnd, other))  # a passing mention
        if d % 7 == 0:
            cells += [f"> {QUESTION}", QUESTION.upper()]
        rnd.shuffle(cells)
        docs.append((d, "\n\n".join(f"[text]\n{c}" for c in cells), "listing", "x"))
        want |= {(d, s) for s in about}
    docs += [(900, None, None, "x"), (901, "", "listing", "x"), (902, "[text]\nplot the rows", "listing", None), (0, docs[0][1], "listing", "x")]
    areas = [*((s, f"{s.title()}alpha, {s}beta and the like") for s in WORDS), ("ghost", "Nothing known"), (None, "x"), ("void", None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(areas, AREAS), spark.createDataFrame([(1, QUESTION)], ITEMS), want


def test_made_corpus(made):
    docs, areas, items, want = made
    model, indexed = S.fit_subjects(docs, areas, items)
    assert sorted(t for t in model.topics if t) == sorted(WORDS)
    rows = [(r.doc_id, r.subject) for r in S.assign_subjects(model, indexed).collect()]
    assert {(r.doc_id, r.subject) for r in S.assign_subjects(model, S.index_cells(docs, model, items)).collect()} == set(rows)
    got = set(rows)
    assert len(rows) == len(got) and len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_labels_held_out(spark):
    rows = p8_label_agreement(spark, BASE).toPandas()
    assert rows["n_found"].sum() >= 0.9 * rows["n_labels"].sum()
    assert len(p8_topics(spark, BASE).where("subject is not null").select("subject").distinct().collect()) == 12
    found = [tuple(r) for r in p8_found(spark, BASE).collect()]
    assert len(found) == len(set(found)) > 500


def test_empty(spark, made):
    docs, areas, items, _ = made
    assert S.assign_subjects(*S.fit_subjects(docs.limit(0), areas, items)).count() == 0


def test_no_subject_takes_part_in_the_free_fit(spark, made):
    """The topics are there without any word of the subjects; mapping them is another step."""
    docs, areas, items, _ = made
    cells = S.cell_terms(docs, items)
    terms = S.vocabulary(cells)
    indexed = S.index_terms(cells, terms)
    company = S.companies(indexed, len(terms))
    special = np.linalg.norm(company.away(), axis=1) > S.UNLIKE
    table = S.fit_topics(S.keep_terms(indexed, special), S.anchored_table(S.Company(company.means[special], company.n[special], company.docs[special]), 12, 3), 3)
    tops = S.top_terms(table, [w for w, s in zip(terms, special) if s], 8)
    assert {s for s in WORDS for t in tops if sum(w.startswith(s) for w in t) >= 6} == set(WORDS)
    nothing = S.map_topics(tops, {s: set() for s in WORDS})
    assert nothing == [None] * len(tops)


def test_topics_of_several_subjects_are_mapped_to_none():
    speaks = {"a": {"a1", "a2", "a3"}, "b": {"b1", "b2", "b3"}}
    assert S.map_topics([{"a1": 3, "a2": 2, "x": 9}, {"a1": 3, "b1": 2, "b2": 2}, {"x": 1}, {"b1": 9}], speaks) == ["a", None, None, None]
    assert S.subject_words([("a", "One, two"), ("b", "Two and three")], {"b": "four"}) == {"a": {"one"}, "b": {"and", "three", "four"}}


def test_digamma_and_sums():
    x = np.array([0.05, 0.5, 1.0, 3.0, 50.0])
    assert np.allclose(S.digamma(x), [-20.49784479, -1.96351003, -0.57721566, 0.92278434, 3.90198967], atol=1e-6)
    total = np.zeros((4, 2))
    S._add(total, np.array([3, 1, 3]), np.array([[1, 2], [3, 4], [5, 6]]))
    assert total.tolist() == [[0, 0], [3, 4], [0, 0], [6, 8]]


def test_terms_and_quotes():
    assert list(S.terms_of("x1 = clean_row(orbitStep, ÉTOILE) 12ab")) == ["x1", "clean_row", "orbit", "step", "étoile"]
    q = S.Quotes([[(1, QUESTION)]])
    assert q.without("own words only") == "own words only"
    assert q.without(QUESTION) == "" and "lawalpha" not in q.without(f"{'my own text about something else entirely ' * 3} {QUESTION}")


def test_no_term_within_the_shares_is_dropped(spark):
    cells = spark.range(3).selectExpr("id as doc_id", "array(transform(sequence(1, 50010), i -> concat('t', i)), array('only' || id)) as cells")
    assert set(S.vocabulary(cells)) == {f"t{i}" for i in range(1, 50_011)}
