from __future__ import annotations

import itertools

import pytest

from weftspan.mining.gates import infer, multiset, weighted_cover


def gate(*sets):
    g = infer({multiset(s) for s in sets})
    return g and g.text()


@pytest.mark.parametrize(("sets", "want"), [
    ([], None), (["A"], "A"), (["AB"], "AND(A,B)"), (["A", "B"], "XOR(A,B)"), (["BC", "DE"], "XOR(AND(B,C),AND(D,E))"), (["BC", "CD"], "AND(C,XOR(B,D))"),
    (["BC", "B", "C"], "OR(B,C)"), (["B", "C", "D", "BC", "BD", "CD", "BCD"], "OR(B,C,D)"), (["AB", "AC", "ABC"], "AND(A,OR(B,C))"), (["A", "BC", "ABC"], "OR(A,AND(B,C))"),
    (["BB"], "BRANCH(B)"), (["BBC", "BBBC"], "BRANCH(XOR(B,C))"), (["BBCC", "BC"], "BRANCH(AND(B,C))"), (["BB", "C"], "BRANCH(XOR(B,C))"),
    (["ABC", "ABD", "E"], "XOR(AND(A,B,XOR(C,D)),E)"),
])
def test_gates(sets, want):
    assert gate(*sets) == want


def test_and_under_or():
    groups = ["B", "CD", "EFG"]
    sets = ["".join(c) for n in (1, 2, 3) for c in itertools.combinations(groups, n)]
    assert gate(*sets) == "OR(AND(C,D),AND(E,F,G),B)"


def test_cover():
    f = frozenset
    assert weighted_cover({f("AB"), f("C"), f("ABC")}, set("ABC")) == {f("AB"), f("C")}
    assert weighted_cover({f("AB"), f("BC")}, set("ABC")) is None


def test_order_of_sets_plays_no_part():
    sets = ["AB", "BC", "CD", "A", "ABD"]
    assert len({gate(*p) for p in itertools.permutations(sets)}) == 1


def test_constant_counts_as_copies():
    from weftspan.mining.gates import with_copies

    sets = {(("B", 1), ("C", 2))}
    assert with_copies(infer(sets), sets).text() == "AND(B,C,C)"
    some = {(("C", 2),), (("C", 3),)}
    assert with_copies(infer(some), some).text() == infer(some).text()
