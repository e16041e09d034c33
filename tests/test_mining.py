from __future__ import annotations

import random

import pytest

from weftspan.mining import diagram as D
from weftspan.mining.graph import Graph, all_connected, is_run_of, same_ring, way_avoiding
from weftspan.mining.loops import find_loops, graph_of, kill_edges, loop_parts
from weftspan.mining.structure import build, diagram_of, puml_of
from weftspan.schemas import START_EVENT

A, B, C, E, F, G, H, I = map(D.Act, "ABCEFGHI")
X = lambda *p: D.Block("XOR", [list(q) for q in p])
N = lambda *p: D.Block("AND", [list(q) for q in p])
O = lambda *p: D.Block("OR", [list(q) for q in p])
L = lambda *p: D.Loop(list(p))
STOP, GONE = D.Stop("break"), D.Stop("detach")

DIAGRAMS = {
    "line": [A, B, C], "xor": [A, X([B], [C]), E], "and": [A, N([B], [C]), E], "or": [A, O([B], [C], [E]), F], "xor in and": [A, N([X([B], [C])], [E]), F], "and in xor": [A, X([N([B], [C])], [E]), F], "or in and": [A, N([O([B], [C])], [E]), F],
    "bunched xor": [A, X([X([B], [C]), E], [F]), G], "bunched and": [A, N([N([B], [C]), E], [F]), G], "nested after events": [A, X([B, N([C], [E]), F], [G]), H], "starts differ": [X([A], [B]), C], "starts together": [N([A], [B]), C],
    "detach": [A, X([B, GONE], [C]), E], "detach in and": [A, N([B, GONE], [C]), E], "loop": [A, L(B), C], "loop of three": [A, L(B, C, E), F], "loop in loop": [A, L(B, L(C), E), F], "xor in loop": [A, L(X([B], [C])), E], "and in loop": [A, L(B, N([C], [E]), F), G],
    "break": [A, L(B, X([C, STOP], [E])), F], "break after two": [A, L(B, X([C, E, STOP], [F]), G), H], "loop in xor": [A, X([L(B)], [C]), E], "two loops": [A, L(B), C, L(E), F], "branch": [D.Act("A", True), B], "branch before": [C, D.Act("A", True), B, E], "loop first": [L(A), B], "block after block": [A, X([B], [C]), N([E], [F]), G], "three blocks": [A, N([B], [C]), X([E], [F]), O([G], [H]), I], "block at the end of a path": [A, X([B, N([C], [E])], [F]), N([G], [H]), I], "blocks in loop": [A, L(X([B], [C]), N([E], [F])), G], "kill in loop": [A, L(B, N([C], [E, GONE]), F), G],
}


@pytest.mark.parametrize("name", DIAGRAMS)
def test_round_trip(name):
    want = DIAGRAMS[name]
    text = D.write(want, name)
    assert D.canonical(D.parse(text)) == D.canonical(want)
    got = diagram_of(D.model_of(D.runs(want), START_EVENT))
    if name in ("break after two", "detach", "detach in and", "kill in loop"):  # what follows may stand in the path or after the block
        assert D.model_of(D.runs(got), START_EVENT) == D.model_of(D.runs(want), START_EVENT)
    else:
        assert D.canonical(got) == D.canonical(want)


J, K, M, P, Q = map(D.Act, "JKMPQ")
#: Diagrams that need to know what was seen before an event, or that end paths within a block.
BEFORE = {
    "an event of its own in each path": [A, N([B, C], [E, C], [F, C]), G], "the same with a path that ends": [A, N([B, C], [E, C], [F, C], [H, GONE]), G], "the same in an or": [A, O([B, C], [E, C], [F, C]), G],
    "paths with a common tail": [A, X([B], [C, E, B]), F, G], "one path of a block goes on": [A, L(B, N([C], [E, GONE], [F, GONE]), G), H], "branch of a branch": [A, D.Act("B", True), D.Act("C", True), E],
    "what comes after the loop, also beside it": [A, L(J, N([B], [C], [H, I, K, GONE], [I, K, GONE]), E, F), G, H, I, K], "branch at the end of a loop": [A, L(D.Act("B", True)), C],
}


@pytest.mark.parametrize("name", BEFORE)
def test_structure_by_what_came_before(name):
    want = BEFORE[name]
    runs = D.runs(want) if name != "branch at the end of a loop" else D.runs([A, L(B), D.Act("B", True), C])
    got = diagram_of(D.model_of(runs, START_EVENT), D.before_of(runs))
    assert D.canonical(got) == D.canonical(want)


def test_loop_left_by_ways_of_which_one_leads_into_another():
    want = [A, L(B, X([C], [E, F, G, STOP], [F, G, STOP]))]
    runs = D.runs(want)
    got = diagram_of(D.model_of(runs, START_EVENT), D.before_of(runs))
    assert D.model_of(D.runs(got), START_EVENT) == D.model_of(runs, START_EVENT) and "break" in D.canonical(got)


@pytest.mark.parametrize("name", DIAGRAMS)
def test_order_of_data_plays_no_part(name):
    runs = D.runs(DIAGRAMS[name])
    want = puml_of(D.model_of(runs, START_EVENT))
    for seed in range(3):
        random.Random(seed).shuffle(runs)
        assert puml_of(D.model_of(runs, START_EVENT)) == want


def test_random_structures_keep_their_model():
    rnd = random.Random(9)

    def grow(depth, names):
        out = []
        for _ in range(rnd.randrange(1, 4)):
            out.append(D.Act(f"e{next(names)}"))
            if depth and rnd.random() < 0.5:
                kind = rnd.choice([X, N, O])
                out += [kind(*[grow(depth - 1, names) for _ in range(rnd.randrange(2, 4))]), D.Act(f"e{next(names)}")]
        return out

    for _ in range(40):
        want = grow(2, iter(range(1000)))
        if len(D.runs(want)) < 3000:
            assert D.canonical(diagram_of(D.model_of(D.runs(want), START_EVENT))) == D.canonical(want)


def test_equivalence():
    a, b = D.write([A, X([B], [C])]), D.write([A, X([C], [B])], "other")
    assert D.equivalent(a, b) and not D.equivalent(a, D.write([A, N([B], [C])])) and not D.equivalent(a, D.write([A, X([B], [C]), E]))
    assert D.equivalent("@startuml\n:A;\nif (XOR) then (true)\n:B;\nelse (false)\n#red:C;\nkill\nendif\n@enduml", D.write([A, X([B], [C, GONE])]))
    assert not D.equivalent(D.write([A, L(B, X([C, STOP], [E]))]), D.write([A, L(B, X([C], [E]))]))
    for bad in ("fork\n:A;", "endif", "while (x)", "fork\n:A;\nend split"):
        with pytest.raises(ValueError):
            D.parse(bad)


def test_simulated_events():
    events = D.events_of([A, N([B], [C]), E], "j")
    assert [(e["eventType"], len(e["previousEventIds"])) for e in events] == [("A", 0), ("B", 1), ("C", 1), ("E", 2)]
    assert len({e["jobId"] for e in D.events_of([A, X([B], [C])], "j")}) == 2


@pytest.mark.parametrize("name", ["xor in and", "or in and", "loop in loop", "break", "branch before", "detach in and", "three blocks"])
def test_runs_by_chance_leave_the_diagram_as_it_is(name):
    want, rnd = DIAGRAMS[name], random.Random(2)
    chance = [D.random_run(want, rnd) for _ in range(30)]
    every = D.runs(want)
    got = diagram_of(D.model_of([*every, *chance], START_EVENT), D.before_of([*every, *chance]))
    assert D.canonical(got) == D.canonical(diagram_of(D.model_of(every, START_EVENT), D.before_of(every)))
    assert len(D.events_of(want, more=5)) > len(D.events_of(want))


def test_loop_components_of_a_nested_graph():
    # entered at D, E, F; I and H lead back, and to each other
    g = Graph([("S", "D"), ("S", "E"), ("S", "F"), ("D", "G"), ("E", "G"), ("F", "G"), ("G", "H"), ("G", "I"), ("I", "F"), ("H", "E"), ("H", "D"), ("I", "H"), ("H", "I"), ("H", "O"), ("I", "O"), ("G", "M"), ("M", "O")])
    (nodes,) = g.components()
    p = loop_parts(nodes, g)
    assert nodes == set("DEFGHI") and p.starts == set("DEF") and p.ends == set("HI") and p.edges == {("I", "F"), ("H", "E"), ("H", "D")} and p.exits == set("GHI")
    sets = {a: {((b, 1),) for b in bs} for a, bs in g.succ.items()}
    flow = find_loops(sets)
    assert not graph_of(flow.sets).components() and list(flow.loops) == ["LOOP_1", "LOOP_2"] or len(flow.loops) == 1
    assert build(flow)


def test_names_like_loops_are_safe():
    items = [D.Act("LOOP_1"), L(D.Act("LOOPER")), D.Act("END")]
    assert D.canonical(diagram_of(D.model_of(D.runs(items), START_EVENT))) == D.canonical(items)


def test_graph_helpers():
    g = Graph([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")])
    assert way_avoiding(g, "a", "b", {"d"}) and not way_avoiding(g, "a", "c", {"d"}) and all_connected(g, {"a", "b"}, {"c"})
    assert same_ring([1, 2, 3], [3, 1, 2]) and not same_ring([1, 2], [1, 2, 3]) and is_run_of([2, 3], [1, 2, 3]) and not is_run_of([1, 3], [1, 2, 3])
    assert kill_edges(Graph([("a", "b"), ("b", "a"), ("a", "x")]), {"a", "b", "x"}, {"b"}, {"a"}) == {("a", "x")}
