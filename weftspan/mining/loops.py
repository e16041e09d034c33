"""Loops of a workflow's model: cycles collapsed to loop events that hold the model of one iteration.

A strongly connected component of the directly-follows graph is entered at its start points and left from its exit
points. Its end points lead back to start points and to no other such point, other than mutually. Without the links
from end to start points it is one iteration; what leaves from other exits and joins the way after the loop again is
a break. Iterations are searched for loops in turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from weftspan.mining.gates import Multiset, multiset
from weftspan.mining.graph import Graph, entered_from_outside, followers_outside, with_links_into, with_links_out_of
from weftspan.schemas import DUMMY_BREAK_EVENT, END_EVENT, LOOP_EVENT, START_EVENT

Model = dict[str, set[Multiset]]


@dataclass
class LoopBody:
    """One iteration: a model from START to END, and the types after which it breaks off."""

    model: Workflow
    breaks: set[str] = field(default_factory=set)


@dataclass
class Workflow:
    """Followers of each type, without cycles, and the bodies of the loop events among them."""

    sets: Model
    loops: dict[str, LoopBody] = field(default_factory=dict)

    def graph(self) -> Graph:
        return graph_of(self.sets)


def graph_of(sets: Model) -> Graph:
    return Graph(((a, b) for a, seen in sets.items() for s in seen for b, _ in s), sets)


def types(s: Multiset) -> set[str]:
    return {t for t, _ in s}


def only(s: Multiset, kinds: set[str]) -> Multiset:
    return tuple((t, n) for t, n in s if t in kinds)


@dataclass
class Parts:
    """What a cyclic component is made of."""

    nodes: set[str]
    starts: set[str]
    ends: set[str]
    edges: set[tuple[str, str]]
    exits: set[str]


def loop_parts(nodes: set[str], g: Graph) -> Parts:
    starts = entered_from_outside(nodes, nodes, g) or {min(nodes)}
    back = with_links_into(nodes, starts, g)
    once = g.part(nodes)
    for a in nodes:
        for b in starts:
            once.cut(a, b)
    reach = {n: once.reach(n) for n in back}
    ends = {i for i in back if all((i in reach[j]) >= (j in reach[i]) for j in back)} or back
    return Parts(nodes, starts, ends, {(a, b) for a in ends for b in g.succ[a] & starts}, with_links_out_of(nodes, nodes, g))


def _free_name(taken: set[str], prefix: str) -> str:
    n = 1
    while f"{prefix}_{n}" in taken:
        n += 1
    return f"{prefix}_{n}"


def _collapse(sets: Model, nodes: set[str], names: set[str], loops: dict[str, LoopBody]) -> Model:
    g = graph_of(sets)
    parts = loop_parts(nodes, g)
    after = followers_outside(parts.ends, nodes, g)
    beyond = after | g.reach(after) if after else set()
    # nodes on ways out that join what comes after the loop, or end there, belong to the iteration
    aside: set[str] = set()
    last: set[str] = set()  # events that end a way out within the loop
    for x in sorted(parts.exits - parts.ends):
        for b in g.succ[x] - nodes:
            straddles = any(b in types(s) and types(s) & nodes for s in sets[x])
            lost = not ({b} | g.reach(b)) & (beyond | nodes)
            if b not in beyond and (lost or not straddles):
                aside |= ({b} | g.reach(b)) - beyond - nodes
    aside = {n for n in aside if g.pred[n] <= nodes | aside}
    if not after and parts.exits - parts.ends:
        # the loop is only left by breaking off: the ways out are what comes after it
        after = followers_outside(parts.exits, nodes, g)
        beyond, aside = after | g.reach(after), set()
        if END_EVENT not in beyond and any(a in g.reach(b) for a in after for b in after - {a}):
            # one way out leads into another: where the loop is left cannot be one place after it
            beyond, aside, after = set(), beyond, set()
            last = {n for n in aside if not g.succ[n]}
    inner = nodes | aside
    name = _free_name(names, LOOP_EVENT)
    names.add(name)
    body: Model = {START_EVENT: set(), END_EVENT: set()}
    breaks: set[str] = set(last)
    dummy = _free_name(names, DUMMY_BREAK_EVENT)
    outs: set[Multiset] = set()
    for n in sorted(inner):
        own = body.setdefault(n, set())
        for s in sorted(sets[n]):
            kinds = types(s)
            if n in parts.ends and kinds & parts.starts:
                body[START_EVENT].add(only(s, parts.starts))
                own.add(multiset([END_EVENT]))
                if rest := only(s, kinds - inner):
                    outs.add(rest)
            elif kinds <= inner:
                own.add(s)
            elif n in parts.ends:
                own.add(multiset([END_EVENT]))
                outs.add(only(s, kinds - inner))
            elif n in aside:
                breaks.add(n)
                outs.add(only(s, kinds - inner))
            elif only(s, inner):
                # what goes on beside the iteration and is not part of it ends there: a copy of its way
                own.add(s)
                for x in kinds - inner:
                    for y in ({x} | g.reach(x)) - inner:
                        body.setdefault(y, set()).update(kept for z in sets[y] if (kept := only(z, types(z) - {END_EVENT})))
            else:
                names.add(dummy)
                body[dummy] = set()
                breaks.add(dummy)
                own.add(multiset([dummy]))
                outs.add(s)
    for n, seen in sets.items():
        if n not in inner:
            body[START_EVENT] |= {only(s, parts.starts) for s in seen if types(s) & parts.starts}
    if not body[START_EVENT]:
        body[START_EVENT] = {multiset([s]) for s in parts.starts}
    if not any(END_EVENT in types(s) for seen in body.values() for s in seen):
        del body[END_EVENT]
    new: Model = {}
    for n, seen in sets.items():
        if n not in inner:
            new[n] = {tuple(sorted([*((t, c) for t, c in s if t not in inner), (name, max(c for t, c in s if t in inner))])) if types(s) & inner else s for s in seen}
    new[name] = {s for s in outs if s}
    loops[name] = LoopBody(find_loops(body, names), breaks)
    return new


def find_loops(sets: Model, names: set[str] | None = None) -> Workflow:
    """The model without cycles. Names of loop events are new to the model, whatever its types are called."""
    names = set(sets) if names is None else names
    loops: dict[str, LoopBody] = {}
    while found := graph_of(sets).components():
        sets = _collapse(sets, found[0], names, loops)
    return Workflow(sets, loops)


def kill_edges(g: Graph, nodes: set[str], goals: set[str], starts: set[str]) -> set[tuple[str, str]]:
    """Links within a loop after which none of its end or break points is reached any more."""
    return {(a, b) for a in sorted(nodes) for b in g.succ[a] if b in nodes and b not in goals and b not in starts and not g.reach(b) & goals}
