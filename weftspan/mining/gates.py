"""Logic gates from observed event sets.

Only which types occur together matters for gates. Every order of a set counts as observed, so that "directly follows"
is symmetric, and the cuts of the inductive miner (Leemans, Fahland, van der Aalst, 2013) come down to components of
the graph of co-occurrence: its components are alternatives (XOR), those of its complement are parallel (AND), and a
part that may be missing is optional. Optionals under an AND become an OR where the sets allow it; counts above one
become a BRANCH.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

Multiset = tuple[tuple[str, int], ...]

XOR, AND, OR, BRANCH, LEAF, NONE = "XOR", "AND", "OR", "BRANCH", "leaf", "none"


@dataclass
class Gate:
    kind: str
    children: list[Gate] = field(default_factory=list)
    label: str | None = None

    def leaves(self) -> list[str]:
        return [self.label] if self.kind == LEAF else [x for c in self.children for x in c.leaves()]

    def text(self) -> str:
        """Canonical form: the order of children plays no part."""
        if self.kind == LEAF:
            return self.label
        return f"{self.kind}({','.join(sorted(c.text() for c in self.children))})" if self.kind != NONE else "-"


def leaf(label: str) -> Gate:
    return Gate(LEAF, label=label)


def multiset(types: Iterable[str]) -> Multiset:
    counts: dict[str, int] = {}
    for t in types:
        counts[t] = counts.get(t, 0) + 1
    return tuple(sorted(counts.items()))


def _parts(nodes: set[str], joined) -> list[set[str]]:
    """Connected components under a symmetric relation, by least member."""
    left, out = set(nodes), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            a = todo.pop()
            if a in part:
                continue
            part.add(a)
            todo += [b for b in left if b not in part and joined(a, b)]
        left -= part
        out.append(part)
    return sorted(out, key=min)


def _cut(sets: set[frozenset[str]]) -> Gate:
    if frozenset() in sets:
        rest = sets - {frozenset()}
        return Gate(XOR, [Gate(NONE), _cut(rest)]) if rest else Gate(NONE)
    nodes = set().union(*sets)
    if len(nodes) == 1:
        return leaf(next(iter(nodes)))
    together = {(a, b) for s in sets for a in s for b in s if a != b}
    ways = _parts(nodes, lambda a, b: (a, b) in together)
    if len(ways) > 1:
        return Gate(XOR, [_cut({s for s in sets if s <= w}) for w in ways])
    sides = _parts(nodes, lambda a, b: (a, b) not in together)
    if len(sides) > 1:
        return Gate(AND, [_cut({s & p for s in sets}) for p in sides])
    # no cut: what is always there stands apart, then one type at a time that leaves something to cut
    always = frozenset.intersection(*sets)
    for t in [*sorted(always), *sorted(nodes - always)]:
        rest = _cut({s - {t} for s in sets})
        if t in always or rest.kind != OR:
            own = leaf(t) if t in always else Gate(XOR, [Gate(NONE), leaf(t)])
            return Gate(AND, [own, *(rest.children if rest.kind == AND else [rest])])
    return Gate(OR, [leaf(t) for t in sorted(nodes)])


def _optional(g: Gate) -> bool:
    return g.kind == XOR and len(g.children) == 2 and any(c.kind == NONE for c in g.children)


def _inner(g: Gate) -> Gate:
    return next(c for c in g.children if c.kind != NONE)


def _either(g: Gate, sets: set[frozenset[str]]) -> Gate:
    """Optionals under an AND as an OR: of all its children, or beside what is always there."""
    g = Gate(g.kind, [_either(c, sets) for c in g.children], g.label)
    if g.kind != AND or not any(_optional(c) for c in g.children):
        return g
    loose, fixed = [_inner(c) for c in g.children if _optional(c)], [c for c in g.children if not _optional(c)]
    if not fixed:
        return Gate(OR, loose) if len(loose) > 1 else Gate(XOR, [Gate(NONE), loose[0]])
    mine, free = {x for c in fixed for x in c.leaves()}, {x for c in loose for x in c.leaves()}
    # some set has the fixed ones alone: then all are alternatives of one OR
    if any(s & mine and not s & free for s in sets):
        return Gate(OR, [*fixed, *loose])
    return Gate(AND, [*fixed, Gate(OR, loose) if len(loose) > 1 else Gate(XOR, [Gate(NONE), loose[0]])])


def _flat(g: Gate, kind: str) -> Gate:
    """Children of the kind under the same kind are taken up."""
    out = []
    for c in (_flat(c, kind) for c in g.children):
        out += c.children if g.kind == c.kind == kind else [c]
    return Gate(g.kind, out, g.label)


def weighted_cover(sets: set[frozenset[str]], universe: set[str]) -> set[frozenset[str]] | None:
    """Greedy cover that prefers sets with much that is still uncovered for their size; ties by size, then by name.

    None if the chosen sets are not disjoint, or some set isn't a union of them.
    """
    left, chosen = set(universe), []
    while left:
        best = max(sets, key=lambda s: (len(s & left) / len(s) ** 2 if s else 0, -len(s), tuple(sorted(s, reverse=True))))
        if not best & left:
            return None
        chosen.append(best)
        left -= best
    if sum(map(len, chosen)) != len(universe):
        return None
    return set(chosen) if all(set().union(*[c for c in chosen if c <= s]) == s for s in sets) else None


def _gather(g: Gate, sets: set[frozenset[str]]) -> Gate:
    """Types that always come together under an OR of types become an AND."""
    g = Gate(g.kind, [_gather(c, sets) for c in g.children], g.label)
    if g.kind != OR or any(c.kind != LEAF for c in g.children):
        return g
    mine = set(g.leaves())
    cover = weighted_cover({s & mine for s in sets if s & mine}, mine)
    if cover is None or len(cover) < 2:
        return g
    return Gate(OR, [leaf(next(iter(c))) if len(c) == 1 else Gate(AND, [leaf(x) for x in sorted(c)]) for c in sorted(cover, key=sorted)])


def _in_proportion(leaves: list[str], sets: Iterable[Multiset]) -> bool:
    """Whether counts of the leaves grow in step within every support."""
    by: dict[frozenset[str], list[list[int]]] = {}
    for s in sets:
        d = dict(s)
        held = [x for x in leaves if x in d]
        if len(held) > 1:
            by.setdefault(frozenset(held), []).append([d[x] for x in sorted(held)])
    return all(a * y == b * x for rows in by.values() for first, *more in [rows] for r in more for a, b, x, y in [(first[0], first[i], r[0], r[i]) for i in range(1, len(r))])


def _under_branch(g: Gate, sets: set[Multiset]) -> Gate:
    kids = [_under_branch(c, sets) for c in g.children]
    if g.kind == OR or (g.kind == AND and not _in_proportion(sorted(g.leaves()), sets)):
        return Gate(XOR, kids)
    return Gate(g.kind, kids, g.label)


def infer(sets: Iterable[Multiset]) -> Gate | None:
    """The gate that follows an event, from the multisets of types seen there; None if nothing was."""
    seen = {s for s in sets if s}
    if not seen:
        return None
    supports = {frozenset(t for t, _ in s) for s in seen}
    g = _flat(_gather(_flat(_flat(_either(_cut(supports), supports), OR), AND), supports), XOR)
    if any(n > 1 for s in seen for _, n in s):
        return Gate(BRANCH, [_flat(_under_branch(g, seen), XOR)])
    return g


def with_copies(g: Gate, sets: Iterable[Multiset]) -> Gate:
    """Types that always come the same number of times, more than once, as so many leaves under an AND."""
    counts: dict[str, set[int]] = {}
    for s in sets:
        for t, n in s:
            counts.setdefault(t, set()).add(n)

    def visit(x: Gate) -> Gate:
        if x.kind == LEAF:
            n = next(iter(counts[x.label])) if len(counts.get(x.label, ())) == 1 else 1
            return Gate(AND, [leaf(x.label) for _ in range(n)]) if n > 1 else x
        return Gate(x.kind, [visit(c) for c in x.children], x.label)

    out = visit(g)
    # a branch of which nothing is left to count is no branch
    fixed = g.kind == BRANCH and all(len(counts.get(t, {1})) == 1 for t in g.leaves())
    return _flat(out.children[0], AND) if fixed else out
