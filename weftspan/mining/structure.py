"""From a model without cycles to a block-structured diagram.

The gate after an event opens a block. Its paths are built up to the node where they come together: the first node,
along the links, that all paths that go on lead through. Paths of which some come together earlier are gathered in a
block of the same kind; a path that never gets there is detached, or breaks off its loop.
"""

from __future__ import annotations

from weftspan.mining.diagram import BREAK, DETACH, Act, Block, Loop, Stop, write
from weftspan.mining.gates import BRANCH, LEAF, NONE, XOR, Gate, infer
from weftspan.mining.graph import Graph
from weftspan.mining.loops import Model, Workflow, find_loops
from weftspan.schemas import DUMMY_BREAK_EVENT, END_EVENT, START_EVENT

_ARTIFICIAL = (START_EVENT, END_EVENT)
JOIN = "\0join"


def joined(flow: Workflow) -> Workflow:
    """The flow with a silent node before each gate that several nodes share, so that their paths can come together there."""
    shared: dict[frozenset, list[str]] = {}
    for n, seen in flow.sets.items():
        gate = infer(seen)
        if gate is not None and gate.kind not in (LEAF, BRANCH):
            shared.setdefault(frozenset(seen), []).append(n)
    sets = dict(flow.sets)
    for i, (seen, nodes) in enumerate(sorted(shared.items(), key=lambda x: sorted(x[1]))):
        if len(nodes) > 1:
            name = f"{JOIN}{i}"
            sets[name] = set(seen)
            for n in nodes:
                sets[n] = {((name, 1),)}
    return Workflow(sets, flow.loops)


def _branch_after(items: list) -> None:
    """Mark the last event, also where it ends a loop, as one after which paths multiply."""
    if items and isinstance(items[-1], Act):
        items[-1].branch = True
    elif items and isinstance(items[-1], Loop):
        _branch_after(items[-1].body)


class _Builder:
    def __init__(self, flow: Workflow, breaks: set[str], before: Model) -> None:
        self.flow, self.breaks, self.before = joined(flow), breaks, before
        self.g: Graph = self.flow.graph()
        self.rank = self.g.order()
        self.after = {n: {n} | self.g.reach(n) for n in self.g}
        self.depth = 0  # blocks that are open

    def from_node(self, node: str | None, stop: str | None) -> list:
        out: list = []
        while node is not None and node != stop:
            self.emit(node, out)
            gate = infer(self.flow.sets[node])
            if gate is None:
                if node in self.breaks:
                    out.append(Stop(BREAK))
                elif stop is not None or self.depth:
                    out.append(Stop(DETACH))
                return out
            node = self.follow(gate, stop, out)
        return out

    def emit(self, node: str, out: list) -> None:
        if node in _ARTIFICIAL or node.startswith((DUMMY_BREAK_EVENT, JOIN)):
            return
        body = self.flow.loops.get(node)
        out.append(Loop(build(body.model, body.breaks, self.before)) if body else Act(node))

    def follow(self, gate: Gate, stop: str | None, out: list) -> str | None:
        """Append the block of a gate; returns the node to go on with."""
        if gate.kind == BRANCH:
            _branch_after(out)
            gate = gate.children[0]
        if gate.kind == LEAF:
            return gate.label
        if gate.kind == NONE:
            return None
        children = list(gate.children)
        merge = self.merge_of(gate.kind, children, stop)
        # paths that come together before all of them do
        while early := self.early_merge(gate.kind, children, merge):
            x, inside = early
            children = [c for c in children if c not in inside] + [Gate(gate.kind, inside, f"\0{x}")]
        block = Block(gate.kind)
        self.depth += 1
        for c in children:
            path: list = []
            if c.kind == NONE:
                pass
            elif c.kind != LEAF and c.label and c.label.startswith("\0"):
                inner = c.label[1:]
                path.append(Block(c.kind, [self.path_of(x, inner) for x in c.children]))
                path += self.from_node(inner, merge)
            else:
                path = self.path_of(c, merge)
            block.paths.append(path)
        self.depth -= 1
        out.append(block)
        return merge

    def path_of(self, gate: Gate, stop: str | None) -> list:
        if gate.kind == LEAF:
            return self.from_node(gate.label, stop)
        out: list = []
        if gate.label and gate.label.startswith("\0"):
            inner = gate.label[1:]
            out.append(Block(gate.kind, [self.path_of(x, inner) for x in gate.children]))
            return out + self.from_node(inner, stop)
        return out + self.from_node(self.follow(gate, stop, out), stop)

    def reach_of(self, gate: Gate) -> set[str]:
        return set().union(*(self.after[x] for x in gate.leaves())) if gate.leaves() else set()

    def _through(self, gate: Gate, node: str, goal: str | None) -> bool:
        """Whether every way of a path to the goal leads through the node; without a goal, whether it leads there at all."""
        for leaf in gate.leaves():
            if node not in self.after[leaf]:
                return False
            if goal is not None and leaf != node and (goal == leaf or goal in self.g.reach(leaf, {node})):
                return False
        return True

    def _meets(self, kind: str, node: str) -> bool:
        """Whether paths that run side by side come together in one such event; each may have one of its own instead."""
        seen = self.before.get(node)
        return kind == XOR or not seen or any(sum(n for _, n in s) > 1 for s in seen)

    def _beyond(self, gate: Gate, stop: str) -> str:
        """Where a block ends of which one path alone goes on: after that path's first event."""
        after = infer(self.flow.sets[gate.label]) if gate.kind == LEAF else None
        return after.label if after is not None and after.kind == LEAF else stop

    def merge_of(self, kind: str, children: list[Gate], stop: str | None) -> str | None:
        reach = [self.reach_of(c) for c in children if c.kind != NONE]
        if any(c.kind == NONE for c in children):
            return stop
        if stop is not None:
            going = [(c, r) for c, r in zip(children, reach) if stop in r]
            if len(going) < 2:
                breaks = any(x in self.breaks or x.startswith(DUMMY_BREAK_EVENT) for r in reach for x in r)
                return self._beyond(going[0][0], stop) if going and not breaks else stop
        else:
            shared = [any(r & q for j, q in enumerate(reach) if j != i) for i, r in enumerate(reach)]
            going = [(c, r) for c, r, s in zip(children, reach, shared) if s]
            if not going:
                return None
        # every path has an event of its own before they come together
        own = {x for c, _ in going for x in c.leaves()}
        common = sorted(set.intersection(*(r for _, r in going)) - own, key=self.rank.get)
        return next((n for n in common if self._meets(kind, n) and all(self._through(c, n, stop) for c, _ in going)), stop)

    def early_merge(self, kind: str, children: list[Gate], merge: str | None) -> tuple[str, list[Gate]] | None:
        """A node, and at least two but not all of the children, that come together there before the merge."""
        last = self.rank[merge] if merge is not None else len(self.rank)
        for x in sorted((n for n in self.rank if self.rank[n] < last and self._meets(kind, n)), key=self.rank.get):
            inside = [c for c in children if c.kind != NONE and x in self.reach_of(c) and self._through(c, x, merge)]
            whole = [c for c in children if c.kind != NONE and x in self.reach_of(c)]
            if 1 < len(inside) < len(children) and len(whole) == len(inside) and not any(x in c.leaves() for c in inside):
                return x, inside
        return None


def build(flow: Workflow, breaks: set[str] = frozenset(), before: Model | None = None) -> list:
    """The diagram of a workflow, or of the body of a loop; ``before`` has what was seen before each type, if it is known."""
    b = _Builder(flow, breaks, before or {})
    stop = END_EVENT if END_EVENT in b.g else None
    if START_EVENT in b.g:
        return b.from_node(START_EVENT, stop)
    roots = [n for n in b.g if not b.g.pred[n]]
    return b.from_node(roots[0], stop) if len(roots) == 1 else b.from_node(min(b.g), stop) if roots else []


def diagram_of(sets: Model, before: Model | None = None) -> list:
    return build(find_loops(sets), before=before)


def puml_of(sets: Model, name: str = "default_name", before: Model | None = None) -> str:
    """Diagram text of a model: gates, loops and structure inferred."""
    return write(diagram_of(sets, before), name)


