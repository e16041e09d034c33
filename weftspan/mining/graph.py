"""Small directed graphs of one workflow's event types. Nodes are strings; everything iterates in sorted order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Graph:
    def __init__(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = ()) -> None:
        self.succ: dict[str, set[str]] = {}
        self.pred: dict[str, set[str]] = {}
        for n in nodes:
            self.add(n)
        for a, b in edges:
            self.link(a, b)

    def add(self, n: str) -> None:
        self.succ.setdefault(n, set())
        self.pred.setdefault(n, set())

    def link(self, a: str, b: str) -> None:
        self.add(a)
        self.add(b)
        self.succ[a].add(b)
        self.pred[b].add(a)

    def cut(self, a: str, b: str) -> None:
        self.succ[a].discard(b)
        self.pred[b].discard(a)

    def drop(self, n: str) -> None:
        for b in self.succ.pop(n):
            self.pred[b].discard(n)
        for a in self.pred.pop(n):
            if a != n:
                self.succ[a].discard(n)

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.succ))

    def __contains__(self, n: str) -> bool:
        return n in self.succ

    def edges(self) -> list[tuple[str, str]]:
        return [(a, b) for a in self for b in sorted(self.succ[a])]

    def copy(self) -> Graph:
        return Graph(self.edges(), self.succ)

    def part(self, nodes: set[str]) -> Graph:
        return Graph(((a, b) for a, b in self.edges() if a in nodes and b in nodes), nodes)

    def reach(self, start: str | Iterable[str], avoid: set[str] = frozenset()) -> set[str]:
        """Nodes that a way of one link or more leads to, not through nodes to avoid."""
        todo, seen = [start] if isinstance(start, str) else list(start), set()
        while todo:
            for b in self.succ.get(todo.pop(), ()):
                if b not in seen and b not in avoid:
                    seen.add(b)
                    todo.append(b)
        return seen

    def components(self) -> list[set[str]]:
        """Strongly connected components that hold a cycle, by Tarjan's algorithm without recursion."""
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack, on, out = [], set(), []
        for root in self:
            if root in index:
                continue
            work = [(root, iter(sorted(self.succ[root])))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while work:
                node, nexts = work[-1]
                for b in nexts:
                    if b not in index:
                        index[b] = low[b] = len(index)
                        stack.append(b)
                        on.add(b)
                        work.append((b, iter(sorted(self.succ[b]))))
                        break
                    if b in on:
                        low[node] = min(low[node], index[b])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == index[node]:
                        found = set()
                        while True:
                            n = stack.pop()
                            on.discard(n)
                            found.add(n)
                            if n == node:
                                break
                        if len(found) > 1 or node in self.succ[node]:
                            out.append(found)
        return sorted(out, key=min)

    def order(self) -> dict[str, int]:
        """Rank of each node along the links; the graph has no cycles. Ties go by name."""
        left = {n: len(self.pred[n]) for n in self.succ}
        ready, out = sorted((n for n, d in left.items() if not d), reverse=True), {}
        while ready:
            n = ready.pop()
            out[n] = len(out)
            for b in sorted(self.succ[n]):
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
                    ready.sort(reverse=True)
        return out


def with_links_out_of(nodes: set[str], bound: set[str], g: Graph) -> set[str]:
    """Nodes with any link to a node outside ``bound``."""
    return {n for n in nodes if g.succ[n] - bound}


def with_links_into(nodes: set[str], bound: set[str], g: Graph) -> set[str]:
    """Nodes with any link to a node of ``bound``."""
    return {n for n in nodes if g.succ[n] & bound}


def followers_outside(nodes: set[str], bound: set[str], g: Graph) -> set[str]:
    return {b for n in nodes for b in g.succ[n]} - bound


def leaders_outside(nodes: set[str], bound: set[str], g: Graph) -> set[str]:
    return {a for n in nodes for a in g.pred[n]} - bound


def entered_from_outside(nodes: set[str], bound: set[str], g: Graph) -> set[str]:
    return {n for n in nodes if g.pred[n] - bound}


def without_way_back(nodes: set[str], goals: set[str], g: Graph) -> set[str]:
    return {n for n in nodes if not g.reach(n) & goals}


def way_avoiding(g: Graph, a: str, b: str, avoid: set[str]) -> bool:
    """Whether b is reached from a and none of the nodes to avoid lies on any way there."""
    if b not in g.reach(a):
        return False
    return not any(n in g.reach(a) and b in g.reach(n) for n in avoid)


def all_connected(g: Graph, sources: set[str], goals: set[str]) -> bool:
    return all(goals <= g.reach(a) | {a} for a in sources)


def same_ring(a: list, b: list) -> bool:
    """Whether one list is a rotation of the other."""
    return len(a) == len(b) and (not a or any(a[i:] + a[:i] == b for i in range(len(a))))


def is_run_of(a: list, b: list) -> bool:
    """Whether ``a`` stands in ``b`` without gaps."""
    return any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
