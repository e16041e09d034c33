"""Activity diagrams as trees: text form, parser, canonical form, and all runs of a diagram."""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from weftspan.mining.gates import AND, OR, XOR, Multiset, multiset

BREAK, DETACH = "break", "detach"


@dataclass
class Act:
    """An event; with ``branch`` what follows it runs several times at once."""

    name: str
    branch: bool = False


@dataclass
class Block:
    kind: str
    paths: list[list] = field(default_factory=list)


@dataclass
class Loop:
    body: list = field(default_factory=list)


@dataclass
class Stop:
    how: str


# The words of the diagram language.
_WORDS = {XOR: ("switch (XOR)", 'case ("{}")', "endswitch"), AND: ("fork", "fork again", "end fork"), OR: ("split", "split again", "end split")}


def _lines(items: list, depth: int, names: Iterator[int]) -> Iterator[str]:
    pad = "    " * depth
    for x in items:
        if isinstance(x, Act):
            yield f"{pad}:{x.name},BCNT,user={x.name},name=BC{next(names)};" if x.branch else f"{pad}:{x.name};"
        elif isinstance(x, Stop):
            yield pad + x.how
        elif isinstance(x, Loop):
            yield pad + "repeat"
            yield from _lines(x.body, depth + 1, names)
            yield pad + "repeat while"
        else:
            first, again, end = _WORDS[x.kind]
            if x.kind == XOR:
                yield pad + first
            for i, path in enumerate(x.paths):
                yield ("    " + pad + again.format(i + 1)) if x.kind == XOR else pad + (again if i else first)
                yield from _lines(path, depth + (2 if x.kind == XOR else 1), names)
            yield pad + end


def write(items: list, name: str = "default_name") -> str:
    body = "\n".join(_lines(items, 2, itertools.count()))
    return f'@startuml\npartition "{name}" {{\n    group "{name}"\n{body}\n    end group\n}}\n@enduml'


def parse(text: str) -> list:
    """The diagram that a text draws; ValueError if its blocks do not match."""
    top: list = []
    stack: list[tuple[str, object, list]] = [("top", None, top)]

    def close(kind: str) -> None:
        while stack[-1][0] == "path":
            stack.pop()
        if stack[-1][0] != kind:
            raise ValueError(f"{kind} ends, but {stack[-1][0]} is open")
        stack.pop()

    def path(block: Block) -> None:
        block.paths.append([])
        stack.append(("path", block, block.paths[-1]))

    for raw in text.splitlines():
        line = raw.strip()
        here = stack[-1][2]
        if not line or line.startswith(("@", "'", "partition", "group", "end group", "}", "start", "title", "{")) or line in ("end", "stop"):
            continue
        if m := re.match(r"(?:#\w+)?:([^;]*);?$", line):
            parts = m[1].split(",")
            here.append(Act(parts[0].strip(), "BCNT" in parts[1:]))
        elif re.match(r"(switch|if)\b", line):
            b = Block(XOR)
            here.append(b)
            stack.append((XOR, b, []))
            if line.startswith("if"):
                path(b)
        elif re.match(r"(case|else|elseif)\b", line):
            if stack[-1][0] == "path":
                stack.pop()
            if stack[-1][0] != XOR:
                raise ValueError(f"{line} outside a switch")
            path(stack[-1][1])
        elif line in ("endswitch", "endif"):
            close(XOR)
        elif m := re.match(r"(fork|split)( again)?$", line):
            kind = AND if m[1] == "fork" else OR
            if m[2]:
                if stack[-1][0] == "path":
                    stack.pop()
                if stack[-1][0] != kind:
                    raise ValueError(f"{line} outside its block")
            else:
                here.append(Block(kind))
                stack.append((kind, here[-1], []))
            path(stack[-1][1])
        elif m := re.match(r"end ?(fork|split|merge)$", line):
            close(OR if m[1] == "split" else AND)
        elif re.match(r"repeat while\b", line):
            close("repeat")
        elif line.startswith("repeat"):
            here.append(Loop())
            stack.append(("repeat", here[-1], here[-1].body))
        elif line in (BREAK, DETACH, "kill"):
            here.append(Stop(BREAK if line == BREAK else DETACH))
        else:
            raise ValueError(f"unknown line: {line}")
    if len(stack) != 1:
        raise ValueError(f"{stack[-1][0]} is not closed")
    return top


def _plain(x: object, nested: bool = True) -> str:
    if isinstance(x, Act):
        return f"{x.name}{'*' if x.branch else ''}"
    if isinstance(x, Stop):
        return x.how
    if isinstance(x, Loop):
        return f"repeat({canonical(x.body)})"
    paths = []
    for p in x.paths:
        # a block of the same kind that is a whole path is the same choice
        inner = p[0].paths if nested and len(p) == 1 and isinstance(p[0], Block) and p[0].kind == x.kind else None
        paths += _plain(p[0])[len(x.kind) + 1 : -1].split("|") if inner is not None else [canonical(p)]
    return f"{x.kind}({'|'.join(sorted(paths))})"


def canonical(items: list) -> str:
    """The same text for diagrams that differ in the order of paths, or in nesting that changes nothing."""
    return ";".join(_plain(x) for x in items)


def equivalent(a: str, b: str) -> bool:
    return canonical(parse(a)) == canonical(parse(b))


@dataclass(frozen=True)
class Run:
    """A partial order of events: for each its type and the events before it (-1: whatever comes before the run)."""

    events: tuple[tuple[str, frozenset[int]], ...] = ()
    outs: frozenset[int] = frozenset({-1})
    status: str = "go"

    def then(self, other: Run) -> Run:
        if self.status != "go":
            return self
        n = len(self.events)
        shift = lambda s: frozenset(x for i in s for x in (self.outs if i < 0 else {i + n}))
        return Run(self.events + tuple((t, shift(p)) for t, p in other.events), shift(other.outs), other.status)


def _beside(runs: tuple[Run, ...]) -> Run:
    events, outs, going = [], set(), False
    for r in runs:
        n = len(events)
        events += [(t, frozenset(i if i < 0 else i + n for i in p)) for t, p in r.events]
        if r.status == "go":
            going = True
            outs |= {i if i < 0 else i + n for i in r.outs}
    status = "go" if going else BREAK if any(r.status == BREAK for r in runs) else DETACH
    return Run(tuple(events), frozenset(outs), status)


def runs(items: list, branch_counts: tuple[int, ...] = (2, 3)) -> list[Run]:
    """Every way through a diagram; loops are taken once and twice, what follows a branch as often as given."""
    out, items, i = [Run()], list(items), 0
    while i < len(items):
        x = items[i]
        i += 1
        if isinstance(x, Act):
            step = [Run(((x.name, frozenset({-1})),), frozenset({0}))]
            if x.branch and i < len(items):
                begin = i
                while i + 1 < len(items) and isinstance(items[i], Act) and items[i].branch:
                    i += 1
                i += 1
                after = runs(items[begin:i], branch_counts)
                step = [s.then(_beside(c)) for s in step for n in branch_counts for c in itertools.combinations_with_replacement(after, n)]
        elif isinstance(x, Stop):
            step = [Run(status=x.how)]
        elif isinstance(x, Loop):
            once = runs(x.body, branch_counts)
            twice = [a.then(b) for a in once if a.status == "go" for b in once]
            step = [Run(r.events, r.outs, "go" if r.status == BREAK else r.status) for r in [*once, *twice]]
        else:
            ways = [runs(p, branch_counts) for p in x.paths]
            if x.kind == XOR:
                step = [r for w in ways for r in w]
            else:
                picks = [ways] if x.kind == AND else [list(c) for n in range(1, len(ways) + 1) for c in itertools.combinations(ways, n)]
                step = [_beside(c) for p in picks for c in itertools.product(*p)]
        out = [a.then(b) for a in out for b in (step if a.status == "go" else [Run()])]
    return list(dict.fromkeys(out))


def random_run(items: list, rnd: random.Random, again: float = 0.5) -> Run:
    """One way through a diagram by chance: loops go on with probability ``again``, branches have two to five paths."""
    out, i = Run(), 0
    while i < len(items) and out.status == "go":
        x, i = items[i], i + 1
        if isinstance(x, Act):
            step = Run(((x.name, frozenset({-1})),), frozenset({0}))
            if x.branch and i < len(items):
                begin = i
                while i + 1 < len(items) and isinstance(items[i], Act) and items[i].branch:
                    i += 1
                i += 1
                step = step.then(_beside(tuple(random_run(items[begin:i], rnd, again) for _ in range(rnd.randrange(2, 6)))))
        elif isinstance(x, Stop):
            step = Run(status=x.how)
        elif isinstance(x, Loop):
            step = random_run(x.body, rnd, again)
            while step.status == "go" and rnd.random() < again:
                step = step.then(random_run(x.body, rnd, again))
            step = Run(step.events, step.outs, "go" if step.status == BREAK else step.status)
        elif x.kind == XOR:
            step = random_run(rnd.choice(x.paths), rnd, again)
        else:
            paths = x.paths if x.kind == AND else rnd.sample(x.paths, rnd.randrange(1, len(x.paths) + 1))
            step = _beside(tuple(random_run(p, rnd, again) for p in paths))
        out = out.then(step)
    return out


def events_of(items: list, job_name: str = "job", application: str = "app", start: str = "2024-01-01T00:00:00.000000Z", more: int = 0, seed: int = 0) -> list[dict]:
    """PV events of every run of a diagram, and of ``more`` runs by chance, each run a job of its own."""
    out, rnd = [], random.Random(seed)
    for j, run in enumerate([*runs(items), *(random_run(items, rnd) for _ in range(more))]):
        for i, (kind, before) in enumerate(run.events):
            out.append({"jobId": f"{job_name}-{j}", "eventId": f"{job_name}-{j}-{i}", "eventType": kind, "timestamp": start, "applicationName": application, "jobName": job_name, "previousEventIds": [f"{job_name}-{j}-{b}" for b in sorted(before) if b >= 0]})
    return out


def before_of(all_runs: list[Run]) -> dict[str, set[Multiset]]:
    """What is seen before each type."""
    out: dict[str, set[Multiset]] = {}
    for run in all_runs:
        for kind, before in run.events:
            if kinds := [run.events[b][0] for b in before if b >= 0]:
                out.setdefault(kind, set()).add(multiset(kinds))
    return out


def model_of(all_runs: list[Run], start: str) -> dict[str, set[Multiset]]:
    """Followers of each type as the model holds them, with an artificial start."""
    model: dict[str, set[Multiset]] = {start: set()}
    for run in all_runs:
        after: dict[int, list[str]] = {}
        for i, (kind, before) in enumerate(run.events):
            after.setdefault(i, [])
            for b in before:
                after.setdefault(b, []).append(kind)
        for i, kinds in after.items():
            own = model.setdefault(start if i < 0 else run.events[i][0], set())
            if kinds:
                own.add(multiset(kinds))
    return model
