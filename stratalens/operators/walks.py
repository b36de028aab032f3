"""Walks over the edges of one graph, in plain Python: strong components, layers, simple cycles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

Edges = list[tuple[str, str]]


def _neighbours(edges: Edges) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    return out


def _finish_order(near: dict[str, list[str]], nodes: Iterable[str]) -> list[str]:
    """Nodes in the order in which a depth-first walk leaves them."""
    seen, out = set(), []
    for root in nodes:
        stack = [(root, iter(near[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            for b in stack[-1][1]:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(near[b])))
                    break
            else:
                out.append(stack.pop()[0])
    return out


def _component_of(near: dict[str, list[str]]) -> dict[str, str]:
    """Each node's strong component by its least node: a second walk over turned edges, last left first."""
    back: dict[str, list[str]] = {a: [] for a in near}
    for a, bs in near.items():
        for b in bs:
            back[b].append(a)
    found: dict[str, str] = {}
    for root in reversed(_finish_order(near, near)):
        if root in found:
            continue
        members, todo = [], [root]
        found[root] = root
        while todo:
            members.append(a := todo.pop())
            for b in back[a]:
                if b not in found:
                    found[b] = root
                    todo.append(b)
        least = min(members)
        for a in members:
            found[a] = least
    return found


def components(edges: Edges) -> Iterator[tuple[str, str]]:
    """(node, component)."""
    yield from _component_of(_neighbours(edges)).items()


def layers(edges: Edges) -> Iterator[tuple[str, int]]:
    """(node, layer): 0 without dependencies, else one more than the highest of them; a component has one layer."""
    near = _neighbours(edges)
    comp = _component_of(near)
    below: dict[str, list[str]] = {c: [] for c in comp.values()}
    for a, bs in near.items():
        below[comp[a]] += [comp[b] for b in bs if comp[b] != comp[a]]
    height: dict[str, int] = {}
    for c in _finish_order(below, below):
        height[c] = 1 + max((height[b] for b in below[c]), default=-1)
    for a, c in comp.items():
        yield a, height[c]


def _groups(near: dict[str, list[str]], nodes: set[str]) -> list[set[str]]:
    """The strong components of more than one of the nodes."""
    found: dict[str, set[str]] = defaultdict(set)
    for a, c in _component_of({a: [b for b in near[a] if b in nodes] for a in nodes}).items():
        found[c].add(a)
    return [g for g in found.values() if len(g) > 1]


def cycles(edges: Edges, longest: int | None = None) -> Iterator[tuple[list[str]]]:
    """([first, ..., first],) for each simple cycle, from its least node.

    The cycles through the least node of a strong component stay in it; then the node goes, and what is left falls into
    components again.  A node that led nowhere is shut until a node on the way to it leaves the path, so the time between
    two cycles is bounded by the edges; with a bound on the length nodes aren't shut, as a shorter path may still pass.
    """
    near = _neighbours(edges)
    for a, bs in near.items():
        if a in bs:
            yield ([a, a],)
    left = _groups(near, set(near))
    while left:
        members = left.pop()
        first = min(members)
        yield from _through(first, {a: [b for b in near[a] if b in members and b != a] for a in members}, longest)
        left += _groups(near, members - {first})


def _through(first: str, near: dict[str, list[str]], longest: int | None) -> Iterator[tuple[list[str]]]:
    shut, waiting, lucky = {first}, defaultdict(set), set()
    path, todo = [first], [iter(near[first])]

    def free(a: str) -> None:
        stack = [a]
        while stack:
            if (x := stack.pop()) in shut:
                shut.discard(x)
                stack += waiting.pop(x, ())

    while path:
        for b in todo[-1]:
            if b == first:
                yield ([*path, first],)
                lucky.update(path)
            elif b not in shut and (longest is None or len(path) < longest):
                shut.add(b)
                lucky.discard(b)
                path.append(b)
                todo.append(iter(near[b]))
                break
        else:
            a = path.pop()
            todo.pop()
            if a in lucky or longest is not None:
                free(a)
            else:
                for b in near[a]:
                    waiting[b].add(a)
