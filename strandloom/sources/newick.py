"""Trees: Newick text, edges in preorder, random coalescent trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[(),;]|:\s*[-+0-9.eE]+|\[[^\]]*\]|[^\s(),:;\[\]']+)")


@dataclass
class Tree:
    """A rooted binary tree. Nodes 0..n-1 are the tips; edges are (parent, child, length), parents first."""

    tips: list[str]
    edges: list[tuple[int, int, float]] = field(default_factory=list)

    @property
    def root(self) -> int:
        return self.edges[0][0] if self.edges else 0

    def total_length(self) -> float:
        return sum(e[2] for e in self.edges)

    def scaled(self, factor: float) -> Tree:
        return Tree(self.tips, [(p, c, x * factor) for p, c, x in self.edges])

    def newick(self) -> str:
        below: dict[int, list[tuple[int, float]]] = {}
        for p, c, x in self.edges:
            below.setdefault(p, []).append((c, x))

        def text(node: int) -> str:
            if node not in below:
                return self.tips[node]
            return "(" + ",".join(f"{text(c)}:{x:g}" for c, x in below[node]) + ")"

        return text(self.root) + ";"

    def ordered_as(self, tips: list[str]) -> Tree:
        """The same tree with tips numbered as in another list; the labels must be the same set."""
        if sorted(tips) != sorted(self.tips) or len(set(tips)) != len(tips):
            raise ValueError("trees have different tip labels")
        place = {t: i for i, t in enumerate(tips)}
        n = len(tips)

        def new(x: int) -> int:
            return place[self.tips[x]] if x < n else x

        return Tree(list(tips), [(new(p), new(c), x) for p, c, x in self.edges])


def parse(text: str) -> Tree:
    """A rooted tree in which every inner node has two children; branches need lengths."""
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("[")]
    at = 0
    tips: list[str] = []
    inner: list[tuple] = []

    def node():
        nonlocal at
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            children = [branch()]
            while at < len(tokens) and tokens[at] == ",":
                at += 1
                children.append(branch())
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("a bracket is not closed in the tree")
            at += 1
            if len(children) != 2:
                raise ValueError("the tree must be rooted and binary")
            if at < len(tokens) and tokens[at] not in "(),;" and not tokens[at].startswith(":"):
                at += 1  # the name of an inner node
            return tuple(children)
        if at >= len(tokens) or tokens[at] in "(),;":
            raise ValueError("a tip has no name")
        name = tokens[at].strip("'").replace("''", "'")
        at += 1
        tips.append(name)
        return len(tips) - 1

    def branch():
        nonlocal at
        x = node()
        if at >= len(tokens) or not tokens[at].startswith(":"):
            raise ValueError("a branch has no length")
        length = float(tokens[at][1:])
        at += 1
        return x, length

    top = node()
    if len(set(tips)) != len(tips):
        raise ValueError("tip labels repeat")
    edges: list[tuple[int, int, float]] = []
    count = len(tips)

    def walk(x, me: int) -> None:
        nonlocal count
        for child, length in x:
            if isinstance(child, int):
                edges.append((me, child, length))
            else:
                count += 1
                number = count - 1
                edges.append((me, number, length))
                walk(child, number)

    if isinstance(top, tuple):
        count += 1
        walk(top, count - 1)
    return Tree(tips, edges)


def read_trees(path: str) -> list[Tree]:
    with open(path) as f:
        return [parse(t + ";") for t in f.read().split(";") if t.strip()]


def coalescent(n: int, rng: np.random.Generator) -> Tree:
    """A tree of Kingman's coalescent: while k lines are left, they wait Exp(k(k-1)/2) and two join."""
    if n < 2:
        raise ValueError("a tree needs two tips")
    height, alive, edges, now = {i: 0.0 for i in range(n)}, list(range(n)), [], 0.0
    following = n
    while len(alive) > 1:
        k = len(alive)
        now += rng.exponential(2 / (k * (k - 1)))
        a, b = rng.choice(k, 2, replace=False)
        for x in (alive[a], alive[b]):
            edges.append((following, x, now - height[x]))
        alive = [x for i, x in enumerate(alive) if i not in (a, b)] + [following]
        height[following] = now
        following += 1
    return Tree([f"t{i + 1}" for i in range(n)], preorder(edges, following - 1))


def preorder(edges: list[tuple[int, int, float]], root: int) -> list[tuple[int, int, float]]:
    below: dict[int, list[tuple[int, int, float]]] = {}
    for e in edges:
        below.setdefault(e[0], []).append(e)
    out, stack = [], [root]
    while stack:
        for e in below.get(stack.pop(), []):
            out.append(e)
            stack.append(e[1])
    return out
