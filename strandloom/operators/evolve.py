"""Evolving a region along a tree: rate classes, indels, then substitutions on every branch."""

from __future__ import annotations

from array import array
from bisect import bisect_right

import numpy as np

from ..functions.rng import generator
from ..plans.models import Indels, Substitution
from ..sources.newick import Tree
from .mutations import canonical

_CODES = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"TCAG"):
    _CODES[_b] = _i
_LETTERS = np.frombuffer(b"TCAGN", np.uint8)


class Region:
    """Bases of a region, where each came from in the reference (-1: inserted), and their rate classes."""

    def __init__(self, bases: np.ndarray, origin: np.ndarray, classes: np.ndarray) -> None:
        self.bases, self.origin, self.classes = bases, origin, classes

    def copy(self) -> Region:
        return Region(self.bases.copy(), self.origin.copy(), self.classes.copy())


def draw_classes(n: int, sub: Substitution, rng: np.random.Generator) -> np.ndarray:
    k = len(sub.gammas)
    if k == 1 and not sub.invariant:
        return np.zeros(n, np.int16)
    c = rng.integers(0, k, n).astype(np.int16)
    c[rng.random(n) < sub.invariant] = k
    return c


#: Branch lengths whose tables are remembered at once.
TABLES = 1_024


def table(sub: Substitution, t: float, tables: dict | None) -> np.ndarray:
    """The first three cumulative chances of P(t), by rate class and base in one row number (class x 5 + base).

    Rows of N and of the invariant class are not used. What tables remembers is bounded by TABLES.
    """
    if tables is not None and t in tables:
        return tables[t]
    out = np.zeros((len(sub.gammas) + 1, 5, 3))
    for k, g in enumerate(sub.gammas):
        out[k, :4] = np.cumsum(sub.transition(t, g), 1)[:, :3]
    out = np.ascontiguousarray(out.reshape(-1, 3).T)
    if tables is not None:
        if len(tables) > TABLES:
            tables.clear()
        tables[t] = out
    return out


def substitute(r: Region, sub: Substitution, t: float, rng: np.random.Generator, tables: dict | None = None) -> None:
    """One draw per site from the row of P(t) of its class; other letters and invariant sites stay."""
    n = len(r.bases)
    if not n or t <= 0:
        return
    u = rng.random(n)
    row = r.classes * 5 + r.bases
    drawn = np.zeros(n, np.int8)
    for upto in table(sub, t, tables):
        drawn += u > upto[row]
    moves = (r.classes < len(sub.gammas)) & (r.bases < 4)
    r.bases = np.where(moves, drawn, r.bases)


def indels(r: Region, ins: Indels | None, dels: Indels | None, sub: Substitution, t: float, epsilon: float, rng: np.random.Generator, tables: dict | None = None) -> None:
    """Tau-leaping with a step that changes the region's size by a share epsilon, or exact events if it is 0.

    An event moves the numbers of sites (4 bytes each) in one array; bases, origins and classes are gathered
    by these numbers once, after the last event.
    """
    if tables is not None and "indels" in tables:
        rate, change, total, drift, spread, upto, pi = tables["indels"]
    else:
        ri = ins.rates if ins else np.zeros(0)
        rd = dels.rates if dels else np.zeros(0)
        rate = np.concatenate([ri, rd])
        change = np.concatenate([np.arange(1, len(ri) + 1), -np.arange(1, len(rd) + 1)])
        total = rate.sum()
        drift, spread, upto, pi = (change * rate).sum(), (change**2 * rate).sum(), _cumulative(rate / total) if total else None, _cumulative(sub.pi).tolist()
        if tables is not None:
            tables["indels"] = rate, change, total, drift, spread, upto, pi
    if not total or t <= 0:
        return
    sites = array("i", np.arange(len(r.bases), dtype=np.int32).tobytes())
    bases, classes = [], []  # of new sites, numbered on from the old ones
    old, k, invariant = len(sites), len(sub.gammas), sub.invariant
    one_class = k == 1 and not invariant
    integers, random = rng.integers, rng.random

    def one(c: int) -> None:
        n = len(sites)
        if not n:
            return
        if c > 0:
            at = int(integers(0, n)) + 1
            first = old + len(bases)
            for _ in range(c):  # one by one: few at a time cost less so than arrays do, from the same stream
                bases.append(bisect_right(pi, random()))
            if one_class:
                classes.extend([0] * c)
            else:
                drawn = [int(integers(0, k)) for _ in range(c)]
                classes.extend([k if random() < invariant else d for d in drawn])
            sites[at:at] = array("i", range(first, first + c))
        else:
            size = min(-c, n)
            at = int(integers(0, n - size + 1))
            del sites[at : at + size]

    left, events = t, 0
    while left > 0 and sites:
        n = len(sites)
        if not epsilon:
            left -= rng.exponential(1 / (total * n))
            if left > 0:
                one(int(change[upto.searchsorted(random(), side="right")]))
                events += 1
            continue
        wide = max(epsilon * n, 1.0)
        m1, m2 = abs(drift * n), spread * n
        tau = min(left, wide / m1 if m1 > 0 else np.inf, wide**2 / m2)
        drawn = np.repeat(change, rng.poisson(rate * n * tau))
        rng.shuffle(drawn)
        for c in drawn.tolist():
            one(c)
        events += len(drawn)
        left -= tau
    if events:
        order = np.frombuffer(sites, np.int32)
        r.bases = np.concatenate([r.bases, np.array(bases, np.int8)])[order]
        r.origin = np.concatenate([r.origin, np.full(len(bases), -1)])[order]
        r.classes = np.concatenate([r.classes, np.array(classes, np.int16)])[order]


def _cumulative(p: np.ndarray) -> np.ndarray:
    c = p.cumsum()
    return c / c[-1]


def evolve(ref: str, start: int, tree: Tree, sub: Substitution, ins: Indels | None, dels: Indels | None, epsilon: float, key: tuple, tables: dict | None = None) -> list[list[tuple[int, int, str]]]:
    """Mutations (old_pos, ref_len, alt) of each tip against ref, whose first base is at start in its chromosome.

    tables, if given, remembers chances by branch length, for one sub, ins and dels, from call to call.
    """
    rng = generator(*key)
    bases = _CODES[np.frombuffer(ref.encode("ascii", "replace"), np.uint8)].copy()
    root = Region(bases, np.arange(len(bases)), draw_classes(len(bases), sub, rng))
    at = {tree.root: root}
    left = {p: 0 for p, _, _ in tree.edges}
    for p, _, _ in tree.edges:
        left[p] += 1
    for parent, child, length in tree.edges:
        r = at[parent].copy()
        left[parent] -= 1
        if not left[parent]:
            del at[parent]  # no more children: only what is still needed is kept
        indels(r, ins, dels, sub, length, epsilon, rng, tables)
        substitute(r, sub, length, rng, tables)
        at[child] = r
    return [differences(ref, start, at[i]) for i in range(len(tree.tips))]


def differences(ref: str, start: int, r: Region) -> list[tuple[int, int, str]]:
    text = _LETTERS[np.minimum(r.bases, 4)].tobytes().decode()
    kept = np.flatnonzero(r.origin >= 0)
    original = _CODES[np.frombuffer(ref.encode("ascii", "replace"), np.uint8)]
    out: list[tuple[int, int, str]] = []
    # a break is where neighbours in the haplotype are not neighbours in the reference
    origin = np.concatenate([[-1], r.origin[kept], [len(ref)]])
    place = np.concatenate([[-1], kept, [len(text)]])
    at = np.flatnonzero((np.diff(origin) != 1) | (np.diff(place) != 1))
    for o, upto, p, end in zip(origin[at].tolist(), origin[at + 1].tolist(), place[at].tolist(), place[at + 1].tolist(), strict=True):
        out += canonical(ref, o + 1, upto, text[p + 1 : end])
    taken = {m[0]: j for j, m in enumerate(out)}
    kept_at = r.origin[kept]
    changed = np.flatnonzero(original[kept_at] != r.bases[kept])
    for p, i in zip(kept_at[changed].tolist(), kept[changed].tolist(), strict=True):
        b = text[i]
        if p in taken:  # the base before an insertion has changed too
            j = taken[p]
            out[j] = (p, out[j][1], b + out[j][2][1:]) if p or out[j][2][-1:] != ref[0] else (p, 1, out[j][2][:-1] + b)
        else:
            out.append((p, 1, b))
    return sorted((p + start, n, a) for p, n, a in out)
