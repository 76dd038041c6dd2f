"""Smooth sensitivity of a join's size, and target sizes made from it.

Deterministic sizing only: nothing here is random, and no result may be taken for a differentially private release.

Relations are bits of a mask. Every edge is one attribute, known by its child; the boundary of a set of relations are the edges that
leave it. T(E) bounds how many combinations of rows of the set E agree with one assignment of its boundary. Local sensitivity at distance k
adds k changed rows anywhere: the largest, over a left-out relation and shares of k, of the sum over sets E of T(E) times
the shares of the relations outside E. The sensitivity is the maximum over k of exp(-beta k) times that.

With floor every T, size and result is at least 1. Without it, as in SQL, what has no rows has no bound (None): an exact bound of no joined rows
gives way to the degree bound, and a left-out relation whose others have an empty one among them tells nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..operators.aggregates import max_frequency
from .contributions import LONG_MAX, count_output
from .tree import JoinTree

LEAVES = 5e5  #: estimated evaluations above which a sensitivity is not computed: the driver makes about 10,000 a second


def clip(n: int) -> int:
    return min(n, LONG_MAX)


def smoothing(epsilon: float, delta: float) -> float:
    """beta. Values out of range stand for epsilon 1 and delta 1e-9."""
    epsilon = epsilon if epsilon > 0 else 1.0
    delta = delta if 0 < delta < 1 else 1e-9
    return epsilon / (2 * math.log(2 * math.exp(epsilon / 2) / delta))


def largest_distance(m: int, beta: float) -> int:
    return int((m - 1) / beta) + m


def estimated_leaves(distance: int, m: int) -> float:
    free = m - 3
    return m * 2.0 if free <= 0 or distance <= 1 else m * 2.0 * float(distance) ** free / math.factorial(free)


def _best_split(a: float, b: float, c: float, d: float, totals: np.ndarray) -> np.ndarray:
    """max of a x y + b x + c y + d over whole x + y = t, for each t: at an end, or beside the vertex."""
    best = np.maximum(b * totals, c * totals) + d
    if a:
        vertex = np.trunc((a * totals + b - c) / (2 * a))
        for x in (vertex, vertex + 1):
            y = totals - x
            best = np.where((0 < x) & (x < totals), np.maximum(best, a * x * y + b * x + c * y + d), best)
    return best


def residual(bounds: Mapping[int, int | None], m: int, beta: float) -> int:
    """max over k of exp(-beta k) times the local sensitivity at distance k. bounds: T by mask; the empty set has 1.

    The shares of all but two relations are enumerated; for those two the sum is a quadratic form, maximal in closed form. With two
    relations only one share is free; the form then keeps the bound of the empty set as its mixed coefficient, an upper bound.
    """
    if m <= 1 or beta <= 0:
        return 1
    top, best = largest_distance(m, beta), 0.0
    for gone in range(m):
        others = [r for r in range(m) if r != gone]
        if bounds.get(sum(1 << r for r in others), 1) is None:
            continue
        held, pair = others[:-2], others[-2:]

        def coefficient(shares: tuple[int, ...], inside: int) -> float:
            total = 0.0
            for chosen in itertools.product((0, 1), repeat=len(held)):
                factor, mask = 1.0, inside
                for bit, r, k in zip(chosen, held, shares):
                    mask |= bit << r
                    factor *= 1 if bit else k
                if factor:
                    total += factor * bounds.get(mask, 1)
            return total

        for shares in _shares(len(held), top):
            used = sum(shares)
            totals = np.arange(top - used + 1, dtype=float)
            if len(pair) == 2:
                x, y = (1 << r for r in pair)
                form = coefficient(shares, 0), coefficient(shares, y), coefficient(shares, x), coefficient(shares, x | y)
            else:
                only = float(bounds.get(1 << pair[0], 1))
                form = 1.0, only, 1.0, only
            best = max(best, float(np.max(np.exp(-beta * (totals + used)) * _best_split(*form, totals))))
    return LONG_MAX if best > LONG_MAX else max(1, math.ceil(best))


def _shares(n: int, total: int):
    """All n whole numbers with a sum of at most total."""
    if not n:
        yield ()
        return
    for first in range(total + 1):
        for rest in _shares(n - 1, total - first):
            yield (first, *rest)


@dataclass
class Sensitivity:
    ok: bool = False
    too_expensive: bool = False
    distance: int = 0
    leaves: float = 0.0
    degree_only: int = 0
    consistent: int = 0
    relaxed: int = 0
    ceiling: int = 0
    final: int = 0
    exact_available: int = 0
    exact_used: int = 0


class SizeModel:
    """Bounds of one tree. Degrees and component boundaries are Spark aggregates, each computed once; the rest is arithmetic over masks."""

    def __init__(self, tree: JoinTree, floor: bool = True):
        self.tree, self.names, self.floor = tree, list(tree.relations), floor
        self.m = len(self.names)
        at = {r: i for i, r in enumerate(self.names)}
        self.parent = {at[e.child]: at[e.parent] for e in tree.edges}
        self.columns = {(at[e.child], at[e.child]): e.child_columns for e in tree.edges} | {(at[e.parent], at[e.child]): e.parent_columns for e in tree.edges}
        self.near = {r: {c for c, p in self.parent.items() if p == r} | ({self.parent[r]} if r in self.parent else set()) for r in range(self.m)}
        self.attributes = {r: frozenset(a for x, a in self.columns if x == r) for r in range(self.m)}
        self._degrees: dict[tuple[int, frozenset], int | None] = {}
        self._boundaries: dict[tuple[frozenset, frozenset], int | None] = {}
        self.rows = {r: self.tree.relations[n].count() for r, n in enumerate(self.names)}

    def raised(self, n: int) -> int | None:
        """A bound of n rows."""
        return max(1, n) if self.floor else n or None

    def degree(self, r: int, attributes: frozenset) -> int | None:
        """Most rows of r that agree in the attributes."""
        if (r, attributes) not in self._degrees:
            columns = [c for a in sorted(attributes) for c in self.columns[r, a]]
            self._degrees[r, attributes] = self.raised(max_frequency(self.tree.relations[self.names[r]], columns).first()[0] if columns else self.rows[r])
        return self._degrees[r, attributes]

    def members(self, mask: int) -> list[int]:
        return [r for r in range(self.m) if mask >> r & 1]

    def boundary(self, mask: int) -> frozenset:
        return frozenset(a for a, p in self.parent.items() if (mask >> a & 1) != (mask >> p & 1))

    def step_towards(self, source: int, goal: int) -> int:
        """The neighbour of source on the way to goal."""
        for first in self.near[source]:
            seen, stack = {source, first}, [first]
            while stack:
                r = stack.pop()
                if r == goal:
                    return first
                stack += self.near[r] - seen
                seen |= self.near[r]
        raise ValueError("the tree is not connected")

    def by_degrees(self, mask: int, kept: frozenset) -> int | None:
        """The largest, over relations outside, of the product of degrees inside: each by its edge towards that relation and its kept boundary edges."""
        if not self.floor and not all(self.rows[j] for j in self.members(mask)):
            return None
        best = 1
        for r in (r for r in range(self.m) if not mask >> r & 1):
            product = 1
            for j in self.members(mask):
                n = self.step_towards(j, r)
                product = clip(product * self.degree(j, (self.attributes[j] & self.attributes[n]) | (kept & self.attributes[j])))
            best = max(best, product)
        return best

    def components(self, mask: int) -> list[frozenset]:
        left, out = set(self.members(mask)), []
        while left:
            stack, part = [min(left)], set()
            while stack:
                r = stack.pop()
                part.add(r)
                stack += (self.near[r] & left) - part
            out.append(frozenset(part))
            left -= part
        return out

    def exact(self, mask: int, kept: frozenset) -> int | None:
        """The real bound: the product over components; None if a component's kept boundary leaves from two relations, or without floor if it has no rows."""
        product = 1
        for part in self.components(mask):
            key = part, kept
            if key not in self._boundaries:
                self._boundaries[key] = self._component(part, kept & self.boundary(sum(1 << r for r in part)))
            if self._boundaries[key] is None:
                return None
            product = clip(product * self._boundaries[key])
        return product

    def _component(self, part: frozenset, edges: frozenset) -> int | None:
        carriers = {a if a in part else self.parent[a] for a in edges}
        if len(carriers) > 1:
            return None
        top = next(iter(carriers)) if carriers else min(part)
        if len(part) == 1:
            return self.degree(top, edges)
        from .contributions import contributions
        from .tree import Edge

        # the component as a tree of its own, rooted where its boundary leaves
        todo, seen, tree_edges = [top], {top}, []
        for r in todo:
            for n in sorted((self.near[r] & part) - seen):
                a = n if self.parent.get(n) == r else r
                tree_edges.append(Edge(self.names[n], self.names[r], tuple(self.columns[n, a]), tuple(self.columns[r, a])))
                seen.add(n)
                todo.append(n)
        name = self.names[top]
        columns = [c for a in sorted(edges) for c in self.columns[top, a]]
        keys = {r: [c for e in tree_edges for c in (e.child_columns if e.child == self.names[r] else ()) + (e.parent_columns if e.parent == self.names[r] else ())] for r in part}
        output = {self.names[r]: list(dict.fromkeys(keys[r] + (columns if r == top else []))) for r in part}
        inner = JoinTree({self.names[r]: self.tree.relations[self.names[r]] for r in sorted(part)}, tree_edges, name, output)
        rows = contributions(inner, saturate=True)[name]
        total = F.sum(F.col(f"{name}__delta").cast("decimal(38,0)")).alias("n")
        grouped = rows.groupBy(*[f"{name}__{c}" for c in columns]).agg(total) if columns else rows.agg(total)
        return self.raised(clip(int(grouped.agg(F.max("n")).first()[0] or 0)))

    def compute(self, epsilon: float, delta: float) -> Sensitivity:
        beta, m = smoothing(epsilon, delta), self.m
        out = Sensitivity(ok=True, distance=largest_distance(m, beta))
        out.leaves = estimated_leaves(out.distance, m)
        if out.leaves > LEAVES:
            out.too_expensive = True
            return out
        full = (1 << m) - 1
        larger_first = sorted(range(1, full), key=lambda e: (-e.bit_count(), e))
        degree: dict[tuple[int, frozenset], int | None] = {}
        exact: dict[tuple[int, frozenset], int | None] = {}
        for e in larger_first:
            edges = self.boundary(e)
            for n in range(len(edges) + 1):
                for dropped in map(frozenset, itertools.combinations(sorted(edges), n)):
                    degree[e, dropped] = self.by_degrees(e, edges - dropped)
                    exact[e, dropped] = self.exact(e, edges - dropped)
        of = lambda table, e: {d: v for (x, d), v in table.items() if x == e and v is not None}
        by_degree = {e: min(of(degree, e).values(), default=None) for e in larger_first}
        by_exact = {e: min(of(exact, e).values(), default=None) for e in larger_first}
        better = {e for e in larger_first if by_exact[e] is not None and by_exact[e] < by_degree[e]}
        out.exact_available = len(better)
        over = lambda e: [e | 1 << r for r in range(m) if not e >> r & 1 and e | 1 << r != full]
        # an exact bound is taken only where all sets one larger take theirs
        used: set[int] = set()
        for e in larger_first:
            if e in better and all(s in used for s in over(e)):
                used.add(e)
        out.exact_used = len(used)
        consistent = {e: by_exact[e] if e in used else by_degree[e] for e in larger_first}
        # relaxations chosen for larger sets bind the smaller ones; below a degree bound only degree bounds follow
        chosen: dict[int, tuple[frozenset, str]] = {}
        relaxed: dict[int, int | None] = {}
        for e in larger_first:
            needed = frozenset().union(*(chosen[s][0] for s in over(e))) & self.boundary(e)
            options = [(v, order, d, "degree") for order, d, v in [(1, needed, degree.get((e, needed)))] if v]
            if not any(chosen[s][1] == "degree" for s in over(e)):
                options += [(v, 0 if d == needed else 2, d, "exact") for d, v in of(exact, e).items() if d >= needed and v > 0]
            value, _, dropped, kind = min(options, key=lambda o: (o[0], o[1], sum(1 << a for a in o[2]))) if options else (by_degree[e], 0, frozenset(), "degree")
            chosen[e], relaxed[e] = (dropped, kind), value
        out.degree_only, out.consistent, out.relaxed = (residual(t, m, beta) for t in (by_degree, consistent, relaxed))
        out.ceiling = self.ceiling()
        out.final = min(out.degree_only, out.consistent, out.relaxed, out.ceiling)
        return out

    def ceiling(self) -> int:
        """Largest product of the sizes of all relations but one: holds for every instance of these sizes."""
        return max(int(self.floor), max(clip(math.prod(self.rows[j] for j in range(self.m) if j != i)) for i in range(self.m)))


def noise_factor(epsilon: float, delta: float) -> float:
    epsilon = epsilon if epsilon > 0 else 1.0
    delta = delta if 0 < delta < 1 else 1e-9
    return 2 * math.exp(2) / epsilon * (1 + math.log(1 + (2 * math.exp(epsilon) - 2 * math.exp(epsilon / 2)) / delta))


@dataclass
class PaddedSize:
    exact_rows: int
    sensitivity: int
    factor: float
    target: int

    @property
    def padding(self) -> int:
        return self.target - self.exact_rows


def padded_size(tree: JoinTree, epsilon: float = 1.0, delta: float = 1e-9, explicit: int = 0, floor: bool = True) -> PaddedSize:
    """exact + ceil(factor * sensitivity), or the explicit size if that is larger than the exact one; saturating. With floor the sensitivity and the size are at least 1."""
    exact = count_output(tree, saturate=True)
    found = SizeModel(tree, floor).compute(epsilon, delta)
    sensitivity = 0 if found.too_expensive else found.final
    if explicit > 0:
        return PaddedSize(exact, sensitivity, 0.0, max(int(floor), exact, explicit))
    factor = noise_factor(epsilon, delta)
    noise = factor * max(int(floor or found.too_expensive), sensitivity)
    return PaddedSize(exact, sensitivity, factor, max(int(floor), clip(exact + (math.ceil(noise) if noise < LONG_MAX else LONG_MAX))))
