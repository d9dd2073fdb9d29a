"""Which covariates to adjust for on a causal graph, and which of the valid sets gives the least variance.

Graphs are edge lists, or arrows both ways for the links of an equivalence class; they have some
dozens of nodes. Estimates for all sets come from one matrix of moments.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from infocausal.operators.dependence import Gram
from infocausal.operators.equivalence import Class, extension
from infocausal.operators.graph import d_separated
from infocausal.operators.identify import ancestors


def _below(edges: list[tuple], of: Iterable) -> set:
    return ancestors([(b, a) for a, b in edges], set(of))


def causal_nodes(edges: list[tuple], x, y) -> set:
    """Nodes on directed paths from x to y, without x."""
    return (_below(edges, [x]) & ancestors(edges, {y})) - {x}


def forbidden(edges: list[tuple], x, y) -> set:
    """What no valid set may hold: x, and all that comes of the nodes between x and y (and of y)."""
    return _below(edges, causal_nodes(edges, x, y)) | {x}


def valid_set(edges: list[tuple], x, y, z: Iterable) -> bool:
    """The generalised criterion on a graph without links: nothing forbidden, and no way from x to y open but the directed ones."""
    z, between = set(z), causal_nodes(edges, x, y)
    if z & (forbidden(edges, x, y) | {y}):
        return False
    return d_separated([(a, b) for a, b in edges if not (a == x and b in between)], x, y, z)


def amenable(arrows: set[tuple], x, y) -> bool:
    """Whether every possibly directed way from x to y in a class begins with an arrow; else no set is valid for all its members."""
    g = Class(sorted({v for a in arrows for v in a}), set(arrows))
    return not any(v == y or g.reaches(v, y, {x}) for v in g.links(x))


def valid_in_class(arrows: set[tuple], x, y, z: Iterable) -> bool:
    """Whether a set is valid in every graph of the class: it is amenable, nothing possibly forbidden is held, and one member's other ways are closed."""
    arrows, z = set(arrows), set(z)
    if not amenable(arrows, x, y):
        return False
    names = sorted({v for a in arrows for v in a})
    # Possibly directed ways may use links in either direction, so arrows of both directions stand for them.
    ways = sorted(a for a in arrows if a[1] != x)
    between = (_below(ways, [x]) & ancestors(ways, {y})) - {x}
    if z & (_below(ways, between) | {x, y}):
        return False
    member = extension(names, arrows)
    if member is None:
        raise ValueError("these arrows are no class of graphs without cycles")
    return valid_set([(p, v) for v, ps in member.items() for p in ps], x, y, z)


def parent_set(edges: list[tuple], x) -> set:
    return {a for a, b in edges if b == x}


def optimal_set(edges: list[tuple], x, y) -> set | None:
    """Parents of the nodes between x and y (and of y) that aren't forbidden: of all valid sets the one with the least asymptotic variance in linear models. None if y doesn't come of x."""
    between = causal_nodes(edges, x, y)
    return {a for a, b in edges if b in between} - forbidden(edges, x, y) if between else None


def valid_sets(edges: list[tuple], x, y, observed: Iterable | None = None, minimal: bool = False) -> list[tuple]:
    """All valid sets of observed nodes, smaller ones first; minimal: those without a valid part."""
    nodes = sorted((set(observed) if observed is not None else {v for e in edges for v in e}) - forbidden(edges, x, y) - {y})
    out: list[tuple] = []
    for z in chain.from_iterable(combinations(nodes, k) for k in range(len(nodes) + 1)):
        if minimal and any(set(o) <= set(z) for o in out):
            continue
        if valid_set(edges, x, y, z):
            out.append(z)
    return out


def disjunctive_causes(edges: list[tuple], x, y, observed: Iterable | None = None) -> set:
    """Observed causes of x or of y that don't come of x: valid whenever any observed set is."""
    found = (ancestors(edges, {x}) | ancestors(edges, {y})) - _below(edges, [x]) - {y}
    return found if observed is None else found & set(observed)


def harmful(edges: list[tuple], x, y) -> list:
    """Nodes that spoil an adjustment by themselves though none is needed: conditioning on such a collider opens a way (the M shape, or selection)."""
    if not valid_set(edges, x, y, ()):
        return []
    return sorted(v for v in {v for e in edges for v in e} - {x, y} if not valid_set(edges, x, y, [v]))


def adjusted(gram: Gram, x: str, y: str, z: Iterable[str]) -> tuple[float, float]:
    """The slope of y on x given z, and its asymptotic standard error."""
    z = list(z)
    slopes, _, rest = gram.ols(y, [x, *z])
    own = gram.ols(x, z)[2]
    return float(slopes[0]), float(np.sqrt(rest / max(own, 1e-300) / gram.n))


def adjusted_effects(spark: SparkSession, df: DataFrame, edges: list[tuple], x: str, y: str) -> DataFrame:
    """adjusted (names joined by commas), estimate, se, optimal for every valid set of columns; one scan."""
    columns = [c for c in df.columns if c in {v for e in edges for v in e}]
    gram, best = Gram(df, columns), optimal_set(edges, x, y)
    rows = [(",".join(z), *adjusted(gram, x, y, z), best is not None and set(z) == best) for z in valid_sets(edges, x, y, columns)]
    return spark.createDataFrame(rows, "adjusted string, estimate double, se double, optimal boolean")


def most_efficient(effects: DataFrame) -> DataFrame:
    """The row with the least error; of equal ones that which comes first by name."""
    return effects.orderBy("se", "adjusted").limit(1)
