"""Search over equivalence classes of graphs, and a Bayesian score, from one matrix of moments.

The data give the moments in one scan; the search runs on the driver over some dozens of variables.
A class is a partly directed graph: an edge whose direction all its members share is an arrow, the
others are links. Insertions and deletions are tested by cliques and semi-directed paths, turns by
building a member; after a move a consistent extension is found and completed to its class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from infocausal.operators.dependence import Gram
from infocausal.operators.discovery import closed

Score = Callable[[str, frozenset], float]


@dataclass
class Class:
    """arrows: (a, b) both ways for a link, one way for an arrow."""

    names: list[str]
    arrows: set[tuple[str, str]] = field(default_factory=set)

    def adjacent(self, a: str, b: str) -> bool:
        return (a, b) in self.arrows or (b, a) in self.arrows

    def linked(self, a: str, b: str) -> bool:
        return (a, b) in self.arrows and (b, a) in self.arrows

    def links(self, v: str) -> set[str]:
        return {w for w in self.names if self.linked(v, w)}

    def parents(self, v: str) -> frozenset:
        return frozenset(w for w in self.names if (w, v) in self.arrows and (v, w) not in self.arrows)

    def clique(self, vs: Iterable[str]) -> bool:
        return all(self.adjacent(a, b) for a, b in combinations(vs, 2))

    def reaches(self, a: str, b: str, without: Iterable[str]) -> bool:
        """Whether a path from a to b that goes against no arrow avoids the nodes `without`."""
        met, todo = {a, *without}, [a]
        while todo:
            v = todo.pop()
            for w in self.names:
                if (v, w) in self.arrows and w not in met:
                    if w == b:
                        return True
                    met.add(w)
                    todo.append(w)
        return False


def _subsets(vs: Iterable[str]) -> Iterator[tuple]:
    vs = sorted(vs)
    return chain.from_iterable(combinations(vs, k) for k in range(len(vs) + 1))


def extension(names: list[str], arrows: set[tuple[str, str]]) -> dict[str, frozenset] | None:
    """Parents of a graph without cycles that keeps the arrows, directs the links and adds no collider between strangers; None if there is none.

    Again and again a node is taken that has no arrow out, and whose links go to nodes that are next to all its neighbours.
    """
    g = Class(list(names), set(arrows))
    left, parents = set(names), {v: set() for v in names}
    while left:
        for v in sorted(left):
            around = {w for w in left if w != v and g.adjacent(v, w)}
            links = {w for w in around if g.linked(v, w)}
            if any((v, w) in g.arrows and w not in links for w in around):
                continue
            if all(g.adjacent(a, b) for a in links for b in around if a != b):
                parents[v] |= around
                g.arrows = {(a, b) for a, b in g.arrows if v not in (a, b)}
                left.discard(v)
                break
        else:
            return None
    return {v: frozenset(p) for v, p in parents.items()}


def class_of(parents: dict[str, frozenset]) -> Class:
    """The class of a graph: its colliders between strangers, closed by the rules."""
    names = sorted(parents)
    edges = {frozenset((p, v)) for v, ps in parents.items() for p in ps}
    arrows = {(a, b) for e in edges for a, b in (tuple(e), tuple(e)[::-1])}
    for v, ps in parents.items():
        for a, b in combinations(ps, 2):
            if frozenset((a, b)) not in edges:
                arrows -= {(v, a), (v, b)}
    return Class(names, closed(names, edges, arrows))


def cached(local: Callable[[str, list[str]], float]) -> Score:
    known: dict[tuple[str, frozenset], float] = {}

    def score(v: str, ps: frozenset) -> float:
        if (v, ps) not in known:
            known[v, ps] = local(v, sorted(ps))
        return known[v, ps]

    return score


def total(parents: dict[str, frozenset], score: Score) -> float:
    return sum(score(v, ps) for v, ps in parents.items())


def _insertions(g: Class, score: Score, most: int) -> Iterator[tuple[float, tuple, set]]:
    for y in g.names:
        near, own = g.links(y), g.parents(y)
        for x in g.names:
            if x == y or g.adjacent(x, y):
                continue
            shared = {w for w in near if g.adjacent(w, x)}
            for t in _subsets(near - shared):
                base = frozenset(shared | set(t))
                if len(base | own) >= most or not g.clique(base) or g.reaches(y, x, base):
                    continue
                gain = score(y, base | own | {x}) - score(y, base | own)
                yield gain, ("insert", x, y, t), (g.arrows | {(x, y)}) - {(y, w) for w in t}


def _deletions(g: Class, score: Score) -> Iterator[tuple[float, tuple, set]]:
    for y in g.names:
        own = g.parents(y)
        for x in g.names:
            if x == y or (x, y) not in g.arrows:
                continue
            shared = {w for w in g.links(y) if g.adjacent(w, x)}
            for h in _subsets(shared):
                base = frozenset(shared - set(h))
                if not g.clique(base):
                    continue
                rest = (base | own) - {x}
                gain = score(y, rest) - score(y, rest | {x})
                gone = {(x, y), (y, x)} | {(w, y) for w in h} | {(w, x) for w in h if g.linked(w, x)}
                yield gain, ("delete", x, y, h), g.arrows - gone


def _turns(g: Class, score: Score, now: float, most: int) -> Iterator[tuple[float, tuple, set]]:
    """x -> y where it was y -> x or a link, with C -> y of y's links and the other links away from y, if a member has that."""
    for y in g.names:
        near, own = g.links(y), g.parents(y)
        for x in g.names:
            if x == y or (y, x) not in g.arrows:
                continue
            for c in _subsets(near - {x}):
                if len(own) + len(c) >= most or not g.clique(c):
                    continue
                turned = (g.arrows | {(x, y)}) - {(y, x)} - {(y, w) for w in c} - {(w, y) for w in near - {x} - set(c)}
                made = extension(g.names, turned)
                if made is not None:
                    yield total(made, score) - now, ("turn", x, y, c), turned


def search(names: list[str], score: Score, most_parents: int | None = None) -> tuple[Class, list[tuple]]:
    """The class where no insertion, then no deletion, then no turn gains; phases again until none does. Ties go to the first by name."""
    names = sorted(names)
    most = len(names) if most_parents is None else most_parents
    g, steps, changed = Class(names), [], True
    while changed:
        changed = False
        for phase in (lambda: _insertions(g, score, most), lambda: _deletions(g, score), lambda: _turns(g, score, total(extension(g.names, g.arrows), score), most)):
            while True:
                best, least = None, 1e-9 * (1 + sum(abs(score(v, ps)) for v, ps in extension(g.names, g.arrows).items()))  # over what rounding makes
                for gain, step, arrows in phase():
                    if gain > least and (best is None or (-round(gain, 9), step) < best[:2]):
                        best = (-round(gain, 9), step, arrows)
                made = extension(names, best[2]) if best else None
                if made is None:
                    break
                g = class_of(made)
                steps.append((*best[1], -best[0]))
                changed = True
    return g, steps


def bge_local(gram: Gram, prior_mean: float = 1.0, extra: float = 1.0) -> Callable[[str, list[str]], float]:
    """The log marginal likelihood of a variable given its parents under normal data with a Normal-Wishart prior around the sample means.

    prior_mean: rows that the prior mean counts for; extra: degrees of freedom over the least that the prior needs.
    """
    p, n = len(gram.columns), gram.n
    dof = p + prior_mean + extra
    t = prior_mean * (dof - p - 1) / (prior_mean + 1) if dof > p + 1 else prior_mean / (prior_mean + 1)
    r = t * np.eye(p) + n * gram.cov
    at = {c: i for i, c in enumerate(gram.columns)}

    def log_det(vs: list[str]) -> float:
        i = [at[v] for v in vs]
        return float(np.linalg.slogdet(r[np.ix_(i, i)])[1]) if i else 0.0

    def local(v: str, ps: list[str]) -> float:
        k = len(ps)
        a = dof - p + k + 1
        return (
            0.5 * math.log(prior_mean / (n + prior_mean)) + math.lgamma((n + a) / 2) - math.lgamma(a / 2) - n / 2 * math.log(math.pi) + (a + k) / 2 * math.log(t)
            + (n + a - 1) / 2 * log_det(ps) - (n + a) / 2 * log_det([*ps, v])
        )

    return local


def scores(gram: Gram, kind: str) -> Score:
    """bic, aic or bge, larger is better."""
    return cached({"bic": gram.bic, "aic": gram.aic}[kind] if kind != "bge" else bge_local(gram))


def ges(spark: SparkSession, df: DataFrame, columns: list[str], score: str = "bic", most_parents: int | None = None) -> DataFrame:
    """a, b, directed: the class that the search ends at; links have a < b."""
    found, _ = search(columns, scores(Gram(df, columns), score), most_parents)
    rows = sorted({(a, b, True) if (b, a) not in found.arrows else (min(a, b), max(a, b), False) for a, b in found.arrows})
    return spark.createDataFrame(rows, "a string, b string, directed boolean")


def graph_scores(spark: SparkSession, df: DataFrame, columns: list[str], graphs: dict[str, dict[str, list[str]]]) -> DataFrame:
    """graph, bic, aic, bge of named graphs (node -> parents), all from one scan."""
    gram = Gram(df, columns)
    rows = [(name, *[float(total({v: frozenset(g.get(v, ())) for v in columns}, scores(gram, k))) for k in ("bic", "aic", "bge")]) for name, g in graphs.items()]
    return spark.createDataFrame(rows, "graph string, bic double, aic double, bge double")
