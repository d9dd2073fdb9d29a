"""Structure learning: the data give one matrix of moments; the search runs on that matrix.

The constraint search keeps a fixed order (names ascending) and freezes neighbours by level, so its
result does not depend on the order of removals.
"""

from __future__ import annotations

from itertools import combinations, count

from pyspark.sql import DataFrame, SparkSession

from infocausal.operators.dependence import Gram


def skeleton(gram: Gram, alpha: float = 0.05, most: int | None = None) -> tuple[set[frozenset], dict[frozenset, tuple]]:
    """Edges and separating sets; levels go on until no node has enough neighbours, or to sets of `most`."""
    names = sorted(gram.columns)
    edges, sepset = {frozenset(p) for p in combinations(names, 2)}, {}
    for level in count() if most is None else range(most + 1):
        frozen = {v: sorted(w for w in names if frozenset((v, w)) in edges) for v in names}
        if all(len(ws) <= level for ws in frozen.values()):
            break
        for a, b in combinations(names, 2):
            if frozenset((a, b)) not in edges:
                continue
            options = [z for side, other in ((a, b), (b, a)) for z in combinations([w for w in frozen[side] if w != other], level)]
            for z in dict.fromkeys(options):
                if gram.fisher_p(a, b, list(z)) > alpha:
                    edges.discard(frozenset((a, b)))
                    sepset[frozenset((a, b))] = z
                    break
    return edges, sepset


def oriented(names: list[str], edges: set[frozenset], sepset: dict[frozenset, tuple]) -> set[tuple[str, str]]:
    """Arrows (a, b) of the class: v-structures, then the first three of the usual closing rules. An undirected edge is both arrows."""
    arrows = {(a, b) for e in edges for a, b in (tuple(e), tuple(e)[::-1])}
    for a, b in combinations(sorted(names), 2):
        if frozenset((a, b)) in edges:
            continue
        for c in sorted(names):
            if frozenset((a, c)) in edges and frozenset((b, c)) in edges and c not in sepset.get(frozenset((a, b)), ()):
                for x in (a, b):
                    if (x, c) in arrows:
                        arrows.discard((c, x))
    return closed(names, edges, arrows)


def closed(names: list[str], edges: set[frozenset], arrows: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """The arrows that follow from those with one direction, by the first three closing rules; changes `arrows`."""
    directed = lambda a, b: (a, b) in arrows and (b, a) not in arrows
    changed = True
    while changed:
        changed = False
        for b, c in sorted(arrows):
            if (c, b) not in arrows or (b, c) not in arrows:
                continue
            one = any(directed(a, b) and frozenset((a, c)) not in edges for a in names)
            two = any(directed(b, k) and directed(k, c) for k in names)
            three = any(
                directed(k, c) and directed(m, c) and frozenset((k, m)) not in edges and (b, k) in arrows and (k, b) in arrows and (b, m) in arrows and (m, b) in arrows
                for k, m in combinations(sorted(names), 2)
            )
            if one or two or three:
                arrows.discard((c, b))
                changed = True
    return arrows


def pc(spark: SparkSession, df: DataFrame, columns: list[str], alpha: float = 0.05, most: int | None = None) -> DataFrame:
    """a, b, directed: the edges of the class; undirected ones have a < b."""
    gram = Gram(df, columns)
    edges, sepset = skeleton(gram, alpha, most)
    arrows = oriented(columns, edges, sepset)
    rows = sorted({(a, b, True) if (b, a) not in arrows else (min(a, b), max(a, b), False) for a, b in arrows})
    return spark.createDataFrame(rows, "a string, b string, directed boolean")


def greedy(spark: SparkSession, df: DataFrame, columns: list[str], most_parents: int | None = None) -> DataFrame:
    """a, b: the DAG that hill climbing by BIC ends at; additions, removals and reversals, best gain first, ties by name."""
    gram, names = Gram(df, columns), sorted(columns)
    most_parents = len(names) if most_parents is None else most_parents
    parents: dict[str, frozenset] = {v: frozenset() for v in names}
    score = {}

    def local(v: str, ps: frozenset) -> float:
        if (v, ps) not in score:
            score[v, ps] = gram.bic(v, sorted(ps))
        return score[v, ps]

    def reaches(a: str, b: str) -> bool:
        return a == b or any(a in parents[c] and reaches(c, b) for c in names)

    while True:
        best = (1e-9, None)
        for a in names:
            for b in names:
                if a == b:
                    continue
                if a in parents[b]:
                    drop = local(b, parents[b] - {a}) - local(b, parents[b])
                    moves = [(drop, ("drop", a, b))]
                    if len(parents[a]) < most_parents:
                        before, parents[b] = parents[b], parents[b] - {a}
                        if not reaches(a, b):
                            moves.append((drop + local(a, parents[a] | {b}) - local(a, parents[a]), ("turn", a, b)))
                        parents[b] = before
                elif b not in parents[a] and len(parents[b]) < most_parents and not reaches(b, a):
                    moves = [(local(b, parents[b] | {a}) - local(b, parents[b]), ("add", a, b))]
                else:
                    continue
                for m in moves:
                    if m[0] > best[0] + 1e-12:
                        best = m
        if best[1] is None:
            break
        kind, a, b = best[1]
        parents[b] = parents[b] | {a} if kind == "add" else parents[b] - {a}
        if kind == "turn":
            parents[a] = parents[a] | {b}
    rows = sorted((p, v) for v, ps in parents.items() for p in ps)
    return spark.createDataFrame(rows, "a string, b string")
