"""Structure learning with hidden causes, comparison of graphs, and search by score. The data give one matrix of
moments (dependence.Gram); graphs over variables have dozens of nodes, so the searches run on the driver."""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infocausal.operators.dependence import Gram
from infocausal.operators.discovery import skeleton
from infocausal.operators.graph import d_separated

CIRCLE, ARROW, TAIL = "o", ">", "-"


class Pag:
    """A partial ancestral graph: mark[a, b] is the mark at b of the edge between a and b."""

    def __init__(self, names: list[str], edges: set[frozenset]):
        self.names = sorted(names)
        self.mark = {(a, b): CIRCLE for e in edges for a, b in (tuple(e), tuple(e)[::-1])}

    def adjacent(self, a: str, b: str) -> bool:
        return (a, b) in self.mark

    def near(self, a: str) -> list[str]:
        return [b for b in self.names if (a, b) in self.mark]

    def is_(self, a: str, b: str, at_a: str, at_b: str) -> bool:
        """Whether the edge has these marks; ? stands for any."""
        return (a, b) in self.mark and at_a in ("?", self.mark[b, a]) and at_b in ("?", self.mark[a, b])

    def put(self, a: str, b: str, mark: str) -> bool:
        """Set the mark at b if it is open."""
        if self.mark[a, b] != CIRCLE or mark == CIRCLE:
            return False
        self.mark[a, b] = mark
        return True

    def rows(self) -> list[tuple[str, str, str]]:
        return [(a, b, f"{'<' if self.mark[b, a] == ARROW else self.mark[b, a]}-{self.mark[a, b]}") for a in self.names for b in self.near(a) if a < b]


def _colliders(g: Pag, sepset: dict[frozenset, tuple]) -> None:
    for c in g.names:
        for a, b in combinations(g.near(c), 2):
            if not g.adjacent(a, b) and c not in sepset.get(frozenset((a, b)), ()):
                g.mark[a, c] = g.mark[b, c] = ARROW


def possible_d_sep(g: Pag, a: str) -> set[str]:
    """Nodes that a path reaches on which every inner node is a collider or in a triangle."""
    seen, todo, out = set(), [(a, b) for b in g.near(a)], set(g.near(a))
    while todo:
        p, v = todo.pop()
        if (p, v) in seen:
            continue
        seen.add((p, v))
        for w in g.near(v):
            if w not in (p, a) and (g.adjacent(p, w) or (g.mark[p, v] == ARROW and g.mark[w, v] == ARROW)):
                out.add(w)
                todo.append((v, w))
    return out - {a}


def _uncovered(g: Pag, start: str, second: str, end: str, ok) -> list[str] | None:
    """A path start, second, .., end of edges that `ok` accepts, in which no three in a row are a triangle."""
    if not ok(start, second):
        return None
    todo = [[start, second]]
    while todo:
        path = todo.pop()
        if path[-1] == end:
            return path
        for w in reversed(g.near(path[-1])):
            if w not in path and ok(path[-1], w) and not g.adjacent(path[-2], w):
                todo.append([*path, w])
    return None


def _discriminated(g: Pag, b: str, c: str, sepset: dict[frozenset, tuple]) -> bool:
    """Rule 4: a path d, .., a, b, c whose inner nodes up to a are colliders and parents of c decides b."""
    for a in g.near(b):
        if not (g.is_(a, c, TAIL, ARROW) and g.mark[b, a] == ARROW):
            continue
        todo, seen = [(a, b)], {a, b, c}
        while todo:
            v, after = todo.pop(0)
            for d in g.near(v):
                if d in seen or g.mark[d, v] != ARROW:
                    continue
                if not g.adjacent(d, c):
                    if b in sepset.get(frozenset((d, c)), ()):
                        return g.put(c, b, TAIL) | g.put(b, c, ARROW)
                    return g.put(a, b, ARROW) | g.put(b, c, ARROW) | g.put(c, b, ARROW)
                if g.is_(d, c, TAIL, ARROW) and g.mark[v, d] == ARROW:
                    seen.add(d)
                    todo.append((d, v))
    return False


def orient(g: Pag, sepset: dict[frozenset, tuple], selection: bool = True) -> Pag:
    """The ten orientation rules until none applies; 5 to 7 only if selection of the rows is possible."""
    forward = lambda a, b: g.mark[b, a] != ARROW and g.mark[a, b] != TAIL  # noqa: E731  potentially directed
    circle = lambda a, b: g.mark[a, b] == g.mark[b, a] == CIRCLE
    changed = True
    while changed:
        changed = False
        for b in g.names:
            for c in g.near(b):
                for a in g.near(b):
                    if a == c:
                        continue
                    apart = not g.adjacent(a, c)
                    if apart and g.mark[a, b] == ARROW and g.mark[c, b] == CIRCLE:  # 1
                        changed |= g.put(c, b, TAIL) | g.put(b, c, ARROW)
                    if not apart and g.mark[a, c] == CIRCLE:  # 2
                        if (g.is_(a, b, TAIL, ARROW) and g.mark[b, c] == ARROW) or (g.mark[a, b] == ARROW and g.is_(b, c, TAIL, ARROW)):
                            changed |= g.put(a, c, ARROW)
                    if apart and g.mark[a, b] == ARROW and g.mark[c, b] == ARROW:  # 3
                        for d in g.near(b):
                            if d not in (a, c) and g.adjacent(a, d) and g.adjacent(c, d) and g.mark[a, d] == g.mark[c, d] == CIRCLE and g.mark[d, b] == CIRCLE:
                                changed |= g.put(d, b, ARROW)
                    if not apart and g.is_(a, c, CIRCLE, ARROW) and (g.is_(a, b, TAIL, ARROW) or g.is_(a, b, TAIL, CIRCLE)) and g.is_(b, c, TAIL, ARROW):  # 8
                        changed |= g.put(c, a, TAIL)
                    if selection and apart and g.is_(a, b, TAIL, CIRCLE) and g.mark[c, b] == CIRCLE:  # 7
                        changed |= g.put(c, b, TAIL)
                    if selection and g.is_(a, b, TAIL, TAIL) and g.mark[c, b] == CIRCLE:  # 6
                        changed |= g.put(c, b, TAIL)
                if g.mark[c, b] == CIRCLE:
                    changed |= _discriminated(g, b, c, sepset)  # 4
        for a in g.names:
            for c in g.near(a):
                if selection and circle(a, c):  # 5
                    for b in g.near(a):
                        if b != c and not g.adjacent(b, c) and (path := _uncovered(g, a, b, c, circle)) and len(path) > 3 and not g.adjacent(a, path[-2]):
                            for u, v in zip([*path, a], [*path[1:], c], strict=False):
                                if g.adjacent(u, v):
                                    changed |= g.put(u, v, TAIL) | g.put(v, u, TAIL)
                            changed |= g.put(a, c, TAIL) | g.put(c, a, TAIL)
                            break
                if not g.is_(a, c, CIRCLE, ARROW):
                    continue
                for b in g.near(a):
                    if b != c and not g.adjacent(b, c) and _uncovered(g, a, b, c, forward):  # 9
                        changed |= g.put(c, a, TAIL)
                        break
                parents = [b for b in g.near(c) if b != a and g.is_(b, c, TAIL, ARROW)]
                for b, d in combinations(parents, 2):  # 10
                    firsts = [[m for m in g.near(a) if m != c and _uncovered(g, a, m, x, forward)] for x in (b, d)]
                    if any(m != o and not g.adjacent(m, o) for m in firsts[0] for o in firsts[1]):
                        changed |= g.put(c, a, TAIL)
                        break
    return g


def fci_graph(gram: Gram, alpha: float = 0.05, most: int | None = None, fast: bool = False, selection: bool = False) -> tuple[Pag, dict[frozenset, tuple]]:
    """The graph of the search that allows for hidden causes; `fast` leaves the pass over possible d-separating sets (RFCI's idea)."""
    edges, sepset = skeleton(gram, alpha, most)
    g = Pag(gram.columns, edges)
    _colliders(g, sepset)
    if not fast:
        for a, b in combinations(g.names, 2):
            if not g.adjacent(a, b):
                continue
            pools = [sorted(possible_d_sep(g, x) - {a, b}) for x in (a, b)]
            levels = range(1, (max(map(len, pools)) if most is None else most) + 1)
            hit = next((z for k in levels for pool in pools for z in combinations(pool, k) if gram.fisher_p(a, b, list(z)) > alpha), None)
            if hit is not None:
                edges.discard(frozenset((a, b)))
                sepset[frozenset((a, b))] = hit
        g = Pag(gram.columns, edges)
        _colliders(g, sepset)
    return orient(g, sepset, selection), sepset


def fci(spark: SparkSession, df: DataFrame, columns: list[str], alpha: float = 0.05, fast: bool = False) -> DataFrame:
    """a, b, edge (o-o, o->, <->, -->, .. from a to b)."""
    return spark.createDataFrame(fci_graph(Gram(df, columns), alpha, fast=fast)[0].rows(), "a string, b string, edge string")


def valid_pag(rows: list[tuple[str, str, str]]) -> bool:
    """No directed and no almost directed cycle: no arrow into an ancestor."""
    directed = {(a, b) for a, b, e in rows if e == "-->"} | {(b, a) for a, b, e in rows if e == "<--"}
    into = {(a, b) for a, b, e in rows if e[-1] == ">"} | {(b, a) for a, b, e in rows if e[0] == "<"}
    reach = set(directed)
    while more := {(a, d) for a, b in reach for c, d in directed if b == c} - reach:
        reach |= more
    return all(a != b for a, b in reach) and not any((b, a) in reach for a, b in into)


def colliders(edges: list[tuple]) -> set[tuple]:
    """a, c, b of a DAG: a -> c <- b with a < b not adjacent."""
    near = {frozenset(e) for e in edges}
    return {(min(a, b), c, max(a, b)) for a, c in edges for b, d in edges if c == d and a != b and frozenset((a, b)) not in near}


def markov_equivalent(one: list[tuple], other: list[tuple]) -> bool:
    return {frozenset(e) for e in one} == {frozenset(e) for e in other} and colliders(one) == colliders(other)


def hamming(one: set[tuple], other: set[tuple]) -> int:
    """Pairs whose edge differs (added, removed, turned or undirected on one side only); an undirected edge is both arrows."""
    pairs = {frozenset(e) for e in one | other}
    return sum({e for e in one if frozenset(e) == p} != {e for e in other if frozenset(e) == p} for p in pairs)


def valid_class(arrows: set[tuple]) -> bool:
    """Whether a DAG exists with these edges, directed as given, that adds no collider: sinks are taken off one by one."""
    left = set(arrows)
    nodes = {v for e in left for v in e}
    while nodes:
        for v in sorted(nodes):
            out = {b for a, b in left if a == v and (b, a) not in left}
            undirected = {b for a, b in left if a == v and (b, a) in left}
            near = {a for a, b in left if b == v} | {b for a, b in left if a == v}
            if not out and all((u, w) in left or (w, u) in left for u in undirected for w in near if u != w):
                left = {e for e in left if v not in e}
                nodes.discard(v)
                break
        else:
            return False
    return True


def conservative_colliders(gram: Gram, edges: set[frozenset], alpha: float = 0.05) -> tuple[set[tuple], set[tuple]]:
    """Unshielded triples a, c, b that are colliders in none of their separating sets, and those that are ambiguous."""
    near = {v: sorted(w for w in gram.columns if frozenset((v, w)) in edges) for v in gram.columns}
    sure, doubt = set(), set()
    for c in gram.columns:
        for a, b in combinations(near[c], 2):
            if frozenset((a, b)) in edges:
                continue
            sets = {z for x in (a, b) for k in range(len(near[x]) + 1) for z in combinations(near[x], k) if a not in z and b not in z}
            apart = [c in z for z in sets if gram.fisher_p(a, b, list(z)) > alpha]
            if apart and not any(apart):
                sure.add((a, c, b))
            elif not apart or any(apart) and not all(apart):
                doubt.add((a, c, b))
    return sure, doubt


def tabu(gram: Gram, length: int | None = None, patience: int = 15) -> tuple[set[tuple], float]:
    """Edges and score (BIC) of the best DAG that a walk meets which always takes the best step not undone lately, even a bad one.

    `length` pairs of nodes are held back after a step, by default a third of all.
    """
    names = sorted(gram.columns)
    length = max(1, len(names) * (len(names) - 1) // 6) if length is None else length
    parents: dict[str, frozenset] = {v: frozenset() for v in names}
    known: dict = {}

    def local(v: str, ps: frozenset) -> float:
        if (v, ps) not in known:
            known[v, ps] = gram.bic(v, sorted(ps))
        return known[v, ps]

    def reaches(a: str, b: str, ps: dict) -> bool:
        seen, todo = set(), [b]
        while todo:
            v = todo.pop()
            if v == a:
                return True
            if v not in seen:
                seen.add(v)
                todo += ps[v]
        return False

    score = best = sum(local(v, parents[v]) for v in names)
    kept, lately, idle = dict(parents), [], 0
    while idle < patience:
        moves = []
        for a in names:
            for b in names:
                if a == b:
                    continue
                if a in parents[b]:
                    less = {**parents, b: parents[b] - {a}}
                    options = [("drop", less)] + ([("turn", {**less, a: parents[a] | {b}})] if not reaches(a, b, less) else [])
                elif b not in parents[a] and not reaches(b, a, parents):
                    options = [("add", {**parents, b: parents[b] | {a}})]
                else:
                    continue
                for kind, ps in options:
                    gain = sum(local(v, ps[v]) - local(v, parents[v]) for v in (a, b))
                    if frozenset((a, b)) not in lately or score + gain > best + 1e-9:
                        moves.append((round(gain, 9), kind, a, b, ps))
        if not moves:
            break
        gain, _, a, b, parents = max(moves, key=lambda m: (m[0], m[1], m[2], m[3]))
        score = sum(local(v, parents[v]) for v in names)
        lately = [*lately, frozenset((a, b))][-length:]
        idle += 1
        if score > best + 1e-9:
            best, kept, idle = score, dict(parents), 0
    return {(p, v) for v, ps in kept.items() for p in ps}, best


def non_gaussian_order(df: DataFrame, columns: list[str]) -> list[str]:
    """Causal order under linear effects and non-Gaussian noise (DirectLiNGAM): the variable most independent of its residuals goes first.

    Independence is by differences of entropy approximations; a round is one aggregation over the rows for all pairs.
    """
    left, order = sorted(columns), []
    data = df.select(*[F.col(c).cast("double").alias(c) for c in left]).na.drop()
    while len(left) > 1:
        m = data.agg(*[f(c).alias(f"{n}_{c}") for c in left for n, f in (("m", F.avg), ("s", F.stddev_pop))], *[F.corr(a, b).alias(f"r_{a}_{b}") for a, b in combinations(left, 2)]).first()
        z = {c: (F.col(c) - m[f"m_{c}"]) / m[f"s_{c}"] for c in left}
        rho = {(a, b): m[f"r_{min(a, b)}_{max(a, b)}"] for a in left for b in left if a != b}
        rest = {(a, b): (z[a] - rho[a, b] * z[b]) / float(np.sqrt(max(1 - rho[a, b] ** 2, 1e-12))) for a, b in rho}
        parts = []
        for name, u in [*[(c, z[c]) for c in left], *[(f"{a}|{b}", u) for (a, b), u in rest.items()]]:
            parts += [F.avg(F.log(F.cosh(u))).alias(f"l_{name}"), F.avg(u * F.exp(-u * u / 2)).alias(f"e_{name}")]
        s = data.agg(*parts).first()

        def entropy(name: str, s=s) -> float:
            return float((1 + np.log(2 * np.pi)) / 2 - 79.047 * (s[f"l_{name}"] - 0.37457) ** 2 - 7.4129 * s[f"e_{name}"] ** 2)

        def cost(a: str, left=left) -> float:
            gaps = [entropy(b) + entropy(f"{a}|{b}") - entropy(a) - entropy(f"{b}|{a}") for b in left if b != a]
            return sum(min(0.0, g) ** 2 for g in gaps)

        first = min(left, key=lambda c: (round(cost(c), 12), c))
        order.append(first)
        keep = [c for c in left if c != first]
        data = data.select(*[(F.col(c) - rho[c, first] * m[f"s_{c}"] / m[f"s_{first}"] * F.col(first)).alias(c) for c in keep])
        left = keep
    return order + left


def separators(edges: list[tuple], x, y, most: int | None = None) -> list[tuple]:
    """Smallest sets of nodes that d-separate x and y on a small DAG."""
    others = sorted({v for e in edges for v in e} - {x, y}, key=str)
    for k in count() if most is None else range(most + 1):
        if k > len(others):
            return []
        if found := [z for z in combinations(others, k) if d_separated(edges, x, y, set(z))]:
            return found
    return []


def markov_blanket(edges: list[tuple], v) -> set:
    children = {b for a, b in edges if a == v}
    return ({a for a, b in edges if b == v or b in children} | children) - {v}


def backdoor_paths(edges: list[tuple], x, y) -> list[tuple]:
    """Paths between x and y that begin with an arrow into x, whatever the directions after."""
    out, todo = [], [(x, a) for a, b in edges if b == x]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while todo:
        p = todo.pop()
        if p[-1] == y:
            out.append(p)
        else:
            todo += [(*p, w) for w in near[p[-1]] if w not in p]
    return sorted(out, key=lambda p: (len(p), tuple(map(str, p))))


def blocked(edges: list[tuple], path: tuple, given: set) -> bool:
    """Whether a path is closed given a set: a collider outside it and its ancestors, or another inner node inside it."""
    from infocausal.operators.identify import ancestors

    above = ancestors(edges, given)
    for a, v, b in zip(path, path[1:], path[2:], strict=False):
        collider = (a, v) in edges and (b, v) in edges
        if (collider and v not in above) or (not collider and v in given):
            return True
    return False
