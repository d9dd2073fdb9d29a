"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

1. Equal texts form a class by their digest and are one text from there on.
2. Shingles of five words weigh tf * idf, with idf = 1 + ln(N / df) / ln(N) from the exact document
   frequencies of all shingles (copies count): 2 for a shingle of one document, 1 for one that all
   have. Dividing by ln(N) keeps the similarity of two given texts from falling as the corpus grows.
   Frequencies are counted and brought back by units of texts (see units.py).
3. Two texts can only have a similarity of 0.8 if the shingles that some other text has too hold
   0.8 of the weight of either. Texts that fail this can have no partner; all others are signed.
4. K samples a text: the shingle with the least a = c / (y e^r), with ln y = r (t - beta) and
   t = floor(ln w / r + beta). r, c ~ Gamma(2, 1) and beta ~ U(0, 1) come from tables that k-wise
   hashes of the shingle address.
5. Bands of `rows` samples are bucket keys. Inside a bucket every document is paired with the
   bucket's first one and the neighbour by total weight. Pairs whose samples agree in less than
   `screen` of the places (more than three standard deviations under the threshold) are left; the
   others are verified by the exact weighted Jaccard similarity, and links make components.
6. Of buckets that still hold several components, all pairs of members of different components are
   compared exactly, in blocks: against the largest component, and among the others. A block looks
   up its members' shingles in an index of its own and sends a forest of the links that it found,
   so no pair of a bucket goes unexamined and what travels follows members, not pairs.

Defined cases: null and empty texts are equal to each other; a text of fewer than five words is
one shingle; ids that are null are in no class (class null) and count for no frequency; repeated
rows are one document in the classes, come back as often as they came and count as often; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.llm.common import free_shuffles, materialize
from infocausal.llm.units import Plan, deal, documents_with, each_unit, expand, key_pairs, runs, squeeze
from infocausal.llm.wordhash import chunks, mix, shingle_hashes, word_hashes
from infocausal.operators.components import connected_components


@dataclass(frozen=True)
class NearDup:
    """Production parameters."""

    words: int = 5
    similarity: float = 0.8
    samples: int = 64
    bands: int = 36
    rows: int = 6
    #: Rows of a bucket that are put in order together, or compared with each other in a block, and bytes of their lists.
    piece: int = 1_000
    piece_bytes: int = 8_000_000
    #: Share of equal samples from which on a pair is verified.
    screen: float = 0.64
    seed: int = 7


_TABLE = 1 << 16
_CHARS = 1_000_000


def shingle_keys(texts: list[str | bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in order and the text of each."""
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    lower = [(t.decode("utf-8") if isinstance(t, bytes) else t).lower() for t in texts]
    for first, part in chunks(lower, _CHARS):
        s, at = shingle_hashes(*word_hashes(part), n)
        keys.append(s)
        owner.append(np.repeat(np.arange(first, first + len(part)), np.diff(at)))
    return np.concatenate(keys), np.concatenate(owner)


def idf(documents: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(n / documents) / ln(n): from 1 for a shingle of all documents to 2 for one of a single one."""
    return 1 + np.log(n / documents) / np.log(max(n, 2))


@lru_cache(maxsize=4)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """Multipliers of the k hashes, and the tables of r, ln c and beta."""
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
    return multipliers, rng.gamma(2, 1, _TABLE), np.log(rng.gamma(2, 1, _TABLE)), rng.random(_TABLE)


def _rank(log_a: np.ndarray) -> np.ndarray:
    """ln a as the high half of an unsigned 64-bit integer in the same order."""
    bits = log_a.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


def _log_a(ln_w, r, ln_c, beta):
    t = np.floor(ln_w / r + beta)
    return ln_c - r * (t - beta) - r


def signatures(s: np.ndarray, w: np.ndarray, at: np.ndarray, p: NearDup) -> np.ndarray:
    """Samples (texts x p.samples) as 64-bit values; texts must have shingles.

    A shingle with the same ln a has the same t, so the pair (ln a, shingle) stands for (shingle, t).
    """
    multipliers, r, ln_c, beta = _draws(p.samples, p.seed)
    ln_w, low = np.log(w), s & np.uint64(0xFFFFFFFF)
    out = np.empty((len(at) - 1, p.samples), np.uint64)
    for k, m in enumerate(multipliers):
        slot = (s * m) >> np.uint64(48)
        value = _rank(_log_a(ln_w, r[slot], ln_c[slot], beta[slot])) | low
        out[:, k] = np.minimum.reduceat(value, at[:-1])
    return out


@lru_cache(maxsize=4)
def _band_columns(samples: int, bands: int, rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed + 1)
    return np.stack([np.sort(rng.choice(samples, rows, replace=False)) for _ in range(bands)])


def band_keys(sig: np.ndarray, p: NearDup) -> np.ndarray:
    columns = _band_columns(p.samples, p.bands, p.rows, p.seed)
    out = np.zeros((len(sig), p.bands), np.uint64)
    for b, which in enumerate(columns):
        key = np.full(len(sig), b + 1, np.uint64)
        for c in which:
            key = mix(key ^ mix(sig[:, c] + np.uint64(c + 1)))
        out[:, b] = key
    return out


@dataclass(frozen=True)
class Weighed:
    """Distinct shingles (cut hashes) of some texts, text by text and in order, with their weights."""

    shingles: np.ndarray
    weights: np.ndarray
    #: Whether another text has the shingle.
    shared: np.ndarray
    offsets: np.ndarray


def weigh(texts: list[bytes], copies: np.ndarray, counts: np.ndarray, plan: Plan, p: NearDup) -> Weighed:
    """tf * idf of a unit's texts; counts as documents_with gives them."""
    k, owner, tf = key_pairs(*shingle_keys(texts, p.words), len(texts), plan.bits)
    _, n = runs(k)
    if len(n) != len(counts):
        raise ValueError(f"{len(counts)} counts for {len(n)} shingles")
    documents = np.repeat(counts, n)
    w = idf(np.where(documents > 0, documents, copies[owner] if len(k) else 0), plan.rows) * tf
    order = np.argsort(owner, kind="stable")
    return Weighed(k[order], w[order], documents[order] > 0, np.searchsorted(owner[order], np.arange(len(texts) + 1)))


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard of two (sorted shingles, weights, weight of all shingles); 0 where either has none."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[2] + b[2] - least
    return float(least / total) if len(both) and total > 0 else 0.0


def screened(pairs: DataFrame, sigs: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose samples agree in p.screen of the places or more."""
    wide = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, p.samples) for c in ("sa", "sb")
            )
            keep = pa.array(np.flatnonzero((x == y).mean(1) >= p.screen))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(found: DataFrame, lists: DataFrame, p: NearDup) -> DataFrame:
    """a, b, similarity of the pairs (a, b: ids) with p.similarity or more; lists (id, weight, shingles, weights) join by id."""
    side = lambda x: lists.select(F.col("id").alias(x), F.struct("weight", "shingles", "weights").alias(f"of_{x}"))
    wide = found.join(side("a"), "a").join(side("b"), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                known: dict[int, tuple] = {}
                ids = [part.column(c).to_pylist() for c in ("a", "b")]
                for own, c in zip(ids, ("of_a", "of_b"), strict=True):
                    column = part.column(c)
                    for i, x in enumerate(own):
                        if x not in known:
                            v = column[i].as_py()
                            known[x] = (np.frombuffer(v["shingles"], "<u8"), expand(v["weights"], "<f8"), v["weight"])
                got[at : at + 500] = [similarity(known[x], known[y]) for x, y in zip(*ids, strict=True)]
            keep = np.flatnonzero(got >= p.similarity - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(got[keep])],
                ["a", "b", "similarity"],
            )

    return wide.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, similarity double")


def _bucket_pairs(members: DataFrame, p: NearDup) -> DataFrame:
    """a < b from members (key, id, weight): each with its bucket's first and one neighbour by weight."""
    heads = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(0)), F.col("id"))).alias("h"), F.count("*").alias("n")).filter("n > 1")
    rows = members.join(heads, "key").withColumn(
        "piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.piece)).cast("int")
    )
    near = F.lag("id").over(Window.partitionBy("key", "piece").orderBy("weight", "id"))
    out = rows.withColumn("near", near).select("id", F.explode(F.array("h.id", "near")).alias("o")).filter("o is not null and o != id")
    return out.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def _cells(members: DataFrame, p: NearDup) -> DataFrame:
    """The members (key, id, part, size) of buckets with several parts, dealt to blocks (key, wide, i, j) with a side.

    Wide blocks compare others (side false) with the largest part (true). The rest compare the others:
    block i = j with itself, i < j with each other. Buckets of two members need no block: they were paired.
    """
    by = members.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    shape = by.groupBy("key").agg(
        F.sum("c").alias("n"), F.sum("s").alias("all"), F.count("*").alias("k"), F.max(F.struct("c", "part", "s")).alias("big")
    ).filter("k > 1 and n > 2")

    def pieces(count, size):
        return F.ceil(F.greatest(count / p.piece, size / p.piece_bytes)).cast("int")

    shape = shape.select(
        "key", F.col("big.part").alias("big"), pieces(F.col("n") - F.col("big.c"), F.col("all") - F.col("big.s")).alias("rest_n"),
        pieces(F.col("big.c"), F.col("big.s")).alias("big_n"),
    )
    rest = F.col("part") != F.col("big")
    rows = members.join(shape, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.when(rest, F.col("rest_n")).otherwise(F.col("big_n"))).cast("int"))
    block = F.col("block")

    def cell(wide, i, j, side):
        return F.struct(F.lit(wide).alias("wide"), i.alias("i"), j.alias("j"), side.alias("side"))

    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(up_to("rest_n"), lambda j: cell(False, F.least(block, j), F.greatest(block, j), block > j))
    against = F.transform(up_to("big_n"), lambda j: cell(True, block, j, F.lit(False)))
    largest = F.transform(up_to("rest_n"), lambda i: cell(True, i, block, F.lit(True)))
    cells = F.explode(F.when(rest, F.concat(among, against)).otherwise(largest)).alias("cell")
    return rows.select("key", "id", "part", cells).select("key", "cell.*", "id", "part")


def block_links(part: np.ndarray, side: np.ndarray, total: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of a block in different parts with a similarity of `least` or more: a forest of them.

    Rows of different sides are compared, or all if there is one side. lists: shingles and weights of the rows.
    """
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(part)), np.arange(len(part)))
    xs, ys = [], []
    if len(left) and len(right):
        size = np.array([len(x[0]) for x in lists])
        shingles, slot = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        weight, owner = np.concatenate([x[1] for x in lists]), np.repeat(np.arange(len(part)), size)
        place = np.full(len(part), -1)
        place[right] = np.arange(len(right))
        on = np.flatnonzero(place[owner] >= 0)
        on = on[np.argsort(slot[on], kind="stable")]
        first = np.searchsorted(slot[on], np.arange(len(shingles) + 1))
        index, index_weight = place[owner[on]], weight[on]
        ends = np.cumsum(size)
        hits = first[slot + 1] - first[slot]
        work = np.add.reduceat(np.append(hits, 0), ends - size) * (size > 0)
        at = 0
        while at < len(left):
            stop = at + max(1, int(np.searchsorted(np.cumsum(work[left[at:]] + len(right)), 4_000_000, side="right")))
            own = left[at:stop]
            mine = np.concatenate([np.arange(ends[i] - size[i], ends[i]) for i in own])
            n = hits[mine]
            skip = np.cumsum(n) - n
            post = np.repeat(first[slot[mine]] - skip, n) + np.arange(n.sum())
            row = np.repeat(np.repeat(np.arange(len(own)), size[own]), n)
            common = np.bincount(row * len(right) + index[post], np.minimum(np.repeat(weight[mine], n), index_weight[post]), len(own) * len(right))
            common = common.reshape(len(own), len(right))
            near = common >= (least - 1e-12) * (total[own][:, None] + total[right][None, :] - common)
            i, j = np.nonzero(near & (part[own][:, None] != part[right][None, :]) & (common > 0))
            xs.append(own[i])
            ys.append(right[j])
            at = stop
    x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (xs, ys))
    on = _forest(part[x], part[y])
    return x[on], y[on]


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the links between parts that join parts not joined by those before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.get(x, x)) != x:
            root[x] = root.get(r, r)
            x = r
        return x

    keep = []
    _, once = np.unique(np.stack([u, v]), axis=1, return_index=True) if len(u) else (None, [])
    for k in once:
        a, b = find(int(u[k])), find(int(v[k]))
        if a != b:
            root[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


def remaining_links(members: DataFrame, lists: DataFrame, p: NearDup) -> DataFrame:
    """a < b: links between different parts of members (key, id, part, size) that share a bucket, enough to join all that any link joins."""

    def link(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, part, side, total = (rows.column(c).to_numpy() for c in ("id", "part", "side", "weight"))
        cut = list(zip([np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()], [expand(x, "<f8") for x in rows.column("weights").to_pylist()], strict=True))
        x, y = block_links(part, side.astype(bool), total, cut, p.similarity)
        return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            cell = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "wide", "i", "j")]
            cut = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1).tolist() if batch.num_rows else []
            if held and batch.num_rows and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("key", "wide", "i", "j")):
                cut = [0, *cut]
            found, last = [], 0
            for at in cut:
                held.append(batch.slice(last, at - last))
                found.append(link(pa.Table.from_batches(held)))
                held, last = [], at
            held.append(batch.slice(last))
            held = [b for b in held if b.num_rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in link(pa.Table.from_batches(held))], ["a", "b"])

    cell = ["key", "wide", "i", "j"]
    dealt = _cells(members, p).join(lists, "id").repartition(*cell).sortWithinPartitions(*cell)
    return dealt.select(*cell, "side", "id", "part", "weight", "shingles", "weights").mapInArrow(run, "a long, b long").distinct()


def _joined(parts: DataFrame | None, found: DataFrame) -> DataFrame:
    """id, component after the links (a, b), given those before."""
    if parts is None:
        return materialize(connected_components(found, "a", "b").withColumnRenamed("node", "id"), "parts")
    of = lambda c: F.coalesce(F.col(f"part_{c}"), F.col(c))
    ends = found
    for c in ("a", "b"):
        ends = ends.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
    grown = connected_components(ends.select(of("a").alias("a"), of("b").alias("b")), "a", "b").withColumnRenamed("node", "id")
    grown = materialize(grown, "grown")
    to = grown.select(F.col("id").alias("component"), F.col("component").alias("root"))
    old = parts.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return materialize(old.unionByName(grown.join(parts, "id", "left_anti")), "parts")


def signed_texts(rows: DataFrame, plan: Plan, p: NearDup) -> DataFrame:
    """id, weight, sig, keys, shingles, weights of the distinct texts that can have a partner, from rows (id, text) without nulls.

    shingles and weights are those that another text has too; `weight` is that of all.
    """
    dealt = deal(rows, plan)
    counts = materialize(documents_with(dealt, plan, lambda texts: shingle_keys(texts, p.words)), "counts")
    free_shuffles(rows.sparkSession)

    def sign(_: int, first: np.ndarray, copies: np.ndarray, texts: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = weigh(texts, copies, counts, plan, p)
        ids, starts = [], []
        whole = np.concatenate([[0.0], np.cumsum(x.weights)])
        common = np.concatenate([[0.0], np.cumsum(x.weights * x.shared)])
        i, j = x.offsets[:-1], x.offsets[1:]
        total = whole[j] - whole[i]
        have = np.flatnonzero((j > i) & (common[j] - common[i] >= (p.similarity - 1e-6) * total))
        if not len(have):
            return
        ids, size = first[have], (j - i)[have]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(i[have] - starts[:-1], size) + np.arange(starts[-1])
        s, w, shared = x.shingles[at], x.weights[at], x.shared[at]
        sig = signatures(s, w, starts, p)
        keys, short = band_keys(sig, p), mix(sig).astype("<u2")
        cut = [(s[a:b][shared[a:b]], w[a:b][shared[a:b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids), pa.array(np.add.reduceat(w, starts[:-1])), pa.array([v.tobytes() for v in short], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                pa.array([c[0].astype("<u8").tobytes() for c in cut], pa.binary()), pa.array([squeeze(c[1].astype("<f8")) for c in cut], pa.binary()),
            ],
            ["id", "weight", "sig", "keys", "shingles", "weights"],
        )

    kind = "id long, weight double, sig binary, keys array<long>, shingles binary, weights binary"
    return each_unit(dealt, counts, sign, kind)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """id, class_id (the smallest id of the class) for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digests = materialize(rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size")), "digests")
    known = digests.filter("id is not null")
    firsts = known.groupBy("digest").agg(F.min("id").alias("first"))
    copies = materialize(known.select("id", "digest").distinct().join(firsts, "digest").select("id", "first"), "copies")
    plan = Plan.of(*[x or 0 for x in known.agg(F.count("*"), F.sum("size")).first()])
    own = materialize(signed_texts(rows.filter("id is not null"), plan, p), "signed")
    free_shuffles(spark)
    sigs = own.select("id", "sig")
    lists = own.select("id", "weight", "shingles", "weights")
    size = (F.octet_length("shingles") + 100).cast("long").alias("size")
    members = own.select("id", "weight", size, F.explode("keys").alias("key"))
    # Only buckets with company go on.
    shared_keys = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = materialize(members.join(shared_keys, "key"), "members")
    near = materialize(screened(_bucket_pairs(members, p), sigs, p), "pairs")
    found = materialize(verified(near, lists, p).select("a", "b"), "links")
    parts = None if found.isEmpty() else _joined(None, found)
    now = members.select("key", "id", "size")
    now = now.withColumn("part", F.col("id")) if parts is None else now.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    found = materialize(remaining_links(now.select("key", "id", "part", "size"), lists, p), "links")
    if not found.isEmpty():
        parts = _joined(parts, found)
    classes = copies
    if parts is not None:
        parts = parts.withColumnRenamed("id", "member")
        classes = copies.join(parts, copies["first"] == parts["member"], "left").select(
            "id", F.coalesce("component", "first").alias("first")
        )
    classes = classes.groupBy("id").agg(F.min("first").alias("class_id"))
    return digests.select("id").join(classes, "id", "left").select("id", "class_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """One document of each class, that with the smallest id, with all columns; rows with a null id stay."""
    classes = near_classes(docs, key, text, p)
    kept = classes.filter("id = class_id").select(F.col("id").alias("_kept_id")).distinct()
    one = Window.partitionBy("_kept_id").orderBy(F.lit(1))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    chosen = (
        docs.select(row, docs[key].cast("long").alias("_kept_id")).join(kept, "_kept_id", "left_semi")
        .withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")
    )
    return chosen.unionByName(docs.filter(docs[key].isNull()))
