"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the positions of a run of words; the hash of the picked words is a seed,
so a substitution at an ignored position does not change it. Training positions whose seed passes
a bit table of bounded size (filled from the benchmark's seeds) are joined to the benchmark's
seeds by equality. Each hit fixes a diagonal, and along it the words around the hits are compared:
a passage counts if some window of WINDOW aligned words (or the whole item, if shorter) has at
least 80 in 100 equal words. The masks together catch every such window (shown by a test).

Words are lower-cased and split at white space and ASCII punctuation. An item of fewer than five
words holds no mask; it matches the documents that have these words and no others, by a hash of
all of them. Items of five to twelve words match as a whole, up to eight words exactly, longer ones
with one substitution.

Defined cases: null texts are empty and match nothing; a null id of a document is returned as
such; equal documents and items match each for themselves; repeated rows of one document or item
give one result; an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import materialize
from infocausal.llm.wordhash import SPACE_OR_MARK, chunks, mix, word_hashes

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
#: Words that a mask needs.
SHORT = 5
WINDOW = 13
#: Words kept on both sides of a hit: a window that holds the hit does not reach further.
AROUND = WINDOW
#: log2 of the bits of the table of benchmark seeds: grown with the benchmark up to the bound (16 MB).
LEAST_BITS, MOST_BITS = 22, 27
_CHARS = 2_000_000


def needed(window: int) -> int:
    """Equal words that a window of so many aligned words must have."""
    if window <= 8:
        return window
    return window - 1 if window < WINDOW else -(-8 * window // 10)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower() for t in texts], SPACE_OR_MARK)


def seeds(words: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask: places in `words` where it fits inside one text, and the seeds there."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out = []
    for i, mask in enumerate(MASKS):
        span = mask[-1] + 1
        n = max(len(words) - span + 1, 0)
        fits = np.flatnonzero(np.arange(n) + span <= ends[:n])
        h = np.full(n, np.uint64(i + 1))
        for x in mask:
            h = (h ^ words[x : x + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((fits, mix(h[fits])))
    return out


def whole_seeds(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places and whole hashes of the texts with too few words for a mask."""
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < SHORT))
    out = np.full(len(short), np.uint64(0x51ED270B))
    for i in range(SHORT - 1):
        on = count[short] > i
        out[on] = mix((out[on] ^ words[offsets[short[on]] + i]) + np.uint64(i + 1))
    return offsets[short], out


def benchmark_seeds(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, text) -> (seed, item_id, q: the place of the seed in the item) and (item_id, words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts, _CHARS):
                words, offsets = _words(part)
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                per_item = [([], []) for _ in part]
                for places, found in [*seeds(words, offsets), whole_seeds(words, offsets)]:
                    for p, s in zip(places.tolist(), found.view(np.int64).tolist(), strict=True):
                        per_item[owner[p]][0].append(s)
                        per_item[owner[p]][1].append(p - int(offsets[owner[p]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + len(part)], pa.int64()),
                        pa.array([words[i:j].view(np.int64) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array([x[0] for x in per_item], pa.list_(pa.int64())),
                        pa.array([x[1] for x in per_item], pa.list_(pa.int32())),
                    ],
                    ["item_id", "words", "seeds", "places"],
                )

    rows = materialize(
        items.mapInArrow(run, "item_id long, words array<long>, seeds array<long>, places array<int>").dropDuplicates(["item_id", "words"]),
        "benchmark",
    )
    index = rows.select("item_id", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select(
        F.col("x.seeds").alias("seed"), "item_id", F.col("x.places").alias("q")
    )
    return index, rows.select("item_id", "words")


def _bit_table(index: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set for the benchmark's seeds; the driver sees byte positions of a table of bounded size only."""
    n = index.select("seed").distinct().count()
    log2 = int(min(max(LEAST_BITS, np.ceil(np.log2(max(n, 1) * 512))), MOST_BITS))
    slot = F.shiftrightunsigned("seed", 64 - log2)
    found = index.select((slot / 8).cast("long").alias("byte"), (slot % 8).cast("int").alias("bit"))
    rows = found.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).cast("int").alias("v")).toPandas()
    table = np.zeros(1 << (log2 - 3), np.uint8)
    table[rows["byte"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).astype(np.uint8)
    return table, log2


def _hits(docs: DataFrame, table, log2: int) -> DataFrame:
    """(doc_id, text) -> documents with hits: places and seeds, and the words around them as segments."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = table.value, np.uint64(64 - log2)
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts, _CHARS):
                words, offsets = _words(part)
                places, found = [], []
                for p, s in [*seeds(words, offsets), whole_seeds(words, offsets)]:
                    slot = (s >> shift).astype(np.int64)
                    on = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    places.append(p[on])
                    found.append(s[on])
                p, s = np.concatenate(places), np.concatenate(found)
                if not len(p):
                    continue
                order = np.argsort(p, kind="stable")
                p, s = p[order], s[order]
                doc = np.searchsorted(offsets, p, side="right") - 1
                out: list[tuple] = []
                for d in np.unique(doc):
                    own = doc == d
                    first, last = int(offsets[d]), int(offsets[d + 1])
                    near = np.zeros(last - first, bool)
                    for x in (p[own] - first).tolist():
                        near[max(x - AROUND, 0) : x + AROUND + 8] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], near, [0]])))
                    cut = [words[first + i : first + j].view(np.int64) for i, j in zip(edge[::2], edge[1::2], strict=True)]
                    out.append((ids[at + d], (p[own] - first).astype(np.int32), s[own].view(np.int64), edge[::2].astype(np.int32), cut))
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "places", "seeds", "starts", "segments"],
                )

    return docs.mapInArrow(
        run, "doc_id long, places array<int>, seeds array<long>, starts array<int>, segments array<array<long>>"
    )


def best_overlap(equal: np.ndarray, window: int) -> tuple[int, int, int] | None:
    """start, end, equal words of the union of the windows with enough equal words along one diagonal."""
    if len(equal) < window:
        return None
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[window:] - sums[:-window] >= needed(window))
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + window
    return start, end, int(sums[end] - sums[start])


def _compare(rows: DataFrame) -> DataFrame:
    """Rows (doc, doc_id, item_id, diagonal, starts, segments, words) -> verified overlaps."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for r in batch.to_pylist():
                item = np.array(r["words"], np.int64)
                window, shift = min(WINDOW, len(item)), r["diagonal"]
                equal = np.zeros(len(item), np.int64)
                for start, seg in zip(r["starts"], r["segments"], strict=True):
                    i, j = max(start - shift, 0), min(start + len(seg) - shift, len(item))
                    if i < j:
                        equal[i:j] = item[i:j] == np.array(seg[i + shift - start : j + shift - start], np.int64)
                if hit := best_overlap(equal, window):
                    out.append((r["doc_id"], r["item_id"], hit[0] + shift, hit[1] + shift, hit[2]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first_word", "end_word", "n_equal"]
            )

    return rows.select("doc_id", "item_id", "diagonal", "starts", "segments", "words").mapInArrow(
        run, "doc_id long, item_id long, first_word int, end_word int, n_equal int"
    )


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, first_word, end_word (place in the document's words), n_equal: the longest overlap of each pair."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("of"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # Joins go by a hash, as an item's id may be null.
    items = items.withColumn("item_id", F.xxhash64(F.col("of").isNull(), "of", "text"))
    names = items.select("item_id", "of").dropDuplicates(["item_id"])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    index, words = benchmark_seeds(items.select("item_id", "text"))
    table, log2 = _bit_table(index)
    hits = materialize(
        _hits(rows, spark.sparkContext.broadcast(table), log2).withColumn("doc", F.xxhash64("doc_id", "places", "seeds")), "hits"
    )
    at = hits.select("doc", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
    lines = (
        at.select("doc", F.col("x.seeds").alias("seed"), F.col("x.places").alias("p")).join(index, "seed")
        .select("doc", "item_id", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    )
    wide = lines.join(hits.select("doc", "doc_id", "starts", "segments").dropDuplicates(["doc"]), "doc").join(words, "item_id")
    found = _compare(wide).join(names, "item_id").drop("item_id").withColumnRenamed("of", "item_id")
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("neg_first"), "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.neg_first")).alias("first_word"), "b.end_word", "b.n_equal"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without an overlap, with all columns; a document with a null id stays."""
    bad = overlaps(docs, benchmark, key, text).select(F.col("doc_id").alias("_bad_id")).filter("_bad_id is not null").distinct()
    return docs.join(bad, docs[key].cast("long") == bad["_bad_id"], "left_anti")
