"""Packing of token sequences by a configuration linear program over the lengths.

Documents are encoded, get an end id, and are cut where they are longer than a sequence. What the
packing needs of them is the histogram of piece lengths, which has at most `size` entries however
large the corpus is. A configuration says how many pieces of each length share a sequence; the
program asks for as few sequences as cover the histogram.

- Multiplicative weights set a price for each length, from its size and from how far its coverage
  lags behind. Knapsack dynamic programming finds the best configuration for these prices, and for
  each length the best that contains it. Those near the best get a share of what is left.
- The prices, scaled so that no configuration is worth more than one sequence, bound the number of
  sequences from below; the best prices met are kept.
- Rounding takes whole copies of configurations that are worth a sequence at those prices (all but
  `waste`). What is left goes through the program once more, and then by best fit, longest first,
  into open sequences and new ones, whole runs of equal pieces at a time.

So the plan is a list of (configuration, copies), about as long at any size of the corpus. Pieces
are numbered within their length (task by task, then over tasks), and a piece finds its sequence
and its place by its length and number in that list, which is broadcast.

Defined cases: null text is empty; an empty text is the end id alone; repeated rows are packed as
often as they come; a null id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.llm.arrow_words import coded_words, slices, spread
from infocausal.llm.common import materialize, release
from infocausal.llm.op3_pair_index_bpe import byte_letters
from infocausal.llm.pieces import PieceTable

SIZE, END_ID = 2_048, 0
#: Bytes of text that are looked at together, and words kept by a Python worker.
CHUNK_BYTES, CACHED_WORDS = 8_000_000, 900_000


# ------------------------------------------------------------------ ids


class WordIds:
    """Ids of the tokenizers library for a lower-casing vocabulary that drops white space, asked once for each distinct word."""

    #: A comma or full stop before a space is a word of its own after a letter or digit (but İ ends in a mark in lower case).
    _joined = r"(?:[^\pL\pN\s]|İ)[.,] "

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_padding()
        self.library.no_truncation()
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.known = PieceTable(CACHED_WORDS)

    def ask(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        model, letters = self.library.model.tokenize, self.letters
        for i, w in enumerate(words):
            if w.isalpha():
                if w.isascii():
                    low = w.lower()
                else:
                    low = unicodedata.normalize("NFC", w).replace("Σ", "σ").lower()
                    if not low.isalpha():
                        continue
                    low = low.encode().decode("latin-1").translate(letters)
                ids = [t.id for t in model(low)]
                out[i] = pack(f"<{len(ids)}I", *ids)
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for i, e in zip(part, self.library.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the last ends)."""
        plain = pc.replace_substring(texts, "\n", " ")
        apart = pc.replace_substring(pc.replace_substring(plain, ", ", " , "), ". ", " . ")
        words, index, bounds = coded_words(pc.if_else(pc.match_substring_regex(plain, self._joined), plain, apart))
        asked = words.to_pylist()
        new = list(self.known.unknown(set(asked)))
        self.known.kept.update(zip(new, self.ask(new), strict=True))
        ids = list(map(self.known.kept.__getitem__, asked))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        upto = np.concatenate([[0], np.cumsum(sizes[index])])
        return spread(flat, np.cumsum(sizes), sizes, index), upto[bounds]


@lru_cache(maxsize=2)
def _words(source: str) -> WordIds:
    return WordIds(source)


def cut_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, length, rank (among the part's pieces of the length), key, piece, start, ids_crc32; a row for each piece."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, met = _words(source.value), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in it:
            for lo, hi in slices(batch.column("text"), CHUNK_BYTES):
                ids, bounds = model.encode(batch.column("text").slice(lo, hi - lo))
                n = np.diff(bounds) + 1
                pieces = -(-n // size)
                owner = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(n[owner] - start, size)
                first = bounds[owner] + start
                last = np.minimum(first + length, bounds[owner + 1])
                raw, ends = memoryview(ids.tobytes()), length > last - first
                crc = [
                    zlib.crc32(end, zlib.crc32(raw[4 * i : 4 * j])) if e else zlib.crc32(raw[4 * i : 4 * j])
                    for i, j, e in zip(first.tolist(), last.tolist(), ends.tolist(), strict=True)
                ]
                order = np.argsort(length, kind="stable")
                by = length[order]
                head = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
                many = np.diff(np.append(head, len(by)))
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - np.repeat(head, many) + met[by]
                met[by[head]] += many
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(owner), part, np.int32)), pa.array(length), pa.array(rank), batch.column("k").slice(lo, hi - lo).take(pa.array(owner)),
                        pa.array(piece.astype(np.int32)), pa.array(start), pa.array(crc, pa.int64()),
                    ],
                    ["part", "length", "rank", "k", "piece", "start", "ids_crc32"],
                )
            release()

    return rows.mapInArrow(run, f"part int, length long, rank long, k {kind}, piece int, start long, ids_crc32 long")


# ------------------------------------------------------------------ the program


@dataclass(frozen=True)
class Weights:
    """Parameters of the program, none of which depends on the corpus."""

    rounds: int = 200
    #: Part of a length's demand that a configuration may take at once, and less where there are fewer lengths than `many`; how strongly lagging coverage raises a price.
    step: float = 0.2
    many: int = 400
    pull: float = 0.3
    #: Configurations so near the best are taken in a round; so much of a sequence's worth may be missing in rounding.
    near: float = 0.01
    waste: float = 1e-3
    passes: int = 2


def _knapsack(price: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best worth of each capacity, and the length that is taken last for it (0: the space is left)."""
    worth, taken = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    fit = np.searchsorted(lengths, np.arange(size + 1), side="right").tolist()
    for c in range(1, size + 1):
        worth[c] = worth[c - 1]
        if fit[c]:
            v = worth[c - lengths[: fit[c]]] + price[: fit[c]]
            j = int(v.argmax())
            if v[j] > worth[c]:
                worth[c], taken[c] = v[j], lengths[j]
    return worth, taken


def _filled(taken: np.ndarray, space: int, first: int) -> tuple[tuple[int, int], ...]:
    found = {first: 1}
    while space > 0:
        got = int(taken[space])
        if got:
            found[got] = found.get(got, 0) + 1
        space -= max(got, 1)
    return tuple(sorted(found.items()))


def solve(demand: np.ndarray, p: Weights = Weights()) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Shares of configurations that cover demand[length] pieces; the prices of the best bound, by length; that bound."""
    size = len(demand) - 1
    lengths = np.flatnonzero(demand)
    n = demand[lengths].astype(np.float64)
    at = {int(x): i for i, x in enumerate(lengths)}
    used, shares = np.zeros(len(lengths)), {}
    bound, best = 0.0, np.zeros(size + 1)
    total = n @ lengths
    step = p.step * min(1.0, len(lengths) / p.many)
    for _ in range(p.rounds):
        live = used < n * (1 - 1e-9)
        if not live.any():
            break
        price = np.where(live, lengths / size * np.exp(p.pull * (used @ lengths / total - used / n)), 0.0)
        worth, taken = _knapsack(price, lengths, size)
        if (n @ price) / worth[size] > bound:
            bound = float(n @ price / worth[size])
            best[lengths] = price / worth[size]
        with_it = worth[size - lengths] + price
        met = set()
        for i in np.argsort(-with_it):
            if not live[i] or with_it[i] < (1 - p.near) * worth[size]:
                continue
            made = _filled(taken, size - int(lengths[i]), int(lengths[i]))
            if made in met:
                continue
            met.add(made)
            share = min(min(step * n[at[x]], n[at[x]] - used[at[x]]) / k for x, k in made)
            if share > 1e-9:
                shares[made] = shares.get(made, 0.0) + share
                for x, k in made:
                    used[at[x]] += share * k
    return shares, best, bound


def plan_packing(demand: np.ndarray, p: Weights = Weights()) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """(pieces of each length in a sequence, copies) that hold demand[length] pieces exactly, and a lower bound of the sequences."""
    size = len(demand) - 1
    left = demand.astype(np.int64).copy()
    copies: dict[tuple[tuple[int, int], ...], int] = {}
    lower = 0.0
    for step in range(p.passes):
        if not left.any():
            break
        shares, price, bound = solve(left, p)
        lower = bound if step == 0 else lower
        for made, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
            if sum(price[x] * k for x, k in made) < 1 - p.waste:
                continue
            m = min(int(share + 1e-9), *(int(left[x]) // k for x, k in made))
            if m > 0:
                for x, k in made:
                    left[x] -= m * k
                copies[made] = copies.get(made, 0) + m
    _best_fit(left, copies, size)
    return sorted(copies.items()), int(np.ceil(lower - 1e-6))


def _best_fit(left: np.ndarray, copies: dict, size: int) -> None:
    """Longest first, each run of equal pieces into the open sequences with the least space that holds them, or into new ones."""
    by_space: dict[int, set] = {}
    spaces = np.zeros(size + 1, np.int64)

    def put(made: tuple, n: int) -> None:
        copies[made] = copies.get(made, 0) + n
        space = size - sum(x * k for x, k in made)
        by_space.setdefault(space, set()).add(made)
        spaces[space] += n

    for made, n in list(copies.items()):
        del copies[made]
        put(made, n)
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        while n:
            fit = np.flatnonzero(spaces[x:])
            if len(fit):
                space = x + int(fit[0])
                made = min(by_space[space])
                m = min(n, copies[made])
                copies[made] -= m
                spaces[space] -= m
                if not copies[made]:
                    del copies[made]
                    by_space[space].discard(made)
                more = dict(made)
                more[x] = more.get(x, 0) + 1
                put(tuple(sorted(more.items())), m)
                n -= m
            else:
                each = min(size // x, n)
                put(((x, each),), n // each)
                n -= n // each * each


# ------------------------------------------------------------------ places


def places(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """For the pieces of a length, in the order of their numbers, the runs that share a configuration: where a run begins, and what a piece's place follows from."""
    rows, met, base = [], {}, 0
    for made, copies in plan:
        offset = 0
        for x, k in made:
            rows.append((x, met.get(x, 0), k, base, offset))
            met[x] = met.get(x, 0) + copies * k
            offset += x * k
        base += copies
    rows.sort()
    length, first, each, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    return {"length": length, "first": first, "each": each, "sequence": sequence, "offset": offset}


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, p: Weights = Weights(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, vocabulary, size, end_id, key, text), "pieces")
    parts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(size + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        demand[r["length"]] = r["n"]
    found = places(plan_packing(demand, p)[0])
    runs = spark.sparkContext.broadcast(found)  # some runs for each configuration, of which rounds * lengths is the most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["length", "part"]).select(
        "k", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number")
    )
    kind = pieces.schema["k"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        bits = max(int(r["first"].max(initial=0)), 1).bit_length() + 1
        keys = (r["length"] << bits) | r["first"]
        for batch in it:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            if not len(length):
                continue
            i = np.searchsorted(keys, (length << bits) | np.minimum(number, (1 << bits) - 1), "right") - 1
            q, o = np.divmod(number - r["first"][i], r["each"][i])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("k", "piece", "start", "length", "ids_crc32")], pa.array(r["sequence"][i] + q), pa.array(r["offset"][i] + o * length)],
                ["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = numbered.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)
