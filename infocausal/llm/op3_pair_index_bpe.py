"""BPE encoding and decoding with a pair occurrence index.

The distinct new pieces of a batch are laid out as one symbol array. An index maps each mergeable
pair to all its positions; active ranks are taken in ascending order from a heap, all positions of
the rank are merged from left to right, and the lists of the neighbouring pairs are extended.
Pieces (what stands between spaces) repeat all over a corpus, so a task keeps their ids in a table
of bounded size. The vocabulary file is read on the driver and broadcast (its size is
fixed by the file).

Defined cases: null text is empty; empty text has no ids and decodes to the empty string; repeated
rows are encoded as often as they come; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import release
from infocausal.llm.pieces import PieceTable

#: Pieces and words kept by a task.
CACHED_PIECES, CACHED_WORDS = 500_000, 200_000
#: Characters of text that are looked at for new pieces at a time.
CHUNK_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """A lower-casing BPE with word ends, from the JSON text of a public tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: A pair of ids as one number -> its rank; by rank: left, right and merged id.
        self.rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        found = np.array(list(self.rank), np.int64)
        order = np.argsort(found)
        self.sorted_pairs, self.sorted_ranks = found[order], np.array(list(self.rank.values()), np.int64)[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces, self.known = PieceTable(CACHED_PIECES), PieceTable(CACHED_WORDS)

    def normalize(self, text: str) -> str:
        # Lower case letter by letter: a final sigma is no exception.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word; all words share one index."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        n = len(flat)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - size] = -1
        keys = (symbols[:-1] << 32) | symbols[1:]
        slot = np.minimum(np.searchsorted(self.sorted_pairs, keys), len(self.sorted_pairs) - 1)
        places = np.flatnonzero((self.sorted_pairs[slot] == keys) & (after[:-1] != -1))
        ranks = self.sorted_ranks[slot[places]]
        order = np.argsort(ranks, kind="stable")
        firsts, starts = np.unique(ranks[order], return_index=True)
        index: dict[int, list[int]] = dict(
            zip(firsts.tolist(), (x.tolist() for x in np.split(places[order], starts[1:])), strict=False)
        )
        sym, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        heap, rank_of = list(index), self.rank.get
        while heap:
            rank = heapq.heappop(heap)
            a, b, made = self.parts[rank]
            for p in sorted(index.pop(rank)):
                q = nxt[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = made, -1
                r = nxt[p] = nxt[q]
                touched = []
                if r >= 0:
                    prv[r] = p
                    touched.append((rank_of((made << 32) | sym[r]), p))
                left = prv[p]
                if left >= 0:
                    touched.append((rank_of((sym[left] << 32) | made), left))
                for new, at in touched:
                    if new is None:
                        continue
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(heap, new)
        done = np.array(sym, np.int64)
        left = done != -1
        flat_ids = done[left].astype("<i4").tobytes()
        stops = (4 * np.cumsum(np.add.reduceat(left, ends - size, dtype=np.int64))).tolist()
        return [flat_ids[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _words(self, normal: str) -> list[str]:
        if normal.isalpha():
            return [normal]
        if normal[:-1].isalpha() and normal[-1] in ",.":
            return [normal[:-1], normal[-1]]
        return self.words.findall(normal)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces without spaces into the table."""
        plain = list(pieces)
        found: dict[str, list[str | int]] = {}
        if self.marks and self.marks.search(joined := " ".join(plain)):
            for x in [x for x in plain if self.marks.search(x)]:
                found[x] = [
                    w for s in self.marks.split(x)
                    for w in ([self.special[s]] if s in self.special else self._words(self.normalize(s)))
                ]
            plain = [x for x in plain if x not in found]
            joined = " ".join(plain)
        elif not self.marks:
            joined = " ".join(plain)
        for x, normal in zip(plain, self.normalize(joined).split(" "), strict=False):
            found[x] = self._words(normal)
        new = list(self.known.unknown({w for ws in found.values() for w in ws if isinstance(w, str)}))
        known = self.known.kept
        if new:
            known.update(zip(new, self.encode_words(new), strict=True))
        for x, ws in found.items():
            self.pieces.kept[x] = b"".join([pack("<i", w) if isinstance(w, int) else known[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian 32-bit integers."""
        return self.pieces.look_up([t.split(" ") for t in texts], self.learn)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _model(source: str) -> PairIndexBPE:
    return PairIndexBPE(source)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `keep`, ids (array of int), decoded (string made from those ids)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate((key, *keep))], F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    names = [f"k{i}" for i in range(1 + len(keep))]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(source.value)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            for part in chunks(texts):
                ids = [np.frombuffer(x, "<i4") for x in model.encode(part)]
                decoded = [model.decode(x.tolist()) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids), pa.int32())
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(n) for n in names], pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())],
                    [*names, "ids", "decoded"],
                )
            release()
        model.pieces.clear()
        model.known.clear()
        release()

    out = rows.mapInArrow(run, f"{kinds}, ids array<int>, decoded string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, (key, *keep), strict=True)], "ids", "decoded")
