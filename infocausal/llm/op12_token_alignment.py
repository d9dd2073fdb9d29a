"""Which tokens of two tokenizers cover the same bytes, and how often each pair of ids does.

A text is cut at spaces between two characters that aren't spaces. Both tokenizers begin a token
there, so what links and groups there are lies within the pieces, and equal pieces have equal ones.
For the distinct pieces of some MB of text DuckDB holds a table of token intervals for each
tokenizer, side by side in one byte space:

- an ASOF join finds for each A token the B token that covers its first byte, a range join the
  B tokens that begin further on inside it;
- a window sum over the places where both begin numbers the groups.

A chunk sends its distinct id pairs with their counts; Spark merges them, finds the highest count
of each B id (as many rows as B has ids, which are broadcast), and answers each chunk's pairs in
the same order. Only then a chunk knows its links' counts and sums them by piece and text.

Defined cases: a null or empty text, or one whose joined tokens differ from a space and the text,
has no tokens, zero counts and an empty digest, and none of its links counts; special tokens' names
are plain text; repeated rows count as often as they come; a null id stays null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.llm.arrow_words import slices, spread, sums
from infocausal.llm.common import materialize, n_tasks, release
from infocausal.llm.op3_pair_index_bpe import byte_letters
from infocausal.llm.op4_token_files import CachedTokenizer
from infocausal.llm.units import expand, groups, squeeze

#: Bytes of text whose distinct pieces are aligned together.
CHUNK_BYTES = 4_000_000
#: Pieces whose alignment a Python worker keeps, and those that DuckDB is given at a time.
KEPT_WORDS, ALIGNED_WORDS = 400_000, 40_000
#: Rows of pairs in an Arrow batch.
BATCH = 200_000
#: White space beside a space, or a space at an end: such texts are cut by a slower rule.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LOOSE = rf"\A | \z| {_WHITE}|{_WHITE} "

_ALIGN = """
WITH found AS (
  SELECT a.pos, a.id AS a, b.id AS b, true AS begins_a, b.pos = a.pos AS begins_b FROM a ASOF JOIN b ON a.pos >= b.pos
  UNION ALL
  SELECT b.pos, a.id, b.id, false, true FROM a JOIN b ON b.pos > a.pos AND b.pos < a.stop)
SELECT pos, a, b, begins_a, begins_b, (sum((begins_a AND begins_b)::INTEGER) OVER (ORDER BY pos))::BIGINT AS grp FROM found ORDER BY pos
"""


class Aligner:
    """Both tokenizers, and the alignment of distinct pieces."""

    def __init__(self, a_source: str, b_model: bytes):
        import sentencepiece

        self.a = CachedTokenizer(a_source)
        self.a.library.encode_special_tokens = True
        self.forget()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {ord(c): i for i, c in enumerate(byte_letters())}
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[ord(c)] for c in t) if all(ord(c) in byte_of for c in t) else t.encode()
        piece = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # An id with what stands before it: A's first of a group or a later one, then B's.
        self.names = pa.array([f"{s}{i}" for s, t in ((";", self.a_bytes), (",", self.a_bytes), ("|", self.b_bytes), (",", self.b_bytes)) for i in range(len(t))])

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.counts, self.links = np.zeros((5, 0), np.int64), np.zeros(0, np.int64)
        self.texts: list[bytes] = []

    def known(self, words: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of each word n_a, n_b, n_groups, n_links and whether it is bad (rows of counts), and its groups, each after a `;`; the link pairs of all words, and each one's word.

        Words met before are looked up; the tables are emptied when they would pass their bound.
        """
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > KEPT_WORDS:
            self.forget()
            new = list(set(words))
        counts, links = [self.counts], [self.links]
        for at in range(0, len(new), ALIGNED_WORDS):
            part = new[at : at + ALIGNED_WORDS]
            c, texts, pairs = self.align(part)
            self.place.update(zip(part, range(len(self.texts), len(self.texts) + len(part)), strict=True))
            self.texts += texts
            counts.append(c)
            links.append(pairs)
        self.counts, self.links = np.concatenate(counts, axis=1), np.concatenate(links)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        n = self.counts[3]
        own = self.counts[:, at]
        return own, [self.texts[i] for i in at.tolist()], spread(self.links, np.cumsum(n), n, at), np.repeat(np.arange(len(words)), own[3])

    def _ids(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and numbers of ids by word, for A and B."""
        pieces = [" " + w for w in words]
        self.a.learn(set(pieces))
        a = [self.a.table.kept[x] for x in pieces]
        self.a.table.clear()
        b = self.b.encode(words, num_threads=1)
        n = np.fromiter(map(len, b), np.int64, len(b))
        return [
            (np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(map(len, a), np.int64, len(a)) // 4),
            (np.fromiter(itertools.chain.from_iterable(b), np.int64, int(n.sum())), n),
        ]

    def align(self, words: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """counts, texts and link pairs (b in the upper half, a in the lower) of distinct words."""
        import duckdb

        raw = [b" " + w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = list(zip(self._ids(words), (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True))
        bad = np.zeros(len(words), bool)
        for (ids, n), _, sizes in sides:
            bad |= sums(sizes[ids], np.concatenate([[0], np.cumsum(n)])) != size
        whole = np.frombuffer(b"".join(raw), np.uint8)[~np.repeat(bad, size)]
        place = np.repeat(np.flatnonzero(~bad), size[~bad])
        differ = [place[np.frombuffer(b"".join(map(names.__getitem__, ids[~np.repeat(bad, n)].tolist())), np.uint8) != whole] for (ids, n), names, _ in sides]
        bad[np.concatenate(differ)] = True
        first = np.cumsum(np.where(bad, 0, size)) - np.where(bad, 0, size)
        tables = []
        for (ids, n), _, sizes in sides:
            ids = ids[~np.repeat(bad, n)]
            stop = np.cumsum(sizes[ids])
            tables.append(pa.table({"pos": stop - sizes[ids], "stop": stop, "id": ids}))
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": spill}) as c:
            for name, t in zip("ab", tables, strict=True):
                c.register(f"{name}_rows", t)
                c.sql(f"CREATE TABLE {name} AS FROM {name}_rows")
                c.unregister(f"{name}_rows")
            found = c.sql(_ALIGN).to_arrow_table()
        pos, a, b, grp = (found.column(x).to_numpy().astype(np.int64) for x in ("pos", "a", "b", "grp"))
        begins_a, begins_b = (found.column(x).to_numpy() for x in ("begins_a", "begins_b"))
        cut = begins_a & begins_b
        good = np.flatnonzero(~bad)
        word = good[np.searchsorted(first[good], pos, "right") - 1] if len(good) else np.zeros(0, np.int64)
        n_a, n_b = (np.where(bad, 0, n) for (_, n), *_ in sides)
        k, most = len(words), int(grp.max(initial=0)) + 1
        counts = np.stack([n_a, n_b, np.bincount(word[cut], minlength=k), np.bincount(word, minlength=k), bad])
        return counts, self._texts(a, b, grp, cut, begins_a, begins_b, most, np.cumsum(n_a + n_b)), (b << 32) | a

    def _texts(self, a, b, grp, cut, begins_a, begins_b, most: int, ends: np.ndarray) -> list[bytes]:
        """The names of a group's A tokens stand before those of its B tokens; ends: of each word's tokens."""
        at_a, at_b = np.flatnonzero(begins_a), np.flatnonzero(begins_b)
        upto_a, upto_b = np.cumsum(np.bincount(grp[at_a], minlength=most)), np.cumsum(np.bincount(grp[at_b], minlength=most))
        code = np.empty(len(at_a) + len(at_b), np.int64)
        va, vb = len(self.a_bytes), len(self.b_bytes)
        code[np.arange(len(at_a)) + upto_b[grp[at_a] - 1]] = a[at_a] + np.where(cut[at_a], 0, va)
        code[np.arange(len(at_b)) + upto_a[grp[at_b]]] = b[at_b] + 2 * va + np.where(cut[at_b], 0, vb)
        names = self.names.take(pa.array(code))
        offsets = np.frombuffer(names.buffers()[1], np.int32)[: len(code) + 1] if len(code) else np.zeros(1, np.int32)
        data = names.buffers()[2].to_pybytes() if len(code) else b""
        at = offsets[np.concatenate([[0], ends])].tolist()
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def _aligner(a_source: str, b_model: bytes) -> Aligner:
    return Aligner(a_source, b_model)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (pieces without their leading space), numbers, bounds, and the order in which the texts come."""
    odd = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False)
    none = (pc.binary_length(texts).to_numpy() == 0) & ~odd
    order = np.concatenate([np.flatnonzero(~odd & ~none), np.flatnonzero(odd), np.flatnonzero(none)])
    parts = [pc.split_pattern(texts.filter(pa.array(~odd & ~none)), " ")]
    pieces = [[x[1:] for x in CachedTokenizer._cut.split(" " + t)] for t in texts.filter(pa.array(odd)).to_pylist()]
    parts.append(pa.array(pieces + [[]] * int(none.sum()), parts[0].type))
    flat = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
    n = np.concatenate([pc.list_value_length(p).to_numpy() for p in parts]).astype(np.int64)
    return flat.dictionary, flat.indices.to_numpy(), np.concatenate([[0], np.cumsum(n)]), order


_CHUNK = (
    "chunk long, ids binary, counts binary, digests array<string>, words binary, bounds binary, link_words binary, link_pairs binary, pairs binary, pair_counts binary"
)


def aligned_chunks(rows: DataFrame, a_vocabulary: str, b_vocabulary: str, keys: str) -> DataFrame:
    """A row for each chunk: counts and digests of its texts, its texts as word numbers, its words' links as pair numbers, its pairs and their counts."""
    spark = rows.sparkSession
    with open(a_vocabulary, encoding="utf-8") as f, open(b_vocabulary, "rb") as g:
        sources = spark.sparkContext.broadcast((f.read(), g.read()))  # of the files' size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = _aligner(*sources.value), TaskContext.get().partitionId() << 32
        for batch in it:
            for lo, hi in slices(batch.column("text"), CHUNK_BYTES):
                words, index, bounds, order = _cut(batch.column("text").slice(lo, hi - lo))
                own_counts, texts, links, link_word = both.known(words.to_pylist())
                lost = sums(own_counts[4][index], bounds) > 0
                used = index[~np.repeat(lost, np.diff(bounds))]
                key, pair = np.unique(links, return_inverse=True)
                times = np.bincount(used, minlength=len(words))
                many = np.zeros(len(key), np.int64)
                np.add.at(many, pair, times[link_word])
                counts = np.stack([np.where(lost, 0, sums(x[index], bounds)) for x in own_counts[:4]])
                digests = [
                    hashlib.sha256(b"".join(map(texts.__getitem__, index[i:j].tolist()))[1:]).hexdigest() if j > i and not gone else ""
                    for i, j, gone in zip(bounds.tolist(), bounds[1:].tolist(), lost.tolist(), strict=False)
                ]
                own = batch.column("k").slice(lo, hi - lo).take(pa.array(order))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("k", own.type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([own], ["k"]))
                live = many > 0
                row = {
                    "chunk": chunk, "ids": sink.getvalue().to_pybytes(), "counts": squeeze(counts), "digests": digests, "words": squeeze(np.where(np.repeat(lost, np.diff(bounds)), -1, index).astype(np.int32)),
                    "bounds": squeeze(bounds), "link_words": squeeze(link_word.astype(np.int32)), "link_pairs": squeeze((np.cumsum(live) - 1)[pair].astype(np.int32)),
                    "pairs": squeeze(key[live]), "pair_counts": squeeze(many[live]),
                }
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))
                chunk += 1
                del texts, words, index, used, key, pair, links, link_word
                release()

    return materialize(rows.mapInArrow(run, _CHUNK), "aligned")


def pair_rows(chunks: DataFrame) -> DataFrame:
    """chunk, pos (place among the chunk's pairs), b, a, n."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                key, n = expand(r["pairs"], "<i8"), expand(r["pair_counts"], "<i8")
                for i in range(0, len(key), BATCH):
                    k = key[i : i + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), r["chunk"])), pa.array(np.arange(i, i + len(k), dtype=np.int32)), pa.array((k >> 32).astype(np.int32)),
                         pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n[i : i + BATCH])],
                        ["chunk", "pos", "b", "a", "n"],
                    )

    return chunks.select("chunk", "pairs", "pair_counts").mapInArrow(run, "chunk long, pos int, b int, a int, n long")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold the pair), best (no other a has more with this b)."""
    totals = materialize(pair_rows(chunks).groupBy("b", "a").agg(F.sum("n").alias("count")), "pair-totals")
    top = F.broadcast(totals.groupBy("b").agg(F.max("count").alias("top")))  # a row for each B id
    return totals.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    chunks = aligned_chunks(rows, a_vocabulary, b_vocabulary, kind)
    tasks = max(n_tasks(docs.sparkSession), chunks.count() // 4)
    judged = pair_rows(chunks).join(pair_counts(chunks), ["a", "b"]).select("chunk", "pos", "count", "best")

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, t in groups(it, "chunk"):
            count, best = t.column("count").to_numpy(), t.column("best").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([squeeze(count)], pa.binary()), pa.array([squeeze(best)], pa.binary())], ["chunk", "found", "best"])

    answers = judged.repartition(tasks, "chunk").sortWithinPartitions("chunk", "pos").mapInArrow(gather, "chunk long, found binary, best binary")
    own = chunks.select("chunk", "ids", "counts", "digests", "words", "bounds", "link_words", "link_pairs").repartition(tasks, "chunk")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                index, bounds = expand(r["words"], "<i4"), expand(r["bounds"], "<i8")
                word, pair = expand(r["link_words"], "<i4"), expand(r["link_pairs"], "<i4")
                k = int(max(index.max(initial=-1), word.max(initial=-1))) + 2  # the last is the word of texts without tokens
                value = np.zeros((2, k), np.int64)
                if r["found"] is not None:
                    count, best = expand(r["found"], "<i8"), expand(r["best"], "?")
                    held = pair >= 0
                    np.add.at(value[0], word[held], best[pair[held]])
                    np.add.at(value[1], word[held], count[pair[held]])
                value[:, -1] = 0
                own_ids = pa.ipc.open_stream(r["ids"]).read_all().column("k").combine_chunks()
                counts = expand(r["counts"], "<i8").reshape(4, -1)
                columns = [own_ids, *map(pa.array, counts), *[pa.array(sums(v[index], bounds)) for v in value], pa.array(r["digests"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*_COUNTS_FIRST, "n_best", "count_sum", "groups_sha256"])
            release()

    out = own.join(answers, "chunk", "left").mapInArrow(
        finish, f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return out.withColumnRenamed("k", key)


_COUNTS_FIRST = ("k", "n_a", "n_b", "n_groups", "n_links")
