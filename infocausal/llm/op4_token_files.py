"""Token ids in files: one zstandard frame per document, a shared dictionary, an offset index.

Layout under a folder:

- `dictionary`: one row (dict_hash, dictionary, end_id); the dictionary is trained on the ids of a
  bounded sample of documents.
- `blocks`: rows in ascending document order (part, seq): part_offset (ids of the part before the
  block), dict_hash, first_doc, last_doc, n_ids,
  doc_ids[], n_tokens[], offsets[] and `data`, the frames of the block's documents end to end.
  Document i of a block is data[offsets[i]:offsets[i + 1]] and decompresses alone to its ids as
  little-endian unsigned 32-bit integers, the end id included.

The container is Parquet, so Spark's committed writes make the files whole under lost executors,
and one document is read by its block's first and last id without touching other blocks.

Defined cases: null text is empty and has the end id only; null ids come first; equal ids stay
side by side, in the order of their texts' checksums; an empty table gives an empty folder that
reads back as no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.llm.common import n_tasks, release
from infocausal.llm.op3_pair_index_bpe import byte_letters
from infocausal.llm.pieces import PieceTable

END_ID = 2
#: The dictionary is fitted on about so many documents, on a piece of those with more than so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 16_384
DICTIONARY_BYTES = 112_640
LEVEL = 1
#: Bytes of ids in a block, before compression; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000
#: Pieces kept per Python worker.
CACHED_PIECES = 1_100_000
CHUNK_CHARS = 1_000_000
_BLOCKS = (
    "part int, seq int, part_offset long, dict_hash string, first_doc long, last_doc long, n_ids long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, data binary"
)


class CachedTokenizer:
    """The tokenizers library, asked once for each distinct piece of text.

    A space between two letters that aren't spaces always begins a new pre-token, so the ids of a
    text are those of its pieces (each with its leading space), one after another.
    """

    _loose = re.compile(r"(?:^|\s)[ ]|[ ](?:\s|$)")
    _other = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _plain = re.compile(r"( ?[^\W\d_]+)([^\w\s]+)?(?:\n([^\W\d_]+)([^\w\s]+)?)?")
    _cut = re.compile(r"(?<=\S)(?=[ ]\S)")

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_padding()
        self.library.no_truncation()
        self.table = PieceTable(CACHED_PIECES)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        spec = json.loads(source)
        #: Whether nothing but the byte-level splitting stands before the model.
        self.direct = spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["model"]["type"] == "BPE" and not any(
            x["content"].strip().isalpha() for x in spec["added_tokens"]
        )
        end = self.library.encode("a\na", add_special_tokens=False).ids
        #: Whether a word at the start of a text has the ids that it has after a line end.
        self.bare = len(end) == 3 and end[0] == end[2]

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or "\0" in text)
        if plain and (not self._other.search(text) or not self._loose.search(text)):
            return text.replace(" ", "\0 ").split("\0")
        return self._cut.split(text)

    def ask(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. A space and letters are one pre-token, which goes straight to the library's model, in the letters that stand for its bytes."""
        out: list[bytes | None] = [None] * len(pieces)
        if self.direct:
            model, letters = self.library.model.tokenize, self.letters
            for i, x in enumerate(pieces):
                if x[0] == " " and x[1:].isalpha():
                    ids = [t.id for t in model(x.encode().decode("latin-1").translate(letters))]
                    out[i] = pack(f"<{len(ids)}I", *ids)
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for i, e in zip(part, self.library.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def learn(self, new: set[str]) -> None:
        """Letters, marks after them, and a line end before further letters are pre-tokens of their own, so pieces made of these share the ids of their parts."""
        kept = self.table.kept
        parts = {}
        for x in new:
            m = None if x[1:].isalpha() else self._plain.fullmatch(x)
            if m and (m[2] or m[3]) and m[1].removeprefix(" ").isalpha() and (not m[3] or (self.bare and m[3].isalpha())):
                parts[x] = [g for g in (m[1], m[2], "\n" if m[3] else "", m[3], m[4]) if g]
        ask = list((new - parts.keys()) | {p for ps in parts.values() for p in ps if p not in kept})
        kept.update(zip(ask, self.ask(ask), strict=True))
        for x, ps in parts.items():
            kept[x] = b"".join([kept[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.table.look_up([self.pieces(t) for t in texts], self.learn)


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedTokenizer(source)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where the samples are too few to train on, their own bytes serve as one."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _fit(docs: DataFrame, source, end_id: int) -> bytes:
    """From a bounded sample: the documents with the smallest hashes of their ids; of long ones a piece from a place that the hash names."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / n) if n else 1.0
    space = 1 << 30
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(space)) <= int(share * space)).limit(2 * SAMPLE_DOCS)
    least = SAMPLE_BYTES // 4
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - least, F.lit(1))).cast("int")
    piece = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.substr("text", place + 1, F.lit(least)))
    sample = picked.select(piece.alias("text"))
    end = pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(source.value)
        for batch in batches:
            ids = [x + end for x in tok.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    rows = sample.select("text").mapInArrow(run, "ids binary").collect()
    return train_dictionary(sorted(bytes(r["ids"]) for r in rows))


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text"
) -> str:
    """Encode all documents into the files described above; returns the dictionary's hash."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = _fit(rows, source, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    end = pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(source.value)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "seq": seq, "part_offset": before, "dict_hash": digest, "first_doc": known[0] if known else None,
                "last_doc": known[-1] if known else None, "n_ids": sum(sizes), "doc_ids": ids, "n_tokens": sizes,
                "offsets": offsets, "data": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        for batch in batches:
            keys, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for chunk in _chunks(texts):
                for own, x in zip(keys[at : at + len(chunk)], tok.encode(chunk), strict=True):
                    if ids and held + len(x) > BLOCK_BYTES:
                        yield block()
                        before += sum(sizes)
                        ids, sizes, frames, held, seq = [], [], [], 0, seq + 1
                    ids.append(own)
                    sizes.append(len(x) // 4 + 1)
                    frames.append(press.compress(x + end))
                    held += len(x) + 4
                at += len(chunk)
        if ids:
            yield block()
        release()

    ordered = rows.repartitionByRange(n_tasks(spark), "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    head = [(digest, bytearray(dictionary), end_id)]
    spark.createDataFrame(head, "dict_hash string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{folder}/dictionary")
    return digest


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("dict_hash", pa.string()), ("first_doc", pa.int64()),
        ("last_doc", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary()),
    ]
)


def _open_frames(spark: SparkSession, folder: str, blocks: DataFrame, wanted: frozenset[int] | None = None) -> DataFrame:
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, digest = bytes(head["dictionary"]), head["dict_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != digest:
                    raise ValueError(f"block {b['part']}/{b['seq']} needs the dictionary {b['dict_hash']}")
                at, out = b["part_offset"], []
                for i, (own, n) in enumerate(zip(b["doc_ids"], b["n_tokens"], strict=True)):
                    if wanted is None or own in wanted:
                        ids = unpress.decompress(b["data"][b["offsets"][i] : b["offsets"][i + 1]])
                        out.append((own, b["part"], at, ids))
                    at += n
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "ids"])

    return blocks.select("part", "seq", "part_offset", "dict_hash", "doc_ids", "n_tokens", "offsets", "data").mapInArrow(
        run, "doc_id long, part int, at long, ids binary"
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (binary, little-endian unsigned 32-bit), from the files alone."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part of the range partitioning, however large the corpus: that bounds the broadcast.
    parts = F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")))
    return _open_frames(spark, folder, blocks).join(parts, "part").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "ids"
    )


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of a few documents: only blocks whose range holds one are read, only their frames are opened."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    hit = F.lit(False)
    for i in doc_ids:
        hit = hit | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return _open_frames(spark, folder, blocks.filter(hit), frozenset(doc_ids)).select("doc_id", "ids")
