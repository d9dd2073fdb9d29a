"""Whole texts in units, and the keys of theirs that other texts have too.

A text goes to the unit that its digest names, so equal texts are one text there, with a count.
A unit sends each of its distinct keys once, in packed and sorted runs, to the buckets of the key
space; a bucket answers every run with the number of documents that have the key, or 0 where only
one text has it. So a key that a third of all texts share costs a bucket one entry a unit, and the
number of rows that travel follows units times buckets, not texts times keys.

Units and buckets follow the bytes of the corpus: from UNIT_BYTES and BUCKET_BYTES on they grow
until there are about PARTS of them, then their number grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import n_tasks, release
from infocausal.llm.packing import LEVEL, unpacked

#: Text bytes of a unit, bytes of keys in a bucket, and how far both may grow.
UNIT_BYTES, BUCKET_BYTES, MOST_BYTES = 2_000_000, 4_000_000, 256_000_000
PARTS = 4_096
#: A key of a text for so many bytes of text, at most.
BYTES_PER_KEY = 6
#: Rows of a unit that are texts sort after the answers to its keys.
TEXT = (1 << 31) - 1


@dataclass(frozen=True)
class Plan:
    """How a corpus of so many rows and text bytes is cut."""

    rows: int
    text_bytes: int
    units: int
    buckets_log2: int
    #: Bits of a key that travel: enough that a corpus' keys rarely collide.
    bits: int

    @classmethod
    def of(cls, rows: int, text_bytes: int) -> Plan:
        buckets = _parts(8 * text_bytes // BYTES_PER_KEY, BUCKET_BYTES)
        return cls(rows, text_bytes, _parts(text_bytes, UNIT_BYTES), max(3, (buckets - 1).bit_length()), max(48, text_bytes.bit_length() + 12))

    def parts(self, least: int) -> int:
        """Parts of about `least` bytes, or larger ones, that the text makes."""
        return _parts(self.text_bytes, least)


def _parts(size: int, least: int) -> int:
    return max(1, -(-size // min(max(size // PARTS, least), MOST_BYTES)))


def deal(rows: DataFrame, plan: Plan) -> DataFrame:
    """(id, text) without nulls -> unit, digest, first (smallest id), copies (rows), text (a frame); equal texts of a batch are one row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in it:
            found: dict[bytes, list] = {}
            for own, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = t.encode("utf-8")
                digest = hashlib.sha256(raw).digest()[:16]
                if (x := found.get(digest)) is None:
                    found[digest] = [own, 1, press.compress(raw)]
                else:
                    x[0], x[1] = min(x[0], own), x[1] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(d[:8], "little") % plan.units for d in found], pa.int32()), pa.array(list(found), pa.binary()),
                    pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64()),
                    pa.array([x[2] for x in found.values()], pa.binary()),
                ],
                ["unit", "digest", "first", "copies", "text"],
            )
            release()

    return rows.select("id", "text").mapInArrow(run, "unit int, digest binary, first long, copies long, text binary")


def groups(it: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The runs of equal values of a sorted column, with their rows."""
    held, last = [], None
    for batch in it:
        if not batch.num_rows:
            continue
        at = batch.column(column).to_numpy()
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            if held and at[i] != last:
                yield int(last), pa.Table.from_batches(held)
                held = []
            last = at[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield int(last), pa.Table.from_batches(held)


def texts_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Smallest ids, numbers of rows and bytes of the distinct texts of a unit's rows, which are sorted by digest."""
    digest = rows.column("digest").to_pylist()
    start = np.array([i for i, d in enumerate(digest) if not i or d != digest[i - 1]], np.int64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    frames = rows.column("text").take(pa.array(start)).to_pylist()
    first, copies = rows.column("first").to_numpy(), rows.column("copies").to_numpy()
    return np.minimum.reduceat(first, start), np.add.reduceat(copies, start), unpacked(frames)


def key_pairs(keys: np.ndarray, owner: np.ndarray, texts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key cut to `bits`, text) in order, and how often each comes."""
    free = 64 - bits
    if texts <= 1 << free:
        both = np.sort((keys >> np.uint64(free) << np.uint64(free)) | owner.astype(np.uint64))
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(both)))
        both = both[start]
        return both >> np.uint64(free), (both & np.uint64((1 << free) - 1)).astype(np.int64), n
    k = keys >> np.uint64(free)
    order = np.lexsort((owner, k))
    k, o = k[order], owner[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(k) else np.zeros(0, np.int64)
    return k[start], o[start], np.diff(np.append(start, len(k)))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(frame: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values by their steps, byte plane by byte plane, as the high planes are nearly empty."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return squeeze(step.view(np.uint8).reshape(len(values), 8).T)


def _unpack_sorted(frame: bytes) -> np.ndarray:
    planes = expand(frame, "u1")
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def documents_with(dealt: DataFrame, plan: Plan, keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """unit, bucket, counts: for the sorted distinct keys of a unit in a bucket the number of documents with the key, 0 if one text has it.

    keys_of gives for some texts the keys and the text that has each.
    """
    low = plan.bits - plan.buckets_log2

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in groups(it, "unit"):
            _, copies, texts = texts_of(rows)
            k, owner, _ = key_pairs(*keys_of(texts), len(texts), plan.bits)
            if not len(k):
                continue
            start, n = runs(k)
            documents = np.add.reduceat(copies[owner], start)
            u = k[start]
            bucket = u >> np.uint64(low)
            edge, _ = runs(bucket)
            out = []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(u)], strict=True):
                own = int(bucket[i])
                out.append((own, unit, _pack_sorted(u[i:j] - np.uint64(own << low)), squeeze(documents[i:j]), squeeze(n[i:j] > 1)))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "unit", "keys", "documents", "many"]
            )
            release()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(it, "bucket"):
            keys = [_unpack_sorted(x) for x in rows.column("keys").to_pylist()]
            documents = np.concatenate([expand(x, "<i8") for x in rows.column("documents").to_pylist()])
            many = np.concatenate([expand(x, "?") for x in rows.column("many").to_pylist()])
            ends = np.cumsum([len(x) for x in keys])
            k = np.concatenate(keys)
            order = np.argsort(k)
            start, n = runs(k[order])
            shared = (n > 1) | np.logical_or.reduceat(many[order], start)
            count = np.empty(len(k), np.int64)
            count[order] = np.repeat(np.where(shared, np.add.reduceat(documents[order], start), 0), n)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("unit").combine_chunks(), pa.array(np.full(len(keys), bucket, np.int32)),
                    pa.array([squeeze(x) for x in np.split(count, ends[:-1])], pa.binary()),
                ],
                ["unit", "bucket", "counts"],
            )
            release()

    tasks = n_tasks(dealt.sparkSession)
    sent = in_units(dealt, tasks).mapInArrow(emit, "bucket int, unit int, keys binary, documents binary, many binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "unit int, bucket int, counts binary")


def in_units(dealt: DataFrame, tasks: int) -> DataFrame:
    return dealt.repartition(tasks, "unit").sortWithinPartitions("unit", "digest")


def each_unit(
    dealt: DataFrame, counts: DataFrame, run: Callable[[int, np.ndarray, np.ndarray, list[bytes], np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """run(unit, first ids, copies, texts, counts of the unit's sorted distinct keys) for every unit."""
    text = dealt.select("unit", F.lit(TEXT).alias("bucket"), "digest", "first", "copies", "text")
    none = {"digest": "binary", "first": "long", "copies": "long"}
    answers = counts.select("unit", "bucket", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("counts").alias("text"))

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in groups(it, "unit"):
            at = int(np.searchsorted(rows.column("bucket").to_numpy(), TEXT))
            known = [expand(x, "<i8") for x in rows.column("text").slice(0, at).to_pylist()]
            yield from run(unit, *texts_of(rows.slice(at)), np.concatenate(known) if known else np.zeros(0, np.int64))
            release()

    both = answers.unionByName(text).repartition(n_tasks(dealt.sparkSession), "unit").sortWithinPartitions("unit", "bucket", "digest")
    return both.mapInArrow(go, schema)
