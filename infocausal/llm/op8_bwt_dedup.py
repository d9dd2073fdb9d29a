"""Removal of byte strings that repeat, by merged Burrows-Wheeler transforms.

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller id goes.

1. Equal texts are one text (units.py), with its smallest id; the other copies go whole if they
   have LENGTH bytes.
2. Each window of LENGTH bytes is keyed by its minimizer (the least hash of its GRAM-byte strings),
   so equal windows have equal keys. Keys that one text alone has are found by counting, as no
   window under them can repeat; this only prunes.
3. A run of windows with the same key is a segment. Segments go to bins by key, with the places
   that hold them; equal ones become one string there, as a transform's alphabet does not care
   how often it is read.
4. The strings of a bin's part, dealt by the unit that they come from, are shards. Each shard has
   its Burrows-Wheeler transform made once (sorted to more than LENGTH symbols), and the transforms
   are merged by interleave refinement: suffixes start in the intervals of their keys, and each
   round reads the STEP symbols before them from the shards' transforms, splits the intervals
   stably by them and moves on by the shards' LF mappings. After the last of the fixed number of
   rounds an interval is a common prefix of LENGTH symbols: one repeated string with all its places.
   Suffixes are never compared or sorted across shards. Intervals of one suffix are settled and left.
5. The least id of an interval decides for each place. Spans travel back packed, by document.

Ids are compared as numbers; equal ids are not smaller than each other. Defined cases: null text
is empty; a null id is compared with nothing and loses nothing; repeated rows are treated alike;
an empty table gives an empty result; further columns are kept apart under `row`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import free_shuffles, materialize, n_tasks, release
from infocausal.llm.packing import LEVEL, unpacked
from infocausal.llm.units import Plan, deal, documents_with, each_unit, expand, groups, runs, squeeze
from infocausal.llm.wordhash import mix, powers, prefix_hashes

LENGTH = 50
GRAM = 24
#: Symbols of nine bits that a round of the refinement reads.
STEP = 7
SHARDS = 4
#: Bytes of strings whose shards are merged together. Cuts are made between keys, so no repeat is lost.
MERGE_BYTES = 1_000_000
#: Documents of a key from which on its windows travel one by one, each to the bin of its own hash.
SPLIT = 50_000
#: Bytes of segments in a bin, about; like units, bins grow before they become more.
BIN_BYTES = 4_000_000
_BYTES = 1_000_000


class Windows:
    """The runs of windows with the same minimizer in some texts, over one buffer."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(size) - size
        self.buf, self.begin = buf, begin
        self.sums = prefix_hashes(buf)
        empty = np.zeros(0, np.int64)
        self.key, self.owner, self.start, self.count = np.zeros(0, np.uint64), empty, empty, empty
        if len(buf) < LENGTH:
            return
        n = len(buf) - GRAM + 1
        least, span, width = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * powers(len(buf))[1][:n]), 1, LENGTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(buf) - LENGTH + 1
        least = np.minimum(least[:n], least[width - span : width - span + n])
        # A run also begins with a text; windows that reach into the next text are none.
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        edge[1:n] = least[1:] != least[:-1]
        long_ones = size >= LENGTH
        edge[begin[long_ones]] = True
        edge[np.minimum((begin + size - LENGTH + 1)[long_ones], n)] = True
        at = np.flatnonzero(edge)
        owner = np.searchsorted(begin, at[:-1], side="right") - 1
        fits = at[:-1] + LENGTH <= (begin + size)[owner]
        self.start, self.count, self.owner = at[:-1][fits], np.diff(at)[fits], owner[fits]
        self.key = least[self.start]

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the bytes at each start."""
        return mix((self.sums[start + size] - self.sums[start]) * powers(len(self.buf) + 1)[1][start] + size.astype(np.uint64))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, Windows]]:
    """Windows of the texts, a few at a time, with the place of the first text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BYTES):
            size += len(texts[stop])
            stop += 1
        yield at, Windows(texts[at:stop])
        at = stop


def minimizer_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts and the text of each."""
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, w in _pieces(texts):
        keys.append(w.key)
        owner.append(w.owner + first)
    return np.concatenate(keys), np.concatenate(owner)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those of start[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of document and place, those that touch as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first, n = runs(doc)
    lift = np.repeat(np.arange(len(first)), n) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] + lift[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[stop] - lift[stop]


_SEGMENTS = "bin int, unit int, keys binary, names binary, sizes binary, data binary, holds binary, docs binary, starts binary"


def _segments(dealt: DataFrame, counts: DataFrame, plan: Plan, bins: int) -> DataFrame:
    """For each unit and bin: keys, names (hashes), sizes and bytes of its distinct segments, and its places: which segment, document, start."""

    def run(unit: int, first: np.ndarray, copies: np.ndarray, texts: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        pieces = list(_pieces(texts))
        known = np.unique(np.concatenate([w.key for _, w in pieces] or [np.zeros(0, np.uint64)]) >> np.uint64(64 - plan.bits))
        if len(known) != len(counts):
            raise ValueError(f"{len(counts)} counts for {len(known)} keys")
        while pieces:
            at, w = pieces.pop()
            key = w.key >> np.uint64(64 - plan.bits)
            n = counts[np.searchsorted(known, key)] if len(known) else np.zeros(0, np.int64)
            cold, hot = np.flatnonzero((n > 0) & (n <= SPLIT)), np.flatnonzero(n > SPLIT)
            single = spread(w.start[hot], w.count[hot])
            start = np.concatenate([w.start[cold], single])
            size = np.concatenate([w.count[cold] + LENGTH - 1, np.full(len(single), LENGTH)])
            owner = np.concatenate([w.owner[cold], np.repeat(w.owner[hot], w.count[hot])])
            name = w.hashes(start, size)
            key = np.concatenate([key[cold], name[len(cold) :]])
            if not len(start):
                continue
            bin_ = (mix(key) % np.uint64(bins)).astype(np.int64)
            order = np.lexsort((name, key, bin_))
            start, size, owner, name, key, bin_ = (x[order] for x in (start, size, owner, name, key, bin_))
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])
            string = np.cumsum(new) - 1
            reps = np.flatnonzero(new)
            data = w.buf[spread(start[reps], size[reps])]
            byte_at = np.concatenate([[0], np.cumsum(size[reps])])
            edge, _ = runs(bin_)
            out = []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(start)], strict=True):
                r, s = int(string[i]), int(string[j - 1]) + 1
                own = reps[r:s]
                out.append(
                    (
                        int(bin_[i]), unit, squeeze(key[own]), squeeze(name[own]), squeeze(size[own]), squeeze(data[byte_at[r] : byte_at[s]]),
                        squeeze(string[i:j] - r), squeeze(first[owner[i:j] + at]), squeeze(start[i:j] - w.begin[owner[i:j]]),
                    )
                )
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["bin", "unit", "keys", "names", "sizes", "data", "holds", "docs", "starts"],
            )

    return each_unit(dealt, counts, run, _SEGMENTS)


class Shard:
    """The transform of some strings, sorted to more than LENGTH symbols; 0 ends a string, a byte b is b + 1."""

    def __init__(self, strings: np.ndarray, sizes: np.ndarray):
        """strings: the bytes of all, one after another."""
        stops = np.cumsum(sizes + 1)
        self.size = n = int(stops[-1])
        raw = np.zeros(n, np.int64)
        raw[spread(stops - sizes - 1, sizes)] = strings.astype(np.int64) + 1
        rank, depth = np.zeros(n, np.int64), STEP
        for i in range(depth):
            rank = (rank << 9) | np.roll(raw, -i)
        while True:
            self.order = np.argsort(rank)
            if depth > LENGTH:
                break
            s = rank[self.order]
            dense = np.empty(n, np.int64)
            dense[self.order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            rank = dense * n + np.roll(dense, -depth)
            depth *= 2
        self.bwt = raw[self.order - 1]
        self.lf = np.empty(n, np.int64)
        self.lf[np.argsort(self.bwt.astype(np.uint16), kind="stable")] = np.arange(n)

    def stepped(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k symbols before each suffix as one number, 0 if a string begins among them, and where k steps of LF lead."""
        at, symbol, inside = np.arange(self.size), np.zeros(self.size, np.int64), np.ones(self.size, bool)
        for i in range(k):
            read = self.bwt[at]
            symbol |= read << np.int64(9 * i)
            inside &= read > 0
            at = self.lf[at]
        return np.where(inside, symbol, 0), at


def merged_repeats(shards: list[Shard], interval: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: suffixes (numbered through the shards' orders) in intervals of a common
    prefix of `length` bytes that hold two or more, and the interval of each. `interval`: where each suffix starts."""
    base = np.cumsum([0, *[s.size for s in shards[:-1]]])

    def steps(k: int) -> tuple[np.ndarray, np.ndarray]:
        found = [s.stepped(k) for s in shards]
        return np.concatenate([x for x, _ in found]), np.concatenate([x + b for (_, x), b in zip(found, base, strict=True)])

    at = np.argsort(interval, kind="stable")
    interval = interval[at]
    for k, rounds in ((STEP, length // STEP), (length % STEP, 1)):
        if not k:
            continue
        symbols, lead = steps(k)
        for _ in range(rounds):
            symbol = symbols[at]
            live = np.flatnonzero(symbol)
            symbol, at, interval = symbol[live], lead[at[live]], interval[live]
            order = np.argsort(symbol, kind="stable")
            symbol, at, interval = symbol[order], at[order], interval[order]
            if not len(at):
                return at, interval
            start = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])]))
            n = np.diff(np.append(start, len(at)))
            open_ = n > 1
            at = at[np.repeat(open_, n)]
            interval = np.repeat(np.arange(open_.sum()), n[open_])
    return at, interval


def covered_windows(data: np.ndarray, sizes: np.ndarray, key: np.ndarray, ids: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows (string, offset, in order) that a string of the same key with a smaller id has too.

    data: the strings' bytes, one after another; ids: the smallest id of each; shard: whose transform it is in.
    """
    begin = np.cumsum(sizes) - sizes
    shards, which = [], []
    for x in np.unique(shard):
        own = np.flatnonzero(shard == x)
        shards.append(Shard(data[spread(begin[own], sizes[own])], sizes[own]))
        which.append(own)
    which = np.concatenate(which)
    # A text place belongs to a string; suffixes are in their shards' orders.
    of = np.repeat(which, sizes[which] + 1)
    offset = spread(np.zeros(len(which), np.int64), sizes[which] + 1)
    base = np.cumsum([0, *[s.size for s in shards[:-1]]])
    place = np.concatenate([s.order + b for s, b in zip(shards, base, strict=True)])
    _, dense = np.unique(key, return_inverse=True)
    at, interval = merged_repeats(shards, dense[of[place]])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string, offset = of[place[at]], offset[place[at]]
    least = np.minimum.reduceat(ids[string], runs(interval)[0])
    hit = ids[string] > least[interval]
    string, offset = string[hit], offset[hit]
    order = np.lexsort((offset, string))
    return string[order], offset[order]


def bin_spans(rows: list[dict], merge_bytes: int = MERGE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end of the covered places of a bin, from the rows of its units."""
    cat = lambda name, kind: np.concatenate([expand(r[name], kind) for r in rows])
    key, name, size, data = cat("keys", "<u8"), cat("names", "<u8"), cat("sizes", "<i8"), cat("data", "u1")
    count = [len(r) // 8 for r in (expand(x["keys"], "u1") for x in rows)]
    before = np.cumsum([0, *count[:-1]])
    hold = np.concatenate([expand(r["holds"], "<i8") + b for r, b in zip(rows, before, strict=True)])
    doc, start = cat("docs", "<i8"), cat("starts", "<i8")
    unit = np.repeat([r["unit"] for r in rows], count)
    # Equal strings of different units become one.
    order = np.lexsort((name, key))
    new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])])
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(new) - 1
    reps = order[new]
    hold = string[hold]
    first = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(first, hold, doc)
    key, size, begin = key[reps], size[reps], (np.cumsum(size) - size)[reps]
    # A key whose strings all have the same smallest id has nothing to say about that document.
    at, n = runs(key)
    differ = np.minimum.reduceat(first, at) < np.maximum.reduceat(first, at)
    part = np.flatnonzero(np.repeat(differ, n))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(part):
        # Whole keys, as many as fit.
        filled = np.cumsum(size[part])
        edge = np.append(runs(key[part])[0][1:], len(part))
        stop = int(edge[max(int(np.searchsorted(filled[edge - 1], merge_bytes, side="right")) - 1, 0)])
        own, part = part[:stop], part[stop:]
        string, offset = covered_windows(data[spread(begin[own], size[own])], size[own], key[own], first[own], unit[reps[own]] % SHARDS)
        hits.append((own[string], offset))
    # Documents after a string's first lose it whole; the first loses the windows that the merge found.
    later = doc > first[hold]
    docs, starts, ends = [doc[later]], [start[later]], [start[later] + size[hold[later]]]
    if sum(len(x) for x, _ in hits):
        string, offset = (np.concatenate(c) for c in zip(*hits, strict=True))
        cut = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.append(cut[1:], len(string)) - 1
        string, low, high = string[cut], offset[cut], offset[last] + LENGTH
        own = np.flatnonzero(~later)
        own = own[np.argsort(hold[own], kind="stable")]
        i, j = np.searchsorted(hold[own], string), np.searchsorted(hold[own], string, side="right")
        of, which = np.repeat(np.arange(len(string)), j - i), own[spread(i, j - i)]
        docs.append(doc[which])
        starts.append(start[which] + low[of])
        ends.append(start[which] + high[of])
    return merged_spans(*[np.concatenate(c) for c in (docs, starts, ends)])


def _dest(doc: np.ndarray, dests: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(dests)).astype(np.int64)


def _spans(segments: DataFrame, dests: int) -> DataFrame:
    """dest, docs, starts, ends: covered byte ranges, packed by the place where their documents will be cut."""
    merge_bytes = MERGE_BYTES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(it, "bin"):
            doc, start, end = bin_spans(rows.to_pylist(), merge_bytes)
            dest = _dest(doc, dests)
            order = np.argsort(dest, kind="stable")
            dest, doc, start, end = (x[order] for x in (dest, doc, start, end))
            edge, n = runs(dest)
            out = [(int(dest[i]), *[squeeze(x[i:j]) for x in (doc, start, end)]) for i, j in zip(edge.tolist(), (edge + n).tolist(), strict=True)]
            kinds = (pa.int32(), *[pa.binary()] * 3)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["dest", "docs", "starts", "ends"])
            release()

    together = segments.repartition(n_tasks(segments.sparkSession), "bin").sortWithinPartitions("bin")
    return together.mapInArrow(run, "dest int, docs binary, starts binary, ends binary")


def _sent(rows: DataFrame, dests: int) -> DataFrame:
    """rows (.., _doc, text) with packed texts and the place where each is cut; those without an id go by their text."""
    at = rows.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in it:
            doc, raw = batch.column("_doc"), [t.encode("utf-8") for t in batch.column(at).to_pylist()]
            dest = _dest(doc.fill_null(0).to_numpy(zero_copy_only=False), dests)
            if doc.null_count:
                other = np.array([zlib.crc32(x) % dests for x in raw])
                dest = np.where(doc.is_null().to_numpy(zero_copy_only=False), other, dest)
            columns = [pa.array([press.compress(x) for x in raw], pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dest, pa.int32())], [*batch.schema.names, "dest"])
        release()

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, dest int")


def _cut(rows: DataFrame, spans: DataFrame, copies: DataFrame, dests: int) -> DataFrame:
    """rows (row, text, _doc) -> row, n_bytes, spans (merged), kept (bytes). copies: ids that go whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups(it, "dest"):
            kind = part.column("kind").to_numpy()
            known = part.filter(pa.array(kind == 0))
            cat = lambda c, t=known: np.concatenate([expand(x, "<i8") for x in t.column(c).to_pylist()]) if t.num_rows else np.zeros(0, np.int64)
            doc, start, end = merged_spans(cat("docs"), cat("starts"), cat("ends"))
            whole = set(part.filter(pa.array(kind == 1)).column("_doc").to_pylist())
            body = part.filter(pa.array(kind == 2))
            for batch in body.to_batches():
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    merged, kept, size = [], [], []
                    for own, t in zip(some.column("_doc").to_pylist(), unpacked(some.column("text").to_pylist()), strict=True):
                        size.append(len(t))
                        if own is None:
                            edges = []
                        elif own in whole:
                            edges = [0, len(t)] if len(t) >= LENGTH else []
                        else:
                            i, j = np.searchsorted(doc, own), np.searchsorted(doc, own, side="right")
                            edges = np.stack([start[i:j], end[i:j]], axis=1).ravel().tolist()
                        cut = [0, *edges, len(t)]
                        kept.append(b"".join(t[i:j] for i, j in zip(cut[::2], cut[1::2], strict=True)))
                        merged.append([{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2], strict=True)])
                    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("row"), pa.array(size, pa.int64()), pa.array(merged, spans_kind), pa.array(kept, pa.binary())],
                        ["row", "n_bytes", "spans", "kept"],
                    )
            release()

    row = rows.schema["row"].dataType
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = [none("binary", c) for c in ("docs", "starts", "ends")]
    texts = _sent(rows, dests).select("dest", F.lit(2).alias("kind"), "_doc", *marks, "text", "row")
    whole = _sent(copies.select("_doc", F.lit("").alias("text")), dests).select("dest", F.lit(1).alias("kind"), "_doc", *marks, "text", none(row, "row"))
    told = spans.select("dest", F.lit(0).alias("kind"), none("long", "_doc"), "docs", "starts", "ends", none("binary", "text"), none(row, "row"))
    together = told.unionByName(whole).unionByName(texts).repartition(n_tasks(rows.sparkSession), "dest").sortWithinPartitions("dest", "kind")
    return together.mapInArrow(run, f"row {row.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[Column, ...] | None = None) -> DataFrame:
    """row (the columns `carry`, by default all), n_bytes, spans (removed runs, in bytes), kept (the remaining bytes)."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null")
    digests = materialize(own.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size")), "digests")
    plan = Plan.of(*[x or 0 for x in digests.agg(F.count("*"), F.sum("size")).first()])
    dealt = deal(own, plan)
    counts = materialize(documents_with(dealt, plan, minimizer_keys), "counts")
    free_shuffles(spark)
    segments = _segments(dealt, counts, plan, plan.parts(BIN_BYTES))
    # Written out, so that the shuffles before it can go before the texts travel again.
    spans = materialize(_spans(segments, plan.units), "spans")
    free_shuffles(spark)
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"))
    copies = digests.join(firsts, "digest").filter("id > first").select(F.col("id").alias("_doc")).distinct()
    row = F.struct(*(carry or [docs[c] for c in docs.columns])).alias("row")
    return _cut(docs.select(row, F.coalesce(docs[text], F.lit("")).alias("text"), docs[key].cast("long").alias("_doc")), spans, copies, plan.units)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes taken out of its text (halves of letters at the edges go too) and its length set anew."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != text], F.lit(0).alias("_")).alias("rest")
    cut = remove_repeats(docs, key, text, (rest, docs[text].isNull().alias("null")))
    clean = F.try_validate_utf8(F.col("kept").cast("string"))
    lenient = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    new = F.when(~F.col("row.null"), F.when(F.size("spans") == 0, F.col("kept").cast("string")).otherwise(F.coalesce(clean, lenient)))
    out = cut.select("row.rest", new.alias("_new"))
    columns = [
        F.col("_new").alias(c) if c == text
        else F.when(F.col("_new").isNull(), F.col("rest")[c]).otherwise(F.length("_new")).cast(docs.schema[c].dataType).alias(c) if c == length
        else F.col("rest")[c].alias(c)
        for c in docs.columns
    ]
    return out.select(*columns)
