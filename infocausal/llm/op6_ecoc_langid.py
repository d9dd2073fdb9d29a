"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over hashed character
n-grams (1 to 3) is trained to tell the languages with a 1 from those with a 0. A text's bits are
decoded by weighted loss: the codeword with the smallest sum of w_b * loss(margin_b) wins, where
w_b is bit b's accuracy on held-back training rows; a small gap to the runner-up flags the text
as ambiguous.

Learning uses a sample of labelled rows of bounded size (SAMPLE_PER_LANGUAGE texts a language and
SAMPLE_ROWS in all, so of at most SAMPLE_ROWS languages, by the hash of their ids and texts). Both learning and
prediction read whole texts, whatever their length, and nothing but the text; tasks turn the
sampled texts into counts of n-grams, which are of one size, and only those reach the driver.

Defined cases: null text and text without a letter give `und` with score 0; with no labelled rows
every text is `und`; with one language every text with a letter has that language; repeated rows
are predicted as often as they come; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on what is learned from: texts a language and in all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1_000, 6_000
BITS_OF_HASH = 13
ORDERS = (1, 2, 3)
EPOCHS, RATE, DECAY = 12, 0.5, 1e-6
#: Below this gap between the two best codewords' losses, in parts of all weight, a text is ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)
#: Letters and bytes above ASCII stand for themselves; all else is one kind of gap.
_KEPT = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1, far apart.

    Up to seven languages take the exhaustive code (every split of the languages once); more take the
    most separated of a few hundred random codes of 10 log2(n) bits.
    """
    if n <= 7:
        splits = range(1, 2 ** max(n - 1, 1)) if n > 1 else range(1, 2)
        return np.array([[1 if i == 0 else (-1 if s >> (i - 1) & 1 else 1) for s in splits] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = bits - np.abs(code.astype(np.int32) @ code.T.astype(np.int32)).max(initial=0, where=~np.eye(n, dtype=bool))
        if apart > far:
            best, far = code, apart
    return best


def slots(text: str) -> list[np.ndarray] | None:
    """Hashed n-grams of the lower-cased letters, an array for each order; None without a letter."""
    if not _LETTER.search(text):
        return None
    raw = _KEPT[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    out, gram = [], raw
    for order in ORDERS:
        if len(raw) < order:
            break
        if order > 1:
            gram = gram[:-1] * np.uint32(257) + raw[order - 1 :]
        out.append(((gram + np.uint32(order * 7919)) * _MIX) >> np.uint32(32 - BITS_OF_HASH))
    return out


def features(grams: list[np.ndarray]) -> np.ndarray:
    """Shares of the hashed n-grams."""
    counts = sum(np.bincount(g, minlength=1 << BITS_OF_HASH) for g in grams)
    return (counts / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def margin(self, grams: list[np.ndarray]) -> np.ndarray:
        """The bits' margins of one text."""
        return self.margins(features(grams)[None])[0]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The bits' margins of texts by their features."""
        return x @ self.weights + self.bias

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """Rows of margins -> the weighted logistic loss of each language's codeword."""
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (loss * self.bit_weight).sum(2) / self.bit_weight.sum()

    def decode(self, margin: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1: the winner's share of exp(-loss)), ambiguity flags."""
        loss = self.losses(margin)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(margin))
        best = loss[rows, order[:, 0]]
        gap = loss[rows, order[:, 1]] - best if loss.shape[1] > 1 else np.full(len(margin), np.inf)
        share = np.exp(-4 * (loss - best[:, None]))
        return [self.languages[i] for i in order[:, 0]], 1 / share.sum(1), gap < AMBIGUOUS


def fit(texts: list[str], labels: list[str]) -> Model | None:
    found = [(features(g), y) for g, y in ((slots(t), y) for t, y in zip(texts, labels, strict=True)) if g is not None]
    return fit_features(np.stack([f for f, _ in found]), [y for _, y in found]) if found else None


def fit_features(x: np.ndarray, labels: list[str]) -> Model:
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    y = np.array([languages.index(v) for v in labels])
    held = np.arange(len(x)) % 10 == 9 if len(x) >= 100 else np.zeros(len(x), bool)
    target = code[y].astype(np.float32)
    # Rows of a language weigh as much as those of any other.
    weight = (1 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    second = np.full_like(w, 1e-10)
    rng, use = np.random.default_rng(3), np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
            z = x[part] @ w + b
            g = -target[part] / (1 + np.exp(target[part] * z)) * (weight[part] / weight[part].sum())[:, None]
            step = x[part].T @ g + DECAY * w
            second += step * step
            w -= RATE * step / np.sqrt(second)
            b -= RATE * 0.1 * g.sum(0)
    right = ((x[held] @ w + b) * target[held] > 0).mean(0) if held.any() else np.ones(code.shape[1])
    return Model(languages, code, w, b, np.maximum(2 * right - 1, 0.05))


def training_sample(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """f (packed features), lang of a bounded sample: about SAMPLE_PER_LANGUAGE texts a language, those with the smallest hashes of id and text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    space = 1 << 30
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "f binary, lang string")
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, each / r["n"]) * space))])
    at = F.pmod(F.xxhash64("k", "text", F.lit(6)), F.lit(space))
    picked = rows.select("text", "lang", at.alias("at"), F.xxhash64("text").alias("h")).filter(F.col("at") <= share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = [slots(t) for t in batch.column("text").to_pylist()]
            held = batch.filter(pa.array([g is not None for g in found], pa.bool_()))
            packed = pa.array([press.compress(features(g).tobytes()) for g in found if g is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *[held.column(c) for c in ("lang", "at", "h")]], ["f", "lang", "at", "h"])

    # Which rows are kept doesn't depend on their order.
    return picked.mapInArrow(run, "f binary, lang string, at long, h long").orderBy("at", "h", "lang").limit(2 * SAMPLE_ROWS).select("f", "lang")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    # At most 2 * SAMPLE_ROWS rows of some KB.
    rows = sorted((bytes(r["f"]), r["lang"]) for r in training_sample(docs, key, text, lang).collect())
    if not rows:
        return None
    unpress = zstandard.ZstdDecompressor()
    return fit_features(np.stack([np.frombuffer(unpress.decompress(f), np.float32) for f, _ in rows]), [y for _, y in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The columns `keep`, lang_pred, score, ambiguous."""
    rows = docs.select(F.struct(*keep, F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [slots(t) if m is not None and t is not None else None for t in part.column("text").to_pylist()]
                lang, score, doubt = [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found), bool)
                have = [i for i, f in enumerate(found) if f is not None]
                if have:
                    names, scores, doubts = m.decode(m.margins(np.stack([features(found[i]) for i in have])))
                    for i, name in zip(have, names, strict=True):
                        lang[i] = name
                    score[have], doubt[have] = scores, doubts
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(lang), pa.array(score), pa.array(doubt)],
                    ["row", "lang_pred", "score", "ambiguous"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("row.*", "lang_pred", "score", "ambiguous").drop("_")
