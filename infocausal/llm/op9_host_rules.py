"""Quality rules with host verdicts; DataFrame functions only.

Per document the base counts are computed inside the row (no shuffle of words or windows).
Failures of the base rule are then counted by host, the host rates are shrunk with a beta
prior fitted to all hosts by moments, and the host verdict joins back to the documents.

Defined cases: null or empty text has zero counts and fails (n_words < 50); a null host is a
host of its own; repeated rows count and are returned as often as they come; an empty table
gives an empty result. Input columns of any name stay untouched: the counts live in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import let, materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Production parameters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host whose shrunken failure rate is above this is rejected.
    max_host_rate: float = 0.5
    #: Weight of the prior, in documents, where the hosts' rates differ no more than chance explains.
    flat_prior: float = 1000.0


def _repeated_words(words: Column) -> Column:
    """Words inside a window of three that comes twice or more in the text.

    Most texts have no such window: a set of the windows' 64-bit hashes tells. In the others, windows
    are sorted by hash and place; equal neighbours repeat, and a repeated window at place i adds
    min(3, i - previous repeated place) words.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        )
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, repeats))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeated_words(words).alias("n_repeat_words"),
        )

    return F.struct(
        let(_words(text), counts).alias("w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def base_failed(text: Column, rules: HostRules) -> Column:
    """The base rule alone, from the two counts that it needs; repeats are looked for in texts that are long enough only."""
    return let(
        _words(text),
        lambda w: (F.size(w) < rules.min_words) | (100 * _repeated_words(w) > rules.max_repeat_percent * F.size(w)),
    )


def with_counts(docs: DataFrame, text: str, keep: list[Column], rules: HostRules) -> DataFrame:
    """`keep` plus the struct `_q`, written out once, as everything after it reads it twice."""
    q = docs.select(*keep, base_counts(docs[text]).alias("_c")).withColumn(
        "_q",
        F.struct(
            F.col("_c.w.n_words").alias("n_words"),
            F.col("_c.word_chars").alias("word_chars"),
            F.col("_c.n_symbols").alias("n_symbols"),
            F.col("_c.n_dup_lines").alias("n_dup_lines"),
            F.col("_c.w.n_repeat_words").alias("n_repeat_words"),
            (
                (F.col("_c.w.n_words") < rules.min_words)
                | (100 * F.col("_c.w.n_repeat_words") > rules.max_repeat_percent * F.col("_c.w.n_words"))
            ).alias("base_failed"),
        ),
    )
    return materialize(q.drop("_c"), "quality")


def host_verdicts(hosts: DataFrame, rules: HostRules) -> DataFrame:
    """host, docs `n`, failures `k` -> host, shrunken rate, ok.

    Beta(a, b) by moments over the hosts' rates: mean m and variance v give a + b = m (1 - m) / v - 1.
    From the variance of the rates goes what the draw of n documents a host adds to it, m (1 - m) / n
    on average. The three moments are the only values that the driver sees.
    """
    rate = F.col("k") / F.col("n")
    m, spread, per_document = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    if m is None:
        return hosts.select("host", F.lit(0.0).alias("host_rate"), F.lit(True).alias("host_ok"))
    v = spread - m * (1 - m) * per_document
    strength = max(m * (1 - m) / v - 1, 0.0) if v > 0 else rules.flat_prior
    shrunken = (F.col("k") + m * strength) / (F.col("n") + strength)
    return hosts.select(
        "host", shrunken.alias("host_rate"), (shrunken <= rules.max_host_rate).alias("host_ok")
    )


def host_rules(
    docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: HostRules = HostRules()
) -> DataFrame:
    """The columns `keep` (all if None) plus `_q` (the counts), `host_rate` and `kept`.

    The host table joins by key, so a host with a third of all rows is split by adaptive
    execution or, where the measured host table is small, broadcast by it.
    """
    kept = [docs[c] for c in (docs.columns if keep is None else keep)]
    base = with_counts(docs, text, [F.struct(*kept).alias("_row"), docs[host].alias("_host")], rules)
    hosts = base.groupBy(F.col("_host").alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("_q.base_failed").cast("long")).alias("k")
    )
    verdicts = host_verdicts(hosts, rules)
    joined = base.join(verdicts, base["_host"].eqNullSafe(verdicts["host"]), "left")
    return joined.select("_row", "_q", "host_rate", (~F.col("_q.base_failed") & F.col("host_ok")).alias("kept"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs` that pass, with its columns only.

    The rule is applied twice, for the hosts and for the rows, so that no copy of the texts is written.
    """
    failed = base_failed(docs[text], rules)
    hosts = docs.select(docs[host].alias("host"), failed.cast("long").alias("f")).groupBy("host").agg(
        F.count("*").alias("n"), F.sum("f").alias("k")
    )
    verdicts = host_verdicts(materialize(hosts, "hosts"), rules).filter("host_ok")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[host].alias("_host"), failed.alias("_failed"))
    good = rows.filter("not _failed")
    return good.join(verdicts, good["_host"].eqNullSafe(verdicts["host"]), "left_semi").select("_row.*")
