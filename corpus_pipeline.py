"""The corpus pipeline: quality rules, near-dedup, repeated passages, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`. When a stage
starts, the scratch tables of the stages before it over the same sf_dir go, but for those that its
docs still read; so one pipeline at a time runs over a folder in a process.

Defined cases, in every stage: an empty table gives an empty result; a document with a null id is
never dropped as a copy, repeat or contaminated one (it can still fail the quality rules); rows
that are repeated whole are one document from near-dedup on; null text fails the quality rules;
further columns of any name are kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from infocausal.llm import op1_icws_neardup, op7_spaced_seeds, op8_bwt_dedup, op9_host_rules
from infocausal.llm.common import materialize, table
from infocausal import scratch
from infocausal.scratch import drop_unread
from infocausal.llm.queries import bpe_digests


#: Scratch tables of the last stages, by input folder.
_own: dict[str, list[str]] = {}


def stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _own.setdefault(sf_dir, [])
        drop_unread(spark, own, [docs])
        before = len(scratch.tables)
        out = f(spark, docs, sf_dir)
        own.extend(scratch.tables[before:])
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host passes."""
    return op9_host_rules.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return op1_icws_neardup.keep_first(docs)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return op8_bwt_dedup.drop_repeats(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return op7_spaced_seeds.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Sampling, iterated links and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = materialize(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
