"""A training-data pipeline over documents: each stage works on all that the one before it kept.

language_id drops texts without letters and texts too far from every learned language; quality_rules drops documents
that fail the base rules or keep too few words once lines common to many documents of a host are gone; near_dedup keeps
one document of each component of near duplicates on 5-word shingles at 0.8; decontaminate drops documents that hold a
benchmark item's template; bpe returns the tokens' digests. All but the last return the columns of documents.

Defined results: null and empty texts go at the first stage; a row repeated with its identifier is judged like its twin, and
stays or goes with it (near duplicates are told apart by identifier, so both rows of one stay); a null identifier is no
duplicate of any row; further columns pass through, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import bpe_automaton, decontaminate, language_id, near_dedup, quality_rules
from sitelens.llm.common import columns_of, discard, free, table, without, written
from sitelens.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known from their own labels."""
    names = tuple(free(docs, "_lang", "_score", "_rejected"))
    judged = language_id.predict(docs, language_id.fit(docs), names=names)
    return judged.filter(~F.col(names[2])).select(*columns_of(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted."""
    return quality_rules.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    gone = written(near_dedup.cluster(docs).filter("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "duplicates")
    return without(docs, "doc_id", gone)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the whole texts."""
    return bpe_automaton.round_trip(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: No SQL expresses language ID, sketching or BPE; tests/llm/test_pipeline.py compares the filtering stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
