"""A training corpus in five stages, each over everything that the one before it kept: toxicity, exact dedup, near-
dedup by shingles, mixing to source weights, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import give_back_heaps, prepare, table
from weftline.llm.exact_dedup import drop_duplicates
from weftline.llm.mixing import mixed_documents
from weftline.llm.packing import pack_documents
from weftline.llm.simhash import keep_one
from weftline.llm.toxicity import drop_toxic
from weftline.sources.workspace import remove, scratch, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the largest doc_id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of near copies (5-word shingles, similarity 0.8 and more) one document stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of every document with their sequences and offsets."""
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rested(stage: Stage) -> Stage:
    """``stage`` on executors that have given back what the stage before it left."""

    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return whole


STAGES: list[tuple[str, Stage]] = [(stage.__name__, _rested(stage)) for stage in (toxicity, exact_dedup, near_dedup, mixing, packing)]

#: Learned scores, fingerprints, random rounding and tokens are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``; every stage's result is written in the shared folder and read again. A stage's working
    tables go once its result is written, and that result goes once the next stage's is.

    Null and empty texts pass every stage and are packed as their end id alone; null ids and repeated rows are documents like any
    other, but for exact and near copies, of which one row stays. Other columns are ignored, an empty table gives an empty result.
    """
    prepare(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as kept:
            result, path = stage(spark, docs, sf_dir), shared_path(spark, name)
            result.write.parquet(path)
            docs = spark.read.schema(result.schema).parquet(path)
            kept.append(path)
        if last:
            remove(spark, last)
        last = path
    return docs
