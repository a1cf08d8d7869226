"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, jaccard, packing, pii, quality, repeats

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality.stage),
    ("n-gram jaccard join", jaccard.stage),
    ("suffix-array dedup", repeats.stage),
    ("personal data", pii.stage),
    ("best-fit packing", packing.stage),
]
#: Trees, suffix arrays and best-fit bins are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and those before it have written is deleted once the stage's own result is;
    tables that others write meanwhile are not touched.

    Rows of null or repeated doc_ids and nulls in any column go through each stage as its docstring says; an empty
    documents table gives an empty result.
    """
    docs = common.read(spark, sf_dir, "documents")
    with common.Scope(spark) as scope:
        for name, stage in STAGES:
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            scope.release(keep=1)
    return docs
