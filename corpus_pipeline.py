"""The corpus pipeline: quality classifier, near-duplicate join, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written and read again before the next one. Stages 1 to 4
return the columns of ``documents``, the last one token pieces and their places.

Null and empty texts have no words: they keep their place unless the classifier
rejects them, are near nothing, hold no passage and no item, and end as one
piece. Rows that repeat an id and a text leave stage 2 as one row; documents
without an id are no copies of anything. Empty tables give empty results; extra
columns pass through stages 1 to 4, whatever their names are.

The tables that a stage writes for itself are deleted as soon as the next stage
starts, as its own result is written by then; a table that the next stage's
``docs`` still reads stays.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, kernels, packing, passages, quality, queries

_LEFT: dict[tuple, list[DataFrame]] = {}


def _release(run: tuple, docs: DataFrame) -> None:
    """Deletes what the stages before wrote in this run, but for what ``docs`` reads."""
    read = "\n".join(docs.inputFiles())
    for table in _LEFT.pop(run, []):
        if table.written_to.rpartition("/")[2] in read:
            _LEFT.setdefault(run, []).append(table)
        else:
            kernels.forget(table)


def _stage(body: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (threading.get_ident(), sf_dir)
        _release(run, docs)
        with kernels.collecting(_LEFT.setdefault(run, [])):
            return body(spark, docs, sf_dir)

    stage.__name__, stage.__doc__ = body.__name__, body.__doc__
    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model, score = queries.quality_model(docs, queries.table(spark, sf_dir, "labels")), kernels.free_name(docs, "quality_score")
    scores = quality.scored(docs, model, keep=tuple(docs.columns), score=score)
    return scores.filter(quality.accepted(scores[score]) == 1).select(docs.columns)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.kept(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return passages.removed(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, in any casing."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"), any_case=True)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed_documents(docs, queries.byte_bpe())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# Training, components and packing have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, source = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = kernels.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if source is not None:
            kernels.forget(source)
        docs = source = out
    _release((threading.get_ident(), sf_dir), docs)
    return docs
