"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last keep the
columns of `documents`; the last gives the pieces of the packed windows.

What a stage gives is read from its scratch until it is written. So a stage's scratch
goes when the next one begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from portolan.llm import host_rules, mixing, packing, simhash
from portolan.llm import toxicity as toxic_texts
from portolan.llm.common import table
from portolan.scratch import new_folder, remove, scratch_in

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Scratch folders of stages whose results were handed out.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """`stage`, with its scratch in a folder of its own, after that of the stages before
    was removed; not what `docs` is still read from, if nobody wrote it."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles())
        for folder in [f for f in _left if f.rpartition("/")[2] not in read]:
            remove(spark, folder)
            _left.remove(folder)
        _left.append(new_folder(spark, stage.__name__))
        with scratch_in(_left[-1]):
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that mostly do."""
    return host_rules.keep_good(docs)


@_tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them does not call toxic."""
    model = toxic_texts.learn(docs, table(spark, sf_dir, "labels"))
    return toxic_texts.keep_civil(docs, model)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of four-word shingles link at four
    differing bits or fewer."""
    return simhash.one_of_each(docs, simhash.CLOSE)


@_tidy
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.take_mix(docs)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens."""
    return packing.pieces_of(packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), 2048))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]

# Models, hashes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; the last one's rows. What one stage
    kept is removed when the next has written what it keeps."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        result, path = stage(spark, docs, sf_dir), new_folder(spark, name)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if kept:
            remove(spark, kept)
        kept = path
    return docs


QUERIES = {"pipeline": run}
