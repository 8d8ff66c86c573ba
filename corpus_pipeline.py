"""A corpus pipeline: toxic documents, near duplicates and benchmark leaks go, sources are mixed, and shards are cut.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``docs``.  All stages take null ids, texts, sources and languages, empty and very
long texts, repeated rows, further columns of any name but ``__``-prefixed ones, and empty tables, which give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheerlight.llm.common import delete_path, scratch_path
from sheerlight.llm.decontaminate import drop_leaks
from sheerlight.llm.hilbert import shard_report
from sheerlight.llm.labelled import fold, sample
from sheerlight.llm.mixing import take_mix
from sheerlight.llm.ngram_join import drop_near_duplicates
from sheerlight.llm.queries import weighed
from sheerlight.llm.toxicity import SAMPLE, drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't reject; it learns from labels of rows outside the held-out fold.

    Null and empty texts are scored like a text without words and stay.  Equal texts have equal scores, so repeated rows stay or go
    together.  Without labels of both kinds nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(sample(docs, labels, "toxic", fold("doc_id", 4) != 2, SAMPLE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the n-gram Jaccard join tie together.

    The row of the least id and text hash stays, null ids last; repeated rows are one.  Rows without words stay, one of each id and text.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, whatever its parameters.

    Null and empty texts stay; repeated rows stay or go together.  An empty benchmark rejects nothing.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, better ones (by the quality classifier) more likely in the last, partial epoch.

    Null and empty texts have no words, so no mix takes them.  A null source is a source of its own, the last.  Of rows that are equal in id,
    text and source, the first so many are taken.
    """
    return take_mix(weighed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), weight="__quality")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of every document, in Hilbert-curve order of its metadata.

    Null metadata come first in each dimension, null ids first in each cell; rows that agree in all that is reported are interchangeable.
    """
    return shard_report(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: A trained network and iterated components have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder, and removed once it has been read.

    The rows returned are worked out from the last folder, which therefore stays, as the checkpoint folder's own files do.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
