"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: what decides which labels may be learned from."""
    return F.pmod(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, bounds: dict[int, int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``text``, ``label`` and ``weight`` of at most ``bounds[y]`` rows of each label y for which ``use`` (over the key) holds.

    The rows with the least hashes of their key are taken, so the choice does not depend on order; the chosen keys are as
    many as the bounds at most and so are broadcast.  A key of several rows in ``docs`` gives the one of the least text hash, so
    the bounds hold for rows.  ``weight`` tells how many usable labels each sampled one stands for.  Null keys and labels
    are left out; without labels, or for an empty table, there are no rows.
    """
    usable = labels.filter(use & labels[key].isNotNull()).select(labels[key].alias("_key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(list(bounds))).distinct()
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    chosen = None
    for y, n in bounds.items():
        weight = F.lit(float(max(1.0, counts.get(y, 0) / n)))
        part = usable.filter(F.col("label") == y).orderBy(F.xxhash64("_key"), "_key").limit(n).withColumn("weight", weight)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("text")).join(F.broadcast(chosen), "_key")
    one = found.groupBy("_key", "label", "weight").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one"))
    return one.select("one.text", "label", "weight")
