"""Sharding by Hilbert-curve order, with DataFrame functions only.

Metadata (size, source, language) is quantised to ``BITS`` bits a dimension by quantiles over all rows, so that each
bin holds about as many rows as it can: a number by the quantiles themselves, a text by the share of rows that come before the middle
of its value in code point order, whatever values have in common at their beginning.  Rows
are sorted by the curve index of their cell, then by doc_id, and the sorted run is cut into shards of row counts at
most one apart (law ``rows``).  Cells next to each other on the curve differ by one step in one dimension, so each
shard, and each file of ``write_shards``, spans narrow ranges in all dimensions and readers can skip files on any.

Positions come from a range-partitioned sort of narrow rows; no text is shuffled, and a source or a cell with a third
of all rows is spread over the ranges by doc_id.

A null text has size 1 and the crc32 of no bytes; null metadata goes to bin 0; null ids come first.  Texts are only measured, so
their length doesn't matter.  Rows equal in all of these, as repeated rows are, are interchangeable.  An empty table gives no rows.
Columns that are no dimensions are ignored by ``assign_shards`` and kept by ``write_shards``; their names must not begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, running, text_of

BITS = 4
SHARDS = 16
DIMENSIONS = ("size", "source", "lang")
#: Distinct values of a text column whose bins are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def curve(bits: int, dims: int) -> list[int]:
    """The Hilbert index of every cell; the cell's coordinates are the digits of the place, first dimension highest."""
    out = []
    for place in range(1 << (bits * dims)):
        x = [(place >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)]
        # Gray-code the coordinates' bit planes from the top, undoing each plane's reflection and exchange.
        bit = 1 << (bits - 1)
        while bit > 1:
            low = bit - 1
            for i in range(dims):
                if x[i] & bit:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
            bit >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        flip, bit = 0, 1 << (bits - 1)
        while bit > 1:
            if x[dims - 1] & bit:
                flip ^= bit - 1
            bit >>= 1
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | ((v ^ flip) >> b) & 1
        out.append(index)
    return out


def _text_bins(df: DataFrame, name: str, bits: int, bin_name: str) -> tuple[DataFrame, bool]:
    """Each distinct value of a text column and its bin, from counts summed up before the shuffle; and whether they are few enough to broadcast.

    A few values are summed up in one window, any number of them over ranges.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    few = counts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if few:
        w = Window.orderBy("_value")
        placed = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    else:
        placed = running(counts, [F.col("_value")], {"_before": "_n"}).persist()
        placed = placed.withColumn("_all", F.lit(placed.agg(F.sum("_n")).first()[0] or 1))
    return placed.select("_value", F.floor((F.col("_before") + F.col("_n") / 2) * (1 << bits) / F.col("_all")).cast("int").alias(bin_name)), few


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """Adds ``name``, the curve index of each row's cell."""
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(f"b{i}") for i, d in enumerate(numbers)]).first() if numbers else None
    columns = df.columns
    cell: Column = F.lit(0)
    for i, d in enumerate(dims):
        if d in numbers:
            at = sum((F.when(F.col(d).cast("double") > F.lit(float(x)), 1).otherwise(0) for x in (bounds[f"b{numbers.index(d)}"] or [])), F.lit(0))
        else:
            told, few = _text_bins(df, d, bits, f"__bin{i}")
            told = told.withColumnRenamed("_value", f"__value{i}")
            df = df.join(F.broadcast(told) if few else told.hint("merge"), F.col(d).cast("string") == F.col(f"__value{i}"), "left")
            at = F.coalesce(F.col(f"__bin{i}"), F.lit(0))
        cell = cell * (1 << bits) + at
    table = long_array(curve(bits, len(dims)))
    return df.select(*columns, F.element_at(table, cell + 1).cast("int").alias(name))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, hilbert, shard and slot of each row; dims name columns of ``docs``, or its ``size``."""
    whole = text_of(docs[text])
    extra = [d for d in dims if d != "size"]
    rows = docs.select(docs[key].alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), *[docs[d].alias(f"dim_{d}") for d in extra])
    rows = with_curve(rows, ["size" if d == "size" else f"dim_{d}" for d in dims], bits).select("key", "size", "text_crc32", "hilbert")
    placed = running(rows, [F.col("hilbert"), F.col("key").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    n = placed.count()
    # Shard k takes the places from ceil(k n / shards) on.
    shard = F.floor((F.col("_pos") * n_shards) / F.lit(max(n, 1))).cast("int")
    first = F.ceil(F.col("shard") * F.lit(n) / F.lit(n_shards)).cast("long")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_pos") - first).select(F.col("key").alias(key), "size", "text_crc32", "hilbert", "shard", "slot")


def shard_report(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``assign_shards`` with its law; ``grown_shard`` is null, as one more shard moves rows under this law."""
    return assign_shards(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS, text: str = "text", key: str = "doc_id") -> None:
    """Write ``docs`` as files in curve order, ready for skipping by minima and maxima: one range of cells a file."""
    whole = text_of(docs[text])
    sized = docs.withColumn("__size", (F.octet_length(whole) + 1).cast("long"))
    named = ["__size" if d == "size" else d for d in dims]
    placed = with_curve(sized, named, bits, "__hilbert")
    placed.repartitionByRange(n_shards, "__hilbert", F.col(key)).sortWithinPartitions("__hilbert", key).drop("__hilbert", "__size").write.parquet(path)
