"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's size is the number of words of its documents.  Sources in code point order, null last, weigh 5, 2, 1,
repeating, and share ``share`` times all words by weight; no target exceeds ``most`` times its source's size, and
what is above is shared out again by weight until none is above.  A target is met by whole epochs first
(``floor(target / source_size)`` copies of every document), and then by a fraction: documents sorted by an
exponential key ``-ln(u) / weight`` (u from a hash of the row, so reruns agree; the weight is a column, as the scores of a quality
classifier in steps of ``STEP``, and 1 where there is none or it is null; smaller keys come first, so better documents are likelier, which is weighted sampling without replacement) are taken while the running sum
of their words stays within the rest; the document that crosses the rest is taken if that comes nearer.

No source is gathered in one task: rows are dealt by range over (source, key), and running sums come from one total
for each range, so a source with most of the rows is spread like any other.

Null and empty texts have size 0 and take 0 words.  Very long texts are counted in whole.  Ties of the key are told apart by the row's hash, then its
id; of rows that are equal in these, as repeated rows are, the first so many are taken as fit.  A source whose size is 0 has target 0.  An
empty table gives no rows.  Other columns are kept by ``take_mix``; their names must not begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, running, text_of

SHARE = 1.5
MOST = 2.0
WEIGHTS = (5, 2, 1)
SEED = 20
#: Weights are rounded to so much, and never less.
STEP = 0.01
#: Rows of the table of sources that are broadcast at most; a longer table is joined by a shuffle.
MOST_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    parts = F.split(text, SPACES)
    empty = lambda at: F.when(F.element_at(parts, at) == "", 1).otherwise(0)  # noqa: E731  split leaves one at each end
    return (F.size(parts) - empty(1) - F.when(F.size(parts) > 1, empty(-1)).otherwise(0)).cast("long")


def _few_targets(sizes: DataFrame, found: list[tuple[str | None, int]], share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [float(weights[k % len(weights)]) for k in range(len(found))]
    cap = [n * most for _, n in found]
    total, level = sum(n for _, n in found), 0.0
    while True:
        above = [c <= level * w for c, w in zip(cap, weight, strict=True)]
        free = sum(w for w, a in zip(weight, above, strict=True) if not a)
        risen = (total * share - sum(c for c, a in zip(cap, above, strict=True) if a)) / free if free else level
        if risen <= level:
            break
        level = risen
    rows, start = [], 0
    for k, (name, n) in enumerate(found):
        rows.append((name, n, start, k, weight[k], min(cap[k], level * weight[k])))
        start += n
    return sizes.sparkSession.createDataFrame(rows, "source string, source_size long, source_start long, source_rank long, weight double, target double")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``, ``source_rank`` and ``source_start`` (words of sources before it).

    The level at which the uncapped sources stand rises with each round that caps further ones.  A few sources are shared out on the driver; with
    more, each round is one aggregate over the table of sources, and only its two sums come to the driver.
    """
    found = sizes.limit(MOST_BROADCAST + 1).collect()
    if len(found) <= MOST_BROADCAST:
        return _few_targets(sizes, [(r["source"], r["source_size"]) for r in found], share, most, weights)
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"source_start": "source_size"})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumnRenamed("_pos", "source_rank").persist()
    cap = F.col("source_size") * F.lit(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(above, 1).otherwise(0)).alias("n")).first()
        if not row["free"]:
            break
        risen = (total * share - row["capped"]) / row["free"]
        if risen <= level:
            break
        level = risen
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _order(key: Column, text: Column, weight: Column | None, seed: int) -> tuple[Column, Column]:
    """A row's hash, and its exponential key."""
    hashed = F.xxhash64(key.cast("string"), text, F.lit(seed))
    u = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    w = F.lit(1.0) if weight is None else F.coalesce(F.greatest(F.lit(STEP), F.round(weight.cast("double") / STEP) * STEP), F.lit(1.0))
    return hashed, -F.log(u) / w


def plan_mix(docs: DataFrame, share: float, most: float, weights: tuple[int, ...], seed: int, text: str, key: str, source: str, weight: str | None) -> DataFrame:
    """key, source, size, order, tie, source_size, target, epochs and fraction (0 or 1) of each row."""
    whole = text_of(docs[text])
    hashed, order = _order(docs[key], whole, None if weight is None else docs[weight], seed)
    rows = cut(docs.select(docs[key].alias("key"), docs[source].cast("string").alias("source"), word_count(whole).alias("size"), order.alias("order"), hashed.alias("tie")))
    level = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    placed = running(rows, [F.col("source").asc_nulls_last(), F.col("order"), F.col("tie"), F.col("key").asc_nulls_last()], {"before": "size"})
    level = level.select(F.col("source").alias("s"), "source_size", "target", "source_start").persist()
    few = level.count() <= MOST_BROADCAST
    held = placed.join(F.broadcast(level) if few else level.hint("merge"), placed["source"].eqNullSafe(level["s"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    inside = F.col("before") - F.col("source_start")
    # The whole document counts if its middle lies within the rest: it fits, or crosses the rest by less than half.
    fraction = F.when((F.col("size") > 0) & (inside + F.col("size") / 2.0 <= rest), 1).otherwise(0)
    return held.withColumn("epochs", epochs).withColumn("fraction", fraction).select("key", "source", "size", "order", "tie", "source_size", "target", "epochs", "fraction")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source", weight: str | None = None) -> DataFrame:
    """For each row: key, size, source, source_size, target, taken (words), copies (times the mix takes it)."""
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("fraction")).otherwise(0)
    plan = plan_mix(docs, share, most, weights, seed, text, key, source, weight)
    return plan.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source", weight: str | None = None) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``copies`` says, with all its columns but ``weight``.

    Within a source the fraction is a run of the order, so a row is in it if it comes no later than the run's last.  That place
    is one row for each source; texts are not shuffled unless there are more sources than fit a checked broadcast.  Only where the run ends
    among equal rows are those counted, by all their columns, and so many taken.
    """
    chosen = cut(plan_mix(docs, share, most, weights, seed, text, key, source, weight))
    place = F.struct("order", "tie")
    last = chosen.groupBy("source").agg(F.max("epochs").alias("__epochs"), F.max(F.when(F.col("fraction") == 1, place)).alias("__last")).withColumnRenamed("source", "__source")
    at_last = chosen.groupBy("source", place.alias("place")).agg(F.count(F.lit(1)).alias("__equal"), F.sum("fraction").alias("__taken")).withColumnRenamed("source", "__s")
    last = last.join(at_last, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__last") == F.col("place")), "left").drop("__s", "place").persist()
    few = last.count() <= MOST_BROADCAST
    kept = [c for c in docs.columns if c != weight]
    hashed, order = _order(docs[key], text_of(docs[text]), None if weight is None else docs[weight], seed)
    placed = docs.withColumn("__place", F.struct(order.alias("order"), hashed.alias("tie"))).join(F.broadcast(last) if few else last.hint("merge"), docs[source].cast("string").eqNullSafe(F.col("__source")))
    within = F.col("__last").isNotNull() & (F.col("__place") <= F.col("__last"))
    partial = F.coalesce((F.col("__taken") < F.col("__equal")) & (F.col("__place") == F.col("__last")), F.lit(False))
    copies = F.when(word_count(text_of(F.col(text))) > 0, F.col("__epochs") + F.when(within & ~partial, 1).otherwise(0)).otherwise(0).cast("int")
    out = placed.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*kept)
    if last.filter("__taken < __equal").limit(1).count():
        equal = placed.filter(partial).groupBy(*kept, "__source", "__taken").agg(F.count(F.lit(1)).alias("__n"))
        numbered = running(equal, [F.col("__source").asc_nulls_last(), *[F.col(c) for c in kept]], {"__before": "__n"})
        first = numbered.groupBy(F.col("__source").alias("__s")).agg(F.min("__before").alias("__first"))
        told = numbered.join(first, F.col("__source").eqNullSafe(F.col("__s")))
        take = F.least(F.col("__n"), F.col("__taken") - (F.col("__before") - F.col("__first"))).cast("int")
        out = out.union(told.withColumn("__take", take).filter("__take > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__take")))).select(*kept))
    return out
