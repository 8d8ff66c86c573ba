"""From the findings of a page to its report: duplicates merged, ranked, capped, summarised, marked and folded.

``items`` has a row for each finding: ``page_id``, ``seq`` (a struct that orders a page's findings), ``element`` (null without one), the
finding's fields, ``reasons``, ``likely_a11y``, ``in_comment``, ``attr_name`` and ``context``.  Everything is partitioned by page, so one exchange
serves all steps, and a list never outgrows its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def severity_rank(severity: Column) -> Column:
    """0 for the worst; null for none."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2)


def group_key(item: dict[str, Column] | None = None) -> Column:
    """What folds findings: the type, with the attribute it stood in, and what was found."""
    c = lambda n: item[n] if item else F.col(n)
    signal = F.when(c("attr_name").isNotNull(), F.concat(c("type"), F.lit(":"), c("attr_name"))).otherwise(c("type"))
    mark = (
        F.when(c("type").isin("instruction-phrase", "control-token"), c("pattern"))
        .when(c("type").isin("invisible", "unicode-tag"), c("hex"))
        .when(c("type") == "css-hidden", F.array_join(c("reasons"), ","))
        .otherwise(F.coalesce(c("decoded"), F.lit("")))
    )
    return F.concat(signal, F.lit(":"), mark)


def with_targets(items: DataFrame, key: str = "page_id") -> DataFrame:
    """``target_id``: elements are numbered in the order in which their first finding comes."""
    first = items.filter(F.col("element").isNotNull()).groupBy(key, "element").agg(F.min("seq").alias("_first"))
    numbered = first.withColumn("target_id", F.concat(F.lit("pi-"), F.row_number().over(Window.partitionBy(key).orderBy("_first")).cast("string"))).drop("_first")
    return items.join(numbered, [key, "element"], "left")


def dedup(items: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each kind of finding in one context: the first one's fields, ``match_count`` (null for one), ``target_ids`` in order."""
    kept = [c for c in items.columns if c != key]
    named = items.withColumn("group_key", group_key())
    named = named.withColumn("_full", F.concat("group_key", F.lit(":"), F.col("context")))
    grouped = named.groupBy(key, "_full").agg(
        F.min_by(F.struct(*kept, "group_key"), "seq").alias("f"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("target_id").isNotNull(), F.struct("seq", "target_id")))).alias("ids"),
    )
    return grouped.select(key, "f.*", F.when(F.col("n") > 1, F.col("n")).alias("match_count"), F.transform("ids", lambda x: x["target_id"]).alias("target_ids"))


def ranked(items: DataFrame, cap: int = V.PAGE_CAP, key: str = "page_id") -> DataFrame:
    """``rank`` by severity, then by order of appearance; the first ``cap`` of each page."""
    w = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), "seq")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def summary(pages: DataFrame, capped: DataFrame, key: str = "page_id") -> DataFrame:
    """``count``, ``worst`` and the number of each severity over what the cap left; pages without findings have 0 and null."""
    n = lambda level: F.count_if(F.col("severity") == level)
    counts = capped.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min(severity_rank(F.col("severity"))).alias("w"), *[n(x).alias(x) for x in V.SEVERITIES])
    joined = pages.select(key, "url").join(counts, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    worst = F.get(F.array(*[F.lit(x) for x in V.SEVERITIES]), F.col("w"))
    return joined.select(key, "url", zero("count"), worst.alias("worst"), *[zero(x) for x in V.SEVERITIES])


def markers(capped: DataFrame, key: str = "page_id") -> DataFrame:
    """For each marked element: its worst severity and the ranks of its findings, in order."""
    each = capped.select(key, "rank", "severity", F.explode("target_ids").alias("target_id"))
    grouped = each.groupBy(key, "target_id").agg(F.min(severity_rank(F.col("severity"))).alias("w"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    level = F.get(F.array(*[F.lit(x) for x in V.SEVERITIES]), F.col("w"))
    return grouped.select(key, "target_id", level.alias("severity"), colour(level).alias("colour"), "ranks")


def element_marks(items: DataFrame, key: str = "page_id") -> DataFrame:
    """For each element with a finding: the severity it is marked with while its page is walked, before anything is merged or capped.

    A text marks its element with its worst finding, whatever the mark was; a hiding style marks it with its own severity unless the mark is
    worse; an attribute overwrites the mark again.  Passes come in that order, and within one the last wins.
    """
    each = with_targets(items, key).filter(F.col("target_id").isNotNull())
    nodes = each.groupBy(key, "target_id", "seq.pass", "seq.ord").agg(F.min(severity_rank(F.col("severity"))).alias("w"))
    last = lambda k: F.max_by(F.when(F.col("pass") == k, F.col("w")), F.when(F.col("pass") == k, F.col("ord")))
    found = nodes.groupBy(key, "target_id").agg(last(1).alias("t"), F.min(F.when(F.col("pass") == 2, F.col("w"))).alias("c"), last(3).alias("a"))
    level = F.get(F.array(*[F.lit(x) for x in V.SEVERITIES]), F.coalesce("a", F.least("t", "c")))
    return found.select(key, "target_id", level.alias("mark"), colour(level).alias("colour"))


def lookup(items: DataFrame, ids: DataFrame, key: str = "page_id") -> DataFrame:
    """For each (key, ``target_id``) of ``ids``: the path of roots that leads to the element, the element, and where its first finding stands.

    An id that the page doesn't have, as one of a page that was scanned again, gives nulls.
    """
    first = with_targets(items, key).filter(F.col("target_id").isNotNull()).groupBy(key, "target_id").agg(F.min_by(F.struct("seq.path", "element", "context"), "seq").alias("f"))
    return ids.join(first, [key, "target_id"], "left").select(key, "target_id", "f.*")


def colour(severity: Column) -> Column:
    return F.when(severity == "high", V.COLOURS["high"]).when(severity == "medium", V.COLOURS["medium"]).otherwise(V.COLOURS["low"])


def fold(capped: DataFrame, least: int = V.FOLD_LEAST, key: str = "page_id") -> DataFrame:
    """The rows of a report: items of one group are one row, at the first one's place, if they are ``least`` or more."""
    sized = capped.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "group_key")))
    row = F.when(F.col("_n") >= least, F.concat(F.lit("g:"), "group_key")).otherwise(F.concat(F.lit("i:"), F.col("rank").cast("string")))
    kept = [c for c in capped.columns if c not in (key, "target_ids", "match_count")]
    part = F.struct("rank", "target_ids", "context")
    grouped = sized.groupBy(key, row.alias("_row")).agg(
        F.min_by(F.struct(*kept), "rank").alias("f"), F.sum(F.coalesce(F.col("match_count"), F.lit(1))).alias("shown_count"), F.max("_n").alias("members"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    ids = F.flatten(F.transform("parts", lambda p: p["target_ids"]))
    contexts = F.flatten(F.transform("parts", lambda p: F.transform(p["target_ids"], lambda _: p["context"])))
    return grouped.select(key, "f.*", "shown_count", (F.col("members") >= least).alias("folded"), ids.alias("target_ids"), contexts.alias("contexts"))


def occurrence(rows: DataFrame, click: int) -> DataFrame:
    """The target and the context that the given click on each row leads to, and its place as ``i of n``; rows cycle."""
    n = F.size("target_ids")
    at = F.when(n > 0, F.pmod(F.lit(click), n))
    return rows.withColumns({"target_id": F.get("target_ids", at), "context": F.coalesce(F.get("contexts", at), F.col("context")), "position": F.when(n > 1, F.concat((at + 1).cast("string"), F.lit(" of "), n.cast("string")))})
