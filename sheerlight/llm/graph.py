"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release


#: Pairs of one round of further tests, for each of the first ones, and the least: what is shuffled for a round is room on disk.
ROUND = 0.5
LEAST_ROUND = 500_000


def _settled(es: DataFrame) -> bool:
    """Whether each node is tied to one other at most, which itself is tied to none."""
    ties = es.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
    if ties.filter("c > 1").limit(1).count():
        return False
    return not es.join(es.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn: every node's larger neighbours, then its smaller ones, are tied to the least
    node among them, until the edges are stars.  Each round is written to the checkpoint folder.  Minima are summed up
    before the shuffle and joined back by sort-merge joins, which Spark splits where one node has most of the edges.
    Plans of past rounds are given back as rounds go on, as they are most of what fills the driver's heap.
    """
    spark = edges.sparkSession
    es = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n = es.count()
    for _ in range(rounds):
        if _settled(es):
            break
        both = es.union(es.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: the larger neighbours of u go to its least neighbour.
        big = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.filter("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        es = cut(small.filter("u <> v").distinct(), n)
        n = es.count()
        del both, least, big, low, small
        release(spark)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = es.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def _tops(pairs: DataFrame, first_pairs: int) -> DataFrame:
    """For each a, the b's met most often."""
    often = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    best = often.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, first_pairs).alias("top"))  # as many as the lists of one node at most
    return best.select("a", F.explode("top.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_components(entries: DataFrame, may: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame], first_pairs: int = 3, told: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Components of the graph whose links are those pairs of one list that ``may`` link and that ``verified`` keeps.

    ``entries``: key (of the list), node, ``info`` (what ``may`` and ``told`` look at) and ``last`` (nodes of lower values
    are preferred to tie a list).  First each list ties its nodes to one of them, chosen by hash, and the pairs met most
    often are verified; then all pairs of a list whose nodes are not in one component yet, but for those that ``told``
    says an earlier list has.  No link between two components is left out, and within a group of thousands of copies
    only a few pairs a member are made.
    """
    spark = entries.sparkSession
    pick = F.min(F.struct("last", F.xxhash64("node", "key").alias("h"), F.col("node").alias("pivot"), F.col("info").alias("about")))
    pivots = entries.groupBy("key").agg(pick.alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "p.pivot", "p.about")
    tied = entries.join(pivots.hint("merge"), "key").filter((F.col("node") != F.col("pivot")) & may(F.col("info"), F.col("about")))
    edges = verified(_tops(tied.select(F.col("node").alias("a"), F.col("pivot").alias("b")), first_pairs))
    known = connected_components(edges)
    del pivots, tied, edges
    release(spark)
    placed = entries.join(known.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    rest = placed.join(open_keys.hint("merge"), "key").select("key", "node", "info", "comp")
    x, y = rest.alias("x"), rest.alias("y").hint("merge")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & may(F.col("x.info"), F.col("y.info"))
    if told is not None:
        meet &= ~F.coalesce(told(F.col("x.info"), F.col("y.info")), F.lit(False))
    pairs = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = verified(pairs)
    del placed, open_keys, rest, x, y, pairs
    return _grown(known, links)


def paired_components(tied: DataFrame, few: DataFrame, many: DataFrame, may: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame], first_pairs: int = 3) -> DataFrame:
    """``candidate_components`` where the pairs are made beforehand, but for those of long lists; no pair is verified twice, and many are in rounds.

    ``tied``: a, b of each list's nodes and the one that ties it; ``few``: all pairs of short lists; ``many``: the entries (key, node, ``info``) of long ones.
    """
    spark = tied.sparkSession
    tested = cut(_tops(tied, first_pairs))
    known = connected_components(verified(tested))
    release(spark)
    root = lambda name: known.select(F.col("node").alias(name), F.col("root").alias(f"r{name}")).hint("merge")
    open_pairs = few.distinct().join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    placed = many.join(known.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    rest = placed.join(open_keys.hint("merge"), "key").select("key", "node", "info", "comp")
    x, y = rest.alias("x"), rest.alias("y").hint("merge")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & may(F.col("x.info"), F.col("y.info"))
    met = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    left = cut(open_pairs.union(met).distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"))
    rounds = max(1, math.ceil(left.count() / max(ROUND * tested.count(), LEAST_ROUND)))
    del tested, open_pairs, placed, open_keys, rest, x, y, met
    release(spark)
    links = None
    for k in range(rounds):
        more = verified(left if rounds == 1 else left.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k))
        links = more if links is None else links.union(more)
    return _grown(known, links)


def _grown(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``known`` as further links (a, b) join them."""
    # New links tie components, so only their roots need another search.
    of = lambda name: known.select(F.col("node").alias(name), F.col("root").alias(f"r{name}")).hint("merge")
    tied = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = connected_components(tied).select(F.col("node").alias("mid"), F.col("root").alias("top"))
    release(known.sparkSession)
    first = known.select("node", F.col("root").alias("mid")).union(over.select(F.col("mid").alias("node"), "mid")).distinct()
    return first.join(over.hint("merge"), "mid", "left").select("node", F.coalesce("top", "mid").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
