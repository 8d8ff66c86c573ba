"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, with DataFrame functions only.

A paragraph is a line.  It is cut into leaves of at most ``LEAF_WORDS`` words with the white space after them (a word
longer than ``WORD_CHARS`` counts as several), so the leaves of a text join to the text itself.  A leaf ends early after a word whose
last character is one of ``LEAF_ENDS``, and a section ends before each paragraph whose digest begins with 0 or 1: borders depend
on content, and an edit, an inserted word too, moves only those next to it.  Digests are SHA-256: of a leaf its text, of a paragraph its leaves' digests, of a section its paragraphs'
digests, of the root its sections' digests.  Equal roots mean equal texts.

The fingerprint is one string::

    <root, 64 hex>|<section, 16 hex>(<paragraph, 16 hex>:<leaf, 16 hex><leaf>...(<paragraph>:...)|<section>...

that is, the tree with all nodes below the root shortened to 64 bits.  Comparing two of them from the root down finds the branches
that differ (``locate_edits``); the likeness of two is 1 if their roots are equal and else twice the number of
leaves that both have over the number of leaves of both (each distinct leaf of a text counted once).

Null and empty texts are equal: one empty paragraph without leaves.  Likeness to an empty text is 0, unless both are.  Texts of any length are
fingerprinted in whole.  Repeated rows and other rows of one id follow each other in the order of their texts' hashes; null ids come
last.  A single row is its own next one.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, shuffle_parts, text_of

LEAF_WORDS = 8
WORD_CHARS = 64
LEAF_ENDS = "dhlptx048"
_GAP = r"[\x20\x09-\x0D]"
_WORD = rf"[^\x20\x09-\x0D]{{1,{WORD_CHARS}}}+"
_INNER = rf"(?:{_WORD}(?<![{LEAF_ENDS}]){_GAP}*+)"
#: A leaf: words that end none and one more, or what is left of the line; or spaces alone.
LEAF = rf"{_GAP}*+{_INNER}{{0,{LEAF_WORDS - 1}}}+{_WORD}{_GAP}*+|{_GAP}*+{_INNER}++|{_GAP}++"
#: Hexadecimal digits of a node below the root.
NODE = 16
#: Ranges of ids for each shuffle partition when neighbours are brought together.
BLOCKS = 256


def _paragraph(line: Column) -> Column:
    """``<paragraph digest, 64 hex>:<leaf, 16 hex>...`` of a line."""
    leaves = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    # The digests are used twice; a lambda's parameter makes them once.
    joined = lambda d: F.concat(F.sha2(F.array_join(d, ""), 256), F.lit(":"), F.array_join(F.transform(d, lambda h: F.substring(h, 1, NODE)), ""))
    return F.element_at(F.transform(F.array(leaves), joined), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; see the module."""
    lines = F.split(text, "\n", -1)
    whole = F.array_join(F.transform(lines, _paragraph), "\n")
    sections = F.split(whole, r"\n(?=[01])")

    def section(s: Column) -> Column:
        paragraphs = F.split(s, "\n")
        digest = F.sha2(F.array_join(F.transform(paragraphs, lambda p: F.substring(p, 1, 64)), ""), 256)
        short = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.substring(p, 1, NODE), F.substr(p, F.lit(65)))), "(")
        return F.concat(digest, F.lit("("), short)

    nodes = F.transform(sections, section)
    put = lambda ns: F.concat(F.sha2(F.array_join(F.transform(ns, lambda s: F.substring(s, 1, 64)), ""), 256), F.lit("|"), F.array_join(F.transform(ns, lambda s: F.concat(F.substring(s, 1, NODE), F.substr(s, F.lit(65)))), "|"))
    return F.element_at(F.transform(F.array(nodes), put), 1)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def leaves(fp: Column) -> Column:
    """The distinct shortened leaves of a fingerprint."""
    runs = F.array_join(F.regexp_extract_all(fp, F.lit(r":([0-9a-f]++)"), F.lit(1)), "")
    return F.array_distinct(F.regexp_extract_all(runs, F.lit(f"[0-9a-f]{{{NODE}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; 1 for equal roots."""
    share = lambda p: F.when(F.size(p[0]) + F.size(p[1]) > 0, 2.0 * F.size(F.array_intersect(p[0], p[1])) / (F.size(p[0]) + F.size(p[1]))).otherwise(0.0)
    return F.when(root(a) == root(b), 1.0).otherwise(F.element_at(F.transform(F.array(F.array(leaves(a), leaves(b))), share), 1)).cast("double")


def locate_edits(a: Column, b: Column) -> Column:
    """The paragraphs of ``a`` (from 0) whose branch differs from ``b``: none if the roots agree, none in sections that
    ``b`` has too, and in the others those whose paragraph node ``b`` lacks."""
    parts = lambda f: F.split(F.substr(f, F.lit(66)), r"\|")
    para = lambda s: F.transform(F.split(F.substr(s, F.lit(NODE + 2)), r"\("), lambda p: F.substring(p, 1, NODE))
    theirs = F.transform(parts(b), lambda s: F.substring(s, 1, NODE))
    their_paragraphs = F.flatten(F.transform(parts(b), para))
    told = F.flatten(F.transform(parts(a), lambda s: F.transform(para(s), lambda p: ~F.array_contains(theirs, F.substring(s, 1, NODE)) & ~F.array_contains(their_paragraphs, p))))
    places = F.filter(F.transform(told, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(places)


def with_next(docs: DataFrame, key: str, columns: list[str], blocks: int = BLOCKS, more: dict[str, Column] | None = None) -> DataFrame:
    """Each row of ``docs`` with the ``columns`` of the next row in descending ``key`` (after the last: the first) as ``next_<name>``.

    ``more`` columns are worked out after the shuffle, which they would make larger, and join ``columns``.

    Keys are cut into ranges at quantiles; each range is one window group, so texts are shuffled once.  A range also
    gets a copy of the first row of the range after it.  The first rows are found by one narrow aggregate whose result has
    a row for each range.  Rows with one key are ordered by their columns; null keys come last.
    """
    parts = shuffle_parts(docs.sparkSession)
    n = max(blocks, 2 * parts)
    bounds = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    k = F.col(key)
    # Descending: block 0 has the largest keys, the last one the nulls.
    table = long_array(bounds)
    steps = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[steps - 1 :: steps]
    # Two steps of about the square root of n comparisons.
    if bounds:
        high = F.size(F.filter(long_array(coarse), lambda b: b < k)) * steps if coarse else F.lit(0)
        fine = lambda h: h + F.size(F.filter(F.slice(table, h + 1, steps), lambda b: b < k))
        at = F.element_at(F.transform(F.array(high), fine), 1)
    else:
        at = F.lit(0)
    block = F.when(k.isNull(), len(bounds) + 1).otherwise(len(bounds) - at).cast("int")
    tie = F.xxhash64(F.col(columns[0]))
    rows = docs.withColumn("_block", block).withColumn("_tie", tie)
    firsts = {r["_block"]: r["m"] for r in rows.groupBy("_block").agg(F.max(F.struct(k.alias("k"), F.col("_tie").alias("t"))).alias("m")).collect()}  # a row for each range
    present = sorted(firsts)
    before = {b: present[i - 1] for i, b in enumerate(present)}  # the last range goes on with the first one
    heads = long_array([firsts[b]["t"] if b in firsts else None for b in range(len(bounds) + 2)])
    goes_to = long_array([before.get(b, -1) for b in range(len(bounds) + 2)])
    top = long_array([firsts[b]["k"] if b in firsts else None for b in range(len(bounds) + 2)])
    is_first = (F.element_at(heads, F.col("_block") + 1) == F.col("_tie")) & F.element_at(top, F.col("_block") + 1).eqNullSafe(k)
    copies = F.when(is_first, F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("ghost")), F.struct(F.element_at(goes_to, F.col("_block") + 1).cast("int").alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("_copy", F.explode(copies)).withColumn("_block", F.col("_copy.b")).withColumn("_ghost", F.col("_copy.ghost")).drop("_copy")
    w = Window.partitionBy("_block").orderBy("_ghost", k.desc_nulls_last(), F.col("_tie").desc())
    dealt = dealt.repartition(parts, "_block").withColumns(more or {})
    out = dealt.select(*docs.columns, *(more or {}), "_ghost", *[F.lead(c).over(w).alias(f"next_{c}") for c in [*columns, *(more or {})]])
    return out.filter("_ghost = 0").drop("_ghost")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ``n_chars`` and ``fingerprint`` of each row."""
    whole = text_of(docs[text])
    return docs.select(docs[key].alias(key), F.length(whole).cast("long").alias("n_chars"), fingerprint(whole).alias("fingerprint"))


def edit_probe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last third of its code points (rounded down) replaced by the first as many, or all, of the next
    document in descending key, after the last the first.
    """
    whole = docs.select(docs[key].cast("long").alias("key"), text_of(docs[text]).alias("text"))
    fed = with_next(whole, "key", ["text"], more={"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - third), F.substr(F.col("next_text"), F.lit(1), third))
    made = fed.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return made.select(
        F.col("key").alias(key),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
