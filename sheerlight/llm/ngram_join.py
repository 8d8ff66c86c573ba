"""Size-aware heavy-light Jaccard self-join on word shingles, with its connected components.

Words are runs of other bytes than the space and the controls from tab to carriage return, A-Z lower-cased; a
document's set holds its distinct shingles of ``SHINGLE`` words (with fewer words, the whole sequence).  Two documents
link when 100 * intersection >= PERCENT * union.  No link between different sets is lost:

1. Equal sets are one set, named by a 64-bit digest.  Every shingle goes, packed by bucket, to the bucket of its hash, where its
   document frequency is counted; only shingles of two sets or more come back.  A shingle that a task meets in ``HOT`` sets of
   one pack is known to be frequent there already: its bucket gets one mark instead of its sets, and the sets keep it
   without asking.  A mark makes a shingle count as frequent for all sets.  A set stays a candidate if enough of its
   shingles came back, as any partner shares that many.
2. Shingles are ordered by frequency (rarest first), then by hash.  Two linked sets share at least ``required(n)`` shingles,
   so they share one among the first ``n - required + 1`` of each and two among the first ``n - required + 2``.
3. Small (light) sets put forward each pair of their first ``... + 2`` shingles as a fixed-size subset; large (heavy) sets are
   found by scanning the inverted lists of their first ``... + 1`` shingles, which light sets that could have a heavy
   partner probe too.  The size that parts light from heavy has the least sum of subsets and list scans, from the candidates' own
   sizes and frequencies.
4. First, each list ties its sets to one of them, which makes as many pairs as list entries; the pairs met most often
   are verified against the whole sets and joined to components.  Then every pair of one list that is not in one
   component yet is verified, unless the place in the order, the sizes or the parity bits of both sets prove that it
   cannot link.  A group of thousands of copies thus costs few tests a member, and what could still join two
   components is tested in full.

Sets are verified by their shared shingles: a shingle of only one set is in no intersection.  A shingle is known by 56 bits of its
hash, so a pair of sets of a thousand shingles is misjudged with a chance of about one in 10^11.

Null and empty texts, and those without words, have size 0 and link with nothing; their component is their own id.
Repeated rows are equal sets; ties of frequency are broken by hash.  Very long texts are read in whole, one at a time if need be.  An empty table
gives no rows.  Other columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``; there their names must not begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, release, shuffle_parts, small_batches, text_chunks, tidy
from .graph import candidate_components

SHINGLE = 5
PERCENT = 75
#: Shingles a task packs before it hands them on.
PACK_TOKENS = 1 << 20
#: Sets of one pack that make a shingle hot.
HOT = 48
_MOST = np.uint64(127)
#: Sets of more shingles than this are heavy whatever the costs.
LIGHT_MOST = 64
#: Pairs of each set that are verified first.
FIRST_PAIRS = 3
#: Longs of parity bits of a set.
PARITY_WORDS = 4
_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_TOKEN = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text as (text, hash), sorted, the number for each text, and a digest of each set."""
    words = Words(data, offsets)
    h, doc, count = words.hashes(), words.doc, words.count
    weights = _WEIGHTS if size <= 64 else mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * weights[k]
    inside = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
    total, owner = total[inside], doc[:n][inside]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        start = np.concatenate([[0], np.cumsum(count)])
        short = np.array([(h[start[d] : start[d] + count[d]] * weights[: count[d]]).sum(dtype=np.uint64) + np.uint64(count[d]) for d in few], np.uint64)
        total, owner = np.concatenate([total, short]), np.concatenate([owner, few])
    total = mix(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=len(offsets) - 1)
    sums = np.zeros(len(offsets), np.uint64)
    np.cumsum(mix(total ^ np.uint64(0x5DEECE66D)), dtype=np.uint64, out=(running := np.zeros(len(total) + 1, np.uint64))[1:])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = running[ends[1:]] - running[ends[:-1]]
    return owner, total, sizes, mix(sums + sizes.astype(np.uint64))


def set_sizes(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, ``n`` (size of its set) and ``digest``."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column(1)):
                _, _, n, digest = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest.view(np.int64))], names=["key", "n", "digest"])

    return docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string")).mapInArrow(run, "key long, n long, digest long")


def placed_sets(named: DataFrame, size: int, text: str) -> DataFrame:
    """``set_sizes`` of rows that are known by a struct ``row`` of key and text hash."""
    small_batches(named.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column(1)):
                _, _, n, digest = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest.view(np.int64))], names=["row", "n", "digest"])

    return named.select("row", F.col(text).cast("string")).mapInArrow(run, "row struct<key:long,h:long>, n long, digest long")


def _packed(docs: DataFrame, buckets: int, size: int, text: str) -> DataFrame:
    """Shingles by bucket: (bucket, payload); a set is packed once in each task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, ...]] = []
        tokens = 0

        def sets(at: np.ndarray, owner: np.ndarray, digest: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            own, count = np.unique(owner[at], return_counts=True)
            return [np.array([len(own)], np.uint64), digest[own], n[own].astype(np.uint32), count.astype(np.uint32)]

        def flush() -> pa.RecordBatch:
            owner, token, digest, n = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            distinct, one, back, times = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            marks, marked = distinct[times >= HOT], bucket[one[times >= HOT]]
            hot = (times >= HOT)[back]
            which, blobs = [], []
            cold = np.flatnonzero(~hot)
            order = cold[np.argsort(bucket[cold], kind="stable")]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                at, own_marks = order[edges[k] : edges[k + 1]], marks[marked == k] & _TOKEN if len(marks) else marks
                if len(at) or len(own_marks):
                    t = token[at] & _TOKEN
                    which.append(k)
                    blobs.append(b"".join(x.tobytes() for x in (np.array([len(own_marks)], np.uint64), own_marks, *sets(at, owner, digest, n), (t & np.uint64(0xFFFFFFFF)).astype(np.uint32), (t >> np.uint64(32)).astype(np.uint16))))
            # Hot shingles go with their sets, to buckets of digests.
            warm = np.flatnonzero(hot)
            home = (digest[owner[warm]] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            for k in range(buckets):
                at = warm[order[edges[k] : edges[k + 1]]]
                if len(at):
                    which.append(buckets + k)
                    blobs.append(b"".join(x.tobytes() for x in (*sets(at, owner, digest, n), _value(_MOST, bucket[at].astype(np.uint64), token[at] & _TOKEN))))
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

        base = 0
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                owner, token, n, digest = shingle_sets(data, offsets, size)
                _, first = np.unique(digest, return_index=True)
                new = np.zeros(len(digest), bool)
                new[first] = True
                new &= (n > 0) & ~np.isin(digest, seen)
                seen = np.concatenate([seen, digest[new]])
                use = new[owner]
                held.append((owner[use] + base, token[use], digest, n))
                base += len(n)
                tokens += int(use.sum())
                if tokens >= PACK_TOKENS:
                    yield flush()
                    held, tokens, base = [], 0, 0
        if tokens:
            yield flush()

    return docs.select(docs[text].cast("string")).mapInArrow(run, "bucket int, payload binary")


def _value(level: np.ndarray, bucket: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Frequency class << 56 | shingle."""
    return level << np.uint64(56) | (bucket & np.uint64(255)) << np.uint64(48) | token


def _read(blob: pa.Buffer, at: int, kind: type, n: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(blob, kind, n, at)
    return x, at + x.nbytes


def _repeated(table: pa.Table, buckets: int) -> pa.Table:
    """Of a bucket, for each bucket of digests: its sets and those of their shingles that two sets or more have, packed.

    Shingles are written as frequency class << 56 | shingle.  So there are as many rows as pairs of buckets at most, whatever the input.
    """
    bucket = table.column(0)[0].as_py()
    digests, sizes, tokens, marks = [], [], [], [np.zeros(0, np.uint64)]
    for payload in table.column(1):
        blob, at = payload.as_buffer(), 0
        if bucket < buckets:
            many, at = _read(blob, at, np.uint64, 1)
            own_marks, at = _read(blob, at, np.uint64, int(many[0]))
            marks.append(own_marks)
        k, at = _read(blob, at, np.uint64, 1)
        digest, at = _read(blob, at, np.uint64, int(k[0]))
        n, at = _read(blob, at, np.uint32, int(k[0]))
        count, at = _read(blob, at, np.uint32, int(k[0]))
        m = int(count.sum())
        if bucket < buckets:
            low, at = _read(blob, at, np.uint32, m)
            mid, at = _read(blob, at, np.uint16, m)
            tokens.append(mid.astype(np.uint64) << np.uint64(32) | low)
        else:
            tokens.append(_read(blob, at, np.uint64, m)[0])
        digests.append(np.repeat(digest, count))
        sizes.append(np.repeat(n, count))
    digest, size, token = (np.concatenate(x) for x in (digests, sizes, tokens))
    if bucket < buckets:
        hot = np.unique(np.concatenate(marks))
        order = np.argsort(token, kind="stable")  # most shingles are of one set only: leave them out before the finer sort
        t = token[order]
        same = t[1:] == t[:-1]
        keep = np.isin(t, hot)
        keep[1:] |= same
        keep[:-1] |= same
        order = order[keep]
        digest, size, token = digest[order], size[order], token[order]
        order = np.lexsort((digest, token))
        digest, size, token = digest[order], size[order], token[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
        digest, size, token = digest[fresh], size[fresh], token[fresh]
        _, back, df = np.unique(token, return_inverse=True, return_counts=True)
        df, often = df[back], np.isin(token, hot)
        many = (df > 1) | often
        digest, size, token, df, often = digest[many], size[many], token[many], df[many], often[many]
        level = np.where(often, 127, np.minimum(126, np.floor(6 * np.log2(np.maximum(df, 1)))))
        token = _value(level.astype(np.uint64), np.full(len(token), bucket, np.uint64), token)
    home = (digest % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((digest, home))
    home, digest, size, token = home[order], digest[order], size[order], token[order]
    which, first = np.unique(home, return_index=True)
    edges, blobs = np.append(first, len(home)), []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        own, at, count = np.unique(digest[i:j], return_index=True, return_counts=True)
        blobs.append(b"".join(x.tobytes() for x in (np.array([len(own)], np.uint64), own, size[i:j][at].astype(np.uint32), count.astype(np.uint32), token[i:j])))
    return pa.table({"home": pa.array(which, pa.int32()), "payload": pa.array(blobs, pa.binary())})


def _gathered(table: pa.Table, percent: int) -> pa.Table:
    """Of a bucket of digests: the sets that may link, with their repeated shingles from the rarest on."""
    digests, sizes, values = [], [], []
    for payload in table.column(1):
        blob = payload.as_buffer()
        k, at = _read(blob, 0, np.uint64, 1)
        digest, at = _read(blob, at, np.uint64, int(k[0]))
        n, at = _read(blob, at, np.uint32, int(k[0]))
        count, at = _read(blob, at, np.uint32, int(k[0]))
        digests.append(np.repeat(digest, count))
        sizes.append(np.repeat(n, count))
        values.append(_read(blob, at, np.uint64, int(count.sum()))[0])
    digest, size, value = (np.concatenate(x) for x in (digests, sizes, values))
    order = np.lexsort((value, digest))
    digest, size, value = digest[order], size[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (digest[1:] != digest[:-1])
    digest, size, value = digest[fresh], size[fresh].astype(np.int64), value[fresh]
    own, first, count = np.unique(digest, return_index=True, return_counts=True)
    need = -(-size[first] * percent // 100)
    keep = count >= need
    value, own, size, count = value[np.repeat(keep, count)], own[keep], size[first][keep], count[keep]
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int64()), pa.array(value.view(np.int64)))
    return pa.table({"digest": pa.array(own.view(np.int64)), "n": pa.array(size), "shared": lists.cast(pa.list_(pa.int64()))})


def required(n: Column, percent: int = PERCENT) -> Column:
    """Shingles that a set of n shares with any set it links with, at least."""
    return F.ceil(n * percent / F.lit(100.0)).cast("int")


def candidates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Sets that may link: digest, n, and their repeated shingles from the rarest on (``shared``)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * shuffle_parts(spark)
    back = _packed(docs, buckets, size, text).groupBy("bucket").applyInArrow(lambda t: _repeated(t, buckets), "home int, payload binary")
    # A set's shingles are all in one bucket of digests; a set's list is no longer than its document.
    return cut(back.groupBy("home").applyInArrow(lambda t: _gathered(t, percent), "digest long, n long, shared array<long>"))


def light_limit(cand: DataFrame, percent: int = PERCENT, most: int = LIGHT_MOST) -> int:
    """The size up to which sets are light: least subsets made, probes and list entries scanned."""
    s, need = F.size("shared"), required(F.col("n"), percent)
    one, two = s - need + 1, F.least(s, s - need + 2)
    scan = F.aggregate(F.slice("shared", 1, one), F.lit(0.0), lambda a, t: a + 1 + F.pow(F.lit(2.0), F.shiftright(t, 56) / 6.0) / 2)
    costs = cand.filter(F.col("n") <= most).groupBy("n").agg(F.sum(two * (two - 1) / 2).alias("subsets"), F.sum(one).alias("probes"), F.sum(scan).alias("scans")).collect()  # a row for each size up to ``most``
    cost = lambda x: sum(r["subsets"] + (r["probes"] if r["n"] * 100 >= x * percent else 0) if r["n"] <= x else r["scans"] for r in costs)
    return min(range(most + 1), key=cost)


def list_entries(cand: DataFrame, limit: int, percent: int = PERCENT) -> DataFrame:
    """The lists: key, node, ``last`` (sets with fewer shingles of their own are preferred to tie a list), and ``info``:

    n, ``side`` (0 a light set's subset, 1 a light set's probe, 2 a heavy set), ``prev`` (the key before), ``left`` (shingles from
    this place on, in the order; for a subset from the place before its second one), ``own`` (shingles of no other set)
    and ``b0`` to ``b3``, the parity bits of the others.
    """
    s, need = F.size("shared"), required(F.col("n"), percent)
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda k: F.aggregate("shared", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.when(F.shiftright(t, 6).bitwiseAND(F.lit(3)) == k, bit(t)).otherwise(F.lit(0).cast("long"))))
    cand = cand.withColumn("own", F.col("n") - s).withColumns({f"b{k}": word(k) for k in range(PARITY_WORDS)})
    first = F.slice("shared", 1, s - need + 1)
    two = F.slice("shared", 1, s - need + 2)
    entry = lambda key, prev, left, side: F.struct(key.alias("key"), prev.alias("prev"), left.cast("long").alias("left"), F.lit(side).alias("side"))
    no_prev = F.lit(None).cast("long")
    subsets = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.greatest(F.size(two) - i - 1, F.lit(0))), lambda y, j: entry(F.xxhash64(x, y), no_prev, s - i - j, 0))))
    single = lambda side: F.transform(first, lambda x, i: entry(x, F.when(i > 0, F.element_at(first, i)), s - i, side))
    probed = F.col("n") * 100 >= limit * percent
    whole = cand.withColumn("e", F.explode(F.when(F.col("n") > limit, single(2)).when(probed, F.concat(subsets, single(1))).otherwise(subsets)))
    info = F.struct("n", "e.side", "e.prev", "e.left", "own", *[f"b{k}" for k in range(PARITY_WORDS)])
    return whole.select("e.key", F.col("digest").alias("node"), (F.floor(F.col("own") * 20 / F.col("n")) - 100 * F.col("e.side")).cast("int").alias("last"), info.alias("info"))


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """False only for pairs of a list that don't link, or that meet in another list too.

    Two linked sets share ``o`` shingles at least.  At the first one they share, both have ``o`` left.  They differ in n + m - 2 o
    at most: in all that is their own, and in one shingle at least for each parity bit that differs.
    """
    n, m = x["n"], y["n"]
    o = F.ceil((n + m) * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    differ = x["own"] + y["own"]
    for k in range(PARITY_WORDS):
        differ = differ + F.bit_count(x[f"b{k}"].bitwiseXOR(y[f"b{k}"]))
    sides = ((x["side"] == 0) & (y["side"] == 0)) | ((x["side"] != 0) & (y["side"] != 0) & (x["side"] + y["side"] > 2))
    return sides & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(x["left"], y["left"]) >= o) & (differ <= n + m - 2 * o)


def _told(x: Column, y: Column) -> Column:
    """The list before has given this pair: the shingle before is in both sets' first ones."""
    return (x["prev"] == y["prev"]) & (x["side"] + y["side"] > 2)


def _verified(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    one = pairs.join(cand.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa")).hint("merge"), "a")
    both = one.join(cand.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb")).hint("merge"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(same * 100 >= (F.col("na") + F.col("nb") - same) * percent).select("a", "b")


def set_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """digest and root of each set that links with another."""
    cand = candidates(docs, size, percent, text)
    release(docs.sparkSession)  # the packed shingles, before pairs are made
    entries = list_entries(cand, light_limit(cand, percent), percent).persist()
    found = candidate_components(entries, lambda x, y: _may_link(x, y, percent), lambda pairs: _verified(pairs, cand, percent), FIRST_PAIRS, _told)
    return found.select(F.col("node").alias("digest"), "root")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, ``n_shingles`` and ``component_id``, the smallest key that its links reach."""
    roots = set_components(docs, size, percent, text)
    rows = set_sizes(docs, size, text, key)
    placed = rows.join(roots.hint("merge"), "digest", "left").withColumn("root", F.coalesce("root", "digest")).drop("digest").persist()
    least = placed.filter("n > 0").groupBy("root").agg(F.min("key").alias("component_id"))
    out = placed.join(least.hint("merge"), "root", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of linked documents, that of the smallest key and text hash (null keys last), with all its columns.

    Rows without words stay.  Rows equal in key and text are one.
    """
    roots = set_components(docs, size, percent, text)
    named = docs.select(F.struct(docs[key].cast("long").alias("key"), F.xxhash64(docs[text].cast("string")).alias("h")).alias("row"), docs[text].alias(text))
    rows = placed_sets(named, size, text)
    placed = rows.join(roots.hint("merge"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    place = F.struct(F.col("row.key").isNull().alias("none"), F.col("row.key").alias("key"), F.col("row.h").alias("h"))
    tops = placed.filter("n > 0").groupBy("root").agg(F.min(place).alias("top")).select("top.key", "top.h")
    held = cut(tops.union(placed.filter("n = 0").select("row.key", "row.h").distinct()).select(F.col("key").alias("__key"), F.col("h").alias("__h")))
    del roots, rows, placed, tops
    release(docs.sparkSession)
    out = docs.join(held.hint("merge"), docs[key].cast("long").eqNullSafe(F.col("__key")) & (F.xxhash64(docs[text].cast("string")) == F.col("__h")), "left_semi")
    more = named.groupBy("row").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count()
    return out.dropDuplicates([key, text]) if more else out
