"""Benchmark decontamination by template canonicalisation.

Texts are read as tokens: runs of letters, or runs of digits with single points or commas inside.  Numbers, units and
names become typed placeholders, so a question with other parameters has the same template:

* number: a token of digits, or a run of number words (``NUMBER_WORDS``), which is one token;
* unit: a token of ``UNITS`` right after a number;
* name: a word with a capital first letter and a small second one that does not begin a sentence or a line.

All other tokens stay, in lower case, whatever stands between them.  The windows of ``WINDOW`` template tokens of each
benchmark item (a shorter item is one window) with at least ``LITERALS`` literal tokens are hashed; each window of each
document is looked up.  As names depend on case and punctuation, each window is hashed a second time with its names as
lower-case words and a unit at its beginning as it stands; if even so fewer than ``LITERALS`` tokens are literal, with the
values of all its tokens.  So exact copies are found in any case and however rich in numbers, names and units.  Windows of one item that match on one alignment (document place less item place) are joined to
a run, and the run's slots are checked: one value of the item must always meet the same value of the document and the
other way about, per type, else the run is dropped from its first contradiction on (what follows begins a new run).
A document is contaminated by an item if consistent runs cover half of the item's tokens, or ``RUN_TOKENS`` in a row.  If some
slot in them has another value, the copy is re-parameterised.

Benchmark windows are broadcast in blocks of at most ``BLOCK_ITEMS`` windows; a larger benchmark takes several passes over
the documents, whose results are united.  So what is broadcast is bounded whatever the benchmark's size.

Null and empty texts match nothing; null and empty items are skipped.  Repeated items are one, and the smallest item_id
is told.  Very long texts are read in whole.  Repeated rows get equal results; an empty table gives no rows, and an empty benchmark
contaminates nothing.  Other columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, small_batches, span_hashes, tidy

WINDOW = 8
LITERALS = 4
RUN_TOKENS = 13
COVER = 0.5
#: Windows of the benchmark that one pass over the documents looks up (16 bytes each when broadcast).
BLOCK_ITEMS = 1 << 20
CHUNK_CHARS = 1 << 18

# Words that stand for numbers, and units.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "trillion", "dozen",
)
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "ms", "s", "min", "h", "hr", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent", "degrees", "millimeters", "millimetres", "centimeters", "centimetres", "kilometers", "kilometres", "yards", "yd", "mph", "kph", "pounds", "ounces", "milligrams", "tons", "tonnes", "gallons", "pints", "cups", "milliliters", "millilitres", "acres", "hectares", "second", "minute", "hour", "day", "week", "month", "year", "mile", "meter", "metre", "foot", "inch", "gram", "kilogram", "liter", "litre", "dollar", "euro", "cent", "pound", "volts", "watts", "amps", "ohms", "joules", "newtons", "hertz", "hz", "kw", "kwh", "bytes", "kb", "mb", "gb")

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_SPACE, _LETTER, _DIGIT, _STOP, _JOINT, _ALONE = 1, 2, 4, 8, 16, 128
#: Scripts without blanks: each letter is a token.
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 code points: class bits with 32 for a capital and 64 for a small letter, and the lower case."""
    if not _TABLE:
        kind, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat[0] in "LM":
                kind[cp] = _LETTER | 32 * (cat in ("Lu", "Lt")) | 64 * (cat == "Ll")
                if len(x := c.lower()) == 1 and ord(x) < 0x10000:
                    low[cp] = ord(x)
            elif cat == "Nd":
                kind[cp] = _DIGIT
            elif c.isspace():
                kind[cp] = _SPACE
        for lo, hi in _UNSPACED:
            kind[lo:hi][kind[lo:hi] & _LETTER > 0] |= _ALONE
        kind[[ord(c) for c in ".!?:\n"]] |= _STOP
        kind[[ord(c) for c in ".,"]] |= _JOINT
        _TABLE.append((kind, low))
    return _TABLE[0]


def _rare(x: int) -> int:
    """Class bits of a code point beyond the first 65,536."""
    kind = unicodedata.category(chr(x))
    if kind[0] in "LM":
        return _LETTER | 32 * (kind in ("Lu", "Lt")) | 64 * (kind == "Ll") | _ALONE * any(lo <= x < hi for lo, hi in _UNSPACED)
    return _DIGIT if kind == "Nd" else 0


def _word_hash(words: tuple[str, ...]) -> np.ndarray:
    t = Tokens(np.array([ord(c) for w in words for c in w + " "], np.uint32), np.array([0, sum(len(w) + 1 for w in words)]), typed=False)
    return np.sort(t.value)


class Tokens:
    """Tokens of texts: ``doc``, ``value`` (hash of the lower-case token), ``kind`` (the type), ``template`` (hash)."""

    def __init__(self, cps: np.ndarray, offsets: np.ndarray, typed: bool = True):
        table, low = _tables()
        inside = np.minimum(cps, 0xFFFF)
        bits, lower = table[inside], low[inside]
        high = np.flatnonzero(cps > 0xFFFF)
        if len(high):
            distinct, back = np.unique(cps[high], return_inverse=True)
            small = [ord(c) if len(c := chr(x).lower()) == 1 else x for x in distinct.tolist()]
            bits[high] = np.array([_rare(x) for x in distinct.tolist()], np.uint8)[back]
            lower[high] = np.array(small, np.uint32)[back]
        n = len(cps)
        digit = bits & _DIGIT > 0
        joint = np.zeros(n, bool)
        if n > 2:
            joint[1:-1] = (bits[1:-1] & _JOINT > 0) & digit[:-2] & digit[2:]
        digit = digit | joint
        letter = bits & _LETTER > 0
        group = letter * 1 + digit * 2
        border = np.ones(n + 1, bool)
        alone = bits & _ALONE > 0
        border[1:-1] = (group[1:] != group[:-1]) | alone[1:] | alone[:-1]
        border[offsets] = True
        at = np.flatnonzero(border)
        start, end = at[:-1], at[1:]
        use = group[start] > 0 if n else np.zeros(0, bool)
        self.start, self.end = start, end = start[use], end[use]
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        size = end - start
        self.value = span_hashes(lower, start, end)
        if not typed:
            return
        start, end = self._joined(_among(self.value, _NUMBERS()))
        size = end - start
        kind = np.where(digit[start], NUMBER, LITERAL) if len(start) else np.zeros(0, np.int64)
        kind[self.words_of_numbers] = NUMBER
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUMBER) & (self.doc[1:] == self.doc[:-1])
        kind[after & (kind == LITERAL) & _among(self.value, _UNIT_HASHES())] = UNIT
        # A sentence begins a text, and after a stop or a line end between two tokens.
        stops = np.concatenate([[0], np.cumsum((bits & _STOP > 0) & ~joint)])
        begins = np.ones(len(kind), bool)
        begins[1:] = (self.doc[1:] != self.doc[:-1]) | (stops[start[1:]] > stops[end[:-1]])
        second = np.minimum(start + 1, max(n - 1, 0))
        capital = (bits[start] & 32 > 0) & (size > 1) & (bits[second] & 64 > 0) if len(start) else np.zeros(0, bool)
        kind[capital & ~begins & (kind == LITERAL)] = NAME
        self.kind = kind
        self.template = np.where(kind == LITERAL, self.value, mix(kind.astype(np.uint64) + np.uint64(77)))

    def _joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Make each run of number words one token, whose value comes from all of them."""
        more = np.zeros(len(number), bool)
        more[1:] = number[1:] & number[:-1] & (self.doc[1:] == self.doc[:-1])
        if more.any():
            first = np.flatnonzero(~more)
            place = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
            parts = np.where(place > 0, mix(self.value + place.astype(np.uint64)), self.value)
            self.value = np.add.reduceat(parts, first)
            self.end = self.end[np.append(first[1:], len(number)) - 1]
            self.start, self.doc, number = self.start[first], self.doc[first], number[first]
        self.words_of_numbers = number
        return self.start, self.end

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window of one text: by template if it has enough literal tokens, and by words."""
        n = len(self.kind) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        slot = (self.kind == NUMBER) | (self.kind == UNIT)
        words = np.where(slot, self.template, self.value)
        h, caseless, exact = (np.zeros(n, np.uint64) for _ in range(3))
        for k in range(size):
            h += self.template[k : k + n] * weights[k]
            # What precedes a window must not decide whether it begins with a unit.
            caseless += (words if k else np.where(self.kind == NUMBER, self.template, self.value))[k : k + n] * weights[k]
            exact += self.value[k : k + n] * weights[k]
        inside = self.doc[:n] == self.doc[size - 1 :]
        least = min(LITERALS, size)
        count = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[size:] - c[:-size]
        at = np.flatnonzero(inside & (count(self.kind == LITERAL) >= least))
        rich = count(~slot) + (self.kind[:n] == UNIT) >= least
        both = np.flatnonzero(inside)
        plain = np.where(rich, mix(caseless + np.uint64(size)) ^ np.uint64(0x5DEECE66D), mix(exact + np.uint64(size)) ^ np.uint64(0xB5026F5AA))
        return np.concatenate([at, both]), np.concatenate([mix(h[at] + np.uint64(size)), plain[both]])


_HASHES: dict[str, np.ndarray] = {}


def _NUMBERS() -> np.ndarray:
    if "n" not in _HASHES:
        _HASHES["n"] = _word_hash(NUMBER_WORDS)
    return _HASHES["n"]


def _UNIT_HASHES() -> np.ndarray:
    if "u" not in _HASHES:
        _HASHES["u"] = _word_hash(UNITS)
    return _HASHES["u"]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x if len(x) else np.zeros(0, bool)


def tokens_of(texts: list[str]) -> Tokens:
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return Tokens(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


class Index:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.tokens = t = tokens_of([x for _, x in items])
        count = np.bincount(t.doc, minlength=len(items))
        self.count, self.first = count, np.cumsum(count) - count
        at, h = t.windows(window)
        size = np.full(len(at), window)
        for n in sorted(set(count[(count > 0) & (count < window)].tolist())):  # short items: one window each
            a, b = t.windows(n)
            whole = count[t.doc[a]] == n
            at, h, size = np.concatenate([at, a[whole]]), np.concatenate([h, b[whole]]), np.concatenate([size, np.full(int(whole.sum()), n)])
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.size = h[order], at[order], size[order]
        self.sizes = sorted(set(self.size.tolist()))

    def hits(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of the documents, token of the items, window size) of each equal window."""
        found = []
        for n in self.sizes:
            place, h = t.windows(n)
            low = np.searchsorted(self.hash, h)
            hit = np.flatnonzero((low < len(self.hash)) & (self.hash[np.minimum(low, len(self.hash) - 1)] == h)) if len(h) else np.zeros(0, int)
            if not len(hit):
                continue
            high = np.searchsorted(self.hash, h[hit], side="right")
            times = high - low[hit]
            which = np.repeat(low[hit], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            rows = np.repeat(place[hit], times)
            same = self.size[which] == n
            found.append((rows[same], self.at[which[same]], np.full(int(same.sum()), n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def consistent_runs(t: Tokens, b: Tokens, pairs: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """Of aligned token pairs in order: (first item token, length, other values), cut where a slot contradicts itself."""
    out: list[tuple[int, int, bool]] = []
    forth: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    first, last, changed = None, None, False
    for d, i in pairs:
        kind = int(b.kind[i])
        mine, theirs = int(b.value[i]), int(t.value[d])
        ok = kind == LITERAL or (forth.get((kind, mine), theirs) == theirs and back.get((kind, theirs), mine) == mine)
        if first is not None and (not ok or i != last + 1):
            out.append((first, last - first + 1, changed))
            first = None
            if not ok:
                forth, back = {}, {}
        if first is None:
            first, changed = i, False
        if kind != LITERAL:
            forth[kind, mine], back[kind, theirs] = theirs, mine
            changed |= mine != theirs
        last = i
    if first is not None:
        out.append((first, last - first + 1, changed))
    return out


def judge(t: Tokens, index: Index, n_docs: int) -> list[list[tuple[int, int, bool]]]:
    """For each document: (item, covered tokens, re-parameterised) of each item that it holds."""
    out: list[list[tuple[int, int, bool]]] = [[] for _ in range(n_docs)]
    place, at, size = index.hits(t)
    if not len(place):
        return out
    item = index.tokens.doc[at]
    doc = t.doc[place]
    order = np.lexsort((at, at - place, item, doc))
    place, at, size, item, doc = place[order], at[order], size[order], item[order], doc[order]
    breaks = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
    for lo, hi in zip([0, *breaks.tolist()], [*breaks.tolist(), len(place)], strict=True):
        d, k = int(doc[lo]), int(item[lo])
        covered, longest, other = set(), 0, False
        shift = at[lo:hi] - place[lo:hi]
        for s in np.unique(shift):
            use = np.flatnonzero(shift == s) + lo
            spans = sorted({int(at[u]) + x for u in use for x in range(int(size[u]))})
            for first, length, changed in consistent_runs(t, index.tokens, [(i - int(s), i) for i in spans]):
                if length >= min(WINDOW, int(index.count[k])):
                    covered |= set(range(first, first + length))
                    longest, other = max(longest, length), other or changed
        if longest >= RUN_TOKENS or len(covered) >= COVER * int(index.count[k]) and covered:
            out[d].append((index.ids[k], len(covered), other))
    return out


def judged(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, list[list[tuple[int, int, bool]]]]]:
    """Runs of texts as (first, after the last, what each holds), so that tokens of a few texts are in memory at once."""
    whole = ["" if x is None else x for x in texts.to_pylist()]
    first = 0
    while first < len(whole):
        last, chars = first + 1, len(whole[first])
        while last < len(whole) and chars + len(whole[last]) <= CHUNK_CHARS:
            chars += len(whole[last])
            last += 1
        yield first, last, judge(tokens_of(whole[first:last]), index, last - first)
        first = last


def benchmark_blocks(benchmark: DataFrame, block: int, item: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block`` windows at most, one of which is on the driver at a time."""
    bench = benchmark.filter(benchmark[item_text].isNotNull()).groupBy(benchmark[item_text].cast("string").alias("x")).agg(F.min(benchmark[item].cast("long")).alias("id"))
    size = bench.agg(F.sum(F.length("x"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block)))  # a token and the gap after it take four characters at least, nearly always, and give two windows
    for k in range(blocks):
        yield sorted((r["id"], r["x"]) for r in bench.filter(F.pmod(F.xxhash64("x"), F.lit(blocks)) == k).collect())


def _pass(docs: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(items)
    loaded: list[Index] = []

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(Index(told.value, window))
        for b in batches:
            for first, last, found in judged(b.column(1), loaded[0]):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), b.column(2).slice(first, last - first), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int64())), pa.array([max((x[1] for x in f), default=0) for f in found], pa.int64()), pa.array([any(x[2] for x in f) for f in found])],
                    names=["key", "_row", "items", "covered", "reparameterised"],
                )

    return docs.mapInArrow(run, "key long, _row long, items array<long>, covered long, reparameterised boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_ITEMS, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row: key, ``contaminated``, ``items`` (ids of the items it holds, sorted), ``covered`` and ``reparameterised``."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"), F.lit(0).cast("long").alias("_row"))
    out = None
    for k, items in enumerate(benchmark_blocks(benchmark, block, item, item_text)):
        if k == 1:  # several passes: rows are numbered, so that their results meet again without relying on unique keys
            rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
            out = _pass(rows, first_items, window)
        first_items = items
        one = _pass(rows, items, window)
        out = one if out is None else out.union(one)
    if k:
        out = out.groupBy("_row").agg(F.first("key").alias("key"), F.flatten(F.collect_list("items")).alias("items"), F.max("covered").alias("covered"), F.max("reparameterised").alias("reparameterised"))
    return out.select(F.col("key").alias(key), (F.size("items") > 0).alias("contaminated"), F.array_sort(F.array_distinct("items")).alias("items"), "covered", "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_ITEMS, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; nothing is shuffled.

    A large benchmark is taken in blocks: each leaves what it doesn't contaminate to the next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = docs.columns.index(text)
    for items in benchmark_blocks(benchmark, block, item, item_text):
        told = spark.sparkContext.broadcast(items)
        loaded: list[Index] = []

        @tidy
        def run(batches: Iterator[pa.RecordBatch], told=told, loaded=loaded) -> Iterator[pa.RecordBatch]:
            if not loaded:
                loaded.append(Index(told.value, window))
            for b in batches:
                keep = [not found for _, _, part in judged(b.column(place), loaded[0]) for found in part]
                if keep:
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
