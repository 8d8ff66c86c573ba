"""Token ids in directly addressable codes: any token can be read without decoding a block.

An id is split into chunks of bits, the lowest first; level k holds the k-th chunk of those ids that have one,
bit-packed, and a bitmap that says which of them go on at the next level.  The id at place i of level k goes on
at place rank(bitmap k, i) of level k+1; a rank directory (a running count every ``RANK_BLOCK`` bits) makes rank
a table look-up and one popcount of a few words.  The bit widths are chosen for each file part by dynamic
programming over the histogram of the ids' bit lengths, at the least total size.

A part (``encode_part``) is a run of whole documents::

    magic "DAC1" | levels u8 | widths u8 each | padding | n_docs u32 | n_tokens u64
    doc_ids i64[n_docs] | first token of each document, and the end, u64[n_docs + 1]
    per level: n u64 | chunk words u64[] | and, but for the last level, bitmap words u64[] | rank directory u32[]

All numbers are little-endian.  Parts are the rows of a Parquet data set in ascending doc_id order, so the format
works on every store that Spark can write to, and a lost executor only repeats its task.

Null and empty texts have just the end id.  Rows with equal doc_id are ordered by their text; a null doc_id comes
first and is read back as null.  An empty table gives an empty data set.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_array, scratch_path, shuffle_parts, small_batches, text_of

RANK_BLOCK = 512
END_ID = 1
#: Tokens in a part at which it is closed.
PART_TOKENS = 1 << 18
#: Distinct words whose ids a task remembers.
CACHE_WORDS = 1_000_000
_NULL_ID = -(1 << 63)


# ------------------------------------------------------------------------------------------------ the code


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least total bits, one bitmap bit for each chunk of every level but the last included."""
    if not len(ids):
        return [8]
    bits = np.maximum(1, np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int))
    top = int(bits.max())
    at_least = np.concatenate([np.cumsum(np.bincount(bits, minlength=top + 1)[::-1])[::-1], [0]])  # ids with >= b bits
    over = lambda b: int(at_least[b + 1]) if b + 1 < len(at_least) else 0  # noqa: E731  ids with more than b bits
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for b in range(top - 1, -1, -1):
        n = len(ids) if b == 0 else over(b)
        best[b] = min((n * (w + (b + w < top)) * (1 + (b + w < top) / 16) + best[b + w][0], [w, *best[b + w][1]]) for w in range(1, min(32, top - b) + 1))
    return best[0][1]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Bit-packed little-endian words, with one spare word at the end."""
    bits = len(values) * width
    out = np.zeros(bits // 64 + 2, np.uint64)
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = values.astype(np.uint64)
    if len(v):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        spill = np.flatnonzero((at & 63) + width > 64)
        out[word[spill] + 1] |= v[spill] >> (np.uint64(64) - shift[spill])
    return out


def unpack(words: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    at = places.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def encode_part(doc_ids: list[int], starts: np.ndarray, ids: np.ndarray) -> bytes:
    widths = best_widths(ids)
    out = [b"DAC1", bytes([len(widths)]), bytes(widths)]
    out.append(b"\0" * (-sum(map(len, out)) % 8))
    out += [struct.pack("<QQ", len(doc_ids), len(ids)), np.array(doc_ids, "<i8").tobytes(), starts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint64)
    for k, w in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), pack(rest & np.uint64((1 << w) - 1), w).tobytes()]
        rest = rest >> np.uint64(w)
        if k < len(widths) - 1:
            more = rest > 0
            padded = np.zeros(-(-len(more) // RANK_BLOCK) * RANK_BLOCK, bool)
            padded[: len(more)] = more
            out.append(np.packbits(padded, bitorder="little").tobytes())
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BLOCK).sum(1))]).astype("<u4")
            out += [ranks.tobytes(), b"\0" * (-ranks.nbytes % 8)]
            rest = rest[more]
    return b"".join(out)


class Part:
    """A part opened for random access; nothing is decoded beforehand."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DAC1":
            raise ValueError("not a part of directly addressable codes")
        self.widths = list(blob[5 : 5 + blob[4]])
        at = -(-(5 + blob[4]) // 8) * 8
        n_docs, self.n = struct.unpack_from("<QQ", blob, at)
        at += 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids = take("<i8", n_docs)
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for k, w in enumerate(self.widths):
            n = int(take("<u8", 1)[0])
            words = take("<u8", n * w // 64 + 2)
            if k == len(self.widths) - 1:
                self.levels.append((words, None, None))
                continue
            blocks = -(-n // RANK_BLOCK)
            bitmap = take("<u8", blocks * RANK_BLOCK // 64)
            ranks = take("<u4", blocks + 1)
            at += -ranks.nbytes % 8
            self.levels.append((words, bitmap, ranks))

    def _rank(self, level: int, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, whole words after it, and the rest of one word."""
        _, bitmap, ranks = self.levels[level]
        word = places >> 6
        out = ranks[places // RANK_BLOCK].astype(np.int64)
        first = places // RANK_BLOCK * (RANK_BLOCK // 64)
        for k in range(RANK_BLOCK // 64 - 1):
            use = first + k < word
            out[use] += np.bitwise_count(bitmap[first[use] + k])
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(bitmap[word] & below)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places of the part."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint64)
        who, shift = np.arange(len(places)), 0
        for k, w in enumerate(self.widths):
            words, bitmap, _ = self.levels[k]
            out[who] |= unpack(words, places, w) << np.uint64(shift)
            shift += w
            if bitmap is None or not len(who):
                break
            on = (bitmap[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) > 0
            who, places = who[on], self._rank(k, places[on])
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        """Every id, level by level; ranks are running sums here."""
        out = np.zeros(self.n, np.uint64)
        who, shift = np.arange(self.n), 0
        for (words, bitmap, _), w in zip(self.levels, self.widths, strict=True):
            out[who] |= unpack(words, np.arange(len(who)), w) << np.uint64(shift)
            shift += w
            if bitmap is None:
                break
            who = who[np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(who)].astype(bool)]
        return out.astype(np.uint32)


# ------------------------------------------------------------------------------------------------ tokens


#: Texts of these characters alone can be split here as the tokenizer's own pattern splits them.
_LATIN = re.compile("[\\t\\n\\r -~¡-ÿ]*")
#: Letters, digits and the rest of Latin-1 under the tokenizer's pattern; it drops white space.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: What the tokenizer must be for that: this pattern, lower-casing, one end mark after each piece.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class _Known(dict):
    """Pieces seen so far and their numbers; new ones are remembered in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class WordEncoder:
    """Ids of whole texts under a tokenizer of lower-cased words.

    Each distinct piece (a word, a digit, a run of signs) is encoded by the library once a task and remembered, and texts
    are put together from the pieces' ids.  That holds as the tokenizer splits texts into pieces by a pattern, and a piece's
    ids end with the only one marked as an end; both are checked on loading.  Texts with characters beyond Latin-1, or
    that may hold a special token, are encoded whole by the library, and so is everything if the check fails.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        model, split = told["model"], told["pre_tokenizer"]
        first = (split.get("pretokenizers") or [{}])[0]
        self.by_piece = (
            first.get("pattern") == {"Regex": _PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed"
            and [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS
            and told["post_processor"] is None and model.get("end_of_word_suffix") == "</w>" and not model.get("unk_token")
        )
        self.special = [a["content"] for a in told["added_tokens"]]
        self.ends = np.zeros(max(model["vocab"].values()) + 1 + len(self.special), bool)
        self.ends[[i for w, i in model["vocab"].items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        new, self.known.new = self.known.new, []
        if not new:
            return
        ids = self._whole(" ".join(new))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new) and ends[-1] == len(ids):
            size = np.diff(ends, prepend=0)
        else:
            each = [self._whole(p) for p in new]
            ids, size = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        found = []
        places, cuts = [], [0]
        for i, t in enumerate(texts):
            if not self.by_piece or not _LATIN.fullmatch(t) or any(s in t for s in self.special):
                out[i] = self._whole(t)
                continue
            pieces = _PIECES.findall(t.lower())
            found.append(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))
            places.append(i)
            cuts.append(cuts[-1] + len(pieces))
        self._learn()
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.first[at] - (ends - size), size)]
        bounds = np.concatenate([[0], ends])[cuts]
        for i, a, b in zip(places, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return out


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


# ------------------------------------------------------------------------------------------------ files


def write_dac(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, part_tokens: int = PART_TOKENS, text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of every text, ``end_id`` after each, to ``path`` in ascending order of ``key``.

    Texts are dealt by ranges of the key (rows with one key are split by their text's hash), sorted, and encoded after
    the shuffle, in parts of about ``part_tokens`` ids.  Rows: ``run`` (the range), ``part`` (its place in it),
    ``n_docs``, ``n_tokens`` and ``payload``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = docs.select(docs[key].cast("long").alias("key"), text_of(docs[text]).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = whole.repartitionByRange(shuffle_parts(spark), *order[:2]).sortWithinPartitions(*order).select(F.spark_partition_id().alias("run"), "key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        keys: list[int] = []
        ids: list[np.ndarray] = []
        held, part, run = 0, 0, None

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            blob = encode_part(keys, starts, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["run", "part", "n_docs", "n_tokens", "payload"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for k, x in zip(s.column(1).to_pylist(), enc.encode(s.column(2).to_pylist()), strict=True):
                    x = np.append(x, np.uint32(end_id))
                    if run is None:
                        run = s.column(0)[0].as_py()
                    keys.append(_NULL_ID if k is None else k)
                    ids.append(x)
                    held += len(x)
                    if held >= part_tokens:
                        yield close()
                        keys, ids, held, part = [], [], 0, part + 1
        if keys:
            yield close()

    dealt.mapInArrow(encode, "run int, part int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_dac(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """For each document of a data set: its key, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``, from the files."""
    files = spark.read.parquet(path)
    totals = files.groupBy("run").agg(F.sum("n_tokens").alias("n"))  # a row for each range
    before, so_far = [], 0
    found = {r["run"]: r["n"] for r in totals.collect()}
    for run in range(max(found, default=-1) + 1):
        before.append(so_far)
        so_far += found.get(run, 0)
    offset = F.element_at(long_array(before or [0]), F.col("run") + 1)
    w = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("run", "part", (F.coalesce(F.sum("n_tokens").over(w), F.lit(0)) + offset).alias("first"))  # narrow: payloads stay out of the window
    placed = files.join(F.broadcast(places) if len(before) <= 4096 and places.count() <= 100_000 else places, ["run", "part"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, first in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                p = Part(payload.as_py())
                ids = p.all().astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(p.starts[:-1], p.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p.doc_ids, mask=p.doc_ids == _NULL_ID), pa.array(p.starts[:-1] + first), pa.array(np.diff(p.starts)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return placed.select("payload", "first").mapInArrow(decode, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def read_tokens(part: bytes, places: list[int]) -> list[int]:
    """The ids at some places of one part, read directly."""
    return Part(part).get(np.array(places, np.int64)).tolist()


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write, then read back; see ``write_dac`` and ``read_dac``.

    Without a ``path`` the data set lies in the shared folder; it stays there, as the rows returned are read from it.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "dac")
    write_dac(docs, path, tokenizer)
    return read_dac(spark, path)
