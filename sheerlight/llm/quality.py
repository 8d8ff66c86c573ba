"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed byte trigrams, and for its words (parted by white space) their shapes, pairs of shapes and
repetitions: a shape tells capitals, the sign classes at the end and the length.  Counts are damped by the logarithm, weighed by
inverse document frequency, and scaled to length 1.  A truncated singular value decomposition of a bounded sample
of labelled texts gives the latent space; the sample's vectors are broadcast (``SAMPLE`` x ``RANK`` numbers whatever the
corpus), and each document's cosine with all of them is computed exactly, in blocks.  The ``NEIGHBOURS`` nearest vote
with weight similarity ** ``SHARPNESS``; a small prior keeps votes of far neighbours from being extreme.

Of labelled texts that are equally near, those first in the sample's order (by label and terms) vote.  Null and empty texts have no
terms: their score is the sample's share of label 1.  Very long texts are counted in whole.  Without any label all scores are 0.5; with
one label only, that label.  Labels, language, source and ids are no inputs, and other columns, whatever their names, are ignored.  Repeated
rows get equal scores.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, fitted, mix, small_batches, text_chunks, tidy

#: Labelled texts that the space is fitted on and that vote, at most, by label.
SAMPLE = {0: 1536, 1: 2560}
TERMS = 4096
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
PRIOR_VOTES = 0.2
CUT = 0.5

_CLASS = np.zeros(256, np.int64)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 4
for _i, _c in enumerate(".,;:!?|*#%&$@~=+-_/\\\"'()[]{}<>^`"):
    _CLASS[ord(_c)] = 5 + _i


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, a row for each text."""
    n = len(offsets) - 1
    half = np.uint64(TERMS // 2)
    cells = []

    def add(owner: np.ndarray, hashed: np.ndarray, part: int) -> None:
        cells.append(owner.astype(np.int64) * TERMS + part * (TERMS // 2) + (hashed % half).astype(np.int64))

    if len(data) > 2:
        b = data.astype(np.uint32)
        gram = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        add(owner[:-2][inside], (gram[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40), 0)
    words = Words(data, offsets, lower=False)
    if len(words.start):
        h, doc = words.hashes(), words.doc
        size = words.end - words.start
        last = _CLASS[data[words.end - 1]]
        before = np.where(size > 1, _CLASS[data[np.maximum(words.end - 2, 0)]], 0)
        first = _CLASS[data[words.start]]
        second = np.where(size > 1, _CLASS[data[np.minimum(words.start + 1, len(data) - 1)]], 0)
        shape = ((first * 64 + second) * 64 + before) * 64 + last
        shape = mix(shape.astype(np.uint64) * np.uint64(8) + np.minimum(size // 4, 7).astype(np.uint64))
        add(doc, shape, 1)
        pair = doc[1:] == doc[:-1]
        add(doc[1:][pair], mix(shape[1:][pair] ^ (shape[:-1][pair] * np.uint64(31))), 1)
        for gap in (1, 2, 3):
            same = (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])
            owner = doc[gap:][same]
            for k in range(8):  # some terms each, so that repetition weighs more than one term
                add(owner, np.full(len(owner), 0xA5A5 + 64 * gap + k, np.uint64), 1)
    if not cells:
        return np.zeros((n, TERMS), np.float32)
    return np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


@dataclass
class Model:
    """Weights of terms, the latent space, and the labelled vectors in it."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = _scaled(np.log1p(counts) * self.idf)
        return _scaled(x @ self.space)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        share = float(self.labels.mean())
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), 256):
            like = np.maximum(self.project(counts[at : at + 256]) @ self.vectors.T, 0)
            # The k most alike; of those as like as the last one, the first in the order of the sample.
            least = np.partition(like, len(self.labels) - k, axis=1)[:, -k, None]
            above, tied = like > least, like == least
            take = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True)))
            near = np.nonzero(take)[1].reshape(len(like), k)
            votes = np.take_along_axis(like, near, 1).astype(np.float64) ** SHARPNESS
            out[at : at + 256] = ((votes * self.labels[near]).sum(1) + PRIOR_VOTES * share) / (votes.sum(1) + PRIOR_VOTES)
        return np.clip(out, 0, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit_counts(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """The model of some labelled texts, by a randomised decomposition with a fixed seed."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    idf = np.log((len(labels) + 1) / ((counts > 0).sum(0) + 1)).astype(np.float32) + np.float32(0.1)
    x = _scaled(np.log1p(counts) * idf)
    rng = np.random.default_rng(8)
    rank = min(rank, len(labels))
    q = np.linalg.qr(x.T @ rng.standard_normal((len(x), rank + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, s, v = np.linalg.svd(x @ q, full_matrices=False)
    space = (q @ v.T)[:, :rank] * (s[:rank] / s[0]) ** -0.5  # whitened by half: weak directions speak up
    model = Model(idf, space.astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float64))
    model.vectors = model.project(counts)
    return model


def fit(labelled: DataFrame) -> Model:
    """The model of a bounded sample (text, label): terms are counted by many tasks, the space is fitted by one."""
    small_batches(labelled.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column(0), 1 << 19):
                counts = np.minimum(term_counts(data, offsets), 65000).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array([x.tobytes() for x in counts], pa.binary())], names=["label", "counts"])

    def make(table: pa.Table) -> Model:
        rows = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        counts = np.frombuffer(b"".join(c for _, c in rows), np.uint16).reshape(len(rows), TERMS).astype(np.float32)
        return fit_counts(counts, np.array([y for y, _ in rows], np.float64))

    return fitted(labelled.select("text", F.col("label").cast("int")).mapInArrow(run, "label int, counts binary"), make)


def score(docs: DataFrame, model: Model, cut_at: float = CUT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ``score`` and ``predicted`` of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column(1), 1 << 19):
                for at in range(0, j - i, 512):
                    to = min(at + 512, j - i)
                    s = told.value.scores(term_counts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + at, to - at), pa.array(s), pa.array((s >= cut_at).astype(np.int32))], names=["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string")).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the score of each row as ``name``; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [told.value.scores(term_counts(data[offsets[at] : offsets[min(at + 512, j - i)]], offsets[at : min(at + 512, j - i) + 1] - offsets[at])) for i, j, data, offsets in text_chunks(b.column(place), 1 << 19) for at in range(0, j - i, 512)]
            if found:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(found))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
