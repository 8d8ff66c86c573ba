"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A text longer than ``chunk_bytes`` is encoded as chunks that overlap.  Two neighbouring encodings are spliced
at a *proven stable* boundary inside the overlap: both encodings end a token there, the byte before it is no
space and the byte at it is one.  The proof is a property of the vocabulary, checked when the model is loaded:
no piece holds a space after another character, and a merge always makes a piece of the vocabulary, so no merge
ever crosses such a place, and what stands on one side cannot change the tokens of the other.  Where an overlap
has no such boundary, the left chunk is widened (doubled) until one is found or the text ends.  If a vocabulary
lacks the property, texts are encoded whole.

Null and empty texts have 0 tokens.  Repeated rows and ids give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

CHUNK_BYTES = 16384
OVERLAP_BYTES = 512
CONTEXT_LIMIT = 4096
_MARK = "▁"
_loaded: dict[str, PieceCounter] = {}


def splice_counts(data: bytes, boundaries: Callable[[bytes], np.ndarray], chunk: int, overlap: int) -> int:
    """Tokens of ``data`` (UTF-8).  ``boundaries`` gives the byte at which each token of a piece of text ends."""
    n = len(data)
    start, known, total = 0, -1, 0  # the chunk's first byte; the boundary up to which tokens are counted; their number; the first token can be the lone space that ends at 0
    size = chunk
    ends = None
    while True:
        stop = _char_start(data, min(n, start + size))
        if ends is None:
            ends = boundaries(data[start:stop]) + start
        if stop >= n:
            return total + int(np.count_nonzero(ends > known))
        nxt = _char_start(data, max(known + 1, stop - overlap))
        follow_stop = _char_start(data, min(n, nxt + chunk))
        after = boundaries(data[nxt:follow_stop]) + nxt
        common = np.intersect1d(ends[(ends > max(known, nxt)) & (ends < stop)], after)
        stable = [b for b in common.tolist() if data[b] == 32 and data[b - 1] != 32]
        if not stable:  # widen the overlap
            size, ends = 2 * size, None
            overlap = max(overlap, size // 4)
            continue
        cut = stable[len(stable) // 2]
        total += int(np.count_nonzero((ends > known) & (ends <= cut)))
        start, known, size, ends = nxt, cut, chunk if follow_stop < n else n - nxt, after
        overlap = min(overlap, chunk // 4)


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class PieceCounter:
    """Counts the tokens of a sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.sizes = np.array([1 if self.model.is_byte(i) else len(p.replace(_MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        inner = any(_MARK in p.lstrip(_MARK) for p in pieces)
        #: Texts may be cut where the proof holds and the pieces' sizes add up to the text (no other normalisation).
        self.stable = not inner and self._adds_up("a  bé\n\t ▁c ﬁ x") and self._adds_up("  a")

    def _adds_up(self, text: str) -> bool:
        data = text.replace(_MARK, " ").encode()
        return int(self.sizes[self.model.encode(text)].sum()) - 1 == len(data)

    def ends(self, data: bytes) -> np.ndarray:
        """The model puts one space before a text; it is taken off the places again."""
        return np.cumsum(self.sizes[self.model.encode(data.decode())]) - 1

    def counts(self, texts: list[str], chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[int]:
        out = [0] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if self.stable and len(t) * 4 > chunk and len(data := t.replace(_MARK, " ").encode()) > chunk:
                out[i] = splice_counts(data, self.ends, chunk, overlap)
            elif t:
                short.append(i)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1) if short else [], strict=True):
            out[i] = len(ids)
        return out


def counter(model: str) -> PieceCounter:
    if model not in _loaded:
        _loaded[model] = PieceCounter(model)
    return _loaded[model]


def token_counts(docs: DataFrame, model: str, limit: int = CONTEXT_LIMIT, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: its key, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                n = np.array(c.counts(texts, chunk_bytes, overlap_bytes), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].cast("string")).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
