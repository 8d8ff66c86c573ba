"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word (a run of bytes other than white space, with ASCII signs at its ends taken off, in lower case) enters as a word
vector and a character vector: the first from a hashed table, the second the maximum, per dimension, of the vectors of
its hashed byte n-grams of 3 to 5 with marks at both ends, so words unseen in training still carry their parts.  The
network reads windows of ``WINDOW`` words every ``STRIDE`` words, which overlap and cover the whole text, in both directions; a
softmax over the hidden states pools them, and a linear layer gives the window's logit.  A document's logit is its
highest window's, mapped to a score by a monotone calibration.

Training is multiple-instance learning on a bounded sample of labelled texts (``SAMPLE``, pieces of at most ``FIT_CHARS`` characters).
The first epochs read all windows of toxic texts, which share their text's weight; the others the highest window of each, and of
the clean texts the highest and some other windows.  Words and n-grams of fewer than ``LEAST_TEXTS`` sampled texts have no vector.  A fifth
of the sample takes no part: on it, each text weighed by the labels it stands for, the threshold of best F1 comes to lie at ``CUT``.

Null and empty texts are one window without words, and get the score of its bias.  Very long texts are scored in whole, some windows
at a time.  Without labels of both kinds, or for an empty table of them, all scores are 0.  An empty table gives no rows.  Labels, language,
source and ids are no inputs, so other columns and their names don't matter.  Repeated rows get equal scores; ties in a pool or between
windows change nothing, as only the highest value counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, fitted, give_back, mix, small_batches, span_hashes, text_chunks, tidy

SAMPLE = {0: 2600, 1: 1300}
FIT_CHARS = 8000
WINDOW = 24
STRIDE = 16
HIDDEN = 8
WIDTH = 8
WORD_ROWS = 1 << 16
GRAM_ROWS = 1 << 16
GRAMS = (3, 4, 5)
#: Distinct words whose n-grams are made at a time.
GRAM_WORDS = 16_384
#: Bytes of texts whose words are found at a time.
BLOCK_BYTES = 1 << 19
EPOCHS = 8
#: Epochs on all windows of toxic texts, before their highest ones are known.
ALL_WINDOWS = 3
RATE = 0.02
TABLE_RATE = 0.2
#: Share of words that a batch reads without their own vectors, so that their characters have to tell.
WORD_DROPOUT = 0.5
#: Sampled texts that must hold a word or an n-gram for it to have a vector.
LEAST_TEXTS = 4
CUT = 0.3
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


# ------------------------------------------------------------------------------------------------ words


class Vocabulary:
    """The distinct words of some texts: their word rows, their n-gram rows (``grams`` from ``first`` on), and the words in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, hashes, counts = [], [], [], []
        lo = 0
        while lo < len(offsets) - 1:  # some texts at a time, as masks take several bytes for each of theirs
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1)
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            start, end = words.start.copy(), words.end.copy()
            for _ in range(4):  # signs at the ends, four at most on each side; a word keeps one character
                lead = (end - start > 1) & _SIGN[words.data[start]] if len(start) else np.zeros(0, bool)
                start[lead] += 1
                trail = (end - start > 1) & _SIGN[words.data[end - 1]] if len(start) else np.zeros(0, bool)
                end[trail] -= 1
            hashes.append(span_hashes(words.data, start, end))
            starts.append(start + offsets[lo])
            ends.append(end + offsets[lo])
            counts.append(words.count)
            lo = hi
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        start, end, h, self.count = join(starts), join(ends), join(hashes), join(counts)
        size = end - start
        self.words = len(start)
        if not self.words:
            self.order, self.row, self.grams, self.first = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
            return
        distinct, one, order = np.unique(h, return_index=True, return_inverse=True)
        self.order = order.astype(np.int32)
        self.row = (distinct % np.uint64(WORD_ROWS)).astype(np.int64)
        # n-grams of the distinct words between two marks, some words at a time
        size, first = size[one], start[one]
        del start, end, h, order
        found = [self._grams(data, first[at : at + GRAM_WORDS], size[at : at + GRAM_WORDS]) for at in range(0, len(one), GRAM_WORDS)]
        self.grams = np.concatenate([g for g, _ in found])
        count = np.concatenate([n for _, n in found])
        self.first = np.cumsum(count) - count  # each word has a 3-gram at least

    @staticmethod
    def _grams(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram rows of some words, word by word, and how many each has."""
        long = size + 2
        at = np.cumsum(long) - long
        marked = np.full(int(long.sum()), 1, np.uint64)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(at, size) + 1 + place] = _LOWER[data[np.repeat(first, size) + place]]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), long)
        left = np.repeat(at + long, long) - np.arange(len(marked))  # bytes from here to the word's end
        found, owners = [], []
        for n in GRAMS:
            ok = np.flatnonzero(left >= n)
            g = np.zeros(len(ok), np.uint64)
            for k in range(n):
                g = g * np.uint64(257) + marked[ok + k]
            found.append((mix(g * np.uint64(8) + np.uint64(n)) % np.uint64(GRAM_ROWS)).astype(np.int32))
            owners.append(owner[ok])
        grams, owners = np.concatenate(found), np.concatenate(owners)
        return grams[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(size))


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (over all words of the texts) and length of each window; a text without words has an empty one."""
    n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(count) - count
    return doc, base[doc] + k * STRIDE, np.clip(count[doc] - k * STRIDE, 0, WINDOW)


# ------------------------------------------------------------------------------------------------ network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters: tables ``word`` and ``gram``; for both directions input weights ``wx``, ``bx``, recurrent ``wh``; attention ``va``; output ``vo``, ``bo``."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": normal(WORD_ROWS, WIDTH, s=0.02), "gram": normal(GRAM_ROWS, WIDTH, s=0.02), "wx": normal(2, 2 * WIDTH, 3 * HIDDEN), "bx": np.zeros((2, 3 * HIDDEN), np.float32), "wh": normal(2, HIDDEN, 3 * HIDDEN), "va": normal(2 * HIDDEN), "vo": normal(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        self.known = {"word": np.ones(WORD_ROWS, bool), "gram": np.ones(GRAM_ROWS, bool)}
        self.map = (1.0, 0.0)
        self.trained = False

    def inputs(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray | None]:
        """Vectors of distinct words, and the n-gram that each character dimension came from."""
        g = self.p["gram"][v.grams]
        top = np.maximum.reduceat(g, v.first, axis=0) if len(v.first) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([self.p["word"][v.row], top], axis=1), g

    def vectors(self, v: Vocabulary) -> np.ndarray:
        """``inputs`` without the n-grams, some words at a time."""
        parts = [self.inputs(_Sub(v, np.arange(at, min(at + 20_000, len(v.row)))))[0] for at in range(0, len(v.row), 20_000)]
        return np.concatenate(parts) if parts else np.zeros((0, 2 * WIDTH), np.float32)

    def forward(self, x: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; ``index`` (windows, WINDOW) points into ``x``, -1 after the end of a window."""
        p = self.p
        n, steps = index.shape
        gates = [np.concatenate([x @ p["wx"][d] + p["bx"][d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in (0, 1)]
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((2, steps, n, HIDDEN), np.float32)
        tape = []
        for t in range(steps):
            at = (t, steps - 1 - t)
            a = np.stack([gates[d][index[:, at[d]]] for d in (0, 1)])
            live = np.stack([index[:, at[d]] >= 0 for d in (0, 1)])[..., None]
            u = np.matmul(h, p["wh"])
            zr = 1 / (1 + np.exp(-np.clip(a[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN], -30, 30)))
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(a[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = np.where(live, h + (1 - z) * (c - h), h)
            if keep:
                tape.append((h, z, r, c, u[..., 2 * HIDDEN :], live))
            h = new
            for d in (0, 1):
                out[d, at[d]] = h[d]
        attention = out[0] @ p["va"][:HIDDEN] + out[1] @ p["va"][HIDDEN:]
        attention = np.where((np.arange(steps)[:, None] < np.maximum(size, 1)[None, :]), attention, -1e9)
        attention = np.exp(attention - attention.max(0))
        attention /= attention.sum(0)
        value = out[0] @ p["vo"][:HIDDEN] + out[1] @ p["vo"][HIDDEN:]
        logit = (attention * value).sum(0) + p["bo"][0]
        return (logit, out, attention, value, tape) if keep else logit

    def gradients(self, x: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the weighted cross entropy by the network's parameters and by ``x``."""
        p, steps = self.p, index.shape[1]
        logit, out, attention, value, tape = self.forward(x, index, size, keep=True)
        prob = _sigmoid(logit)
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())
        dl = (weight * (prob - y) / weight.sum()).astype(np.float32)
        both = np.concatenate([out[0], out[1]], axis=2)
        da = attention * (value - (logit - p["bo"][0])) * dl
        dv = attention * dl
        g = {"va": np.einsum("tnk,tn->k", both, da), "vo": np.einsum("tnk,tn->k", both, dv), "bo": dl.sum(keepdims=True)}
        dout = da[..., None] * p["va"] + dv[..., None] * p["vo"]
        g |= {k: np.zeros_like(p[k]) for k in ("wx", "bx", "wh")}
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        dh = np.zeros((2, len(y), HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, un, live = tape[t]
            at = (t, steps - 1 - t)
            dh = dh + np.stack([dout[at[d], :, d * HIDDEN : (d + 1) * HIDDEN] for d in (0, 1)])
            act = dh * live
            dc = act * (1 - z) * (1 - c * c)
            dz = act * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            da_in = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            dh = dh * (1 - live) + act * z + np.matmul(du, p["wh"].transpose(0, 2, 1))
            for d in (0, 1):
                where = index[:, at[d]]
                g["wh"][d] += h[d].T @ du[d]
                g["wx"][d] += padded[where].T @ da_in[d]
                g["bx"][d] += da_in[d].sum(0)
                np.add.at(dx, where, da_in[d] @ p["wx"][d].T)
        return g, dx[:-1], loss

    def logits(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        x = self.vectors(v)
        doc, first, size = windows(v.count)
        out = np.empty(len(doc), np.float32)
        for at in range(0, len(doc), 2048):
            out[at : at + 2048] = self.forward(x, _index(v, first[at : at + 2048], size[at : at + 2048]), size[at : at + 2048])
        return doc, out

    def scores(self, v: Vocabulary) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(v.count))
        return self.calibrated(_highest(self, v))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        slope, shift = self.map
        return _sigmoid(slope * logit.astype(np.float64) + shift)


def _index(v: Vocabulary, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    steps = np.arange(WINDOW)
    at = first[:, None] + steps
    inside = steps < size[:, None]
    return np.where(inside, v.order[np.minimum(at, max(v.words - 1, 0))] if v.words else -1, -1)


# ------------------------------------------------------------------------------------------------ training


def _seen(v: Vocabulary, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word rows and which n-gram rows occur in ``least`` texts or more."""
    counts = [np.zeros(n, np.int64) for n in (WORD_ROWS, GRAM_ROWS)]
    ends = np.cumsum(v.count)
    for e, n in zip(ends, v.count, strict=True):
        if n:
            words = np.unique(v.order[e - n : e])
            counts[0][np.unique(v.row[words])] += 1
            counts[1][np.unique(_Sub(v, words).grams)] += 1
    return counts[0] >= least, counts[1] >= least


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = EPOCHS, seed: int = 2) -> Network:
    """A network that has seen all texts but every fifth, which only set its threshold."""
    net = Network(seed)
    weights = np.ones(len(texts)) if weights is None else weights
    if not len(texts) or labels.min() == labels.max():
        return net
    rng = np.random.default_rng(seed + 1)
    order = np.random.default_rng(seed).permutation(len(texts))
    order = order[np.argsort(labels[order], kind="stable")]  # each part gets its share of both labels
    held = order[::5]
    used = np.sort(np.setdiff1d(order, held)) if len(np.unique(labels[np.setdiff1d(order, held)])) == 2 else np.sort(order)
    v, y = _vocabulary([texts[i] for i in used]), labels[used].astype(np.int64)
    give_back()
    # What only a few texts hold has no vector: it would tell the texts, not the label.
    for name, seen in zip(("word", "gram"), _seen(v, LEAST_TEXTS), strict=True):
        net.p[name][~seen] = 0
        net.known[name] = seen
    # A maximum over n-grams can only tell what is there, so the network begins as one in which more input means a higher logit.
    net.p["wx"][:, :, 2 * HIDDEN :] = np.abs(net.p["wx"][:, :, 2 * HIDDEN :])
    net.p["va"], net.p["vo"] = np.abs(net.p["va"]), np.abs(net.p["vo"])
    trainer = _Trainer(net, rng)
    epochs = epochs * min(6, max(1, round(3000 / len(texts))))  # few texts are read more often
    for epoch in range(epochs):
        trainer.epoch(v, y, epoch, RATE * (1 - 0.8 * epoch / epochs))
    net.trained = True
    tested = _vocabulary([texts[i] for i in held]), labels[held]
    if len(np.unique(tested[1])) < 2:
        held, tested = used, (v, y)
    _calibrate(net, _highest(net, tested[0]), tested[1], weights[held])
    return net


class _Trainer:
    """Adam on the network's own weights, Adagrad on the rows of the tables."""

    def __init__(self, net: Network, rng: np.random.Generator):
        self.net, self.rng, self.step = net, rng, 0
        self.moments = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in net.p.items() if k not in ("word", "gram")}
        self.squares = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "gram")}

    def epoch(self, v: Vocabulary, y: np.ndarray, number: int, rate: float) -> None:
        """One pass: at first over all windows of toxic texts, which share their text's weight, then over the highest one of each."""
        net, rng = self.net, self.rng
        doc, first, size = windows(v.count)
        starts = np.searchsorted(doc, np.arange(len(y)))
        ends = np.append(starts[1:], len(doc))
        others = np.flatnonzero(y[doc] == 0)
        if number < ALL_WINDOWS:
            toxic = np.flatnonzero(y[doc] == 1)
            clean = rng.choice(others, min(len(others), max(2 * len(y), 2 * len(toxic))), replace=False)
            use = np.concatenate([toxic, clean])
            share = np.where(y[doc[use]] == 1, 1 / np.sqrt((ends - starts)[doc[use]]), 1.0)
        else:
            _, top = net.logits(v)
            best = np.array([s + int(np.argmax(top[s:e])) for s, e in zip(starts, ends, strict=True)])
            extra = rng.choice(others, min(len(others), 2 * len(y)), replace=False)
            hard = others[np.argsort(-top[others])[: len(y)]]
            use = np.unique(np.concatenate([best, extra, hard]))
            share = np.ones(len(use))
        mix_up = rng.permutation(len(use))
        use, share = use[mix_up], share[mix_up]
        toxic = y[doc[use]] == 1
        lift = max(1.0, share[~toxic].sum() / max(1e-9, share[toxic].sum()) / 2)
        for at in range(0, len(use), 256):
            part = use[at : at + 256]
            target = y[doc[part]].astype(np.float32)
            self.batch(v, _index(v, first[part], size[part]), size[part], target, (share[at : at + 256] * np.where(target > 0, lift, 1.0)).astype(np.float32), rate)

    def batch(self, v: Vocabulary, index: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        net = self.net
        words, inverse = np.unique(index, return_inverse=True)
        at = inverse.reshape(index.shape) - (words[0] < 0)
        words = words[words >= 0]
        if not len(words):
            return
        sub = _Sub(v, words)
        x, g = net.inputs(sub)
        without = self.rng.random(len(words)) < WORD_DROPOUT
        x[without, :WIDTH] = 0
        grad, dx, _ = net.gradients(x, at, size, target, weight)
        dx[without, :WIDTH] = 0
        self.step += 1
        for k, m in self.moments.items():
            m[0] += 0.1 * (grad[k] - m[0])
            m[1] += 0.01 * (grad[k] ** 2 - m[1])
            net.p[k] -= (rate * (m[0] / (1 - 0.9**self.step)) / (np.sqrt(m[1] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
        # The character gradient goes to the n-gram that gave the maximum.
        per = np.diff(np.append(sub.first, len(sub.grams)))
        hit = g >= np.repeat(x[:, WIDTH:], per, axis=0)
        for k, rows, d in (("word", sub.row, dx[:, :WIDTH]), ("gram", sub.grams, np.repeat(dx[:, WIDTH:], per, axis=0) * hit)):
            ids, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(total, back, d)
            total[~net.known[k][ids]] = 0
            self.squares[k][ids] += (total**2).mean(1)
            net.p[k][ids] -= TABLE_RATE * total / np.sqrt(self.squares[k][ids])[:, None]


class _Sub:
    """Some words of a vocabulary."""

    def __init__(self, v: Vocabulary, words: np.ndarray):
        ends = np.append(v.first, len(v.grams))
        per = ends[words + 1] - ends[words]
        self.row = v.row[words]
        self.first = np.cumsum(per) - per
        self.grams = v.grams[np.repeat(v.first[words], per) + np.arange(int(per.sum())) - np.repeat(self.first, per)]


def _vocabulary(texts: list[str]) -> Vocabulary:
    data = [t.lower().encode() for t in texts]
    return Vocabulary(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))


def _highest(net: Network, v: Vocabulary) -> np.ndarray:
    doc, logit = net.logits(v)
    return np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(v.count)))).astype(np.float64)


def _calibrate(net: Network, z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Put the threshold of best F1 at ``CUT``; each sampled text counts as the labelled rows that it stands for."""
    order = np.argsort(-z)
    hits = np.cumsum((labels * weights)[order])
    wrong = np.cumsum(((1 - labels) * weights)[order])
    f1 = 2 * hits / (hits + wrong + (labels * weights).sum())
    best = int(np.argmax(f1))
    top = z[order]
    at = (top[best] + top[min(best + 1, len(top) - 1)]) / 2
    slope = min(2.0, max(0.5, 4.0 / max(1e-3, float(np.std(z)))))
    net.map = (slope, float(np.log(CUT / (1 - CUT)) - slope * at))


# ------------------------------------------------------------------------------------------------ on tables


def fit(labelled: DataFrame) -> Network:
    """Train on a bounded sample (text, label, weight), in one executor task.

    A text beyond ``FIT_CHARS`` gives one piece of so many characters, chosen by its hash, if it is clean; a toxic one is left
    out, as its piece may be clean.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    piece = F.pmod(F.xxhash64(text), F.ceil(n / FIT_CHARS)).cast("int")
    rows = labelled.filter((n <= FIT_CHARS) | (F.col("label") == 0)).select(F.substr(text, piece * FIT_CHARS + 1, F.lit(FIT_CHARS)).alias("text"), F.col("label").cast("int").alias("label"), weight.cast("double").alias("weight"))

    def make(table: pa.Table) -> Network:
        found = sorted(zip(*(table.column(k).to_pylist() for k in range(3)), strict=True))
        return train([t for t, _, _ in found], np.array([y for _, y, _ in found], np.int64), np.array([w for _, _, w in found]))

    return fitted(rows, make)


def score(docs: DataFrame, net: Network, cut_at: float = CUT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ``score`` and ``predicted`` of each row, over all windows of its whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(net)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column(1)):
                s = told.value.scores(Vocabulary(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= cut_at).astype(np.int32))], names=["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), F.lower(docs[text].cast("string"))).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, net: Network, cut_at: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut_at``, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(net)
    n = len(docs.columns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [told.value.scores(Vocabulary(data, offsets)) < cut_at for _, _, data, offsets in text_chunks(b.column(n))]
            if keep:
                yield b.select(range(n)).filter(pa.array(np.concatenate(keep)))

    return docs.select("*", F.lower(docs[text].cast("string")).alias("__low")).mapInArrow(run, docs.schema)
