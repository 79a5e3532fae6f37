"""Quality classification with supervised subword embeddings.

A document is the average of learned vectors of its words, adjacent word pairs and character n-grams, all
hashed into fixed tables; a softmax over the classes reads it.  Vectors and output weights are trained by
stochastic gradient descent in numpy on a bounded sample.  Two equal adjacent words share one pair feature
whatever the word.  For two classes the output is a function of one number per table row, so scoring looks
up a single weight per n-gram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, fresh, quoted, with_computed
from phylospan.llm.labelled import fold, prior_shift, training_sample

#: log2 of the rows for character n-grams and for words with their pairs.
CHAR_BITS, WORD_BITS = 16, 16
CHAR_SIZES = (3, 4)
DIM = 8
EPOCHS = 6
RATE = 4.0
#: Training documents of each class at most.
PER_CLASS = 1500
THRESHOLD = 0.3
HELD_OUT = (5, 0)
SEED = 7
#: Bytes hashed at once; a longer text is taken in pieces, cut at white space where there is any.
PIECE = 1 << 20

#: The row of every pair of equal adjacent words; words and other pairs come after it.
_REPEAT = 1 << CHAR_BITS
_ROWS = _REPEAT + (1 << WORD_BITS)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n, 1 << 14), base, np.uint64)])
    return [p[:n] for p in _powers]


def _pieces(data: bytes):
    lo = 0
    while len(data) - lo > PIECE:
        cut = max(data.rfind(b" ", lo + PIECE // 2, lo + PIECE), data.rfind(b"\n", lo + PIECE // 2, lo + PIECE))
        cut = lo + PIECE if cut < 0 else cut
        yield data[lo:cut]
        lo = cut
    yield data[lo:]


def features(data: bytes) -> np.ndarray:
    """Table rows of a UTF-8 text's n-grams, repeats included: bytes in runs of 3 and 4, words, word pairs."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    x = b.astype(np.uint32)
    three = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16)) if len(x) > 2 else x[:0]
    four = three[:-1] | (x[3:] << np.uint32(24)) if len(x) > 3 else x[:0]
    four = (four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - CHAR_BITS)
    out = [(three * np.uint32(0x9E3779B1) >> shift).astype(np.int32), (four >> shift).astype(np.int32)]
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if len(start):
        power, inverse = _power(len(b))
        total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)  # wraps; differences are right
        word = (total[end - 1] - total[start - 1]) * inverse[start]
        word = (word ^ (word >> np.uint64(29))) * _MIX
        size = np.uint64((1 << WORD_BITS) - 1)
        out.append((_REPEAT + 1 + (word >> np.uint64(20)) % size).astype(np.int32))
        pair = (word[:-1] * np.uint64(31) + word[1:]) * _MIX
        out.append(np.where(word[:-1] == word[1:], _REPEAT, _REPEAT + 1 + (pair >> np.uint64(20)) % size).astype(np.int32))
    return np.concatenate(out)


class QualityModel:
    """Learned table rows ``vectors``, output weights and biases of two classes."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray, shift: float = 0.0):
        self.vectors, self.output, self.bias = vectors, output, bias
        #: The softmax of two classes needs only the difference of their scores.
        self.weight = (vectors @ (output[1] - output[0])).astype(np.float64)
        self.base = float(bias[1] - bias[0] + shift)

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for piece in _pieces((text or "").encode()):
            if piece:
                w = self.weight[features(piece)]
                total, n = total + float(w.sum()), n + len(w)
        z = self.base + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[str], labels: np.ndarray, share: float, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent on cross-entropy, one document at a time, the rate falling to zero.

    ``share`` is the share of label 1 among all labelled rows, to which the sample's is corrected.  With no
    or one label among the rows the score is the share everywhere.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (_ROWS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    if len(set(labels.tolist())) < 2:
        return QualityModel(vectors, output, bias, prior_shift(0.5, share))
    docs = []
    for t in texts:
        rows = [features(p) for p in _pieces(t.encode()) if p]
        ids, count = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.int32), np.empty(0, int))
        docs.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, part = docs[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = part @ vectors[ids]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output.T @ p
            output -= lr * p[:, None] * hidden
            bias -= 0.1 * lr * p
            # a row's gradient has its share in the document; it is lifted to move rare n-grams too
            vectors[ids] -= (lr * np.sqrt(part))[:, None] * back
    return QualityModel(vectors, output, bias, prior_shift(labels.mean(), share))


def train_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT) -> QualityModel:
    """A model from at most ``per_class`` labelled documents of each class outside the held-out fold."""
    return train(*training_sample(docs, labels, "quality", *held_out, per_class, id_col, text_col))


def _scorer(model):
    """Only the one weight per row travels to the executors."""
    weight, base = model.value if hasattr(model, "value") else model

    def score(text):
        slim = object.__new__(QualityModel)
        slim.weight, slim.base = weight, base
        return slim.score(text)

    return score


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Only the text enters the score.  Null and empty texts have the score of no evidence; a null id has a
    null ``held_out``; repeated rows repeat; other columns are ignored; an empty table gives an empty one.  Of a
    very long text all words and n-grams count.  No shuffle.
    """
    packed = docs.sparkSession.sparkContext.broadcast((model.weight, model.base))  # 1 MB, whatever the input

    def setup():
        score = _scorer(packed)

        def row(doc_id, out, text):
            s = score(text)
            return doc_id, out, s, int(s >= threshold)

        return row

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return each_row(rows, setup, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a quality score of at least ``threshold``, all columns, whatever their names, as they are.

    Null and empty texts have one and the same score, repeated rows stay or go together, ids are not looked at; an
    empty table gives an empty one.  No shuffle.
    """
    packed = docs.sparkSession.sparkContext.broadcast((model.weight, model.base))
    name = fresh(docs, "quality_score")

    def setup():
        score = _scorer(packed)
        return lambda text: (score(text),)

    return with_computed(docs, [text_col], setup, f"`{name}` double").where(F.col(name) >= threshold).select(*map(quoted, docs.columns))
