"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary documents, one on the fragments of toxic
documents that ordinary text does not share.  Every window of a text is compressed twice, with the ordinary
dictionary and with the same one behind the toxic one, so that what the two have in common lies at the same
distance and cancels; the bytes saved by the toxic part are the window's distance.  A document's evidence is how many of its
windows pass saving thresholds, by number and by share, with the mean and the largest saving; logistic
weights calibrated on documents that the dictionaries have not seen turn it into a probability.
"""

from __future__ import annotations

import re
import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, fresh, quoted, with_computed
from phylospan.llm.labelled import fold, logistic, training_sample

#: Bytes in a window at most; windows end at white space where there is any.
WINDOW = 48
#: Bytes of the ordinary and of the toxic dictionary.
ORDINARY, TOXIC = 6 << 10, 2 << 10
#: Training documents at most: toxic and ordinary ones.
PER_CLASS = (1600, 4800)
#: A fragment is made of runs of so many bytes that so many times the share of toxic documents have, so many
#: times as often in proportion to text, found in at least
#: this share of toxic documents; of a document so many occurrences count.
RUNS, TIMES, OFTEN, LEAST, AT_MOST = (4, 8), 15, 30, 0.01, 8
THRESHOLD = 0.3
HELD_OUT = (4, 2)
#: Savings in bytes that windows are counted by.
SAVINGS = (1, 2, 4, 6)

_cut = re.compile(rb"(?s).{1,%d}(?=[\x20\t-\r]|\Z)|.{%d}" % (WINDOW, WINDOW))


def windows(text: str | None) -> list[bytes]:
    """A text's windows in order: joined they are its UTF-8, lower-cased in A-Z."""
    return _cut.findall((text or "").encode().lower())


class ToxicityModel:
    def __init__(self, toxic: bytes, ordinary: bytes, weights, bias: float, mean, scale):
        self.parts = toxic, ordinary, weights, bias, mean, scale
        self.weights, self.bias, self.mean, self.scale = weights, bias, mean, scale
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, by window."""
        cut = windows(text)
        a, b = self.toxic.compress, self.ordinary.compress
        return np.array([len(b(w)) - len(a(w)) for w in cut], np.int64)

    def evidence(self, text: str | None) -> np.ndarray:
        d = self.savings(text)
        n = max(1, len(d))
        over = [int((d >= s).sum()) for s in SAVINGS]
        return np.array([*np.log1p(over), *np.sqrt(np.array(over) / n), d.mean() if len(d) else 0.0, d.max() if len(d) else 0.0])

    def score(self, text: str | None) -> float:
        z = float(((self.evidence(text) - self.mean) / self.scale) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    """A compressor with matches from four bytes on, for windows of some dozen bytes."""
    how = zstd.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=8, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    if not content:
        return zstd.ZstdCompressor(compression_params=how)
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=d, compression_params=how)


def _numbered(data: bytes, n: int) -> np.ndarray:
    """The runs of ``n`` (at most 8) bytes at every position, as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | b[k : k + len(out)]
    return out


def distinct(texts: list[bytes], size: int = 16) -> list[int]:
    """Which texts to learn from: of near copies, which share half of their least hashed runs, the first."""
    kept: list[int] = []
    holders: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        runs = np.unique(_numbered(t, 8)) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
        least = np.sort(runs)[:size].tolist()
        met: dict[int, int] = {}
        for r in least:
            for other in holders.get(r, ()):
                met[other] = met.get(other, 0) + 1
        if not least or max(met.values(), default=0) * 2 < len(least):
            kept.append(k)
            for r in least:
                holders.setdefault(r, []).append(k)
    return kept


def _frequent(texts: list[bytes], n: int, least: float, at_once: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``n`` bytes in at least so many texts, with their number over all texts (at most :data:`AT_MOST` a text) and of texts."""
    runs, often, spread = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    for lo in range(0, len(texts), at_once):
        each = [np.unique(_numbered(t, n), return_counts=True) for t in texts[lo : lo + at_once]]
        counts = [np.minimum(c, AT_MOST).astype(float) for _, c in each]
        old = runs
        runs, place = np.unique(np.concatenate([old, *(r for r, _ in each)]), return_inverse=True)
        often = np.bincount(place, np.concatenate([often, *counts]), len(runs))
        spread = np.bincount(place, np.concatenate([spread, *(np.ones(len(c)) for c in counts)]), len(runs))
    enough = spread >= least
    return runs[enough], often[enough], spread[enough]


def _found_in(texts: list[bytes], n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often given runs are in texts, counted as in :func:`_frequent`, and in how many."""
    often, spread = np.zeros(len(runs)), np.zeros(len(runs))
    for t in texts if len(runs) else ():
        ids = _numbered(t, n)
        at = np.minimum(np.searchsorted(runs, ids), len(runs) - 1)
        place, count = np.unique(at[runs[at] == ids], return_counts=True)
        often[place] += np.minimum(count, AT_MOST)
        spread[place] += 1
    return often, spread


def toxic_fragments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """What each toxic document has that ordinary text hardly shares, joined; documents without any are left out."""
    share = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    covered = [np.zeros(len(t) + 1, np.int32) for t in toxic]
    for n in RUNS:
        runs, often, spread = _frequent(toxic, n, max(3, LEAST * len(toxic)))
        known_often, known_spread = _found_in(ordinary, n, runs)
        rich = runs[(spread * len(ordinary) >= TIMES * len(toxic) * (known_spread + 1)) & (often >= OFTEN * share * (known_often + 1))]
        for t, c in zip(toxic, covered):
            start = np.flatnonzero(np.isin(_numbered(t, n), rich))
            np.add.at(c, start, 1)
            np.add.at(c, start + n, -1)
    out = []
    for t, c in zip(toxic, covered):
        kept = np.frombuffer(t, np.uint8)[np.cumsum(c)[:-1] > 0].tobytes()
        if len(kept) >= 8:
            out.append(kept)
    return out


def train(texts: list[str], labels: np.ndarray, share: float) -> ToxicityModel:
    """Dictionaries from every other document of a class, calibration on the others.

    With no or one label among the rows, or too little text for a dictionary, the score is the share of
    label 1 everywhere.
    """
    none = np.zeros(2 * len(SAVINGS) + 2)
    share = min(max(share, 1e-3), 1 - 1e-3)
    flat = ToxicityModel(b"", b"", none, float(np.log(share / (1 - share))), none, none + 1)
    if min((labels == 0).sum(), (labels == 1).sum()) < 8:
        return flat
    half = np.zeros(len(labels), bool)
    for y in (0, 1):
        half[np.flatnonzero(labels == y)[::2]] = True
    ordinary, toxic = ([texts[k].encode().lower() for k in np.flatnonzero(half & (labels == y))] for y in (0, 1))
    ordinary, toxic = ([t[k] for k in distinct(t)] for t in (ordinary, toxic))
    try:
        common = zstd.train_dictionary(ORDINARY, [w for t in ordinary for w in _cut.findall(t)], k=32, d=6, level=3).as_bytes()
        own = zstd.train_dictionary(TOXIC, toxic_fragments(toxic, ordinary), k=16, d=6, level=3).as_bytes()
    except zstd.ZstdError:
        return flat
    model = ToxicityModel(own + common, common, none, 0.0, none, none + 1)
    rest = np.flatnonzero(~half)
    fitted = logistic(np.array([model.evidence(texts[k]) for k in rest]), labels[rest].astype(float), share)
    return ToxicityModel(own + common, common, *fitted)


def train_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = PER_CLASS, held_out: tuple[int, int] = HELD_OUT) -> ToxicityModel:
    """A model from at most ``per_class`` toxic and ordinary documents outside the held-out fold."""
    return train(*training_sample(docs, labels, "toxic", *held_out, per_class, id_col, text_col))


def _scorer(broadcast):
    model = ToxicityModel(*broadcast.value)
    return model.score


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Only the text enters the score; every window of it is compressed.  Null and empty texts have the score of
    no evidence; a null id has a null ``held_out``; repeated rows repeat; other columns are ignored; an empty table
    gives an empty one.  Of a very long text every window counts.  No shuffle.
    """
    parts = docs.sparkSession.sparkContext.broadcast(model.parts)  # two dictionaries of some KB

    def setup():
        score = _scorer(parts)

        def row(doc_id, out, text):
            s = score(text)
            return doc_id, out, s, int(s >= threshold)

        return row

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return each_row(rows, setup, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a toxicity score below ``threshold``, all columns, whatever their names, as they are.

    Null and empty texts have the score of no evidence, repeated rows stay or go together, ids are not looked at; an
    empty table gives an empty one.  No shuffle.
    """
    parts = docs.sparkSession.sparkContext.broadcast(model.parts)
    name = fresh(docs, "toxicity_score")

    def setup():
        score = _scorer(parts)
        return lambda text: (score(text),)

    return with_computed(docs, [text_col], setup, f"`{name}` double").where(F.col(name) < threshold).select(*map(quoted, docs.columns))
