"""Hard negatives by angular triangle filtering.

Every row stores its integer vector, its norm and its angles to a few reference directions.  By the triangle
inequality on the sphere the angle between two vectors lies between the difference of their angles to a
reference and their sum (or what the sum lacks to a full turn); cosines of these ends times the norms, widened
for rounding, bound the score.  In a block of rows sorted by the angle to a reference the rows whose bounds
overlap the wanted scores are one window, found by binary search; of all references the one with the
shortest window is taken, and only its rows are scored, in integers.

Anchors are cut into blocks and rows into slices; a task meets one block with one slice, streaming the
slice's rows and keeping the best few of each anchor, whose worst narrows the next window.  The first pass
finds the positives, the second the negatives in the windows that the positives' scores set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.llm.common import written
from phylospan.shipping import ship

SCALE, EVERY, RELABEL, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Negative scores lie between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Reference directions of a length of vectors, and rows of the sample that they are fitted on; results do not depend on it.
REFERENCES, SAMPLE = 32, 2048
#: Anchors in a block and rows in a slice, on average.
ANCHORS, ROWS = 8192, 8192
#: Radians, and shares of the norms' product, by which bounds are widened for rounding.
SLACK, SHARE = 1e-6, 1e-9

#: A window that leaves out less than this share of a block is widened to the block, which needs no gathering.
NARROW = 0.125
#: Whole numbers below these are exact in floating point of 32 and of 64 bits, and in a long.  No part of a sum of
#: products is larger than the product of the norms.
_SINGLE, _EXACT, _LONG = float(1 << 24), float(1 << 53), 1 << 63


def fit_references(vectors: np.ndarray, k: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Unit directions that lie near the vectors: the farthest ones first, then means of the nearest."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.zeros((0, vectors.shape[1]))
    chosen, near = [unit[0]], unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(unit[int(near.argmin())])
        near = np.maximum(near, unit @ chosen[-1])
    out = np.array(chosen)
    for _ in range(rounds):
        sums = np.zeros_like(out)
        np.add.at(sums, (unit @ out.T).argmax(axis=1), unit)
        size = np.linalg.norm(sums, axis=1)
        out = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-300)[:, None], out)
    return out


class _Angles:
    """Integer vectors with norms and angles to the references of their length."""

    def __init__(self, references):
        self.references = references

    def __call__(self, batches):
        references = self.references.value
        for batch in batches:
            rows = [{"q": None}] * batch.num_rows
            for k, vector in enumerate(batch.column(2).to_pylist()):
                with np.errstate(over="ignore"):
                    q = np.floor(SCALE * np.array(vector, np.float64))
                if np.isfinite(q).all():
                    top = max(1.0, float(np.abs(q).max(initial=0)))
                    size = float(np.linalg.norm(q / top))
                    ref = references.get(len(q))
                    theta = np.zeros(0 if ref is None else len(ref)) if not size or ref is None else np.arccos(np.clip(ref @ (q / top / size), -1, 1))
                    rows[k] = {"q": q, "norm": size * top, "theta": theta}
            kept = [k for k, r in enumerate(rows) if r["q"] is not None and np.isfinite(r["norm"])]
            fields = {"q": pa.list_(pa.float64()), "norm": pa.float64(), "theta": pa.list_(pa.float64())}
            head = [batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([rows[k][f] for k in kept], t) for f, t in fields.items())], names=["vec_id", "label", *fields])


def stored_angles(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The written table ``(row, vec_id, label, dim, q, norm, theta)`` of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    taking = vectors.where(vec_id.isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
    moved = F.when(vec_id % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    rows = taking.select(vec_id.alias("vec_id"), moved.alias("label"), v.alias("v"))
    sample: dict[int, list] = {}
    for (x,) in rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect():
        sample.setdefault(len(x), []).append(np.clip(x, -1e100, 1e100))
    spark = vectors.sparkSession
    ship(spark)
    references = spark.sparkContext.broadcast({n: fit_references(np.array(x, np.float64)) for n, x in sample.items() if n})
    angled = rows.mapInArrow(_Angles(references), "vec_id long, label long, q array<double>, norm double, theta array<double>")
    return written(angled.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("q").alias("dim"), "q", "norm", "theta"), "angles")


def integer_scores(q: np.ndarray, norm: float, rows: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products of a whole-number vector with others of at most a norm, and which of them a 64-bit integer
    holds (None for all)."""
    size = norm * most * (1 + 1e-6) + 1
    if size < (_SINGLE if rows.dtype == np.float32 else _EXACT):
        return (rows @ q.astype(rows.dtype)).astype(np.int64), None
    exact = [sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows]
    fits = np.array([-_LONG <= s < _LONG for s in exact], bool)
    return np.array([s if ok else 0 for s, ok in zip(exact, fits)], np.int64), fits


class Block:
    """Rows of equal length, each reference's order of their angles, and the windows in it."""

    def __init__(self, q, norm, theta, label, vec_id, row):
        self.q, self.norm, self.theta, self.label, self.vec_id, self.row = q, norm, theta, label, vec_id, row
        self.most = float(norm.max(initial=0))
        self.single = q.astype(np.float32) if self.most < _SINGLE else q
        self.least = float(norm.min()) if len(norm) else 0.0
        self.order = np.argsort(theta, axis=0, kind="stable")
        self.sorted = np.take_along_axis(theta, self.order, axis=0)

    def _angle(self, score: float, norm: float, near: bool) -> float | None:
        """The widest angle at which a row can reach a score (``near``), or up to which each row is above it."""
        slack = SHARE * norm * self.most + 1
        score = score - slack if near else score + slack
        others = (self.most if score > 0 else self.least) if near else (self.least if score > 0 else self.most)
        size = norm * others
        if size <= 0:
            return None
        c = score / size
        if near:
            return np.pi if c <= -1 else None if c > 1 else float(np.arccos(c))
        return 0.0 if c >= 1 else float(np.arccos(max(c, -1.0)))

    def window(self, theta: np.ndarray, norm: float, low: float, high: float) -> np.ndarray | slice:
        """Positions of the rows whose score with a vector may lie in ``low .. high``; a slice for the whole block."""
        n, k = self.theta.shape
        if not n:
            return np.zeros(0, np.int64)
        if not k or not norm or not self.most or not self.least:  # no angles are known
            return slice(0, n)
        far = np.pi if low == -np.inf else self._angle(low, norm, True)
        if far is None:
            return np.zeros(0, np.int64)
        close = 0.0 if high == np.inf else self._angle(high, norm, False)
        best, place = n + 1, (0, 0, n)
        for r in range(k):
            t = float(theta[r])
            left = max(t - far - SLACK, close - t - SLACK)
            right = min(t + far + SLACK, 2 * np.pi - close - t + SLACK)
            lo, hi = int(np.searchsorted(self.sorted[:, r], left, "left")), int(np.searchsorted(self.sorted[:, r], right, "right"))
            if hi - lo < best:
                best, place = max(0, hi - lo), (r, lo, hi)
        r, lo, hi = place
        return slice(0, n) if best > (1 - NARROW) * n else self.order[lo:hi, r]

    def scores(self, q: np.ndarray, norm: float, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray | None]:
        single = norm * self.most * (1 + 1e-6) + 1 < _SINGLE
        return integer_scores(q, norm, (self.single if single else self.q)[at], self.most)


def best_of(score: np.ndarray, vec_id: np.ndarray, n: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``n`` highest scores, ties by the smaller id, with what belongs to them."""
    if len(score) > 4 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        few = np.flatnonzero(score >= least)
        score, vec_id, more = score[few], vec_id[few], tuple(m[few] for m in more)
    order = np.lexsort((vec_id, -score))[:n]
    return (score[order], vec_id[order], *(m[order] for m in more))


class _Meeting:
    """Streams the rows of a slice past a block of anchors; rows come sorted by key, anchors first."""

    KEY = 3

    def __init__(self, positives: bool):
        self.positives = positives
        self.scored = 0

    def __call__(self, batches):
        now, anchors = None, []
        for batch in batches:
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(self.KEY + 1)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                group, side = tuple(int(k[lo]) for k in key[: self.KEY]), int(key[self.KEY][lo])
                if group != now:
                    yield from self.done(anchors)
                    now, anchors = group, []
                part = batch.slice(lo, hi - lo)
                if side == 0:
                    anchors += self.anchors(part)
                elif anchors:
                    self.meet(anchors, part)
        yield from self.done(anchors)

    def arrays(self, part):
        names = part.schema.names
        q, theta = ([np.array(x, np.float64) for x in part.column(names.index(c)).to_pylist()] for c in ("q", "theta"))
        flat = lambda c: part.column(names.index(c)).to_numpy(zero_copy_only=False)
        return np.array(q).reshape(len(q), -1), flat("norm"), np.array(theta).reshape(len(q), -1), flat("label"), flat("vec_id"), flat("row")

    def anchors(self, part):
        q, norm, theta, label, vec_id, row = self.arrays(part)
        windows = part.column(part.schema.names.index("windows")).to_pylist()
        none = np.zeros(0, np.int64)
        out = []
        for k in range(len(q)):
            found = [(none, none)] if self.positives else [(none, none) for _ in windows[k]]
            out.append({"q": q[k], "norm": float(norm[k]), "theta": theta[k], "label": label[k], "row": row[k], "windows": windows[k], "found": found})
        return out

    def meet(self, anchors, part):
        columns = self.arrays(part)
        labels = columns[3]
        blocks: dict[int, Block] = {}

        def block(label) -> Block:
            """The rows of a label; of negatives all rows, whose labels are told apart in the window."""
            if label not in blocks:
                chosen = np.flatnonzero(labels == label) if self.positives else slice(None)
                blocks[label] = Block(*(c[chosen] for c in columns))
            return blocks[label]

        for a in anchors:
            b = block(int(a["label"]) if self.positives else None)
            if self.positives:
                score = a["found"][0][0]
                ends = [float(score[-1]) if len(score) == POSITIVES else -np.inf]
                high = np.inf
            else:
                if not a["windows"]:
                    continue
                ends = [(float(max(w["low"], s[-1])) if len(s) == NEGATIVES else float(w["low"])) for w, (s, _) in zip(a["windows"], a["found"])]
                high = float(max(w["high"] for w in a["windows"]))
            at = b.window(a["theta"], a["norm"], min(ends), high)
            score, fits = b.scores(a["q"], a["norm"], at)
            self.scored += len(score)
            other = b.row[at] != a["row"] if self.positives else b.label[at] != a["label"]
            keep = (score >= min(ends)) & (score <= high) & other
            keep = np.flatnonzero(keep if fits is None else keep & fits)
            score, vec_id = score[keep], b.vec_id[at][keep]
            if self.positives:
                old = a["found"][0]
                a["found"][0] = best_of(np.concatenate((old[0], score)), np.concatenate((old[1], vec_id)), POSITIVES)
                continue
            for k, (w, old) in enumerate(zip(a["windows"], a["found"])):
                inside = (score >= w["low"]) & (score <= w["high"])
                if inside.any():
                    a["found"][k] = best_of(np.concatenate((old[0], score[inside])), np.concatenate((old[1], vec_id[inside])), NEGATIVES)

    def done(self, anchors):
        out = [(a["row"], k, s, i) for a in anchors for k, (score, ids) in enumerate(a["found"]) for s, i in zip(score.tolist(), ids.tolist())]
        for lo in range(0, len(out), 10_000):
            row, window, score, vec_id = zip(*out[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(window, pa.int32()), pa.array(score, pa.int64()), pa.array(vec_id, pa.int64())], names=["anchor", "window", "score", "vec_id"])


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, positives: bool, n: int) -> DataFrame:
    """``(anchor, window, score, vec_id, rank)``: the first ``n`` rows of each anchor's window, over all slices."""
    cols = ["dim", "block", "slice", "side", "row", "vec_id", "label", "q", "norm", "theta", "windows"]
    kind = "array<struct<low:long,high:long>>"
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = anchors.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "slice": every(slices), "side": F.lit(0)})
    right = rows.withColumns({"block": every(blocks), "slice": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slices)).cast("int"), "side": F.lit(1), "windows": F.lit(None).cast(kind)})
    dealt = left.select(cols).unionByName(right.select(cols)).repartition("dim", "block", "slice").sortWithinPartitions("dim", "block", "slice", "side")
    found = dealt.mapInArrow(_Meeting(positives), "anchor long, window int, score long, vec_id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of all anchors in ``vectors``.

    Rows with a null id, a null label, a null vector or null or non-finite components take no part, nor do
    those whose components overflow when scaled.  Vectors of different lengths do not meet, and scores that
    a 64-bit integer cannot hold do not count.  Repeated rows are rows of their own: each is an anchor, and
    other rows to each other; equal scores of equal ids stand side by side.  A zero vector scores 0 with all.
    An anchor without positives, or a positive without negatives, gives no row, and neither does an empty table.  Other
    columns are ignored.
    """
    rows = stored_angles(vectors, id_col, vector_col, label_col)
    is_anchor = F.col("vec_id") % EVERY == 0
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    blocks, slices = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // ROWS))
    anchors = rows.where(is_anchor)
    kind = "array<struct<low:long,high:long>>"
    first = written(_met(anchors.withColumn("windows", F.lit(None).cast(kind)), rows, blocks, slices, True, POSITIVES).select("anchor", (F.col("rank") - 1).alias("window"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # 30 p <= 100 n <= 90 p in whole numbers; of a negative p there is no such n, which gives an empty window
    ten = lambda c, k: F.col(c).cast("decimal(38,0)") * k
    low = F.ceil(ten("positive_score", LOW) / 100).cast("long")
    high = F.floor(ten("positive_score", HIGH) / 100).cast("long")
    ends = F.transform(F.array_sort(F.collect_list(F.struct("window", low.alias("low"), high.alias("high")))), lambda x: F.struct(x.low.alias("low"), x.high.alias("high")))
    windows = first.groupBy(F.col("anchor").alias("row")).agg(ends.alias("windows"))
    found = _met(anchors.join(windows, "row"), rows, blocks, slices, False, NEGATIVES)
    named = found.join(first, ["anchor", "window"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
