"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors are one class with a multiplicity, so copies are never compared.  Each table hashes a class
to the signs of its dot products with a few random hyperplanes; classes that share a bucket in some table
are compared by the cosine of their vectors in double precision.  A pair that shares several buckets is
counted in the first of those tables only, which both members' codes tell.  Bits per table follow the
number of classes, tables follow the wanted recall at the threshold.  A bucket of many classes is cut into
blocks and its pairs of blocks are dealt to tasks, so no task holds more than two blocks.  Links are summed
in the task that finds them: what leaves it is a number of links and a root per class, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, written
from phylospan.llm.components import connected_components
from phylospan.llm.simhash import _forest, _starts
from phylospan.shipping import ship

THRESHOLD = 0.95
#: Share of pairs right at the threshold that at least one table should bring together; closer pairs fare better.
RECALL = 0.995
#: Classes that a bucket has on average where vectors are spread evenly.
BUCKET = 256
#: Classes in a block.
BLOCK = 1024
SEED = 11


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """``(bits per table, tables)`` for ``n`` classes: one bit more for every doubling."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n) / BUCKET))))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    tables = 1 if together >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - together))
    return bits, max(1, tables)


def _usable(vector):
    d = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(d, lambda x: x != 0), F.lit(False))


def _coded(bits: int, tables: int):
    def setup():
        planes: dict[int, np.ndarray] = {}

        def rows(cid, copies, vector):
            v = np.array(vector, np.float64)
            dim = len(v)
            if dim not in planes:
                planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((tables * bits, dim))
            top = np.abs(v).max()
            signs = (planes[dim] @ (v / top) > 0).reshape(tables, bits)
            codes = (signs.astype(np.int64) << np.arange(bits)).sum(axis=1).astype("<u4")
            return cid, copies, vector, dim, codes.tolist()

        return rows

    return setup


class _Compared:
    """Compares whole pairs of blocks, from batches sorted by them; gives links and roots per class."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            starts = _starts(keys)
            if held:
                last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(5)]
                if any(k[0] != v for k, v in zip(keys, last)):
                    yield from self.group(held)
                    held = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield from self.group(held)
                    held = []
        if held:
            yield from self.group(held)

    def group(self, held):
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return
        table, a, b = t["turn"][0].as_py(), t["a"][0].as_py(), t["b"][0].as_py()
        cid, copies, block = (t[c].to_numpy() for c in ("cid", "copies", "block"))
        width = t["dim"][0].as_py()
        values = t["vector"].combine_chunks()
        x = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        codes = np.asarray(t["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(x), -1)[:, :table]
        left = np.flatnonzero(block == a)
        right = left if a == b else np.flatnonzero(block == b)
        links = np.zeros(len(x), np.int64)
        found_i, found_j = [], []
        for lo in range(0, len(left), 128):
            rows = left[lo : lo + 128]
            cos = (x[rows] @ x[right].T) / norm[rows][:, None] / norm[right][None, :]
            i, j = np.nonzero(cos >= self.threshold)
            i, j = rows[i], right[j]
            if a == b:
                keep = i < j
                i, j = i[keep], j[keep]
            if table and len(i):
                new = np.ones(len(i), bool)
                for s in range(0, len(i), 1 << 16):
                    p = slice(s, s + (1 << 16))
                    new[p] = ~(codes[i[p]] == codes[j[p]]).any(axis=1)
                i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found_i.append(i)
            found_j.append(j)
            if sum(map(len, found_i)) > 1 << 18:
                root, leaf = _forest(len(x), np.concatenate(found_i), np.concatenate(found_j))
                found_i, found_j = [root], [leaf]
        root, leaf = _forest(len(x), *(np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_i, found_j)))
        top = cid.copy()
        top[leaf] = cid[root]
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(links[hit]), pa.array(top[hit])], names=["cid", "links", "root"])


def _bucket_links(classes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """``(cid, links, root)`` per class, bucket and pair of blocks in which it has links."""
    spark = classes.sparkSession
    element = classes.schema["vector"].dataType.elementType.simpleString()
    coded = written(each_row(classes, _coded(bits, tables), f"cid long, copies long, vector array<{element}>, dim int, codes array<int>"), "vector-codes")
    slim = coded.select("cid", "dim", F.posexplode("codes").alias("turn", "code"))
    sizes = slim.groupBy("dim", "turn", "code").agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select("dim", "turn", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = slim.join(written(blocks, "vector-buckets"), ["dim", "turn", "code"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid", "turn"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))))
    dealt = placed.select("dim", "turn", "code", "block", "cid", meet.alias("p")).select("dim", "turn", "code", "p.a", "p.b", "block", "cid")
    rows = dealt.join(coded.select("cid", "copies", "vector", "codes"), "cid")
    keys = ["dim", "turn", "code", "a", "b"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "block", "cid", "copies", "vector", "codes")
    ship(spark)
    return rows.mapInArrow(_Compared(threshold), "cid long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Rows are linked where the cosine of their vectors, in double precision, is at least ``threshold`` and a
    table brings them together; a pair at the threshold is missed with a chance of ``1 - recall``, closer
    ones hardly ever, and no pair below it is linked.  Vectors that are null, empty or zero, or that hold
    null or non-finite components, and vectors of different lengths, link with nothing.  Rows with equal
    vectors are linked with each other; repeated rows repeat.  A null id keeps its row, counts as a link and
    never names a component.  ``kept`` marks the rows that name their component.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("vector")))
    good = rows.where("usable").select("vec_id", "vector")
    grouped = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    bits, tables = plan_tables(n, threshold, recall)
    found = written(_bucket_links(classes.select("cid", "copies", "vector"), bits, tables, threshold), "vector-links")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-components")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    slim = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    slim = slim.select("vector", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    names = slim.groupBy("root").agg(F.min("least").alias("component_id"))
    done = slim.join(names, "root").select("vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(done, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def exact_links(vectors: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Brute force for tests and recall: index pairs of a small array of vectors."""
    x = vectors.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(x @ x.T >= threshold)
    return np.column_stack([i, j])[i < j]
