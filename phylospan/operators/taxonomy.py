"""Taxonomies as tables: marking, breadth-first and depth-first numbers, closure, lowest common ancestors.

Numbers are given breadth first, so a parent's is below its children's; *entries* are depth-first places (see
:mod:`phylospan.operators.tree`).  Both are ranks in one distributed sort, by depth and path and by path alone.
Paths from the root come from doubling: in every round each node takes over the path of the topmost node it
knows, so the rounds follow the logarithm of the depth.  A taxonomy is bounded by what is known of life (some
millions of nodes); sequences and reads never gather here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospan.model import TAXONOMY
from phylospan.operators import tree as trees
from phylospan.operators.tree import Tree
from phylospan.shipping import ship
from phylospan.storage import dropped, written


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """``(ext_id, path, open)`` of ``nodes(ext_id, parent_ext, ..)``: ids from the topmost node above to the node itself.

    A path ends above at id 1, or where a parent is not among the nodes.  ``open`` marks nodes in or under
    a cycle, whose paths never end; they hold all nodes of the cycle.
    """
    links = nodes.select("ext_id", F.when((F.col("ext_id") != 1) & (F.col("parent_ext") != F.col("ext_id")), F.col("parent_ext")).alias("top"))
    known = links.select(F.col("ext_id").alias("top"), F.lit(True).alias("there")).distinct()
    first = links.join(known, "top", "left").select("ext_id", F.when(F.col("there"), F.col("top")).alias("top"))
    rooted = F.col("top") == 1  # most nodes of a flat tree hang on the root, whose path is known
    own = F.array("ext_id")
    now = written(first.select("ext_id", F.when(rooted, F.concat(F.array(F.lit(1).cast("long")), own)).otherwise(own).alias("path"), F.when(~rooted, F.col("top")).alias("top")), "paths")
    pending = now.where("top is not null").count()
    while pending:
        above = now.select(F.col("ext_id").alias("top"), F.col("path").alias("head"), F.col("top").alias("next"))
        moved = now.where("top is not null").join(above, "top").select("ext_id", F.concat("head", "path").alias("path"), F.col("next").alias("top"))
        after = written(now.where("top is null").select("ext_id", "path", "top").unionByName(moved), "paths")
        left = after.where("top is not null").count()
        dropped(now)
        now = after
        if left == pending:  # a round settles some node unless all that are left lead into cycles
            break
        pending = left
    return now.select("ext_id", "path", F.col("top").isNotNull().alias("open"))


def mark(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes ``(ext_id, parent_ext, ..)`` that are among ``ids(ext_id)`` or above them, the root always.

    Ids that no node has are ignored.  A leaf that is not asked for is above none, so only the others' paths are made.
    """
    inner = ids.select("ext_id").unionByName(nodes.select(F.col("parent_ext").alias("ext_id"))).unionByName(nodes.where("ext_id = 1").select("ext_id")).distinct()
    nodes = written(nodes.join(inner, "ext_id", "left_semi"), "inner-nodes")
    paths = ancestor_paths(nodes).join(ids.select("ext_id").distinct(), "ext_id", "left_semi")
    keep = paths.select(F.explode("path").alias("ext_id")).unionByName(nodes.where("ext_id = 1").select("ext_id")).distinct()
    return nodes.join(keep, "ext_id", "left_semi")


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``keys``: one sort by ranges, in which every task counts on
    from what the tasks before it hold."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    offsets = placed.groupBy("_task").agg(F.count("*").alias("n")).select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_task").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).cast("long").alias(name))


def toured(nodes: DataFrame) -> DataFrame:
    """``nodes(node, path, ..)`` with their depth-first numbers ``entry`` and ``last``."""
    below = nodes.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("_below"))
    placed = ranked(nodes.join(below, "node"), ["path"], "_entry")
    entry = F.col("_entry").cast("int")
    return placed.select(*nodes.columns, entry.alias("entry"), (entry + F.col("_below") - 1).cast("int").alias("last"))


def number(nodes: DataFrame) -> DataFrame:
    """The taxonomy table of ``nodes(ext_id, parent_ext, name, rank)``, whose root has id 1.

    Nodes are numbered from 1 breadth first, children in order of their external id, under parents in
    theirs.  Nodes that the root does not reach are left out; missing names and ranks are empty.
    """
    rows = written(nodes.select("ext_id", "parent_ext", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("rank", F.lit("")).alias("rank")), "nodes")
    paths = ancestor_paths(rows).where(~F.col("open") & (F.col("path")[0] == 1)).select("ext_id", (F.size("path") - 1).alias("depth"), F.col("path").alias("ids"))
    placed = ranked(paths, ["depth", "ids"], "node")
    steps = placed.select("ext_id", "node", "depth", F.posexplode("ids").alias("at", "id")).join(placed.select(F.col("ext_id").alias("id"), F.col("node").alias("step")), "id")
    whole = steps.groupBy("ext_id", "node", "depth").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("s"))
    whole = whole.select("ext_id", "node", "depth", F.col("s.step").alias("path"))
    parent = F.when(F.col("depth") > 0, F.element_at("path", -2)).otherwise(F.lit(0)).cast("long")
    return toured(written(whole.join(rows.drop("parent_ext"), "ext_id").select("node", parent.alias("parent"), "ext_id", "name", "rank", "depth", "path"), "numbered"))


class Taxonomy:
    """A numbered taxonomy; ``nodes`` has the columns of :data:`phylospan.model.TAXONOMY`."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self._tree: tuple | None = None

    @classmethod
    def from_nodes(cls, nodes: DataFrame, marked: DataFrame | None = None) -> Taxonomy:
        return cls(written(number(nodes if marked is None else mark(nodes, marked)), "taxonomy"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Taxonomy:
        return cls(spark.read.schema(TAXONOMY).parquet(path))

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)

    def tree(self):
        """The depth-first numbers as a broadcast :class:`~phylospan.operators.tree.Tree`, or None for a taxonomy of
        more than ``TREE_NODES`` nodes, which is counted before anything is gathered."""
        limit = trees.TREE_NODES
        if self._tree is None or self._tree[0] != limit:
            packed = None
            if self.nodes.count() <= limit:
                t = self.nodes.select("node", "parent", "entry", "last", "ext_id").toArrow()
                packed = self.nodes.sparkSession.sparkContext.broadcast(Tree.of(*(t[c].to_numpy() for c in t.column_names)))
            self._tree = (limit, packed)
        return self._tree[1]

    def closure(self) -> DataFrame:
        """``(node, ancestor, dist)``, every node being an ancestor of itself."""
        exploded = self.nodes.select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
        return exploded.select("node", "ancestor", (F.col("depth") - F.col("at")).alias("dist"))

    def internal(self, ids: DataFrame, col: str = "ext_id") -> DataFrame:
        """``ids`` with the internal number ``taxon`` of their external id, 0 where there is none."""
        numbers = self.nodes.select(F.col("ext_id").alias(col), F.col("node").alias("taxon"))
        return ids.join(numbers, col, "left").withColumn("taxon", F.coalesce("taxon", F.lit(0).cast("long")))

    def lca(self, a: Column, b: Column, entries: bool = False) -> Column:
        """The lowest common ancestor of two nodes (or of two entries, given as numbers); 0 is neutral, unknown nodes are null."""
        ship(self.nodes.sparkSession)
        return _lca_of(self.tree(), entries)(a, b)

    def lca_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with ``lca``; 0 is neutral."""
        if self.tree() is not None:
            return pairs.select("a", "b", self.lca(F.col("a").cast("long"), F.col("b").cast("long")).alias("lca"))
        path = self.nodes.select("node", "path")
        both = pairs.join(path.select(F.col("node").alias("a"), F.col("path").alias("pa")), "a", "left").join(path.select(F.col("node").alias("b"), F.col("path").alias("pb")), "b", "left")
        shared = F.array_max(F.array_intersect("pa", "pb"))
        lca = F.when(F.col("a") == 0, F.col("b")).when(F.col("b") == 0, F.col("a")).otherwise(shared)
        return both.select("a", "b", lca.alias("lca"))

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with ``above``: whether ``a`` is ``b`` or above it; never for 0."""
        side = lambda k: self.nodes.select(F.col("node").alias(k), F.col("entry").alias(f"entry_{k}"), F.col("last").alias(f"last_{k}"))
        both = pairs.join(side("a"), "a", "left").join(side("b").drop("last_b"), "b", "left")
        return both.select("a", "b", F.coalesce(F.col("entry_b").between(F.col("entry_a"), F.col("last_a")), F.lit(False)).alias("above"))

    def children(self) -> DataFrame:
        """``(node, first_child, child_count)``; breadth-first numbers make children consecutive."""
        own = self.nodes.groupBy("parent").agg(F.min("node").alias("first_child"), F.count("*").alias("child_count"))
        return self.nodes.select("node").join(own.withColumnRenamed("parent", "node"), "node", "left").na.fill(0)


def _lca_of(packed, entries: bool):
    def lca(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tree = packed.value
        for a, b in batches:
            a, b = (x.fillna(-1).to_numpy(np.int64) for x in (a, b))
            known = (a >= 0) & (b >= 0) & (a < len(tree.entry)) & (b < len(tree.entry))
            a, b = np.where(known, a, 0), np.where(known, b, 0)
            found = tree.node[tree.lca(a, b) if entries else tree.lca(tree.entry[a], tree.entry[b])].astype(np.int64)
            yield pd.Series(np.where(known, found, 0), dtype="Int64").where(known)

    return F.pandas_udf(lca, "long")


def lca_by(groups: DataFrame, key: list[str], taxonomy: Taxonomy, taxon: str = "taxon") -> DataFrame:
    """``(*key, lca)``: the lowest common ancestor of all taxa of a key; taxon 0 is neutral.

    It is that of the taxa with the least and the largest entry, so one aggregation of two numbers a key is
    all that is shuffled.  A taxonomy too large for the broadcast arrays goes by :func:`lca_by_closure`.
    """
    if taxonomy.tree() is None:
        return lca_by_closure(groups, key, taxonomy, taxon)
    numbers = taxonomy.nodes.select(F.col("node").alias("t"), "entry")
    placed = groups.select(*key, F.col(taxon).alias("t")).where("t <> 0").join(numbers, "t")
    return lca_of_entries(placed, key, taxonomy)


def lca_of_entries(placed: DataFrame, key: list[str], taxonomy: Taxonomy) -> DataFrame:
    """``(*key, lca)`` of ``placed(*key, entry)``."""
    ends = placed.groupBy(*key).agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"))
    return ends.select(*key, taxonomy.lca(F.col("lo").cast("long"), F.col("hi").cast("long"), entries=True).alias("lca"))


def lca_by_closure(groups: DataFrame, key: list[str], taxonomy: Taxonomy, taxon: str = "taxon") -> DataFrame:
    """:func:`lca_by` by joins alone.

    Keys of one taxon are settled without the closure; for the others the common ancestors are those that
    as many of the key's taxa have as it has taxa, and the largest of them is the lowest.
    """
    sets = groups.select(*key, F.col(taxon).alias("t")).where("t <> 0").distinct()
    counted = sets.groupBy(*key).agg(F.count("*").alias("n"), F.max("t").alias("only"))
    single = counted.where("n = 1").select(*key, F.col("only").alias("lca"))
    many = sets.join(counted.where("n > 1").select(*key, "n"), key)
    above = many.join(taxonomy.closure().select(F.col("node").alias("t"), "ancestor"), "t")
    common = above.groupBy(*key, "ancestor").agg(F.count("*").alias("have"), F.max("n").alias("n")).where("have = n")
    return single.unionByName(common.groupBy(*key).agg(F.max("ancestor").alias("lca")))


def clade_sums(counts: DataFrame, taxonomy: Taxonomy, cols: list[str], taxon: str = "taxon") -> DataFrame:
    """Sums of ``cols`` over every node's clade: ``(node, *cols)`` for nodes with any count below."""
    closure = taxonomy.closure().select(F.col("node").alias(taxon), "ancestor")
    return counts.join(closure, taxon).groupBy(F.col("ancestor").alias("node")).agg(*[F.sum(c).alias(c) for c in cols])
