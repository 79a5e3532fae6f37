"""Ready-made inputs for the classifier from relational tables: DNA from text, taxonomies from dimensions.

A byte's two hexadecimal digits become two bases, so equal texts give equal sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.model import IndexOptions
from phylospan.operators.index import TaxIndex, build_index
from phylospan.operators.taxonomy import Taxonomy
from phylospan.storage import dealt, spread, written

HEX, BASES, BASES_N = "0123456789ABCDEF", "ACGTACGTACGTACGT", "ACGTACGTACGTACGN"
#: The options of the small bridges.
SHORT = IndexOptions(k=12, l=8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column, alphabet: str = BASES) -> Column:
    return F.translate(F.hex(text.cast("binary")), HEX, alphabet)


def market_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root - region - nation - customer or supplier, as ``(ext_id, parent_ext, name, rank)``."""
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    ext = lambda base, col: (F.lit(base) + F.col(col)).cast("long").alias("x")
    parts = [
        spark.createDataFrame([(1, 0, "root", "no rank")], "ext_id long, parent_ext long, name string, rank string"),
        region.select(ext(2, "r_regionkey"), F.lit(1).cast("long"), "r_name", F.lit("domain")),
        nation.select(ext(100, "n_nationkey"), ext(2, "n_regionkey"), "n_name", F.lit("kingdom")),
        customer.select(ext(1_000_000_000, "c_custkey"), ext(100, "c_nationkey"), "c_name", F.lit("species")),
        supplier.select(ext(2_000_000_000, "s_suppkey"), ext(100, "s_nationkey"), "s_name", F.lit("clade")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def market(spark: SparkSession, sf_dir: str) -> Taxonomy:
    return Taxonomy.from_nodes(market_nodes(spark, sf_dir))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root - first word of a part's name - the name; external ids follow from the least part key."""
    part = table(spark, sf_dir, "part")
    word = F.substring_index("p_name", " ", 1)
    words = part.groupBy(word.alias("w")).agg((2 * F.min("p_partkey") + 2).alias("ext_id"))
    names = part.groupBy("p_name").agg((2 * F.min("p_partkey") + 3).alias("ext_id")).withColumn("w", word)
    root = spark.createDataFrame([(1, 0, "root", "no rank")], "ext_id long, parent_ext long, name string, rank string")
    named = names.join(words.withColumnRenamed("ext_id", "parent_ext"), "w")
    return root.union(words.select("ext_id", F.lit(1).cast("long"), "w", F.lit("genus"))).union(named.select("ext_id", "parent_ext", "p_name", F.lit("species")))


def part_index(spark: SparkSession, sf_dir: str, options: IndexOptions = SHORT) -> TaxIndex:
    """An index of all part names, each under the node of its name."""
    taxonomy = Taxonomy.from_nodes(part_nodes(spark, sf_dir))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_no"), "p_name", dna(F.col("p_name")).alias("seq"))
    taxa = part.join(taxonomy.nodes.where("depth = 2").select(F.col("name").alias("p_name"), F.col("node").alias("taxon")), "p_name").select("seq_no", "taxon")
    built = build_index(part.select("seq_no", "seq"), taxa, taxonomy, options)
    return TaxIndex(written(built.index, "index"), taxonomy, options)


def part_reads(spark: SparkSession, sf_dir: str, paired: bool = False) -> DataFrame:
    """Reads from parts: a name with brand and type behind it, some bases ambiguous; of a pair the mate is the next part's."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select(F.col("p_partkey").alias("seq_no"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"), "p_name")
    first = part.select("seq_no", F.concat(F.lit("part"), F.col("seq_no").cast("string"), F.lit("/1")).alias("header1"), F.lit("").alias("comment1"), dna(F.col("t"), BASES_N).alias("seq1"), F.lit("").alias("quals1"), F.lit("fasta").alias("format1"))
    if not paired:
        return first.select("*", *[F.lit(None).cast("string").alias(f"{c}2") for c in ("header", "comment", "seq", "quals", "format")])
    following = part.select((F.col("seq_no") - 1).alias("seq_no"), dna(F.col("p_name")).alias("seq2"))
    both = first.join(following, "seq_no")
    return both.select("seq_no", "header1", "comment1", "seq1", "quals1", "format1", *[F.lit("").alias(f"{c}2") for c in ("header", "comment")], "seq2", F.lit("").alias("quals2"), F.lit("fasta").alias("format2"))


def benchmark_index(spark: SparkSession, sf_dir: str, options: IndexOptions = IndexOptions()) -> TaxIndex:
    """An index of all benchmark passages, spread over the market's nations.

    Of the market only what has passages or is above them is numbered, as in the reference (``src/build_db.rs:119``); no call
    can be any other node."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_no"), dna(F.col("text")).alias("seq"), (100 + F.col("item_id") % 25).alias("ext_id"))
    taxonomy = Taxonomy.from_nodes(market_nodes(spark, sf_dir), marked=items.select("ext_id"))
    taxa = taxonomy.internal(items.select("seq_no", "ext_id")).select("seq_no", "taxon")
    built = build_index(items.select("seq_no", "seq"), taxa, taxonomy, options)
    return TaxIndex(written(built.index, "index"), taxonomy, options)


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, as reads."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    null = lambda c: F.lit(None).cast("string").alias(c)
    return docs.select(F.col("doc_id").alias("seq_no"), F.col("doc_id").cast("string").alias("header1"), F.lit("").alias("comment1"), dna(F.col("text")).alias("seq1"), F.lit("").alias("quals1"), F.lit("fasta").alias("format1"), *[null(f"{c}2") for c in ("header", "comment", "seq", "quals", "format")])
