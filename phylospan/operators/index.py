"""The index: which taxon a minimizer belongs to, and what can be asked of it."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.bits import SECTIONS, murmur64, signed, subsample_threshold, unsigned_less
from phylospan.model import INDEX, IndexOptions
from phylospan.operators.minimizers import found_minimizers, minimizers
from phylospan.operators.sieve import sieve_of
from phylospan.operators.taxonomy import Taxonomy, lca_by, lca_of_entries


#: Index rows that are broadcast at most: 12 bytes each, some 50 MB.
BROADCAST_ROWS = 4_000_000


class TaxIndex:
    """Index, taxonomy and options; what a classifier needs.  Its broadcast form is made once, however often it classifies."""

    def __init__(self, index: DataFrame, taxonomy: Taxonomy, options: IndexOptions):
        self.index, self.taxonomy, self.options = index, taxonomy, options
        self._rows: int | None = None
        self._arrays = self._sieve = None

    def sieve(self):
        """The broadcast sieve of the index's minimizers, made once."""
        if self._sieve is None:
            self.fits()
            self._sieve = self.index.sparkSession.sparkContext.broadcast(sieve_of(self.index, self._rows))
        return self._sieve

    def fits(self, rows: int | None = None) -> bool:
        """Whether the index has at most so many rows (by default ``BROADCAST_ROWS``); they are counted, once."""
        rows = BROADCAST_ROWS if rows is None else rows
        if self._rows is None:
            self._rows = self.index.count()
        return self._rows <= rows

    def arrays(self):
        """The index as broadcast arrays, sorted by minimizer; refused beyond ``BROADCAST_ROWS``."""
        if self._arrays is None:
            if not self.fits():
                raise ValueError(f"an index of more than {BROADCAST_ROWS} rows is not broadcast")
            from phylospan.operators.classify import _Arrays

            table = self.index.toArrow()
            minimizers = table["minimizer"].to_numpy().view(np.uint64)
            order = np.argsort(minimizers)
            entries = self.taxonomy.tree().value.entry[table["taxon"].to_numpy()]
            self._arrays = self.index.sparkSession.sparkContext.broadcast(_Arrays(minimizers[order], entries[order]))
        return self._arrays

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write the three parts.  The index is sorted by minimizer within files, so reads can skip; with ``buckets``
        it is cut into so many by the minimizer's hash, and is later joined without moving."""
        spark = self.index.sparkSession
        if buckets is None:
            self.index.repartitionByRange("minimizer").sortWithinPartitions("minimizer").write.mode("overwrite").parquet(f"{path}/index")
        else:
            name = f"index_{uuid.uuid4().hex}"
            self.index.repartition(buckets, "minimizer").write.mode("overwrite").bucketBy(buckets, "minimizer").sortBy("minimizer").option("path", f"{path}/index").saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")  # its files stay
        self.taxonomy.write(f"{path}/taxonomy")
        spark.createDataFrame([(json.dumps(self.options.as_dict() | {"buckets": buckets}),)], "options string").coalesce(1).write.mode("overwrite").text(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TaxIndex:
        saved = json.loads(spark.read.text(f"{path}/options").first()[0])
        buckets = saved.pop("buckets", None)
        if buckets is None:
            index = spark.read.schema(INDEX).parquet(f"{path}/index")
        else:
            name, place = f"index_{uuid.uuid4().hex}", f"{path}/index".replace("'", "\\'")
            spark.sql(f"CREATE TABLE {name} ({INDEX.replace('long', 'bigint')}) USING parquet CLUSTERED BY (minimizer) SORTED BY (minimizer) INTO {buckets} BUCKETS LOCATION '{place}'")
            index = spark.table(name)
        return cls(index, Taxonomy.read(spark, f"{path}/taxonomy"), IndexOptions(**saved))

    def value_counts(self) -> DataFrame:
        """``(taxon, minimizers)`` of the index."""
        return self.index.groupBy("taxon").agg(F.count("*").alias("minimizers"))


def sequence_taxa(headers: DataFrame, id_map: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """``(seq_no, taxon)`` of ``headers(seq_no, ids array<string>)`` by ``id_map(seqid, taxid)``.

    A sequence with several mapped ids has their lowest common ancestor; external ids that the taxonomy
    lacks are neutral, and sequences that none maps are left out.
    """
    ids = headers.select("seq_no", F.explode("ids").alias("seqid"))
    mapped = taxonomy.internal(ids.join(id_map, "seqid").select("seq_no", F.col("taxid").alias("ext_id")))
    return lca_by(mapped, ["seq_no"], taxonomy).select("seq_no", F.col("lca").alias("taxon"))


def build_index(sequences: DataFrame, taxa: DataFrame, taxonomy: Taxonomy, options: IndexOptions) -> TaxIndex:
    """The index of ``sequences(seq_no, seq)`` with ``taxa(seq_no, taxon)``.

    Minimizers leave the scan and meet the entries of their sequence's taxon; a minimizer's taxon is the common
    ancestor of its least and largest entry, two numbers that are combined before the shuffle.
    """
    seqs = sequences if options.dna else sequences.withColumn("seq", F.when(F.col("seq").endswith("*"), F.col("seq")).otherwise(F.concat("seq", F.lit("*"))))
    found = found_minimizers(seqs, options).withColumnRenamed("read", "seq_no")
    if taxonomy.tree() is None:
        index = lca_by(found.join(taxa.where("taxon <> 0"), "seq_no"), ["minimizer"], taxonomy)
    else:
        entries = taxa.join(taxonomy.nodes.select(F.col("node").alias("taxon"), "entry"), "taxon").select("seq_no", "entry")
        index = lca_of_entries(found.join(entries, "seq_no"), ["minimizer"], taxonomy)
    index = index.select("minimizer", F.col("lca").alias("taxon"))
    return TaxIndex(index, taxonomy, options)


def limited(options: IndexOptions, capacity: int, maximum: int) -> tuple[IndexOptions, int]:
    """Options and capacity of an index that may have ``maximum`` cells where it would need ``capacity``: minimizers of
    low hash are left out, alike in building and in classification.  Without a maximum (0) all stay."""
    if not maximum:
        return options, capacity
    return replace(options, min_hash=subsample_threshold(maximum, capacity)), maximum


def subsampled(index: DataFrame, threshold: int) -> DataFrame:
    """The index without minimizers whose hash is below an unsigned threshold."""
    if not threshold:
        return index
    return index.where(~unsigned_less(murmur64(F.col("minimizer")), F.lit(signed(threshold))))


def estimate_capacity(sequences: DataFrame, options: IndexOptions, n: int = 4) -> DataFrame:
    """One row ``(distinct_sampled, capacity)``: distinct minimizers in the first ``n`` of 1024 hash sections, scaled up."""
    if not 1 <= n <= SECTIONS:
        raise ValueError("n lies in 1 to 1024")
    seqs = sequences if options.dna else sequences.withColumn("seq", F.when(F.col("seq").endswith("*"), F.col("seq")).otherwise(F.concat("seq", F.lit("*"))))
    section = murmur64(F.col("minimizer")).bitwiseAND(F.lit(SECTIONS - 1))
    counted = minimizers(seqs, options).select("minimizer").distinct().where(section < n).agg(F.count("*").alias("distinct_sampled"))
    return counted.select("distinct_sampled", F.floor((F.col("distinct_sampled") + 1) * F.lit(float(SECTIONS)) / n).cast("long").alias("capacity"))


