"""Accession look-ups: targets joined with accession maps, in the two forms that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_accessions(targets: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taxa of ``targets(seqid, accession)`` by ``maps(accession, taxid, file_no, line_no)``: found and unmapped.

    Accessions match without their version; of several map lines the first file's first line counts.  Found
    is ``(seqid, accession, taxid)``, unmapped ``(accession)``.  The first line of a file is its header, which
    the reader leaves out.  The side of the targets is the small one: AQE broadcasts it if it is.
    """
    first = maps.join(targets.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min_by("taxid", F.struct("file_no", "line_no")).alias("taxid"))
    return targets.join(first, "accession").select("seqid", "accession", "taxid"), targets.select("accession").distinct().join(first, "accession", "left_anti")


def lookup_any_version(targets: DataFrame, maps: DataFrame) -> DataFrame:
    """``(seqid, accession, taxid)`` for every target, by ``maps(accession, accession_version, taxid, line_no)``.

    A target matches an accession with or without its version; the last line counts, and 0 stands for none.
    """
    keys = maps.select(F.explode(F.array_distinct(F.array("accession", "accession_version"))).alias("accession"), "taxid", "line_no")
    last = keys.groupBy("accession").agg(F.max_by("taxid", "line_no").alias("taxid"))
    return targets.join(last, "accession", "left").select("seqid", "accession", F.coalesce("taxid", F.lit(0).cast("long")).alias("taxid"))
