"""Text tables around a library: taxonomy dumps, id maps, accession maps, assembly summaries, header scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.sequence import header_taxid

#: Assembly levels that are taken (fixed values).
LEVELS = ("Complete Genome", "Chromosome")


def _dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", "\t\\|$", ""), "\t\\|\t", -1).alias("f"))


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """``(ext_id, parent_ext, name, rank)`` of a nodes and a names dump; only scientific names count, the root has parent 0.

    A node of id 0 is refused.
    """
    rows = _dump(spark, nodes).select(F.col("f")[0].cast("long").alias("ext_id"), F.col("f")[1].cast("long").alias("parent_ext"), F.col("f")[2].alias("rank"))
    rows = rows.withColumn("ext_id", F.when(F.col("ext_id") == 0, F.raise_error(F.lit("node 0 is not allowed")).cast("long")).otherwise(F.col("ext_id")))
    named = _dump(spark, names).where(F.col("f")[3] == "scientific name").select(F.col("f")[0].cast("long").alias("ext_id"), F.col("f")[1].alias("name"))
    named = named.groupBy("ext_id").agg(F.max("name").alias("name"))
    return rows.join(named, "ext_id", "left").select("ext_id", F.when(F.col("ext_id") == 1, F.lit(0).cast("long")).otherwise(F.col("parent_ext")).alias("parent_ext"), "name", "rank")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``: a text's lines, numbers rising in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def parse_id_map(lines: DataFrame) -> DataFrame:
    """``(seqid, taxid)`` of ``lines(line_no, value)``.

    Lines are ``seqid taxid`` or ``TAXID seqid taxid``; taxa that are no positive number are skipped, and of
    repeated ids the last line counts.
    """
    f = F.split(F.trim("value"), "\\s+")
    at = F.when((F.size(f) >= 3) & (f[0] == "TAXID"), 1).otherwise(0)
    rows = lines.select("line_no", F.get(f, at).alias("seqid"), F.get(f, at + 1).try_cast("long").alias("taxid")).where("taxid > 0 and seqid <> ''")
    return rows.groupBy("seqid").agg(F.max_by("taxid", "line_no").alias("taxid"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_map(numbered_lines(spark, path))


def read_accession_maps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(accession, accession_version, taxid, file_no, line_no)`` of tab-separated maps, without their header lines."""
    out = None
    for k, path in enumerate(paths):
        f = F.split("value", "\t", -1)
        rows = numbered_lines(spark, path).where("line_no > 0").select(f[0].alias("accession"), F.get(f, F.lit(1)).alias("accession_version"), F.get(f, F.lit(2)).try_cast("long").alias("taxid"), F.lit(k).alias("file_no"), "line_no").where("taxid is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_assemblies(lines: DataFrame) -> DataFrame:
    """``(taxid, level, ftp_path)`` of an assembly summary's ``lines(value)``: whole genomes that can be fetched."""
    f = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 20)
    rows = rows.select(F.col("f")[5].try_cast("long").alias("taxid"), F.col("f")[11].alias("level"), F.col("f")[19].alias("ftp_path"))
    return rows.where(F.col("ftp_path") != "na").where(F.col("level").isin(*LEVELS)).where("taxid is not null")


def keep_reference_lines(lines: DataFrame) -> DataFrame:
    """Summary lines that are comments or name the human reference consortium."""
    return lines.where(F.col("value").startswith("#") | F.col("value").contains("Genome Reference Consortium"))


def prelim_map(headers: DataFrame) -> DataFrame:
    """``(value)``: ``TAXID seqid taxid`` lines, tab separated, for headers with a taxid tag in their first word."""
    first = F.regexp_extract(F.col("header"), r"^>?(\S*)", 1)
    tagged = headers.select(first.alias("seqid"), header_taxid(F.col("header")).alias("taxid")).where("taxid is not null")
    return tagged.select(F.concat_ws("\t", F.lit("TAXID"), "seqid", F.col("taxid").cast("string")).alias("value"))
