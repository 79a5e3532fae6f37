"""FASTA and FASTQ: the reader, a Spark data source for whole local files, writers and cleaning up."""

from __future__ import annotations

import bz2
import glob
import gzip
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phylospan.model import SEQUENCES
from phylospan.sources.splits import parse_lines, read_splits


def open_text(path: str):
    """A file's lines as Latin-1, decompressed after its suffix."""
    opener = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else open
    return opener(path, "rt", encoding="latin-1", newline="\n")


class _File(InputPartition):
    def __init__(self, number: int, path: str, mate: int):
        super().__init__(number)
        self.number, self.path, self.mate = number, path, mate


class FastxReader(DataSourceReader):
    def __init__(self, options):
        names = [p for part in options["path"].split(",") for p in (sorted(glob.glob(part)) or [part])]
        self.files = [_File(k, p.removeprefix("file://"), int(options.get("mate", "0"))) for k, p in enumerate(names)]

    def partitions(self):
        return self.files

    def read(self, partition):
        with open_text(partition.path) as f:
            for k, record in enumerate(parse_lines(f)):
                yield ((partition.number << 40) + k, partition.mate, *record)


class FastxSource(DataSource):
    """``spark.read.format("fastx").load(paths)``: a file is a partition, read as a stream.

    Records are numbered ``(file number << 40) + place``, so order and mates can be told.  Paths are comma
    separated, may have wildcards, and must be readable by every executor.
    """

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SEQUENCES

    def reader(self, schema):
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, paths: str | list[str], mate: int = 0) -> DataFrame:
    """Sequence records of files, plain or ``.gz`` or ``.bz2``, from any store, read by splits; see :func:`~phylospan.sources.splits.read_splits`."""
    return read_splits(spark, paths, mate)


def write_fasta(sequences: DataFrame, path: str, width: int = 72) -> None:
    """FASTA text files, records in order of ``seq_no``."""
    from phylospan.functions.sequence import fasta_text

    text = fasta_text(F.col("header"), F.col("comment"), F.col("seq"), width)
    sequences.orderBy("seq_no").select(text.alias("value")).write.mode("overwrite").text(path)


def clean(folder: str) -> None:
    """Remove a library's working files: ``library``, ``taxonomy`` and ``seqid2taxid.map``, if it looks like one."""
    import shutil

    if not os.path.isdir(folder) or os.path.realpath(folder) in ("/", os.path.expanduser("~")):
        raise ValueError(f"not a library folder: {folder}")
    for name in ("library", "taxonomy"):
        shutil.rmtree(os.path.join(folder, name), ignore_errors=True)
    if os.path.exists(mapping := os.path.join(folder, "seqid2taxid.map")):
        os.remove(mapping)
