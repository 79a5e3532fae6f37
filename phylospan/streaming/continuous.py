"""Structured Streaming: reads that arrive as files are classified against a static index.

Classification is stateless per read, so the stream needs no watermark; running counts per taxon are a
streaming aggregation, kept in complete mode.  So is the running report: its state has a row for every taxon and used
register of the taxon's sketch, at most ``2 ** precision + 1`` a taxon however long the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phylospan.model import ClassifyOptions
from phylospan.operators.classify import classify_narrow, output_lines, prepared, single_reads
from phylospan.operators.index import TaxIndex
from phylospan.operators.reports import counter_report, counter_rows, counters


def read_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Records that arrive in a folder as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def classify_stream(index: TaxIndex, records: DataFrame, opts: ClassifyOptions = ClassifyOptions()) -> DataFrame:
    """Calls of a stream of single records, in one pass per batch over broadcast arrays."""
    return classify_narrow(index, prepared(single_reads(records), opts), opts)


def start_lines(index: TaxIndex, records: DataFrame, out: str, checkpoint: str, opts: ClassifyOptions = ClassifyOptions()):
    """Start a query that writes each batch's output lines as text; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        reads = prepared(single_reads(batch), opts).persist()
        calls = classify_narrow(index, reads, opts)
        output_lines(calls, reads, index.taxonomy, opts).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{out}/batch={number}")
        reads.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def start_counts(index: TaxIndex, records: DataFrame, name: str, checkpoint: str, opts: ClassifyOptions = ClassifyOptions()):
    """Start a query that keeps the number of reads per call in the memory table ``name``."""
    counts = classify_stream(index, records, opts).groupBy("call").agg(F.count("*").alias("reads"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_report(index: TaxIndex, records: DataFrame, out: str, checkpoint: str, opts: ClassifyOptions = ClassifyOptions(), precision: int = 12):
    """Start a query that writes the report of all reads so far after each batch, with k-mers and an estimate of how many differ.

    The report of batch ``n`` is the folder ``batch=n``; a batch that is run again replaces its own.
    """

    def write(state: DataFrame, number: int) -> None:
        state.persist()
        counter_report(state, index.taxonomy, precision).write.mode("overwrite").parquet(f"{out}/batch={number}")
        state.unpersist()

    calls = classify_narrow(index, prepared(single_reads(records), opts), opts, kmers=True)
    state = counters(counter_rows(calls, precision))
    return state.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()
