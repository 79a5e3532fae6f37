"""A session that answers requests: lines of a log that grows, each a list of sequence files to classify.

The log is a stream whose offsets are places in the file, so a session that starts again from its checkpoint goes on
where it was.  The index is loaded once.  A request's answer is the folder ``request=<place>``: ``lines`` has the output lines
of its files in order, and ``summary.json`` says that the request is done; it is written last, so a request that was cut
off is done anew and one that has its summary is not repeated.  ``PING`` is answered by a summary alone, ``STOP`` ends the
session; requests behind it wait for the next one.
"""

from __future__ import annotations

import json
import threading

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from phylospan.model import ClassifyOptions
from phylospan.operators.classify import classify, single_reads
from phylospan.operators.index import TaxIndex
from phylospan.sources.fastx import read_fastx
from phylospan.sources.sinks import _store, write_outputs
from phylospan.shipping import ship

CHUNK = 1 << 20


class _Lines(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


class RequestReader(DataSourceStreamReader):
    """Complete lines of a file that is only appended to; an offset is the place behind a line."""

    def __init__(self, options):
        self.path = options["path"]
        self.seen = 0

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        store, path = _store(self.path)
        if store.get_file_info(path).is_file:
            with store.open_input_file(path) as f:
                at = self.seen
                while data := f.read_at(CHUNK, at):
                    self.seen = max(self.seen, at + data.rfind(b"\n") + 1)
                    at += len(data)
        return {"at": self.seen}

    def partitions(self, start, end):
        return [_Lines(start["at"], end["at"])]

    def read(self, partition):
        store, path = _store(self.path)
        with store.open_input_file(path) as f:
            at, rest = partition.start, b""
            while at + len(rest) < partition.end:
                data = f.read_at(min(CHUNK, partition.end - at - len(rest)), at + len(rest))
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    yield at, line.decode("utf-8", "replace").strip()
                    at += len(line) + 1

    def commit(self, end):
        pass


class Requests(DataSource):
    """``spark.readStream.format("requests").load(log)``: ``(at, request)`` of a growing log."""

    @classmethod
    def name(cls):
        return "requests"

    def schema(self):
        return "at long, request string"

    def streamReader(self, schema):
        return RequestReader(self.options)


class _Stop(Exception):
    pass


class RequestSession:
    """Answers the requests of ``log`` in ``out``; see the module."""

    def __init__(self, index: TaxIndex, log: str, out: str, checkpoint: str, opts: ClassifyOptions = ClassifyOptions()):
        self.index, self.log, self.out, self.checkpoint, self.opts = index, log, out.rstrip("/"), checkpoint, opts
        self.stopped = threading.Event()

    def start(self):
        """Start the query; it ends with an error at ``STOP``, so that what follows is not taken for done."""
        spark: SparkSession = self.index.index.sparkSession
        ship(spark)
        spark.dataSource.register(Requests)
        self.stopped.clear()
        return spark.readStream.format("requests").load(self.log).writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).start()

    def run(self) -> None:
        """Answer requests until ``STOP``."""
        try:
            self.start().awaitTermination()
        except StreamingQueryException:
            if not self.stopped.is_set():
                raise

    def _batch(self, batch: DataFrame, number: int) -> None:
        for r in batch.where("request <> ''").orderBy("at").toLocalIterator():
            store, folder = _store(f"{self.out}/request={r.at}")
            if store.get_file_info(f"{folder}/summary.json").is_file:
                continue
            store.create_dir(folder, recursive=True)
            store.delete_dir_contents(folder)  # what an attempt that was cut off has left
            summary = {"request": r.request, **self._answer(r.request, f"{self.out}/request={r.at}/lines")}
            with store.open_output_stream(f"{folder}/summary.part") as f:
                f.write(json.dumps(summary).encode())
            store.move(f"{folder}/summary.part", f"{folder}/summary.json")
            if r.request == "STOP":
                self.stopped.set()
                raise _Stop

    def _answer(self, request: str, target: str) -> dict:
        if request in ("PING", "STOP"):
            return {"status": "OK"}
        try:
            reads = single_reads(read_fastx(self.index.index.sparkSession, request.split()))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {"status": "ERROR", "error": "a file is not there"}
        reads = reads.persist()
        calls = classify(self.index, reads, self.opts).persist()
        write_outputs(calls, reads, self.index.taxonomy, self.opts, target)
        n = calls.agg(F.count("*").alias("sequences"), F.count_if(F.col("call") != 0).alias("classified")).first()
        calls.unpersist()
        reads.unpersist()
        return {"status": "DONE", "sequences": n.sequences, "classified": n.classified}
