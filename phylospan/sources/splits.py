"""FASTA and FASTQ read by byte ranges of files, from any store and codec that Spark's text reader knows.

Spark deals a file's lines out by splits (of plain and bzip2 files; a gzip file is one).  Where a split begins, a
record may be anywhere: in its sequence, or in its qualities, whose lines may begin with ``@`` or ``>``.  What
goes on is told by a small state (see :class:`State`), so the work is done in two passes:

1. Every split guesses its state from its first lines and gives the state at its end, the number of
   records that begin in it, and the pieces of the records that go over its borders.  States at ends and at
   starts are then compared; splits that guessed wrong, if any, are read again with the state that is known
   by then.  Only these few numbers a split come to the driver.
2. Splits give the records that lie within them, numbered in file order; pieces of the others are joined by
   record number.  Nothing but pieces is shuffled.

Each record tells its own format by its first byte, and ends at a line with ``>`` or ``@``; in FASTQ the
sequence ends at ``+`` too, and qualities are read until they are as long as the sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.shipping import ship
from phylospan.storage import dropped, written

SEARCH, FASTA, FASTQ, QUALITY = range(4)
KINDS = {">": FASTA, "@": FASTQ}
#: Lines that a split looks at for its first guess.
GUESSED = 64
#: Numbers of records that a file has at most; a record's number is its file's times this and its place.
IN_FILE = 1 << 40


class State(NamedTuple):
    """Where a reader is: ``mode``, the bases so far (FASTQ) or the qualities still wanted (QUALITY), and the kind of
    a record whose header was met in place of ``+``, which goes on when the qualities are complete."""

    mode: int = SEARCH
    n: int = 0
    waiting: int = 0


def split_header(line: str) -> tuple[str, str]:
    """Name and comment of a header line behind its first byte."""
    cut = next((k for k, c in enumerate(line) if c in " \t"), len(line))
    return line[:cut], line[cut:].lstrip()


def _size(line: str) -> int:
    """Lengths count in bytes."""
    return len(line) if line.isascii() else len(line.encode())


class Scan:
    """Reads lines from a state on; ``begun`` headers were met before.

    Records are lists ``[number, begins here, header, comment, format, sequence parts, quality parts]``.
    ``run`` gives those that end, ``open`` has those that may go on.
    """

    def __init__(self, state: State = State(), begun: int = 0):
        self.mode, self.n, self.waiting = state
        self.begun = begun
        blank = lambda number, kind: [number, False, None, None, "fastq" if kind == FASTQ else "fasta", [], []]
        self.later = blank(begun - 1, self.waiting) if self.waiting else None
        self.now = None if self.mode == SEARCH else blank(begun - 1 - (self.later is not None), FASTA if self.mode == FASTA else FASTQ)

    @property
    def state(self) -> State:
        return State(self.mode, self.n, self.waiting)

    @property
    def open(self) -> list:
        return [r for r in (self.now, self.later) if r is not None]

    def _header(self, line: str) -> list:
        header, comment = split_header(line[1:])
        self.begun += 1
        return [self.begun - 1, True, header, comment, "fastq" if line[0] == "@" else "fasta", [], []]

    def _next(self):
        """Ends the record; one that waits comes up."""
        done, self.now = self.now, self.later
        self.mode, self.n = (self.waiting, 0) if self.later is not None else (SEARCH, 0)
        self.later, self.waiting = None, 0
        return done

    def run(self, lines: Iterable[str]):
        for line in lines:
            line = line.rstrip("\r\n")
            first = line[:1]
            if self.mode == QUALITY:
                self.now[6].append(line)
                self.n -= _size(line)
                if self.n <= 0:
                    yield self._next()
            elif first in KINDS:
                record = self._header(line)
                if self.mode == FASTQ:
                    self.later, self.waiting = record, KINDS[first]
                    self.mode = QUALITY
                    if self.n <= 0:
                        yield self._next()
                    continue
                if self.now is not None:
                    yield self.now
                self.now, self.mode, self.n = record, KINDS[first], 0
            elif self.mode == FASTQ and first == "+":
                self.mode = QUALITY
                if self.n <= 0:
                    yield self._next()
            elif self.mode != SEARCH:
                self.now[5].append(line)
                self.n += _size(line) if self.mode == FASTQ else 0


def parse_lines(lines: Iterable[str]):
    """Records ``(header, comment, seq, quals, format)`` of a whole file's lines."""
    scan = Scan()
    for r in scan.run(lines):
        yield r[2], r[3], "".join(r[5]), "".join(r[6]), r[4]
    for r in scan.open:
        yield r[2], r[3], "".join(r[5]), "".join(r[6]), r[4]


def guess(lines: list[str]) -> State:
    """The likely state before lines from the midst of a file: FASTQ records of four lines, else FASTA."""
    lines = [x.rstrip("\r\n") for x in lines]
    for p in range(min(4, max(0, len(lines) - 3))):
        at = range(p, len(lines) - 3, 4)
        if all(lines[k][:1] == "@" and lines[k + 2][:1] == "+" and len(lines[k + 1]) == len(lines[k + 3]) for k in at):
            if p == 0:
                return State()
            if p == 1:
                return State(QUALITY, len(lines[0]))
            return State(FASTQ, len(lines[1]) if p == 2 else 0)
    return State(FASTA)


# --- tasks -------------------------------------------------------------------------------------------


def _by_split(batches):
    """``(path, start, batches of lines)`` of consecutive splits in a task."""
    now, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column(1), batch.column(2).to_numpy()
        lo = 0
        while lo < batch.num_rows:
            key = (paths[lo].as_py(), int(starts[lo]))
            # splits of a task follow each other; most batches have one
            hi = batch.num_rows if (paths[batch.num_rows - 1].as_py(), int(starts[-1])) == key else next(k for k in range(lo, batch.num_rows + 1) if k == batch.num_rows or (paths[k].as_py(), int(starts[k])) != key)
            yield key, key != now, batch.column(0).slice(lo, hi - lo).to_pylist()
            now, lo = key, hi


class _Ends:
    """The states at the ends of splits, and the pieces of records over their borders."""

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("was", pa.list_(pa.int64())), ("state", pa.list_(pa.int64())), ("begun", pa.int64()), ("pieces", pa.list_(pa.struct([("number", pa.int64()), ("begins", pa.bool_()), ("header", pa.string()), ("comment", pa.string()), ("format", pa.string()), ("seq", pa.string()), ("quals", pa.string())])))])
    ddl = "path string, start long, was array<long>, state array<long>, begun long, pieces array<struct<number:long,begins:boolean,header:string,comment:string,format:string,seq:string,quals:string>>"

    def __init__(self, known):
        self.known = known

    def __call__(self, batches):
        known = self.known.value
        key, scan, was, pieces = None, None, None, []
        for split, new, lines in _by_split(batches):
            if new:
                if scan is not None:
                    yield self.row(key, was, scan, pieces)
                key, pieces = split, []
                was = known.get(split) or (State() if split[1] == 0 else guess(lines[:GUESSED]))
                # numbers count from the split's own first header; records that began before have negative ones
                scan = Scan(was, 0)
            for r in scan.run(lines):
                if not r[1]:
                    pieces.append(r)
        if scan is not None:
            yield self.row(key, was, scan, pieces)

    def row(self, key, was, scan, pieces):
        rows = [{"number": r[0], "begins": r[1], "header": r[2], "comment": r[3], "format": r[4], "seq": "".join(r[5]), "quals": "".join(r[6])} for r in [*pieces, *scan.open]]
        return pa.RecordBatch.from_pylist([{"path": key[0], "start": key[1], "was": list(was), "state": list(scan.state), "begun": scan.begun, "pieces": rows}], schema=self.schema)


#: Characters of records that make a batch.
BATCH_CHARS = 8 << 20


class _Whole:
    """Records that lie within a split, numbered."""

    schema = pa.schema([("seq_no", pa.int64()), *((c, pa.string()) for c in ("header", "comment", "seq", "quals", "format"))])
    ddl = "seq_no long, header string, comment string, seq string, quals string, format string"

    def __init__(self, plan):
        self.plan = plan

    def __call__(self, batches):
        plan, scan, base, held, size = self.plan.value, None, 0, [], 0
        for split, new, lines in _by_split(batches):
            if new:
                base, state, begun = plan[split]
                scan = Scan(state, begun)
            for r in scan.run(lines):
                if r[1]:
                    seq, quals = "".join(r[5]), "".join(r[6])
                    held.append((base + r[0], r[2], r[3], seq, quals, r[4]))
                    size += len(seq) + len(quals) + 100
                    if size >= BATCH_CHARS:
                        yield self.batch(held)
                        held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


def _name(uri: str) -> str:
    """A file's URI in one spelling: Spark writes ``file:/`` and ``file:///``, escaped or not."""
    return re.sub("^([a-z0-9]+):/+", "\\1:/", unquote(uri))


# --- the reader --------------------------------------------------------------------------------------


def read_splits(spark: SparkSession, paths: str | list[str], mate: int = 0) -> DataFrame:
    """Sequence records of files by splits, ``(seq_no, mate, header, comment, seq, quals, format)``.

    ``paths`` are comma separated or a list and may have wildcards.  Files count in the order of the list and, within a
    wildcard, of their names; record numbers are ``(file << 40) + place``.  An empty file has no records.
    """
    ship(spark)
    given = [p for p in (paths.split(",") if isinstance(paths, str) else paths) if p]
    files = list(dict.fromkeys(f for p in given for f in sorted(spark.read.text(p).inputFiles())))
    lines = spark.read.option("lineSep", "\n").text(given).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    context = spark.sparkContext
    known: dict[tuple[str, int], State] = {}
    while True:
        ends = written(lines.mapInArrow(_Ends(context.broadcast(known)), _Ends.ddl), "split-ends")
        rows = ends.select("path", "start", "was", "state", "begun").collect()  # a few numbers a split
        splits = {(r.path, r.start): r for r in rows}
        order = {_name(f): k for k, f in enumerate(files)}
        plan, wrong, before = {}, {}, None
        for key in sorted(splits, key=lambda s: (order[_name(s[0])], s[1])):
            if before is None or before[0] != key[0]:
                state, begun = State(), 0
            r = splits[key]
            if tuple(r.was) != state:
                wrong[key] = state
            plan[key] = (order[_name(key[0])] * IN_FILE, state, begun)
            state, begun, before = State(*r.state), begun + r.begun, key
        if not wrong:
            break
        # the first split that guessed wrong is now known; the states after it are so unless they depended on it
        known = known | {key: p[1] for key, p in plan.items()}
        dropped(ends)
    whole = lines.mapInArrow(_Whole(context.broadcast(plan)), _Whole.ddl)
    offsets = spark.createDataFrame([(k[0], k[1], base + begun) for k, (base, _, begun) in plan.items()], "path string, start long, base long")
    pieces = ends.join(offsets, ["path", "start"]).select("start", "base", F.explode("pieces").alias("p"))
    parts = F.array_sort(F.collect_list(F.struct("start", "p.seq", "p.quals")))
    named = lambda c: F.max(F.when(F.col("p.begins"), F.col(f"p.{c}"))).alias(c)
    border = pieces.groupBy((F.col("base") + F.col("p.number")).alias("seq_no")).agg(named("header"), named("comment"), named("format"), parts.alias("x"))
    border = border.select("seq_no", "header", "comment", F.array_join("x.seq", "").alias("seq"), F.array_join("x.quals", "").alias("quals"), "format")
    both = whole.unionByName(border)
    return both.select("seq_no", F.lit(mate).alias("mate"), "header", "comment", "seq", "quals", "format")
