"""The compact hash table in ranges: built, probed, read and written by tasks that hold one range of cells at a time.

A table has ``capacity`` cells of 32 bits, the high bits of a key's hash and a value (a taxon) in the low ones; probing
is linear and goes on behind the last cell at the first.  Here it is rows ``(part, cells)`` of :data:`CELLS`
cells.  Keys meet the range of their first cell; what runs over a range's end goes on in the next one in
another round, which the few keys near a border do.  Any order of insertion gives a right table, for no cell is ever
emptied: between a key's first cell and its own there is never a free one.

Keys are mixed well, so ranges get alike many; a range's keys are streamed past its cells.  A table of at most
:data:`BROADCAST_CELLS` is asked where the keys are: it has few ranges, which all keys would have to meet.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.bits import bits_for_taxa, fmix64
from phylospan.model import IndexOptions
from phylospan.operators.minimizers import found_minimizers, runs_of
from phylospan.operators.taxonomy import Taxonomy
from phylospan.shipping import ship
from phylospan.storage import dropped, written

#: Cells of a range: 4 MB.
CELLS = 1 << 20
#: Cells that are broadcast at most: 64 MB.
BROADCAST_CELLS = 1 << 24
#: Fixed values of the format: capacity, filled cells, bits of keys and of values.
HEADER = "<QQQQ"
#: Bytes before the cells.
FRONT = struct.calcsize(HEADER)


@dataclass(frozen=True)
class Layout:
    """How keys find cells: ``cells`` are those of a range."""

    capacity: int
    value_bits: int
    cells: int = CELLS

    def __post_init__(self):
        if self.capacity < 1 or not 0 < self.value_bits < 32 or self.cells < 1:
            raise ValueError("a compact table has cells, and 1 to 31 bits of value")

    @property
    def parts(self) -> int:
        return -(-self.capacity // self.cells)

    def width(self, part: int) -> int:
        return min(self.cells, self.capacity - part * self.cells)

    def home(self, keys: np.ndarray) -> np.ndarray:
        """The first cell of keys."""
        return (fmix64(keys) % np.uint64(self.capacity)).astype(np.int64)

    def short(self, keys: np.ndarray) -> np.ndarray:
        """The bits of keys that cells keep."""
        return (fmix64(keys) >> np.uint64(32 + self.value_bits)).astype(np.uint32)

    def starts(self, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Where in a range keys begin: those that come from another begin at its first cell."""
        return np.where(turns == 0, self.home(keys) % self.cells, 0)


def find(cells: np.ndarray, value_bits: int, at: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys in a range, 0 where a free cell ends the search, and which keys run over its end."""
    out, past = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    at, todo, low = at.copy(), np.arange(len(at)), np.uint32((1 << value_bits) - 1)
    while len(todo):
        over = at[todo] >= len(cells)
        past[todo[over]] = True
        todo = todo[~over]
        cell = cells[at[todo]]
        value = cell & low
        hit = (value != 0) & (cell >> np.uint32(value_bits) == short[todo])
        out[todo[hit]] = value[hit]
        todo = todo[(value != 0) & ~hit]
        at[todo] += 1
    return out, past


class Filling:
    """A range that is filled; taxa are entries of a tree, of which a cell keeps the least and the largest."""

    def __init__(self, tree, value_bits: int, cells: np.ndarray):
        self.tree, self.bits = tree, np.uint32(value_bits)
        self.short = cells >> self.bits
        self.lo = tree.entry[cells & np.uint32((1 << value_bits) - 1)].astype(np.int32)
        self.hi = self.lo.copy()

    def insert(self, at: np.ndarray, short: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Set keys, all stepping together; gives which run over the end."""
        at, todo, past = at.copy(), np.arange(len(at)), np.zeros(len(at), bool)
        while len(todo):
            over = at[todo] >= len(self.lo)
            past[todo[over]] = True
            todo = todo[~over]
            # the first of those that meet at a free cell takes it; others like it are then met there
            wanting = todo[self.lo[at[todo]] == 0]
            taken, first = np.unique(at[wanting], return_index=True)
            self.short[taken] = short[wanting[first]]
            self.lo[taken] = entry[wanting[first]]
            self.hi[taken] = entry[wanting[first]]
            here = at[todo]
            same = self.short[here] == short[todo]
            np.minimum.at(self.lo, here[same], entry[todo[same]])
            np.maximum.at(self.hi, here[same], entry[todo[same]])
            todo = todo[~same]
            at[todo] += 1
        return past

    def cells(self) -> np.ndarray:
        node = self.tree.node[self.tree.lca(self.lo, self.hi)].astype(np.uint32)
        return np.where(node > 0, (self.short << self.bits) | node, 0).astype("<u4")


def _of_parts(batches, columns: int):
    """``(part, cells or None, columns of keys)`` of rows that come by part, a part's cells before its keys."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            cells = batch.column(1)[lo]
            data = cells.as_buffer() if cells.is_valid else None
            lo += data is not None
            yield int(part[lo - 1 if data is not None else lo]), data, [batch.column(k).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for k in range(2, 2 + columns)]


class _Fill:
    """Rows ``(part, cells, minimizer, turns, entry)``: filled ranges, and keys for the ranges behind them."""

    ddl = "part int, cells binary, minimizer long, turns int, entry int"
    schema = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("minimizer", pa.int64()), ("turns", pa.int32()), ("entry", pa.int32())])

    def __init__(self, tree, layout: Layout):
        self.tree, self.layout = tree, layout

    def __call__(self, batches):
        tree, layout, now, filling = self.tree.value, self.layout, None, None
        for part, data, (minimizer, turns, entry) in _of_parts(batches, 3):
            if data is not None:
                if filling is not None:
                    yield self.range(now, filling)
                cells = np.frombuffer(data, "<u4") if data.size else np.zeros(layout.width(part), np.uint32)
                now, filling = part, Filling(tree, layout.value_bits, cells.astype(np.uint32))
            if len(minimizer):
                keys = minimizer.view(np.uint64)
                past = np.flatnonzero(filling.insert(layout.starts(keys, turns), layout.short(keys), entry))
                if len(past):
                    behind = np.full(len(past), (part + 1) % layout.parts, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(behind), pa.nulls(len(past), pa.binary()), pa.array(minimizer[past]), pa.array(turns[past] + np.int32(1)), pa.array(entry[past])], schema=self.schema)
        if filling is not None:
            yield self.range(now, filling)

    def range(self, part: int, filling: Filling):
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([filling.cells().tobytes()], pa.binary()), *none], schema=self.schema)


class _Probe:
    """Rows ``(part, cells, minimizer, turns)``: keys with their taxon, or with the range where they go on."""

    ddl = "part int, minimizer long, turns int, taxon long"
    schema = pa.schema([("part", pa.int32()), ("minimizer", pa.int64()), ("turns", pa.int32()), ("taxon", pa.int64())])

    def __init__(self, layout: Layout):
        self.layout = layout

    def __call__(self, batches):
        layout, cells, last = self.layout, None, None
        for part, data, (minimizer, turns) in _of_parts(batches, 2):
            if data is not None:
                cells, last = np.frombuffer(data, "<u4"), None
            # keys come in order, so repeated ones are neighbours
            new = np.append(True, minimizer[1:] != minimizer[:-1])[: len(minimizer)]
            if len(minimizer):
                new[0] = last is None or minimizer[0] != last
                last = minimizer[-1]
            minimizer, turns = minimizer[new], turns[new]
            if not len(minimizer):
                continue
            keys = minimizer.view(np.uint64)
            value, past = find(cells, layout.value_bits, layout.starts(keys, turns), layout.short(keys))
            on = past & (turns < layout.parts)  # behind its whole table a key is nowhere
            keep = np.flatnonzero(on | (value > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), (part + 1) % layout.parts, np.int32), mask=~on[keep]), pa.array(minimizer[keep]), pa.array(turns[keep] + np.int32(1)), pa.array(value[keep], mask=on[keep])], schema=self.schema)


class _Answered:
    """Keys that a whole table answers, with their taxa; those that repeat in a batch once."""

    ddl = "minimizer long, taxon long"

    def __init__(self, cells, layout: Layout):
        self.cells, self.layout = cells, layout

    def of(self, keys: np.ndarray) -> pa.RecordBatch:
        """The answers to unsigned keys."""
        cells, layout = self.cells.value, self.layout
        home = layout.home(keys)
        # most keys of foreign texts meet a free cell at once
        taken = np.flatnonzero(cells[home] & np.uint32((1 << layout.value_bits) - 1))
        keys, home = keys[taken], home[taken]
        short, value, todo = layout.short(keys), np.zeros(len(keys), np.int64), np.arange(len(keys))
        for _ in range(2):  # behind the last cell the search goes on at the first
            value[todo], past = find(cells, layout.value_bits, home[todo], short[todo])
            todo = todo[past]
            home[todo] = 0
        hit = np.flatnonzero(value)
        keys, first = np.unique(keys[hit], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(value[hit[first]])], names=["minimizer", "taxon"])

    def __call__(self, batches):
        for batch in batches:
            yield self.of(batch.column(0).to_numpy().view(np.uint64))


class _Searched(_Answered):
    """Sequences to the answers of a whole table to their minimizers, which do not leave the scan."""

    def __init__(self, cells, layout: Layout, options: IndexOptions):
        super().__init__(cells, layout)
        self.options = options

    def __call__(self, batches):
        o = self.options
        for batch in batches:
            for seqs in _groups(batch.column(0)):
                _, m, ambiguous, _, _ = runs_of(seqs, o)
                keep = ~ambiguous
                if o.min_hash:
                    keep &= fmix64(m) >= np.uint64(o.min_hash)
                yield self.of(m[keep])


def _groups(column, bases: int = 1 << 22):
    """Texts of a column as bytes, in lists of not much more than so many bases."""
    held, size = [], 0
    for s in column:
        held.append((s.as_py() or "").encode("latin-1", "replace"))
        size += len(held[-1])
        if size >= bases:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Heads:
    """Ranges up to their first free cell, all that keys from the range before them can meet."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def __call__(self, batches):
        low = np.uint32((1 << self.layout.value_bits) - 1)
        for batch in batches:
            heads = []
            for data in batch.column(1):
                cells = np.frombuffer(data.as_buffer(), "<u4")
                free = np.flatnonzero(cells & low == 0)
                heads.append(cells[: free[0] + 1 if len(free) else len(cells)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["part", "cells"])


class _Asked:
    """Keys with the range of their first cell, those that repeat in a batch once, so that a frequent one is thinned before it moves."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def __call__(self, batches):
        for batch in batches:
            keys = np.unique(batch.column(0).to_numpy())
            home = self.layout.home(keys.view(np.uint64)) // self.layout.cells
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(np.zeros(len(keys), np.int32)), pa.array(keys)], names=["part", "turns", "minimizer"])


class _Homes:
    """Keys with the range of their first cell; other columns stay as they are."""

    def __init__(self, layout: Layout, names: list[str]):
        self.layout, self.names = layout, names

    def __call__(self, batches):
        for batch in batches:
            home = self.layout.home(batch.column(0).to_numpy().view(np.uint64)) // self.layout.cells
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(np.zeros(batch.num_rows, np.int32)), *batch.columns], names=["part", "turns", *self.names])


def _meet(ranges: DataFrame, keys: DataFrame, layout: Layout, columns: list[str]) -> DataFrame:
    """Ranges and keys by part, a part's cells first."""
    rows = ranges.select("part", "cells").unionByName(keys.select("part", *columns), allowMissingColumns=True).select("part", "cells", *columns)
    return rows.repartition(layout.parts, "part").sortWithinPartitions("part", F.col("minimizer").asc_nulls_first())


def _once(answers: DataFrame) -> DataFrame:
    """Answers of many batches, each key's once."""
    return answers.groupBy("minimizer").agg(F.min("taxon").alias("taxon"))


@dataclass
class CompactIndex:
    """A compact table: ``ranges(part, cells)`` and how keys find their cells."""

    ranges: DataFrame
    layout: Layout
    _whole: object = field(default=None, repr=False, compare=False)

    @classmethod
    def build(cls, index: DataFrame, taxonomy: Taxonomy, capacity: int, cells: int = CELLS, value_bits: int = 0) -> CompactIndex:
        """An exact index as a compact table; keys that share a cell get the ancestor that their taxa share.

        Null minimizers and taxon 0 are left out.  Values have the bits that the taxa need, or ``value_bits`` if these are
        more.  Refused if the keys or the taxa do not fit, or for a taxonomy beyond the
        bound of the broadcast arrays, which would leave keys fewer than nine bits.
        """
        tree, spark = taxonomy.tree(), index.sparkSession
        if tree is None:
            raise ValueError("a compact table of so many taxa has no room for keys")
        layout = Layout(capacity, bits_for_taxa(len(tree.value.entry), value_bits), cells)
        ship(spark)
        placed = index.where("minimizer is not null and taxon > 0").join(taxonomy.nodes.select(F.col("node").alias("taxon"), "entry"), "taxon").select("minimizer", F.col("entry").cast("int"))
        keys = placed.mapInArrow(_Homes(layout, ["minimizer", "entry"]), "part int, turns int, minimizer long, entry int")
        ranges, before = spark.range(layout.parts).select(F.col("id").cast("int").alias("part"), F.lit(b"").alias("cells")), None
        while True:
            filled = written(_meet(ranges, keys, layout, ["minimizer", "turns", "entry"]).mapInArrow(_Fill(tree, layout), _Fill.ddl), "compact")
            if before is not None:
                dropped(before)
            ranges, keys, before = filled.where("minimizer is null").select("part", "cells"), filled.where("minimizer is not null"), filled
            turns = keys.agg(F.max("turns")).first()[0]
            if turns is None:
                return cls(ranges, layout)
            if turns > layout.parts:
                raise ValueError("the compact table is full")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``(minimizer, taxon)`` of the different ``keys(minimizer)`` that the table answers, right or by chance.

        A small table is broadcast to the keys, and only answers move.  With a larger one keys move once: they are
        brought to their ranges in order, where those that repeat are left out.
        """
        layout = self.layout
        ship(keys.sparkSession)
        if layout.capacity <= BROADCAST_CELLS:
            asked = keys.select("minimizer").where("minimizer is not null")
            return _once(asked.mapInArrow(_Answered(self.whole(), layout), _Answered.ddl))
        todo = keys.select("minimizer").where("minimizer is not null").mapInArrow(_Asked(layout), "part int, turns int, minimizer long")
        ranges, answers = self.ranges, []
        while True:
            step = written(_meet(ranges, todo, layout, ["minimizer", "turns"]).mapInArrow(_Probe(layout), _Probe.ddl), "probed")
            answers.append(step.where("taxon is not null").select("minimizer", "taxon"))
            todo = step.where("taxon is null")
            if todo.isEmpty():
                break
            touched = self.ranges.join(todo.select("part").distinct(), "part", "left_semi").select("part", "cells")
            ranges = touched.mapInArrow(_Heads(layout), "part int, cells binary")
        out = answers[0]
        for more in answers[1:]:
            out = out.unionByName(more)
        return out

    def search(self, sequences: DataFrame, options: IndexOptions, seq_col: str = "seq") -> DataFrame:
        """:meth:`lookup` of all minimizers of sequences; a small table is asked in the scan itself."""
        if self.layout.capacity > BROADCAST_CELLS:
            return self.lookup(found_minimizers(sequences.withColumn("seq_no", F.lit(0).cast("long")), options, "seq_no", seq_col))
        ship(sequences.sparkSession)
        return _once(sequences.select(seq_col).mapInArrow(_Searched(self.whole(), self.layout, options), _Searched.ddl))

    def whole(self):
        """All cells as a broadcast array, made once; for tables of at most ``BROADCAST_CELLS``."""
        if self._whole is None:
            ranges = self.ranges.select("part", "cells").toArrow().sort_by("part")
            cells = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for chunk in ranges["cells"].chunks for c in chunk])
            self._whole = self.ranges.sparkSession.sparkContext.broadcast(cells)
        return self._whole

    def value_counts(self) -> DataFrame:
        """``(taxon, minimizers)``: filled cells by value."""
        low = np.uint32((1 << self.layout.value_bits) - 1)

        def count(batches):
            for batch in batches:
                for data in batch.column(1):
                    values, n = np.unique(np.frombuffer(data.as_buffer(), "<u4") & low, return_counts=True)
                    used = values > 0
                    yield pa.RecordBatch.from_arrays([pa.array(values[used].astype(np.int64)), pa.array(n[used].astype(np.int64))], names=["taxon", "minimizers"])

        return self.ranges.select("part", "cells").mapInArrow(count, "taxon long, minimizers long").groupBy("taxon").agg(F.sum("minimizers").alias("minimizers"))

    def size(self) -> int:
        """Filled cells."""
        return self.value_counts().agg(F.coalesce(F.sum("minimizers"), F.lit(0))).first()[0]

    def save(self, path: str) -> None:
        """One file on a mount that all executors share: tasks write their ranges in place, and the file gets its name at the end.

        A repeated task writes the same bytes again.
        """
        layout, at = self.layout, path.removeprefix("file://")
        fresh = f"{at}.{uuid.uuid4().hex}"
        with open(fresh, "wb") as f:
            f.write(struct.pack(HEADER, layout.capacity, self.size(), 32 - layout.value_bits, layout.value_bits))
            f.truncate(FRONT + 4 * layout.capacity)

        def put(batches):
            out = os.open(fresh, os.O_WRONLY)
            try:
                for batch in batches:
                    for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                        view, offset = memoryview(data.as_buffer()), FRONT + 4 * part * layout.cells
                        while len(view):
                            n = os.pwrite(out, view, offset)
                            view, offset = view[n:], offset + n
                    yield pa.RecordBatch.from_arrays([batch.column(0)], names=["part"])
                os.fsync(out)
            finally:
                os.close(out)

        try:
            if self.ranges.select("part", "cells").mapInArrow(put, "part int").distinct().count() != layout.parts:
                raise RuntimeError("a range of the compact table is missing")
            os.replace(fresh, at)
        except BaseException:
            os.remove(fresh)
            raise

    @classmethod
    def load(cls, spark: SparkSession, path: str, cells: int = CELLS) -> CompactIndex:
        """A table's file from any store that pyarrow knows; tasks read its ranges."""
        uri = path if "://" in path else f"file://{os.path.abspath(path)}"
        store, at = fs.FileSystem.from_uri(uri)
        with store.open_input_file(at) as f:
            capacity, _, _, bits = struct.unpack(HEADER, f.read(FRONT))
            if f.size() < FRONT + 4 * capacity:
                raise ValueError("the compact table's file is cut off")
        layout = Layout(capacity, bits, cells)

        def read(batches):
            store, at = fs.FileSystem.from_uri(uri)
            with store.open_input_file(at) as f:
                for batch in batches:
                    for part in batch.column(0).to_pylist():
                        data = f.read_at(4 * layout.width(part), FRONT + 4 * part * cells)
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "cells"])

        ship(spark)
        return cls(spark.range(0, layout.parts, 1, min(layout.parts, 10_000)).mapInArrow(read, "part int, cells binary"), layout)
