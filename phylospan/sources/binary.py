"""The binary index files: options, taxonomy and compact hash table, read and written.

A compact table keeps 32-bit cells: the high bits of a key's hash, and a value in the low bits; probing is
linear.  Looking a key up in it can hit another key with the same cell, so it is imported as a table of its
own and probed as it is; exact indexes are exported into it with the collisions that its size brings.  Both
are done by ranges of cells (see :mod:`~phylospan.sources.compact`); :class:`CompactTable` is the same on one array.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from phylospan.functions.bits import fmix64
from phylospan.model import ClassifyOptions, IndexOptions
from phylospan.operators.minimizers import found_minimizers
from phylospan.operators.taxonomy import Taxonomy, toured
from phylospan.sources.compact import CompactIndex
from phylospan.storage import written

# Fixed values of the format.
TAXONOMY_MAGIC = b"K2TAXDAT"
OPTIONS_LAYOUT = struct.Struct("<QQQQB7xQiii4x")
NODE_FIELDS = 7


def pack_options(o: IndexOptions) -> bytes:
    return OPTIONS_LAYOUT.pack(o.k, o.l, o.spaced_seed_mask, o.toggle_mask, int(o.dna), o.min_hash, o.revcom_version, 0, 0)


def unpack_options(data: bytes) -> IndexOptions:
    k, l, spaced, toggle, dna, low, revcom, _, _ = OPTIONS_LAYOUT.unpack(data[: OPTIONS_LAYOUT.size])
    return IndexOptions(k, l, spaced, toggle, bool(dna), low, revcom)


def _strings(values: list[str]) -> tuple[bytes, list[int]]:
    data, offsets = bytearray(), []
    for v in values:
        offsets.append(len(data))
        data += v.encode() + b"\0"
    return bytes(data), offsets


def pack_taxonomy(taxonomy: Taxonomy) -> bytes:
    rows = taxonomy.nodes.join(taxonomy.children(), "node").orderBy("node").collect()
    names, name_at = _strings([r.name for r in rows])
    ranks = sorted({r.rank for r in rows})
    rank_data, rank_at = _strings(ranks)
    place = dict(zip(ranks, rank_at))
    table = np.zeros((len(rows) + 1, NODE_FIELDS), "<u8")
    following = 2
    for r, at in zip(rows, name_at):
        first = r.first_child or following
        table[r.node] = (r.parent, first, r.child_count, at, place[r.rank], r.ext_id, 0)
        following = first + r.child_count
    head = TAXONOMY_MAGIC + struct.pack("<QQQ", len(table), len(names), len(rank_data))
    return head + table.tobytes() + names + rank_data


def unpack_taxonomy(spark: SparkSession, data: bytes) -> Taxonomy:
    if data[:8] != TAXONOMY_MAGIC:
        raise ValueError("not a taxonomy file")
    n, names_len, ranks_len = struct.unpack_from("<QQQ", data, 8)
    table = np.frombuffer(data, "<u8", n * NODE_FIELDS, 32).reshape(n, NODE_FIELDS)
    at = 32 + table.nbytes
    names, ranks = data[at : at + names_len], data[at + names_len : at + names_len + ranks_len]
    text = lambda pool, k: pool[k : pool.index(b"\0", k)].decode()
    rows, paths = [], {0: []}
    for node in range(1, n):
        parent, _, _, name, rank, ext, _ = map(int, table[node])
        paths[node] = [*paths[parent], node]
        rows.append((node, parent, ext, text(names, name), text(ranks, rank), len(paths[node]) - 1, paths[node]))
    return Taxonomy(written(toured(spark.createDataFrame(rows, "node long, parent long, ext_id long, name string, rank string, depth int, path array<long>")), "taxonomy"))


@dataclass
class CompactTable:
    """Cells of a compact hash table; keys are unsigned 64-bit minimizers."""

    cells: np.ndarray
    value_bits: int
    size: int = 0

    @classmethod
    def empty(cls, capacity: int, value_bits: int) -> CompactTable:
        return cls(np.zeros(capacity, np.uint32), value_bits)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = fmix64(keys)
        return (h % np.uint64(len(self.cells))).astype(np.int64), (h >> np.uint64(32 + self.value_bits)).astype(np.uint32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, 0 where there is none; all keys step through the table together."""
        at, short = self._place(np.asarray(keys, np.uint64))
        out = np.zeros(len(at), np.int64)
        todo, low = np.arange(len(at)), np.uint32((1 << self.value_bits) - 1)
        for _ in range(len(self.cells)):
            if not len(todo):
                break
            cell = self.cells[at[todo]]
            hit = (cell & low != 0) & (cell >> np.uint32(self.value_bits) == short[todo])
            out[todo[hit]] = (cell & low)[hit]
            todo = todo[(cell & low != 0) & ~hit]
            at[todo] = (at[todo] + 1) % len(self.cells)
        return out

    def compare_and_set(self, key: int, new: int, old: int) -> tuple[bool, int]:
        """Set the value of a key if it is ``old``; whether it was, and what it is now or was instead."""
        if new == 0:
            return False, old
        (at,), (short,) = self._place(np.array([key], np.uint64))
        for _ in range(len(self.cells)):
            cell = int(self.cells[at])
            value = cell & ((1 << self.value_bits) - 1)
            if not value or cell >> self.value_bits == int(short):
                if value != old:
                    return False, value
                self.cells[at] = (int(short) << self.value_bits) | new
                self.size += value == 0
                return True, new
            at = (at + 1) % len(self.cells)
        raise ValueError("the compact table is full")

    def pack(self) -> bytes:
        return struct.pack("<QQQQ", len(self.cells), self.size, 32 - self.value_bits, self.value_bits) + self.cells.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> CompactTable:
        capacity, size, _, bits = struct.unpack_from("<QQQQ", data)
        return cls(np.frombuffer(data, "<u4", capacity, 32).astype(np.uint32), bits, size)

    def value_counts(self) -> dict[int, int]:
        values, counts = np.unique(self.cells & np.uint32((1 << self.value_bits) - 1), return_counts=True)
        return {int(v): int(c) for v, c in zip(values, counts) if v}


def write_index_files(folder: str, index, capacity: int, value_bits: int = 0) -> None:
    """``opts.k2d``, ``taxo.k2d`` and ``hash.k2d`` (fixed names) of a :class:`phylospan.operators.index.TaxIndex`, in a
    folder on a mount that all executors share; the table is built and written by ranges."""
    os.makedirs(folder, exist_ok=True)
    for name, data in (("opts.k2d", pack_options(index.options)), ("taxo.k2d", pack_taxonomy(index.taxonomy))):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    CompactIndex.build(index.index, index.taxonomy, capacity, value_bits=value_bits).save(os.path.join(folder, "hash.k2d"))


def read_index_files(spark: SparkSession, folder: str) -> tuple[IndexOptions, Taxonomy, CompactIndex]:
    """Options, taxonomy and the table in ranges; the taxonomy alone is read whole, being bounded by what is known of life."""
    parts = [open(os.path.join(folder, name), "rb").read() for name in ("opts.k2d", "taxo.k2d")]
    return unpack_options(parts[0]), unpack_taxonomy(spark, parts[1]), CompactIndex.load(spark, os.path.join(folder, "hash.k2d"))


def index_for(table: CompactIndex, taxonomy: Taxonomy, options: IndexOptions, reads: DataFrame, opts: ClassifyOptions = ClassifyOptions()):
    """What a compact table says of the minimizers of ``reads``, as an index to classify them with."""
    from phylospan.operators.classify import frames_of, prepared
    from phylospan.operators.index import TaxIndex

    opts = replace(opts, translated=opts.translated or not options.dna)
    found = found_minimizers(frames_of(prepared(reads, opts), opts), options, "read")
    return TaxIndex(written(table.lookup(found), "answers"), taxonomy, options)
