"""BLAST database volumes as sequence records: index, ASN.1 definition lines, packed bases, ambiguity runs."""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phylospan.functions.sequence import PROTEIN_CODES
from phylospan.model import SEQUENCES
from phylospan.shipping import ship

#: Bases by two bits, and by the four-bit set of bases they stand for (fixed values).
TWO_BIT, FOUR_BIT = "ACGT", "-ACMGRSVTWYHKDBN"
#: Numbers of the id kinds that are no plain text id (fixed values).
LOCAL, GENERAL, GI, PDB = 0, 10, 11, 14


def parse_ber(data: bytes, at: int = 0, end: int | None = None, open_ended: bool = False):
    """``(items, position)``: ``(tag, value)`` pairs, a value being bytes or, if constructed, items again."""
    items, end = [], len(data) if end is None else end
    while at < end:
        if open_ended and data[at : at + 2] == b"\0\0":
            return items, at + 2
        tag, size = data[at], data[at + 1]
        at += 2
        if size == 0x80:
            value, at = parse_ber(data, at, end, True)
        else:
            if size > 0x80:
                n = size & 0x7F
                size = int.from_bytes(data[at : at + n], "big")
                at += n
            value = parse_ber(data, at, at + size)[0] if tag & 0x20 else data[at : at + size]
            at += size
        items.append((tag, value))
    if open_ended:
        raise ValueError("an open value has no end")
    return items, at


def _inner(value):
    """The single value inside explicit tags and sequences."""
    while isinstance(value, list):
        value = value[0][1] if value else b""
    return value


def _fields(value) -> dict[int, object]:
    """A sequence's fields by tag number; one layer of SEQUENCE is taken off."""
    if isinstance(value, list) and len(value) == 1 and value[0][0] in (0x30, 0x31) and isinstance(value[0][1], list):
        value = value[0][1]
    return {tag & 0x1F: v for tag, v in value} if isinstance(value, list) else {}


def _text(value) -> str:
    return _inner(value).decode("latin-1")


def _integer(value) -> int:
    return int.from_bytes(_inner(value), "big", signed=True)


def _id_text(kind: int, value) -> str:
    f = _fields(value)
    if kind == GI:
        return ""
    if kind == PDB:
        chain = _text(f[3]) if 3 in f else chr(_integer(f[1])) if 1 in f and _integer(f[1]) else ""
        return _text(f.get(0, b"")) + (f"_{chain}" if chain else "")
    if kind == GENERAL:
        tag = f.get(1, [])
        numbered = isinstance(tag, list) and tag and tag[0][0] & 0x1F == 0
        return f"{_text(f.get(0, b''))}_{_integer(tag) if numbered else _text(tag)}"
    if kind == LOCAL:
        return str(_integer(value)) if isinstance(value, list) and value and value[0][0] & 0x1F == 0 else _text(value)
    if 1 in f:
        return _text(f[1]) + (f".{_integer(f[3])}" if 3 in f and _integer(f[3]) > 0 else "")
    return _text(value) if not f else ""


def parse_deflines(data: bytes) -> list[dict]:
    """Definition lines ``{title, ids, taxid, memberships}`` of a header block."""
    items = parse_ber(data)[0]
    lines = items[0][1] if items else []
    out = []
    for _, line in lines:
        f = _fields([(0x30, line)])
        ids = f.get(1, [])
        ids = ids[0][1] if len(ids) == 1 and ids[0][0] == 0x30 else ids
        members = f.get(3, [])
        members = members[0][1] if isinstance(members, list) and len(members) == 1 and isinstance(members[0][1], list) else members
        out.append({"title": _text(f[0]) if 0 in f else "", "ids": [(t & 0x1F, v) for t, v in ids], "taxid": _integer(f[2]) if 2 in f else 0, "memberships": [int.from_bytes(v, "big") for _, v in members] if isinstance(members, list) else []})
    return out


def defline_text(lines: list[dict], tag: str | None = None) -> str:
    """A FASTA header: ids and title of each line, further lines behind ``>``; with a tag ``tag|taxid|`` before the ids."""
    one = lambda d: (f"{tag}|{d['taxid']}|" if tag and d["taxid"] else "") + "".join(_id_text(k, v) for k, v in d["ids"]) + f" {d['title']}"
    return " >".join(one(d) for d in lines)


def longest_printable(data: bytes) -> str:
    """The longest run of printable characters, the first of equal ones."""
    best = run = b""
    for k in range(len(data)):
        run = run + data[k : k + 1] if 0x20 <= data[k] < 0x7F else b""
        if len(run) > len(best):
            best = run
    return best.decode() if best else f"sequence_{len(data)}"


def decode_bases(packed: bytes, ambiguous: bytes = b"") -> str:
    """Bases of a packed sequence, whose last byte tells how many it holds itself, with ambiguity runs laid over."""
    raw = np.frombuffer(packed, np.uint8)
    two = ((raw[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()
    n = 4 * (len(raw) - 1) + int(raw[-1] & 3)
    out = np.frombuffer(TWO_BIT.encode(), np.uint8)[two[:n]].copy()
    if ambiguous:
        head = struct.unpack_from(">I", ambiguous)[0]
        letters = FOUR_BIT.encode()
        if head >> 31:
            for (x,) in struct.iter_unpack(">Q", ambiguous[4 : 4 + 8 * ((head & 0x7FFFFFFF) // 2)]):
                at = x & 0xFFFFFFFF
                out[at : at + (x >> 48 & 0xFFF) + 1] = letters[x >> 60]
        else:
            for (x,) in struct.iter_unpack(">I", ambiguous[4 : 4 + 4 * head]):
                at = x & 0xFFFFFF
                out[at : at + (x >> 24 & 15) + 1] = letters[x >> 28]
    return out.tobytes().decode()


def decode_protein(data: bytes) -> str:
    return "".join(PROTEIN_CODES[b] if b < len(PROTEIN_CODES) else "X" for b in data)


class Volume:
    """The index of a volume, and its records by number."""

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.protein = not os.path.exists(f"{prefix}.nin")
        with open(f"{prefix}.{'pin' if self.protein else 'nin'}", "rb") as f:
            data = f.read()
        at = 8
        version, _ = struct.unpack_from(">II", data)

        def text():
            nonlocal at
            n = struct.unpack_from(">I", data, at)[0]
            at += 4 + n
            return data[at - n : at].decode("latin-1")

        if version == 5:
            self.number = struct.unpack_from(">I", data, at)[0]
            at += 4
        self.title = text()
        if version == 5:
            text()
        self.date = text()
        self.count = struct.unpack_from(">I", data, at)[0]
        at += 4 + 8 + 4
        take = lambda k: np.frombuffer(data, ">u4", self.count + 1, at + 4 * k * (self.count + 1)).astype(np.int64)
        self.headers, self.seqs = take(0), take(1)
        self.ambiguities = None if self.protein else take(2)

    def records(self, first: int, last: int, tag: str | None = None):
        """``(header, comment, seq, quals, format)`` of records ``first`` to ``last``, excluded."""
        kind = "p" if self.protein else "n"
        with open(f"{self.prefix}.{kind}hr", "rb") as heads, open(f"{self.prefix}.{kind}sq", "rb") as seqs:
            for k in range(first, last):
                heads.seek(self.headers[k])
                block = heads.read(int(self.headers[k + 1] - self.headers[k]))
                try:
                    text = defline_text(parse_deflines(block), tag)
                except (ValueError, IndexError, KeyError, TypeError):
                    text = longest_printable(block)
                seqs.seek(self.seqs[k])
                data = seqs.read(int(self.seqs[k + 1] - self.seqs[k]))
                if self.protein:
                    seq = decode_protein(data.rstrip(b"\0"))
                else:
                    cut = int(self.ambiguities[k] - self.seqs[k])
                    seq = decode_bases(data[:cut], data[cut:])
                header, _, comment = text.partition(" ")
                yield header, comment, seq, "", "fasta"


class _Range(InputPartition):
    def __init__(self, number, prefix, first, last):
        super().__init__(number)
        self.prefix, self.first, self.last = prefix, first, last


class BlastReader(DataSourceReader):
    def __init__(self, options):
        self.tag = options.get("tag")
        each = int(options.get("records", "10000"))
        self.ranges = []
        for volume, prefix in enumerate(options["path"].split(",")):
            n = Volume(prefix.removeprefix("file://")).count
            self.ranges += [_Range((volume << 40) + lo, prefix.removeprefix("file://"), lo, min(n, lo + each)) for lo in range(0, n, each)]

    def partitions(self):
        return self.ranges

    def read(self, partition):
        base = partition.value - partition.first
        for k, record in enumerate(Volume(partition.prefix).records(partition.first, partition.last, self.tag), partition.first):
            yield (base + k, 0, *record)


class BlastSource(DataSource):
    """``spark.read.format("blastdb").load(prefixes)``: a partition per range of records of a volume.

    Option ``tag`` puts ``tag|taxid|`` before the ids; prefixes are comma separated and must be readable by
    every executor.
    """

    @classmethod
    def name(cls):
        return "blastdb"

    def schema(self):
        return SEQUENCES

    def reader(self, schema):
        return BlastReader(self.options)


def read_blastdb(spark: SparkSession, prefixes: str | list[str], tag: str | None = None, records: int = 10_000) -> DataFrame:
    ship(spark)
    spark.dataSource.register(BlastSource)
    reader = spark.read.format("blastdb").option("records", str(records))
    return (reader.option("tag", tag) if tag else reader).load(prefixes if isinstance(prefixes, str) else ",".join(prefixes))
