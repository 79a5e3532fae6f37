"""Token files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of zstandard frames that any decoder reads: a skippable frame with the file's own
header, data frames of at most ``FRAME_IDS`` ids each, compressed one by one, a skippable frame with the
directory of documents, and the seek table of the seekable format: for every frame its compressed and plain
size and the low half of the XXH64 of its plain bytes, then the number of frames and the closing magic.  A
reader takes the table from the file's end, the directory from where the table says, and then only those
frames that hold wanted documents.

Documents are dealt by ranges of their id and written in its order, so the files of a set, read in the
order of their numbers, hold the documents in ascending order.  Every file is written under a name of its
own and counts once its row of the manifest is written, so a repeated task leaves nothing twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.llm.common import new_path, written
from phylospan.llm.pretokens import tokenizer_path
from phylospan.llm.warc import _scan_only
from phylospan.llm.word_pieces import word_pieces
from phylospan.shipping import ship

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids in a data frame, and ids and documents in a file, at most (a document longer than a file's ids has one alone).
FRAME_IDS, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 25, 1 << 20
LEVEL = 1
#: Magic numbers of skippable frames (own header, own directory) and of the seekable format (fixed values).
HEADER_FRAME, DIRECTORY_FRAME, SEEK_FRAME, SEEK_END = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "part int, number int, path string, docs long, ids long, first_id long, last_id long, nulls long"


def filesystem(uri: str):
    """``(file system, path)`` of a URI; one without a scheme or with ``file:`` is local to all who mount it."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class TokenFileWriter:
    """Writes documents one after the other to an open file; ``close`` adds directory and seek table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.encoder = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.held_bytes = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.ids = 0
        self._raw(_skippable(HEADER_FRAME, struct.pack("<4sBB", b"TOKS", 1, width)))

    def _raw(self, frame: bytes, plain: bytes = b"") -> None:
        self.out.write(frame)
        self.frames.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF if plain else 0))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.doc_ids.append(doc_id)
        self.counts.append(n)
        self.ids += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        most = FRAME_IDS * self.width
        if self.held_bytes >= most:
            data = b"".join(self.held)
            full = len(data) // most * most
            for lo in range(0, full, most):
                self._frame(data[lo : lo + most])
            self.held, self.held_bytes = [data[full:]], len(data) - full

    def _frame(self, plain: bytes) -> None:
        self._raw(self.encoder.compress(plain), plain)

    def close(self) -> None:
        if self.held_bytes:
            self._frame(b"".join(self.held))
        n = len(self.counts)
        null = np.packbits(np.array([d is None for d in self.doc_ids], bool)).tobytes()
        body = null + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes()
        self._raw(_skippable(DIRECTORY_FRAME, struct.pack("<Q", n) + self.encoder.compress(body)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(_skippable(SEEK_FRAME, table + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END)))
        self.out.close()


class TokenFileReader:
    """Reads a seekable file: the seek table and directory at once, data frames only when asked for."""

    def __init__(self, file, size: int):
        self.file, self.decoder, self.decoded = file, zstandard.ZstdDecompressor(), 0
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END or not descriptor & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        head, body = struct.unpack("<II", self._at(size - 9 - 12 * n - 8, 8))
        if head != SEEK_FRAME or body != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(entries[:, 0])))
        kind, version, self.width = struct.unpack("<4sBB", self._at(8, 6))
        if kind != b"TOKS" or version != 1:
            raise ValueError("not a token file")
        self.entries, self.data = entries, np.arange(1, n - 1)
        self.plain = np.concatenate(([0], np.cumsum(entries[1 : n - 1, 1])))
        directory = self._at(int(self.starts[n - 1]) + 8, int(entries[n - 1, 0]) - 8)
        docs = struct.unpack("<Q", directory[:8])[0]
        body = self.decoder.decompress(directory[8:], max_output_size=17 * docs + 8)
        flags = (docs + 7) // 8
        self.null = np.unpackbits(np.frombuffer(body[:flags], np.uint8))[:docs].astype(bool)
        self.doc_ids = np.frombuffer(body[flags : flags + 8 * docs], "<i8")
        counts = np.frombuffer(body[flags + 8 * docs :], "<u8").astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(counts)))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        """The plain bytes of data frame ``k``, checked against its checksum."""
        e = int(self.data[k])
        plain = self.decoder.decompress(self._at(int(self.starts[e]), int(self.entries[e, 0])), max_output_size=int(self.entries[e, 1]))
        if len(plain) != self.entries[e, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[e, 2]:
            raise ValueError("a frame differs from its checksum")
        self.decoded += 1
        return plain

    def documents(self):
        """``(position, ids)`` parts of all documents in order; a document that goes over frames has several."""
        at, k = 0, 0
        for f in range(len(self.data)):
            ids = np.frombuffer(self.frame(f), f"<u{self.width}")
            lo = 0
            while lo < len(ids):
                n = min(int(self.offsets[k + 1]) - at, len(ids) - lo)
                yield k, ids[lo : lo + n]
                lo, at = lo + n, at + n
                while k + 1 < len(self.offsets) and at >= self.offsets[k + 1]:
                    k += 1

    def document(self, k: int) -> np.ndarray:
        """The ids of the document at a position, from the frames that hold it alone."""
        lo, hi = int(self.offsets[k]) * self.width, int(self.offsets[k + 1]) * self.width
        first, last = int(np.searchsorted(self.plain, lo, "right")) - 1, int(np.searchsorted(self.plain, hi, "left")) - 1
        data = b"".join(self.frame(f) for f in range(first, last + 1))
        base = int(self.plain[first])
        return np.frombuffer(data[lo - base : hi - base], f"<u{self.width}")

    def find(self, doc_id: int) -> range:
        """Positions of a document id, by binary search behind the null ids, which come first."""
        nulls = int(self.null.sum())
        lo, hi = np.searchsorted(self.doc_ids[nulls:], [doc_id, doc_id + 1])
        return range(nulls + int(lo), nulls + int(hi))


def open_tokens(uri: str) -> TokenFileReader:
    store, path = filesystem(uri)
    return TokenFileReader(store.open_input_file(path), store.get_file_info(path).size)


class _Files:
    """Encodes sorted documents and writes them into files; a row of the manifest for each."""

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("nulls", pa.int64())])

    def __init__(self, folder: str, vocabulary: str, end_id: int, file_ids: int):
        self.folder, self.vocabulary, self.end_id, self.file_ids = folder, vocabulary, end_id, file_ids

    def __call__(self, batches):
        words = word_pieces(self.vocabulary)
        end = np.array([self.end_id], f"<u{words.width}").tobytes()
        part, number, now = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode_bytes(text.as_py() or "") + end
                if now is not None and (now[1].ids + len(ids) // words.width > self.file_ids or len(now[1].counts) >= FILE_DOCS):
                    yield self.row(part, number, *now)
                    number, now = number + 1, None
                if now is None:
                    store, folder = filesystem(self.folder)
                    store.create_dir(folder, recursive=True)
                    name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.tokens.zst"
                    now = f"{self.folder}/{name}", TokenFileWriter(store.open_output_stream(f"{folder}/{name}", compression=None), words.width)
                now[1].add(doc_id, ids)
        if now is not None:
            yield self.row(part, number, *now)

    def row(self, part, number, path, writer):
        writer.close()
        known = [d for d in (writer.doc_ids[-1], next((d for d in writer.doc_ids if d is not None), None)) if d is not None]
        nulls = sum(d is None for d in writer.doc_ids)
        row = {"part": part, "number": number, "path": path, "docs": len(writer.counts), "ids": writer.ids, "first_id": known[-1] if known else None, "last_id": known[0] if known else None, "nulls": nulls}
        return pa.RecordBatch.from_pylist([row], schema=self.schema)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """The manifest ``(part, number, path, docs, ids, first_id, last_id, nulls, start)`` of the files of all documents.

    Ordered by ``part`` and ``number`` the files hold the documents in ascending order of their id, null ids
    first; ``start`` is the number of ids in all files before.  Repeated ids stand in the order of the
    table's rows.  Null and empty texts have the end id alone; a long text goes over several frames; an
    empty table makes no file.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    if not _scan_only(docs):  # the rows are used twice: of any other plan they are written once
        rows = written(rows, "token-input")
    ship(spark)
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    files = _Files(new_path(spark, "tokens"), vocabulary or tokenizer_path(VOCABULARY), end_id, file_ids)
    manifest = written(ordered.select("doc_id", "text").mapInArrow(files, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "token-manifest")


class _ReadBack:
    """Documents of whole files: id, start, length and checksum."""

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def __call__(self, batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                reader = open_tokens(path)
                crc = np.zeros(len(reader.null), np.int64)
                for k, ids in reader.documents():
                    crc[k] = zlib.crc32(ids.astype("<u4"), int(crc[k]))
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, mask=reader.null), pa.array(start + reader.offsets[:-1]), pa.array(np.diff(reader.offsets)), pa.array(crc)], schema=self.schema)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files of a manifest, file by file."""
    ship(manifest.sparkSession)
    files = max(1, min(100_000, manifest.count()))
    return manifest.select("path", "start").repartition(files).mapInArrow(_ReadBack(), _ReadBack.ddl)


@dataclass
class _Wanted:
    doc_ids: list[int]

    def __call__(self, batches):
        for batch in batches:
            for (path,) in zip(batch.column(0).to_pylist()):
                reader = open_tokens(path)
                rows = [{"doc_id": d, "ids": reader.document(k).astype(np.int64)} for d in self.doc_ids for k in reader.find(d)]
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"frames": reader.decoded} for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("frames", pa.int32())]))


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids, frames)`` of a short list of documents: files are chosen by their first and last id,
    and only frames that hold a wanted document are decompressed (``frames`` counts them in a file)."""
    wanted = sorted(set(doc_ids))
    ship(manifest.sparkSession)
    may = F.lit(False)
    for d in wanted:
        may = may | F.lit(d).between(F.col("first_id"), F.col("last_id"))
    return manifest.where(may).select("path").mapInArrow(_Wanted(wanted), "doc_id long, ids array<long>, frames int")


def token_files_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per row of ``docs``, read back from the files that :func:`write_token_files` writes."""
    return read_token_files(write_token_files(docs, id_col, text_col, vocabulary))
