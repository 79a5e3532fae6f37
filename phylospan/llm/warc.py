"""WARC archives with a two-level capture index.

Writing: a page becomes a gzip member holding one WARC/1.1 record, a ``response`` with the payload or a
``revisit`` that refers to the response with the same payload.  Members are joined into archives of a
bounded size.  Index: capture lines, sorted by reversed-host URL key, are cut into compressed blocks; the
sparse directory has one first key per block, and a short list has one per part of the sorted order.
Reading: a wanted key is binary-searched in the list of parts, then in the part's directory, then in the
one block that can hold it, and its record is read from its archive by offset and length.

Archives and blocks are tables in the shared folder, an archive a row, so any store that Spark writes will
do; :func:`export_archives` makes plain ``.warc.gz`` files of them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, new_path, written
from phylospan.shipping import ship

#: Payloads shorter than this are always stored.
REVISIT_FROM = 1000
ARCHIVE_BYTES = 1 << 20
BLOCK_LINES = 1000
#: Captures in a part of the index on average, and parts at most (the list of their first keys is broadcast).
PART_LINES, PARTS = 5000, 4096
BUCKET_BYTES = 16 << 20
GZIP_LEVEL = 4
#: WARC 1.1's profile of a revisit by payload digest, and the date of all records (fixed values).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, STAMP = "1970-01-01T00:00:00Z", "19700101000000"


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,www)/path?query``, without scheme, user, default port and fragment.

    Spaces and controls become ``%20``; null or a text without host is kept behind ``-)``.
    """
    text = "".join(c if c > " " else "%20" for c in (url or "").strip())
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"-){text}"
    if not host:
        return f"-){text}"
    plain = host.replace(".", "").isdigit() or ":" in host
    key = host if plain else ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


# --- records -----------------------------------------------------------------------------------------


def _record(kind: str, cid: int, page_id, url, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:capture:{cid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(c if c > " " else "%20" for c in url or "urn:none"))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))), *extra]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def response_record(cid: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _record("response", cid, page_id, url, _http(len(payload)) + payload, [("WARC-Payload-Digest", digest)])


def revisit_record(cid: int, page_id: int | None, url: str | None, n: int, sha1_hex: str, refers_cid: int, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    extra = [("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:capture:{refers_cid}>")]
    if refers_to is not None:
        extra.append(("X-Refers-To-Page-Id", str(refers_to)))
    return _record("revisit", cid, page_id, url, _http(n), extra)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end after its block")
    return fields, rest[:n]


def read_capture(member: bytes) -> tuple:
    """``(cid, page_id, payload_bytes, payload_digest, record_type, refers_to)`` of a gzip member."""
    fields, block = parse_record(zlib.decompress(member, 31))
    number = lambda name: int(fields[name]) if name in fields else None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload differs from its digest")
    cid = int(fields["WARC-Record-ID"].removeprefix("<urn:capture:").removesuffix(">"))
    return cid, number("X-Page-Id"), length, digest.hex(), fields["WARC-Type"], number("X-Refers-To-Page-Id")


# --- writing -----------------------------------------------------------------------------------------


@dataclass
class Captures:
    """Written archives ``(archive, data, entries)``, index blocks ``(part, block, first_key, first_cid, lines, data)``,
    and the ``(first_key, first_cid, part)`` of each part in order."""

    archives: DataFrame
    blocks: DataFrame
    parts: list[tuple[str, int, int]]


def _responses():
    def row(cid, page_id, url, html):
        return cid, url, gzip_member(response_record(cid, page_id, url, (html or "").encode()))

    return row


class _Archived:
    """Joins members into archives; a task's archives are numbered after its partition."""

    schema = pa.schema([("archive", pa.int64()), ("data", pa.binary()), ("entries", pa.list_(pa.struct([("urlkey", pa.string()), ("cid", pa.int64()), ("offset", pa.int64()), ("length", pa.int32())])))])
    ddl = "archive long, data binary, entries array<struct<urlkey:string,cid:long,offset:long,length:int>>"

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, batches):
        task, number = TaskContext.get().partitionId(), 0
        info = gzip_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:capture:info>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n")
        held, entries, size = [info], [], len(info)
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                member = r["member"]
                if r["refers_cid"] is not None:
                    member = gzip_member(revisit_record(r["cid"], r["page_id"], r["url"], r["n"], r["sha1"], r["refers_cid"], r["refers_to"]))
                entries.append({"urlkey": url_key(r["url"]), "cid": r["cid"], "offset": size, "length": len(member)})
                held.append(member)
                size += len(member)
                if size >= self.limit:
                    yield self.batch((task << 24) + number, held, entries)
                    held, entries, size, number = [info], [], len(info), number + 1
        if entries:
            yield self.batch((task << 24) + number, held, entries)

    def batch(self, name, held, entries):
        return pa.RecordBatch.from_pylist([{"archive": name, "data": b"".join(held), "entries": entries}], schema=self.schema)


class _Blocks:
    """Cuts sorted capture lines into compressed blocks."""

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("first_cid", pa.int64()), ("lines", pa.int32()), ("data", pa.binary())])
    ddl = "part int, block int, first_key string, first_cid long, lines int, data binary"

    def __init__(self, lines: int):
        self.lines = lines

    def __call__(self, batches):
        part, number, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= self.lines:
                yield self.batch(part, number, held[: self.lines])
                held, number = held[self.lines :], number + 1
        if held:
            yield self.batch(part, number, held)

    def batch(self, part, number, lines):
        text = "".join(f"{key} {STAMP} {cid} {archive} {offset} {length}\n" for key, cid, archive, offset, length in lines)
        return pa.RecordBatch.from_pylist([{"part": part, "block": number, "first_key": lines[0][0], "first_cid": lines[0][1], "lines": len(lines), "data": zlib.compress(text.encode(), 6)}], schema=self.schema)


def number_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(cid, page_id, url, html)``: rows with a number of their own, which follows from the table's files."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return named.select(F.monotonically_increasing_id().alias("cid"), "page_id", "url", "html")


def _scan_only(df: DataFrame) -> bool:
    """Whether the plan only reads files and picks columns or rows, so that each evaluation splits and orders the rows alike."""
    nodes = [line.lstrip(" +-:*()0123456789").split(" ")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return bool(df.inputFiles()) and all(n in ("FileScan", "ColumnarToRow", "Project", "Filter", "") for n in nodes)


def find_revisits(slim: DataFrame, at_least: int = REVISIT_FROM) -> DataFrame:
    """``(cid, page_id, n, sha1, refers_cid, refers_to)`` of the rows of ``slim(cid, page_id, n, sha1)`` whose payload of at
    least so many bytes another row's response has: of equal payloads that with the largest page id (null is
    least; of repeated ids the first row)."""
    large = slim.where(F.col("n") >= at_least)
    first = F.max(F.struct("page_id", (-F.col("cid")).alias("c")))
    shared = large.groupBy("sha1", "n").agg(first.alias("w"), F.count("*").alias("k")).where("k > 1")
    mine = large.join(shared.select("sha1", "n", (-F.col("w.c")).alias("refers_cid"), F.col("w.page_id").alias("refers_to")), ["sha1", "n"])
    return mine.where("cid <> refers_cid").select("cid", "page_id", "n", "sha1", "refers_cid", "refers_to")


def write_captures(numbered: DataFrame, slim: DataFrame, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> Captures:
    """Archives and index of ``numbered(cid, page_id, url, html)``; ``slim(cid, page_id, url, n, sha1)`` has its payload sizes and digests.

    Payloads are compressed where they are scanned, so only gzip members are shuffled.  Archives are bucketed
    by number: reading them later moves the small list of wanted places, not the archives.
    """
    spark = numbered.sparkSession
    count, total = slim.agg(F.count("*"), F.sum("n")).first()
    members = each_row(numbered, _responses, "cid long, url string, member binary", rows=64)
    revisits = find_revisits(slim).hint("shuffle_hash")
    joined = members.join(revisits, "cid", "left").select("cid", "url", "member", "page_id", "n", "sha1", "refers_cid", "refers_to")
    ship(spark)
    name, path = f"archives_{uuid.uuid4().hex}", new_path(spark, "archives")
    buckets = min(8192, max(1, -(-(total or 0) // BUCKET_BYTES)))
    packed = joined.mapInArrow(_Archived(archive_bytes), _Archived.ddl)
    packed.write.option("path", path).option("compression", "uncompressed").bucketBy(buckets, "archive").saveAsTable(name)
    archives = spark.table(name)
    lines = archives.select("archive", F.explode("entries").alias("e")).select("e.urlkey", "e.cid", "archive", "e.offset", "e.length")
    parts = min(PARTS, max(1, -(-count // part_lines)))
    ordered = lines.repartitionByRange(parts, "urlkey", "cid").sortWithinPartitions("urlkey", "cid")
    blocks = written(ordered.mapInArrow(_Blocks(block_lines), _Blocks.ddl), "capture-index")
    firsts = blocks.where("block = 0").select("first_key", "first_cid", "part").collect()  # at most PARTS rows
    return Captures(archives, blocks, sorted((r.first_key, r.first_cid, r.part) for r in firsts))


# --- reading -----------------------------------------------------------------------------------------


def _before(keys: list, wanted) -> int:
    """The last position whose first key is not after the wanted one."""
    return max(0, bisect_right(keys, wanted) - 1)


class _Directory:
    """Binary search of wanted keys in the directory of their part, from rows sorted by part with the directory first."""

    ddl = "part int, block int, urlkey string, cid long"
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("urlkey", pa.string()), ("cid", pa.int64())])

    def __call__(self, batches):
        now, keys = None, []
        for batch in batches:
            out = []
            for part, wanted, key, cid in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, keys = part, []
                if not wanted:
                    keys.append((key, cid))
                elif keys:
                    if cid is None:  # all captures of the key, which may go on in further blocks
                        lo, hi = max(0, bisect_left(keys, (key, -1)) - 1), _before(keys, (key, 1 << 62))
                        out += [(part, b, key, None) for b in range(lo, hi + 1)]
                    else:
                        out.append((part, _before(keys, (key, cid)), key, cid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), self.schema.types)], schema=self.schema)


def _places(wanted, data):
    rows = [line.split(" ") for line in zlib.decompress(data).decode().split("\n")[:-1]]
    keys = [(r[0], int(r[2])) for r in rows]
    for w in wanted:
        lo = bisect_left(keys, (w["urlkey"], -1 if w["cid"] is None else w["cid"]))
        hi = bisect_right(keys, (w["urlkey"], 1 << 62 if w["cid"] is None else w["cid"]))
        for r in rows[lo:hi]:
            yield int(r[3]), int(r[4]), int(r[5])


def _slices(data, places):
    for p in places:
        yield read_capture(data[p["offset"] : p["offset"] + p["length"]])


def _part_of(firsts):
    def setup():
        keys = [(k, c) for k, c, _ in firsts.value]
        parts = [p for _, _, p in firsts.value]

        def rows(key, cid):
            if cid is not None:
                yield parts[_before(keys, (key, cid))], key, cid
            else:
                for k in range(max(0, bisect_left(keys, (key, -1)) - 1), _before(keys, (key, 1 << 62)) + 1):
                    yield parts[k], key, None

        return rows

    return setup


def find_captures(captures: Captures, wanted: DataFrame) -> DataFrame:
    """``(archive, offset, length)`` of the captures that ``wanted(urlkey, cid)`` names; with a null ``cid`` all of the key.

    Keys that the index does not have give no row.
    """
    spark = wanted.sparkSession
    if not captures.parts:
        return spark.createDataFrame([], "archive long, offset long, length int")
    firsts = spark.sparkContext.broadcast(captures.parts)
    asked = each_row(wanted.select("urlkey", "cid"), _part_of(firsts), "part int, urlkey string, cid long", many=True)
    directory = captures.blocks.select("part", F.lit(0).alias("wanted"), F.col("first_key").alias("urlkey"), F.col("first_cid").alias("cid"))
    both = directory.unionByName(asked.select("part", F.lit(1).alias("wanted"), "urlkey", "cid"))
    dealt = both.repartition("part").sortWithinPartitions("part", "wanted", "urlkey", "cid")
    by_block = dealt.mapInArrow(_Directory(), _Directory.ddl).groupBy("part", "block").agg(F.collect_list(F.struct("urlkey", "cid")).alias("wanted"))
    held = by_block.join(captures.blocks.select("part", "block", "data"), ["part", "block"]).select("wanted", "data")
    return each_row(held, lambda: _places, "archive long, offset long, length int", rows=4, many=True)


def read_captures(captures: Captures, places: DataFrame) -> DataFrame:
    """``(cid, page_id, payload_bytes, payload_digest, record_type, refers_to)`` read from archives by ``(archive, offset, length)``."""
    by_archive = places.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places")).hint("shuffle_hash")
    held = captures.archives.select("archive", "data").join(by_archive, "archive").select("data", "places")
    return each_row(held, lambda: _slices, "cid long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", rows=1, many=True)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per row of ``pages``: archived, indexed, found by key, read back.

    Null html is an empty payload, a null url has a key of its own, a null page id stays null, repeated rows
    are records of their own (of equal payloads of at least 1000 bytes one is the response), an empty table
    gives an empty result, and other columns are ignored.
    """
    numbered = number_pages(pages, id_col, url_col, html_col)
    if not _scan_only(pages):  # the numbers are used twice: of any other plan they are written once
        numbered = written(numbered, "numbered-pages")
    slim = written(numbered.select("cid", "page_id", "url", F.octet_length("html").cast("long").alias("n"), F.sha1(F.col("html").cast("binary")).alias("sha1")), "captures")
    captures = write_captures(numbered, slim)
    wanted = each_row(slim.select("url", "cid"), lambda: lambda url, cid: (url_key(url), cid), "urlkey string, cid long")
    return read_captures(captures, find_captures(captures, wanted)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_archives(captures: Captures, folder: str) -> None:
    """Write the archives as ``.warc.gz`` files into a folder that all executors share."""

    def write(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r.archive}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(r.data)
            os.replace(part, os.path.join(folder, f"{r.archive:012d}.warc.gz"))

    captures.archives.select("archive", "data").foreachPartition(write)
