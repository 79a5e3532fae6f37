"""Media columns: payloads kept as lossless images, read back to pixel arrays and described by features.

A payload of any length is a column of images of 64 samples a row (16 pixels of four 8-bit samples: blue, green,
red, alpha), each a whole WebP file of at most ``TILE_ROWS`` rows, joined one after the other.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm import webp
from phylospan.llm.common import each_group, spans, text_sizes, written
from phylospan.llm.webp_many import decode_many, encode_many

UNIT = 64
TILE_ROWS = 4096
#: Bytes of samples that a task has as images at a time.
AT_ONCE = 4 << 20


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_media(payload: bytes) -> bytes:
    return to_many([payload])[0]


def to_many(payloads: list[bytes]) -> list[bytes]:
    """``to_media`` of each; all images are written in step."""
    pixels = [np.frombuffer(p, "<u4").astype(np.uint32, copy=False).reshape(-1, UNIT // 4) for p in payloads]
    tiles = [[p[k : k + TILE_ROWS] for k in range(0, len(p), TILE_ROWS)] for p in pixels]
    flat = [t for each in tiles for t in each]
    files = iter([f for lo, hi in spans(np.array([t.nbytes for t in flat]), 2 * AT_ONCE) for f in encode_many(flat[lo:hi])])
    return [b"".join(next(files) for _ in t) for t in tiles]


def from_media(media: bytes, parts: set[str] | None = None) -> np.ndarray:
    """The samples of a medium, one array of shape (rows, 64); the format's parts it uses are added to ``parts``."""
    return from_many([media], None if parts is None else [parts])[0]


def from_many(media: list[bytes], parts: list[set[str]] | None = None) -> list[np.ndarray]:
    """``from_media`` of each; all images are decoded in step."""
    files = [webp.split_files(m) for m in media]
    used = [p for p, f in zip(parts or [set() for _ in media], files) for _ in f]
    flat = [f for each in files for f in each]
    images = iter([p for lo, hi in spans(np.array([_samples(f) for f in flat]), 2 * AT_ONCE) for p in decode_many(flat[lo:hi], used[lo:hi])])
    return [np.ascontiguousarray(np.concatenate([next(images) for _ in f]).astype("<u4", copy=False)).view(np.uint8) for f in files]


def _samples(file: bytes) -> int:
    """Samples of an image by its header."""
    width, height = webp.size_of(file)
    return 4 * width * height


def _media_sizes(media) -> np.ndarray:
    """Samples of each medium, none for null."""
    return np.array([sum(map(_samples, webp.split_files(m or b""))) for m in media.to_pylist()], np.int64)


def describe(samples: np.ndarray) -> str:
    """Whole numbers from the pixel array: rows, width, sum, sum of squares, steps along and across rows, 16-bin histogram."""
    x = samples.astype(np.int16)
    along, across = (int(np.abs(np.diff(x, axis=k)).sum()) for k in (1, 0))
    count, value = np.bincount(samples.ravel(), minlength=256), np.arange(256)
    bins = count.reshape(16, 16).sum(axis=1)
    return f"{x.shape[0]}x{x.shape[1]};sum={count @ value};squares={count @ (value * value)};along={along};across={across};bins={','.join(map(str, bins))}"


def _stored(doc_ids, texts):
    data = [(t or "").encode() for t in texts]
    return [(i, len(d), m) for i, d, m in zip(doc_ids, data, to_many([pad(d) for d in data]))]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media binary)``: each text's UTF-8, padded, as lossless images.

    Null and empty texts are one row of zeros, a null id stays null, repeated rows repeat, other columns are
    ignored, an empty table gives an empty one.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return each_group(rows, _stored, "doc_id long, n_bytes long, media binary", 1, text_sizes, AT_ONCE)


def decode_media(media: DataFrame) -> DataFrame:
    """``(doc_id, width, height, pixels binary)`` from ``(doc_id, media)``: the samples read back, row by row.

    A null medium has null results; one that is broken is an error; an empty table gives an empty one.
    """

    def rows(doc_ids, data):
        images = iter(from_many([d for d in data if d is not None]))
        found = [None if d is None else next(images) for d in data]
        return [(i, None, None, None) if x is None else (i, x.shape[1], x.shape[0], x.tobytes()) for i, x in zip(doc_ids, found)]

    return each_group(media.select("doc_id", "media"), rows, "doc_id long, width int, height int, pixels binary", 1, _media_sizes, AT_ONCE)


def _features(doc_ids, sizes, media):
    parts: list[set[str]] = [set() for _ in media]
    out = []
    for doc_id, n, m, samples, used in zip(doc_ids, sizes, media, from_many(media, parts), parts):
        back = samples.tobytes()
        out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), describe(samples), ",".join(sorted(used))))
    return out


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, parts)`` per row.

    The media are written into the shared folder and read back from there; digest, checksum and feature are of
    the samples decoded from what was read.  ``parts`` lists what the medium uses of the format.  Null and empty
    texts are one row of zeros; a null id stays null; repeated rows repeat; other columns are ignored; an empty
    table gives an empty one.  No shuffle.
    """
    stored = written(encode_texts(docs, id_col, text_col), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, parts string"
    return each_group(stored, _features, schema, 2, _media_sizes, AT_ONCE)
