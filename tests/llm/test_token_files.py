"""Token files against the library, and the file format against a plain decoder."""

import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from phylospan.llm import token_files
from phylospan.llm.pretokens import tokenizer_path
from phylospan.llm.token_files import TokenFileReader, TokenFileWriter, filesystem, open_tokens, read_documents, read_token_files, token_files_round_trip, write_token_files
from phylospan.llm.word_pieces import word_pieces

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n", None, "Hello, World's 12345!", "a" * 3000, "x  y\t\tz\x0b\x0c\r\nq", "\x1c\x1d\x1e\x1f\x00a\x7fb", "İstanbul ΑΣ Σ ǅ ﬁ", "<|endoftext|>", "a<|startoftext|>b <|endof text|>", "don't DON'T we'Ll I'M 's''t", "é ́x  y z\u0085w", "͸\U0010ffff\U0001f600", "漢字かな交じり文 한국어", "____--==::", "naïve café", "½²³ Ⅷ", "a​b﻿c", "ẞ ß SS"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def expected(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_words_equal_the_library():
    words = word_pieces(PATH)
    rnd = random.Random(4)
    alphabet = ["a", "B", "'", "s", "t", " ", "\n", "\t", "1", "9", "é", "Σ", "́", "-", "_", "<|endoftext|>", "\x1f", " ", "字", "ll", "re"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(words.encode_bytes(t), "<u2").tolist() == ids_of(t), t


def test_every_vocabulary_string_is_merged_alike():
    """The compiled merges join any neighbours that make a vocabulary string; they agree with the file's list of
    pairs if each string comes out whole by that list, and does so in both."""
    words = word_pieces(PATH)
    strings = [(s, i) for s, i in LIBRARY.get_vocab().items() if s.endswith("</w>") and s[:-4].isascii() and s[:-4].isalpha() and s[:-4].islower()]
    assert len(strings) > 20_000
    for lo in range(0, len(strings), 5000):
        part = strings[lo : lo + 5000]
        assert [i for _, i in part] == ids_of(" ".join(s[:-4] for s, _ in part)) == np.frombuffer(words.encode_bytes(" ".join(s[:-4] for s, _ in part)), "<u2").tolist()


def test_very_long_text(monkeypatch):
    from phylospan.llm import word_pieces as module

    monkeypatch.setattr(module, "SLICE", 1000)
    text = "some words, and 12 more's é\n" * 2000 + "y" * 5000
    assert np.frombuffer(word_pieces(PATH).encode_bytes(text), "<u2").tolist() == ids_of(text)


def test_round_trip_with_small_frames_and_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    rows = [(k * 3 % 40, t) for k, t in enumerate(ODD)] + [(100 + k, "word " * k) for k in range(30)] + [(None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = write_token_files(docs, file_ids=400)
    assert manifest.count() > 3 and manifest.agg({"ids": "max"}).first()[0] <= max(400, 3001)
    assert sorted((tuple(r) for r in read_token_files(manifest).collect()), key=key) == sorted(expected(rows), key=key)


def test_only_wanted_frames_are_decompressed(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 64)
    rows = [(k, f"word number {k} " * 10) for k in range(200)]
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = read_documents(manifest, [3, 150, 999]).collect()
    assert {r.doc_id: r.ids for r in got} == {k: ids_of(rows[k][1]) + [2] for k in (3, 150)}
    assert all(1 <= r.frames <= 6 for r in got)


def test_any_decoder_reads_a_file_and_damage_is_noticed(tmp_path):
    path = str(tmp_path / "x.tokens.zst")
    docs = [(k, np.arange(k * 7, dtype="<u2").tobytes()) for k in range(60)]
    writer = TokenFileWriter(open(path, "wb"), 2)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(i for _, i in docs)
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    assert (descriptor, magic) == (0x80, 0x8F92EAB1) and n == len(writer.frames)
    reader = open_tokens(path)
    assert [reader.document(k).tobytes() for k in range(60)] == [i for _, i in docs]
    spoiled = bytearray(data)
    struct.pack_into("<I", spoiled, len(data) - 9 - 12 * (n - 1) + 8, 12345)  # the checksum of the first data frame
    (tmp_path / "y").write_bytes(spoiled)
    with pytest.raises(ValueError, match="checksum"):
        list(open_tokens(str(tmp_path / "y")).documents())
    (tmp_path / "z").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        TokenFileReader(open(tmp_path / "z", "rb"), len(data) - 1)


def test_empty_table_and_clashing_columns(spark):
    assert token_files_round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 4)], "doc_id long, text string, row string, start int")
    assert [tuple(r) for r in token_files_round_trip(docs).collect()] == expected([(1, "a b")])


def test_local_names():
    assert [filesystem(u)[1] for u in ("file:///a/b", "file:/a/b", "/a/b")] == ["/a/b"] * 3
