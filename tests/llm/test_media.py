import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from phylospan.llm import webp
from phylospan.llm.media import decode_media, encode_texts, from_media, media_features, pad, to_media


class Writer(webp.BitWriter):
    """Writes any entropy-coded image, for the decoder's tests."""

    def prefixed(self, v):
        """A length or distance as prefix symbol and extra bits."""
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        top = v.bit_length() - 1
        second = v >> (top - 1) & 1
        return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1

    def image(self, argb, main, rng, cache_bits=0, copies=False, groups=None):
        height, width = argb.shape
        flat = argb.ravel().tolist()
        self.put(int(bool(cache_bits)), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(int(groups is not None), 1)
            if groups is not None:
                tile, which = groups
                self.put(tile - 2, 3)
                self.image((which << 8).astype(np.uint32), False, rng)
        n_groups = int(groups[1].max()) + 1 if groups is not None else 1
        cache, ops, at, seen = [0] * (1 << cache_bits), [], 0, {}
        while at < len(flat):
            x, y = at % width, at // width
            g = int(groups[1][y >> groups[0], x >> groups[0]]) if groups is not None else 0
            slot = (webp.CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            n, d = 1, seen.get(flat[at])
            if copies and d is not None and rng.random() < 0.5:
                d = at - d
                while n < 200 and at + n < len(flat) and flat[at + n] == flat[at + n - d]:
                    n += 1
                code = next((k + 1 for k, (dx, dy) in enumerate(webp.NEAR) if max(1, dx + dy * width) == d), d + len(webp.NEAR))
                ops.append((g, "copy", n, code))
            elif cache_bits and cache[slot] == flat[at]:
                ops.append((g, "cache", slot, 0))
            else:
                ops.append((g, "pixel", flat[at], 0))
            for k in range(at, at + n):
                seen[flat[k]] = k
                if cache_bits:
                    cache[(webp.CACHE_FACTOR * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            at += n
        counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
        for g, kind, a, b in ops:
            c = counts[g]
            if kind == "pixel":
                for k, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    c[k][a >> s & 255] += 1
            elif kind == "copy":
                c[0][256 + self.prefixed(a)[0]] += 1
                c[4][self.prefixed(b)[0]] += 1
            else:
                c[0][280 + a] += 1
        codes = []
        for c in counts:
            for k in c:
                if not any(k):
                    k[0] = 1
            codes.append([webp.put_code(self, webp.code_lengths(k)) for k in c])
        for g, kind, a, b in ops:
            c = codes[g]
            if kind == "pixel":
                for k, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    self.put(*c[k][a >> s & 255])
            elif kind == "copy":
                s, extra, n = self.prefixed(a)
                self.put(*c[0][256 + s])
                self.put(extra, n)
                s, extra, n = self.prefixed(b)
                self.put(*c[4][s])
                self.put(extra, n)
            else:
                self.put(*c[0][280 + a])


def predict_forward(argb, modes, size):
    c = webp._channels(argb)
    out = c.copy()
    h, w = argb.shape
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = c[y, x - 1] if x else (255, 0, 0, 0)
            elif x == 0:
                p = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                p = webp.predicted(int(modes[y >> size, x >> size] >> 8) & 15, *(v.tolist() for v in (c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])))
            out[y, x] = (c[y, x] - np.array(p)) & 255
    return webp._joined(out)


def test_predictors_by_hand():
    l, t, r, c = [10, 200, 30, 40], [50, 60, 250, 80], [1, 2, 3, 4], [12, 100, 255, 60]
    want = {0: [255, 0, 0, 0], 1: l, 2: t, 3: r, 4: c, 5: [27, 80, 133, 51], 6: [11, 150, 142, 50], 7: [30, 130, 140, 60], 8: [31, 80, 252, 70], 9: [25, 31, 126, 42], 10: [18, 90, 134, 46], 12: [48, 160, 25, 60], 13: [39, 145, 83, 60]}
    for mode, value in want.items():
        assert list(webp.predicted(mode, l, t, r, c)) == value, mode
    assert webp.predicted(11, [10] * 4, [90] * 4, [0] * 4, [12] * 4) == [90] * 4


@pytest.mark.parametrize("seed", range(14))
def test_all_features_round_trip(seed):
    rng, r = random.Random(seed), np.random.default_rng(seed)
    w, h = rng.randint(1, 40), rng.randint(1, 30)
    few = seed % 3 == 0
    colours = r.integers(0, 1 << 32, [2, 3, 9, 60][rng.randrange(4)] if few else 5000, dtype=np.uint64).astype(np.uint32)
    pixels = np.repeat(np.repeat(colours[r.integers(0, len(colours), (h // 2 + 1, w // 3 + 1))], 2, 0), 3, 1)[:h, :w]
    out = Writer()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    now = pixels
    if few:
        palette = np.unique(pixels)
        out.put(1, 1)
        out.put(webp.PALETTE, 2)
        out.put(len(palette) - 1, 8)
        delta = webp._channels(palette)
        delta[1:] = delta[1:] - delta[:-1]
        out.image(webp._joined(delta)[None, :], False, rng)
        bits = webp._bundle_bits(len(palette))
        index = np.searchsorted(palette, now)
        packed = np.zeros((h, webp._blocks(w, bits)), np.uint32)
        for x in range(w):
            packed[:, x >> bits] |= (index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))).astype(np.uint32) << np.uint32(8)
        now = packed
    for kind in rng.sample([webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN], rng.randint(0, 3)):
        out.put(1, 1)
        out.put(kind, 2)
        size = rng.randint(2, 4)
        if kind == webp.SUBTRACT_GREEN:
            now = webp.add_green(now, -1)
            continue
        block = (r.integers(0, 16, (webp._blocks(h, size), webp._blocks(now.shape[1], size))) << 8 if kind == webp.PREDICTOR else r.integers(0, 1 << 24, (webp._blocks(h, size), webp._blocks(now.shape[1], size)))).astype(np.uint32)
        out.put(size - 2, 3)
        out.image(block, False, rng)
        now = predict_forward(now, block, size) if kind == webp.PREDICTOR else webp.cross_colour(now, block, size, forward=True)
    out.put(0, 1)
    tile = rng.randint(2, 4)
    groups = (tile, r.integers(0, 3, (webp._blocks(h, tile), webp._blocks(now.shape[1], tile)))) if seed % 2 else None
    out.image(now, True, rng, cache_bits=rng.choice([0, 3, 11]), copies=seed % 4 < 3, groups=groups)
    stream = out.value.to_bytes((out.count + 7) // 8, "little")
    assert (webp.decode(webp.riff(stream)) == pixels).all()


def test_a_public_one_pixel_file():
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)


def test_broken_files_are_refused():
    good = webp.encode(np.arange(256, dtype=np.uint32).reshape(4, 64) * np.uint32(0x1234567))
    for bad in (b"", b"RIFF", good[:-30], good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_code_lengths_are_limited():
    counts = [1 << k for k in range(30)]
    lengths = webp.code_lengths(counts)
    assert max(lengths) <= 15 and sum(1 << (15 - n) for n in lengths) == 1 << 15


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "\0" * 64, "ab" * 200, "é中" * 9, "".join(map(chr, range(300))) * 3, "z" * 300_000 + "end"])
def test_payload_round_trip(text):
    payload = pad(text.encode())
    assert len(payload) % 64 == 0 and len(payload) > 0
    assert from_media(to_media(payload)).tobytes() == payload


def test_media_features(spark):
    rows = [(1, "hello"), (2, None), (2, ""), (3, "hello"), (None, "é" * 100), (4, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, feature string")
    got = media_features(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t in rows if i == r.doc_id) or ""
        p = pad(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(to_media(p)).hexdigest()
    one, three = ([tuple(r)[1:] for r in got if r.doc_id == i][0] for i in (1, 3))
    assert one == three
    assert media_features(df.limit(0)).count() == 0
    back = decode_media(encode_texts(df)).collect()
    assert all(r.pixels.rstrip(b"\0") == (next(t for i, t in rows if i == r.doc_id) or "").encode() for r in back)


def channels(*planes):
    a = [np.asarray(p).astype(np.uint32) & 255 for p in planes]
    return a[0] << 24 | a[1] << 16 | a[2] << 8 | a[3]


def suited():
    """Images that one transform suits each, and one with repeats."""
    r = np.random.default_rng(7)
    y, x = np.mgrid[0:60, 0:16]
    noise = lambda n: r.integers(0, n, (60, 16))
    g = r.integers(-100, 100, (60, 16))
    yield "predictor", channels(3 * x + y * y + noise(2), 5 * x + 90 * y + noise(2), x * y + noise(2), 7 * x + y * y * y)
    yield "cross-colour", channels(255 + 0 * x, 2 * g + noise(3), g, -g + noise(3))
    yield "subtract-green", channels(255 + 0 * x, g + noise(2), g, g + noise(2))
    yield "palette", r.choice(r.integers(0, 1 << 32, 12, dtype=np.uint32), (60, 16))
    yield "backward", np.tile(r.integers(0, 1 << 32, (9, 16), dtype=np.uint32), (20, 1))
    yield "cache", r.choice(r.integers(0, 1 << 32, 300, dtype=np.uint32), (600, 16))


def test_encoder_uses_what_suits():
    for part, pixels in suited():
        used = set()
        assert (webp.decode(webp.encode(pixels), used) == pixels).all()
        assert part in used, (part, used)


def test_both_ways_of_reading_agree(monkeypatch):
    files = [webp.encode(p) for _, p in suited()] + [to_media(pad(("line %d of a text\n" % (k % 7) * 40).encode())) for k in range(5)]
    fast = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "MANY", 1 << 30)
    assert all((webp.decode(f) == p).all() for f, p in zip(files, fast))


def test_the_query_uses_the_format(spark):
    from phylospan.llm.queries import QUERIES

    got = QUERIES["op2_webp"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) >= 200 and all(r.payload_sha256 == hashlib.sha256(pad(texts[r.doc_id].encode())).hexdigest() for r in got)
    used = {p for r in got for p in r.parts.split(",")}
    assert {"backward", "cache", "palette"} <= used


def mixed():
    """Files of all sizes and features: texts, images that transforms suit, several groups of codes, one pixel."""
    rng, r = random.Random(11), np.random.default_rng(11)
    words = ["".join(rng.choices("etaoin shrdlu", k=rng.randint(1, 9))) for _ in range(90)]
    texts = ["", "a", "\0" * 64, "é中" * 9, "z" * 300_000 + "end", *(" ".join(rng.choices(words, k=rng.randint(1, 600))) for _ in range(60))]
    images = [np.frombuffer(pad(t.encode()), "<u4").reshape(-1, 16)[:4096] for t in texts]
    images += [p for _, p in suited()] + [r.integers(0, 1 << 32, (rng.randint(1, 40), rng.randint(1, 50)), dtype=np.uint64).astype(np.uint32) for _ in range(9)]
    return images + [r.choice(p.ravel()[:k], (h, 16)) for p in images[:30] for k, h in ((1, 1), (5, 9), (16, 40), (200, 70))]


def test_many_images_are_written_and_read_as_one_by_one():
    from phylospan.llm.webp_many import decode_many, encode_many

    images = mixed()
    files = [webp.encode(p) for p in images]
    assert encode_many(images) == files and encode_many([]) == []
    grouped = Writer()
    for v, n in ((0x2F, 8), (19, 14), (9, 14), (1, 1), (0, 3), (0, 1)):
        grouped.put(v, n)
    pixels = np.random.default_rng(3).integers(0, 90, (10, 20)).astype(np.uint32)
    grouped.image(pixels, True, random.Random(3), cache_bits=11, copies=True, groups=(2, np.arange(15).reshape(3, 5) % 4))
    files += [webp.riff(grouped.value.to_bytes((grouped.count + 7) // 8, "little"))]
    used, alone = [set() for _ in files], [set() for _ in files]
    got = decode_many(files, used)
    assert all(a.shape == b.shape and (a == b).all() for a, b in zip(got, [*images, pixels]))
    assert all((webp.decode(f, u) == p).all() for f, u, p in zip(files, alone, got)) and used == alone
    with pytest.raises(ValueError):
        decode_many([*files, webp.riff(webp.lossless_part(files[70])[:60])])


def test_cache_symbols_of_empty_slots():
    """Such a symbol is the pixel 0, which enters the cache in the slot of 0."""
    from phylospan.llm.webp_many import FEW, decode_many

    out = Writer()
    for v, n in ((0x2F, 8), (3, 14), (0, 14), (1, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):  # 4 x 1, a cache of 2
        out.put(v, n)
    slot = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> 31
    low = next(g for g in range(1, 256) if slot(g << 8) == 0)
    lengths = [0] * 282
    lengths[low], lengths[280], lengths[281] = 1, 2, 2
    codes = webp.put_code(out, lengths)
    for _ in range(4):
        webp.put_code(out, [1])
    for s in (low, 281, 280, 281):
        out.put(*codes[s])
    f = webp.riff(out.value.to_bytes((out.count + 7) // 8, "little"))
    assert webp.decode(f).tolist() == [[low << 8, 0, 0, 0]]
    assert all(p.tolist() == [[low << 8, 0, 0, 0]] for p in decode_many([f] * (FEW + 5)))
