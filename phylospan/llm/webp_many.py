"""Many lossless WebP files read and written in step, with the pixels and the bytes that ``webp`` has for each alone.

Reading, all images of a batch advance by one symbol with each array step.  Which symbols a stream holds does not
depend on the pixels, so these are found first, and then what back-references and cache symbols stand for: each
points at an earlier pixel, and pointers are followed by doubling.  A copy has the cache slot of what it copies, and a
cache symbol names its own, so the slots of all pixels are known before their values.  Images of several groups of
codes, of very long codes, and the few that outlast the rest are read one by one.

Writing, transforms are compared, repeats sorted, code trees grown and bits packed for all images of a batch at once.
"""

from __future__ import annotations

import numpy as np

from phylospan.llm.webp import (
    CACHE_FACTOR,
    CODE_LENGTH_ORDER,
    CROSS_COLOUR,
    DISTANCE_CODES,
    EXPLAINED,
    LENGTH_CODES,
    LONGEST,
    MANY,
    NEAR,
    PREDICTOR,
    SEEN,
    SHORTEST,
    SUBTRACT_GREEN,
    BitWriter,
    _entropies,
    _octets,
    _predict,
    _prefix_of,
    _times_log,
    _turned,
    add_green,
    begin_stream,
    block_of,
    cross_colour,
    end_stream,
    lossless_part,
    palette_transform,
    put_head,
    read_image,
    riff,
    sub_image,
)

#: So many images or fewer are read one by one from the start, and so many that outlast the rest of a batch.
FEW, LAST = 36, 8
#: Bits that a window holds from any bit on.
WINDOW = 57
#: By prefix symbol of a length or distance, the number of its extra bits and its least value.
EXTRA = np.array([max(p - 2, 0) >> 1 for p in range(DISTANCE_CODES)])
LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << EXTRA[p]) + 1 for p in range(DISTANCE_CODES)])
NEAR_X, NEAR_Y = np.array(NEAR).T


class _Windows:
    """The 57 bits from any bit on of streams that lie one after the other."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(s) for s in streams], np.int64)
        self.start = 8 * (np.cumsum(size) - size)
        self.end = self.start + 8 * size
        data = b"".join(streams) + bytes(16)
        self.words = np.ascontiguousarray(np.ndarray((len(data) - 7,), "<i8", data, strides=(1,)))

    def at(self, bit: np.ndarray) -> np.ndarray:
        return self.words.take(bit >> 3, mode="clip") >> (bit & 7)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``start`` on, ``n`` of them."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of code lengths each: one table of all codes (a symbol, and its length times 65,536), where each begins, and its width."""
    row, symbol = np.nonzero(lengths)
    length = lengths[row, symbol].astype(np.int64)
    used = np.bincount(row, minlength=len(lengths))
    if not used.all():
        raise ValueError("a prefix code without symbols")
    length[used[row] == 1] = 0
    width = np.zeros(len(lengths), np.int64)
    np.maximum.at(width, row, length)
    rank = np.empty(len(lengths), np.int64)  # codes by width, so that those of one width are turned together
    by_width = np.argsort(width, kind="stable")
    rank[by_width] = np.arange(len(lengths))
    order = np.argsort(rank[row] << 4 | length, kind="stable")
    row, symbol, length = row[order], symbol[order], length[order]
    share = 1 << (width[row] - length)
    if (np.bincount(row, share, len(lengths)) != 1 << width).any():
        raise ValueError("a prefix code is not complete")
    flat = np.repeat((symbol | length << 16).astype(np.int32), share)
    size = 1 << width[by_width]
    start = np.empty(len(lengths), np.int64)
    start[by_width] = np.cumsum(size) - size
    at = 0
    for w, codes in enumerate(np.bincount(width).tolist()):
        part = flat[at : at + (codes << w)]
        at += codes << w
        if w > 1 and codes:
            part[:] = part.reshape(codes, 1 << w)[:, _turned(w)].ravel()
    return flat, start, width


def _lengths(see: _Windows, pos: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The code lengths of one code of each stream, a row each; ``pos`` moves behind them."""
    out = np.zeros((len(pos), int(alphabet.max())), np.uint8)
    w = see.at(pos)
    plain = np.flatnonzero(w & 1)
    if len(plain):
        v = w[plain]
        two, wide = v >> 1 & 1, v >> 2 & 1
        one = np.where(wide, v >> 3 & 255, v >> 3 & 1)
        n = 4 + 7 * wide
        other = np.where(two, v >> n & 255, one)
        if (np.maximum(one, other) >= alphabet[plain]).any():
            raise ValueError("a symbol outside the alphabet")
        out[plain, one] = out[plain, other] = 1
        pos[plain] += n + 8 * two
    coded = np.flatnonzero(~w & 1)
    if not len(coded):
        return out
    at, most = pos[coded], alphabet[coded]
    n = 4 + (w[coded] >> 1 & 15)
    k = np.arange(19)
    first = np.zeros((len(coded), 19), np.uint8)
    first[:, CODE_LENGTH_ORDER] = np.where(k < n[:, None], see.at(at + 5)[:, None] >> 3 * k & 7, 0)
    table, start, width = _tables(first)
    at += 5 + 3 * n
    w = see.at(at)
    wide = 2 + 2 * (w >> 1 & 7)
    left = np.where(w & 1, 2 + (w >> 4 & ((1 << wide) - 1)), most)
    at += np.where(w & 1, 4 + wide, 1)
    mask = (1 << width) - 1
    before, filled = np.full(len(coded), 8), np.zeros(len(coded), np.int64)
    which = np.arange(len(coded))
    put = []
    while True:
        go = (left > 0) & (filled < most)
        if not go.all():
            pos[coded[which[~go]]] = at[~go]
            if (filled > most).any():
                raise ValueError("code lengths beyond the alphabet")
            which, at, left, filled, before, start, mask, most = (x[go] for x in (which, at, left, filled, before, start, mask, most))
        if not len(which):
            break
        w = see.at(at)
        s = table[start + (w & mask)].astype(np.int64)
        n = s >> 16
        s &= 0xFFFF
        run, value = np.ones(len(s), np.int64), s
        again = np.flatnonzero(s > 15)
        if len(again):
            kind = s[again] - 16
            extra = np.array((2, 3, 7))[kind]
            run[again] = np.array((3, 3, 11))[kind] + (w[again] >> n[again] & ((1 << extra) - 1))
            n[again] += extra
            value = s.copy()
            value[again] = np.where(kind, 0, before[again])
        before = np.where((s < 16) & (s > 0), s, before)
        put.append((which, filled, run, value))
        filled = filled + run
        at = at + n
        left = left - 1
    which, filled, run, value = (np.concatenate(x) for x in zip(*put))
    some = value > 0
    which, filled, run, value = which[some], filled[some], run[some], value[some]
    out[np.repeat(coded[which], run), _spread(filled, run)] = np.repeat(value, run)
    return out


def _roots(parent: np.ndarray) -> None:
    """Let every pixel point at the first of its chain of earlier pixels."""
    some = np.flatnonzero(parent != np.arange(len(parent)))
    p = parent[some]
    while len(some):
        q = parent[p]
        moved = q != p
        some, p = some[moved], q[moved]
        parent[some] = p


def _symbols(see: _Windows, pos: np.ndarray, stop: np.ndarray, first: np.ndarray, last: np.ndarray, tables: np.ndarray, start: np.ndarray, width: np.ndarray):
    """Read the streams' symbols in step from bit ``pos`` to ``stop``, for the pixels from ``first`` to ``last`` each.

    Gives the pixels (true where a literal is), the copies (image, place, length, distance code), the cache symbols
    (image, place, slot) and the images that are left over.
    """
    out = np.zeros(int(last[-1]), np.uint32)
    mask = (1 << width) - 1
    state = np.stack([np.arange(len(pos)), pos, first, last, *(x for k in range(5) for x in (start[k], mask[k]))])
    copies, cached = [], []
    while state.shape[1] > LAST:
        which, pos, at, end, g, g_mask, r, r_mask, b, b_mask, a, a_mask, f, f_mask = state
        w = see.at(pos)
        s = tables[g + (w & g_mask)]
        n = s >> 16
        s &= 0xFFFF
        ahead = w >> n
        red = tables[r + (ahead & r_mask)]
        ahead >>= red >> 16
        blue = tables[b + (ahead & b_mask)]
        ahead >>= blue >> 16
        alpha = tables[a + (ahead & a_mask)]
        bits = n + (red >> 16) + (blue >> 16) + (alpha >> 16)
        out[at] = ((alpha & 255) << 24 | (red & 255) << 16 | (s & 255) << 8 | blue & 255).view(np.uint32)
        step = 1
        other = np.flatnonzero(s > 255)
        if len(other):
            bits[other] = n[other]
            copy = s[other] < 256 + LENGTH_CODES
            slot = other[~copy]
            if len(slot):
                cached.append((which[slot], at[slot], s[slot]))
            copy = other[copy]
            if len(copy):
                v, p = w[copy] >> n[copy], s[copy] - 256
                long = EXTRA[p]
                length = LEAST[p] + (v & ((1 << long) - 1))
                v >>= long
                far = tables[f[copy] + (v & f_mask[copy])]
                v >>= far >> 16
                p = far & 0xFFFF
                extra = EXTRA[p]
                copies.append((which[copy], at[copy], length, LEAST[p] + (v & ((1 << extra) - 1))))
                bits[copy] += long + (far >> 16) + extra
                step = np.ones(len(s), np.int64)
                step[copy] = length
        pos += bits
        at += step
        go = at < end
        if not go.all():
            if (pos[~go] > stop[which[~go]]).any():
                raise ValueError("the stream ends early")
            state = state[:, go]
    joined = lambda parts, n: [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * n
    return out, joined(copies, 4), joined(cached, 3), state[0]


def _read_many(streams: list[bytes], pos: list[int], sizes: list[tuple[int, int]], cache_bits: list[int]):
    """Per image its pixels, and whether it has copies and cache symbols; None for one that has to be read alone."""
    n = len(streams)
    see, bits = _Windows(streams), np.array(cache_bits)
    pos = see.start + np.array(pos)
    width, height = np.array(sizes, np.int64).T
    greens = 256 + LENGTH_CODES + np.where(bits > 0, 1 << bits, 0)
    tables, start, wide, at = [], [], [], 0
    for alphabet in (greens, *([np.full(n, 256)] * 3), np.full(n, DISTANCE_CODES)):
        table, first, w = _tables(_lengths(see, pos, alphabet))
        tables.append(table)
        start.append(first + at)
        wide.append(w)
        at += len(table)
    fits = (sum(wide[:4]) <= WINDOW) & (wide[0] + wide[4] + 28 <= WINDOW)
    last = np.cumsum(width * height)
    first = last - width * height
    some = np.flatnonzero(fits)
    alone = ~fits
    if not len(some):
        return [None] * n
    out, copies, cached, rest = _symbols(see, pos[some], see.end[some], first[some], last[some], np.concatenate(tables), np.stack(start)[:, some], np.stack(wide)[:, some])
    return _values(out, [some[copies[0]], *copies[1:]], [some[cached[0]], *cached[1:]], some[rest], alone, first, last, width, bits)


def _values(out, copies, cached, rest, alone, first, last, width, bits):
    """Pixels from literals, copies and cache symbols."""
    alone[rest] = True
    image, at, length, code = copies
    near = code <= len(NEAR)
    k = np.where(near, code, 1) - 1
    far = np.where(near, np.maximum(1, NEAR_X[k] + NEAR_Y[k] * width[image]), code - len(NEAR))
    ours = ~alone[image]
    image, at, length, far = image[ours], at[ours], length[ours], far[ours]
    if (at - far < first[image]).any() or (at + length > last[image]).any():
        raise ValueError("a back-reference leaves the image")
    has_copies, has_cached = np.zeros(len(first), bool), np.zeros(len(first), bool)
    has_copies[image] = True
    parent = np.arange(len(out))
    place = _spread(at, length)
    parent[place] = place - np.repeat(far, length)
    image, at, slot = cached
    slot = slot - (256 + LENGTH_CODES)
    ours = ~alone[image]
    image, at, slot = image[ours], at[ours], slot[ours]
    if len(at):
        if not bits[image].all():
            raise ValueError("a cache symbol without a cache")
        has_cached[image] = True
        _roots(parent)
        which = np.repeat(np.arange(len(first)), last - first)
        slots = ((out * np.uint32(CACHE_FACTOR)) >> (32 - np.maximum(bits, 1)).astype(np.uint32)[which[: len(out)]]).astype(np.uint16)
        slots[at] = slot
        slots = slots[parent]
        order = np.argsort(slots, kind="stable")  # of one slot in the order of pixels, so image by image
        here, before = order[1:], order[:-1]
        same = (slots[here] == slots[before]) & (which[here] == which[before])
        earlier = np.full(len(out), -1)
        earlier[here[same]] = before[same]
        empty = earlier[at] < 0
        alone[image[empty]] = True  # such a pixel is 0 and enters another slot
        parent[at[~empty]] = earlier[at[~empty]]
    _roots(parent)
    pixels = out[parent]
    return [None if a else (pixels[s:e], c, h) for a, s, e, c, h in zip(alone.tolist(), first.tolist(), last.tolist(), has_copies.tolist(), has_cached.tolist())]


def decode_many(files: list[bytes], parts: list[set[str]] | None = None) -> list[np.ndarray]:
    """What ``webp.decode`` gives of each file, and into each set of ``parts``."""
    parts = [set() for _ in files] if parts is None else parts
    streams = [lossless_part(f) for f in files]
    begun = [begin_stream(s) for s in streams]
    together, pos, sizes, cache_bits = [], [], [], []
    for k, (bits, _, size, _) in enumerate(begun):
        at = bits.position
        cache = bits.read(4) if bits.read(1) else None
        if not bits.read(1) and (cache is None or 1 <= cache <= 11):
            together.append(k)
            pos.append(bits.position)
            sizes.append(size)
            cache_bits.append(cache or 0)
        bits.seek(at)
    found = [None] * len(files)
    if len(together) > FEW:
        for k, x in zip(together, _read_many([streams[k] for k in together], pos, sizes, cache_bits)):
            found[k] = x
    out = []
    for (bits, undo, (w, h), opaque), x, used in zip(begun, found, parts):
        if x is None:
            pixels = read_image(bits, w, h, True, used)
        else:
            pixels, copied, cached = x
            used.update(name for name, there in (("backward", copied), ("cache", cached)) if there)
        out.append(end_stream(pixels.reshape(h, w), undo, opaque, used))
    return out


# --- writing -----------------------------------------------------------------------------------------

#: Bits of a sort key that are a pixel's place; the rest are of the hash of three pixels.
PLACE = 24
#: Symbols of the green code with the largest cache that is written.
GREENS = 256 + LENGTH_CODES + 128


def _tree_depths(weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Depths of each row's leaves in its Huffman tree; rows of at least two ascending weights, the longest row first."""
    rows, most = len(n), weights.shape[1]
    wide = most + 1
    none = np.iinfo(np.int64).max
    leaves = np.full((rows, wide), none)
    leaves[:, :most] = np.where(np.arange(most) < n[:, None], weights, none)
    made = np.full((rows, wide), none)
    of_leaf, of_made = np.zeros((rows, wide), np.int64), np.zeros((rows, wide), np.int64)
    leaf, inner = np.arange(rows) * wide, np.arange(rows) * wide
    flat = [x.ravel() for x in (leaves, made, of_leaf, of_made)]
    active = np.searchsorted(-n, -np.arange(1, most), "left")  # rows with more than so many leaves
    for k, m in enumerate(active.tolist()):
        a, b, weight = leaf[:m], inner[:m], 0
        for _ in range(2):
            x, y = flat[0][a], flat[1][b]
            first = x <= y
            weight = weight + np.where(first, x, y)
            flat[2][a[first]] = k
            flat[3][b[~first]] = k
            a += first
            b += ~first
        made[:m, k] = weight
    depth = np.zeros((rows, wide), np.int64)
    at = np.arange(rows)
    for k in range(most - 3, -1, -1):
        m = int(active[k + 1])
        depth[:m, k] = depth[at[:m], of_made[:m, k]] + 1
    return np.take_along_axis(depth, of_leaf[:, :most], 1) + 1


def lengths_of(counts: np.ndarray, limit: int) -> np.ndarray:
    """``webp.code_lengths`` of each row of counts."""
    out = np.zeros(counts.shape, np.uint8)
    used = (counts > 0).sum(axis=1)
    alone = np.flatnonzero(used == 1)
    out[alone, counts[alone].argmax(axis=1)] = 1
    left = np.flatnonzero(used > 1)
    left = left[np.argsort(-used[left], kind="stable")]
    now = counts[left].astype(np.int64)
    while len(left):
        n = used[left]
        row, symbol = np.nonzero(now)
        weight = now[row, symbol]
        order = np.argsort(row << 40 | weight, kind="stable")
        symbol, weight = symbol[order], weight[order]
        place = _spread(np.zeros(len(n), np.int64), n)
        table = np.zeros((len(n), int(n[0])), np.int64)
        table[row, place] = weight
        depth = _tree_depths(table, n)
        deepest = np.where(np.arange(depth.shape[1]) < n[:, None], depth, 0).max(axis=1)
        fine = deepest <= limit
        some = fine[row]
        out[left[row[some]], symbol[some]] = depth[row[some], place[some]]
        left = left[~fine]
        now = now[~fine]
        now = np.where(now > 0, now // 2 + 1, 0)  # flatter counts, shorter codes
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.canonical`` of each row of lengths: the codes, their first bit lowest, and what is written of each."""
    row, symbol = np.nonzero(lengths)
    length = lengths[row, symbol].astype(np.int64)
    length[np.bincount(row, minlength=len(lengths))[row] == 1] = 0
    order = np.argsort((row << 4 | length), kind="stable")
    row, symbol, length = row[order], symbol[order], length[order]
    width = np.zeros(len(lengths), np.int64)
    np.maximum.at(width, row, length)
    share = 1 << (width[row] - length)
    end = np.cumsum(share)
    total = 1 << width
    first = end - share - (np.cumsum(total) - total)[row]
    code, n = np.zeros(lengths.shape, np.int64), np.zeros(lengths.shape, np.int64)
    code[row, symbol] = _turned(15)[first] >> (15 - width[row])
    n[row, symbol] = length
    return code, n


def _code_fields(lengths: np.ndarray):
    """What ``webp.put_code`` writes of each row of lengths: the rows, in order, values and widths of fields."""
    used = (lengths > 0).sum(axis=1)
    last = lengths.shape[1] - 1 - (lengths[:, ::-1] > 0).argmax(axis=1)
    simple = (used <= 2) & (last < 256)
    rows, values, widths = [], [], []
    some = np.flatnonzero(simple)
    one, two = (lengths[some] > 0).argmax(axis=1), used[some] == 2
    wide = np.where(one > 1, 8, 1)
    rows.append(some)
    values.append(1 | two << 1 | (one > 1) << 2 | one << 3 | np.where(two, last[some], 0) << (3 + wide))
    widths.append(3 + wide + 8 * two)
    some = np.flatnonzero(~simple)
    if len(some):
        size = last[some] + 1
        each = np.repeat(np.arange(len(some)), size)
        flat = lengths[some][each, _spread(np.zeros(len(some), np.int64), size)].astype(np.int64)
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (each[1:] != each[:-1])
        start = np.flatnonzero(new)
        value, code, run = flat[start], each[start], np.diff(start, append=len(flat))
        seen = np.maximum.accumulate(np.where(value > 0, np.arange(len(value)), -1))  # the last run of a length that is not zero
        before = np.full(len(value), 8)
        earlier = np.append(-1, seen[:-1])
        there = earlier >= 0
        there[there] = code[earlier[there]] == code[there]
        before[there] = value[earlier[there]]
        lead = ((value > 0) & (value != before)).astype(np.int64)
        most = np.where(value > 0, 6, 138)
        full, rest = np.divmod(run - lead, most)
        single = np.where(rest < 3, rest, 0)
        short = (rest >= 3).astype(np.int64)
        n = lead + full + single + short
        of = np.repeat(np.arange(len(value)), n)
        k = _spread(np.zeros(len(n), np.int64), n)
        plain = (k < lead[of]) | (k >= (lead + full + short)[of])
        length = np.where(k < (lead + full)[of], most[of], rest[of])
        v = value[of]
        token = np.where(plain, v, np.where(v > 0, 16, np.where(length <= 10, 17, 18)))
        extra = np.where(plain, 0, np.where(token == 18, length - 11, length - 3))
        extra_n = np.array([0] * 16 + [2, 3, 7])[token]
        owner = code[of]
        first = lengths_of(np.bincount(owner * 19 + token, minlength=19 * len(some)).reshape(-1, 19), 7)
        by_order = first[:, CODE_LENGTH_ORDER].astype(np.int64)
        end = np.maximum(19 - (by_order[:, ::-1] > 0).argmax(axis=1), 4)
        tokens = np.bincount(owner, minlength=len(some))
        bits = np.frexp(np.maximum(tokens - 2, 1).astype(np.float64))[1].astype(np.int64)
        wide = np.where(tokens > 5, np.maximum(1, -(-(bits - 2) // 2)), 0)
        head = by_order << 3 * np.arange(19)
        codes, n = codes_of(first)
        rows += [some, some, some, some[owner]]
        values += [(end - 4) << 1, head.sum(axis=1), 1 | wide << 1 | (tokens - 2) << 4, codes[owner, token] | extra << n[owner, token]]
        widths += [np.full(len(some), 5), 3 * end, 6 + 2 * wide, n[owner, token] + extra_n]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(values)[order], np.concatenate(widths)[order]


def _packed(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[list[bytes], np.ndarray]:
    """Streams of the fields (stream in ascending order, value, width) of each piece, one piece after the other, and their bits."""
    sizes = np.stack([np.bincount(of, width, n).astype(np.int64) for of, _, width in pieces])
    bits = sizes.sum(axis=0)
    octets = (bits + 7) >> 3
    base = np.cumsum(octets) - octets
    begin = 8 * base + np.cumsum(sizes, axis=0) - sizes
    words = np.zeros(int(octets.sum()) // 8 + 2, np.uint64)
    for (of, value, width), size, first in zip(pieces, sizes, begin):
        at = np.cumsum(width) - width + (first - (np.cumsum(size) - size))[of]
        value, by = value.astype(np.uint64), (at & 63).astype(np.uint64)
        np.add.at(words, at >> 6, value << by)
        np.add.at(words, (at >> 6) + 1, value >> np.uint64(1) >> (np.uint64(63) - by))
    data = words.astype("<u8", copy=False).tobytes()
    return [data[s : s + k] for s, k in zip(base.tolist(), octets.tolist())], bits


def _copies(flat: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the back-references that ``webp._matches`` finds in each image."""
    place = np.uint64(PLACE if len(flat) < 1 << PLACE else 32)
    whole = np.flatnonzero(image[:-2] == image[2:])
    wide = flat.astype(np.uint64)
    key = wide[whole] * np.uint64(0x9E3779B97F4A7C15) ^ wide[whole + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[whole + 2] * np.uint64(0x165667B19E3779F9)
    key = key >> place << place | whole.astype(np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    here, before = order[1:], order[:-1]
    same = (key[1:] ^ key[:-1] < np.uint64(1) << place) & (image[here] == image[before])
    here, before = here[same], before[same]
    true = (flat[here] == flat[before]) & (flat[here + 1] == flat[before + 1]) & (flat[here + 2] == flat[before + 2])
    far = np.zeros(len(flat), np.int64)
    far[here[true]] = here[true] - before[true]
    first = np.flatnonzero(np.diff(far, prepend=0))
    last, distance = np.append(first[1:], len(far)), far[first]
    some = distance > 0
    out, at = [], 0
    for s, e, d in zip(first[some].tolist(), last[some].tolist(), distance[some].tolist()):
        if s < at:
            s = at
        while s < e:
            n = e + SHORTEST - 1 - s
            if n > LONGEST:
                n = LONGEST
            out.append((s, n, d))
            s += n
            at = s
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def put_images(heads: list[tuple[int, int]], images: list[np.ndarray], main: bool) -> tuple[list[bytes], np.ndarray]:
    """Streams of the bits of each head (their number, and how many) and of an image as ``webp.put_image`` writes it, and their bits."""
    n = np.array([i.size for i in images], np.int64)
    count = len(images)
    flat = np.concatenate([i.ravel() for i in images])
    image = np.repeat(np.arange(count), n)
    at, length, distance = _copies(flat, image)
    starts = np.ones(len(flat), bool)
    starts[_spread(at + 1, length - 1)] = False
    copied = np.zeros(len(flat), bool)
    copied[at] = True
    green = ((flat >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    cache_bits = np.zeros(count, np.int64)
    if main:
        bits = np.minimum(7, np.frexp(n.astype(np.float64))[1] - 2)
        may = n >= MANY
        slot = ((flat * np.uint32(CACHE_FACTOR)) >> (32 - np.where(may, bits, 7)).astype(np.uint32)[image]).astype(np.uint8)
        order = np.argsort(slot, kind="stable")
        here, before = order[1:], order[:-1]
        hit = np.zeros(len(flat), bool)
        hit[here[(slot[here] == slot[before]) & (flat[here] == flat[before]) & (image[here] == image[before])]] = True
        hit &= starts & ~copied & may[image]
        there = np.bincount(image[hit] * 128 + slot[hit], minlength=128 * count).reshape(count, 128)
        use = 10 * there.sum(axis=1) > 8 * (there > 0).sum(axis=1) + 40
        cache_bits[use] = bits[use]
        hit &= use[image]
        green[hit] = slot[hit].astype(np.int64) + (256 + LENGTH_CODES)
    long_symbol, long_extra, long_n = _prefix_of(length)
    green[at] = 256 + long_symbol
    far_symbol, far_extra, far_n = _prefix_of(distance + len(NEAR))
    place = np.flatnonzero(starts)
    green, owner = green[place], image[place]
    pixel = np.flatnonzero(green < 256)
    others, owners = flat[place[pixel]], owner[pixel]
    channels = [((others >> np.uint32(k)) & np.uint32(255)).astype(np.int64) for k in (16, 0, 24)]
    counts = [np.bincount(owners * 256 + c, minlength=256 * count).reshape(count, 256) for c in channels]
    literals = np.bincount(owners, minlength=count)
    alone = [c.max(axis=1) == literals for c in counts]
    shared = np.flatnonzero(~(alone[0] & alone[1] & alone[2]))
    copying = np.flatnonzero(np.bincount(image[at], minlength=count))
    table = np.zeros((count + len(shared) + len(copying), GREENS), np.int64)
    table[:count] = np.bincount(owner * GREENS + green, minlength=GREENS * count).reshape(count, GREENS)
    table[count : count + len(shared), :256] = sum(np.where(a[:, None], 0, c) for c, a in zip(counts, alone))[shared]
    table[count + len(shared) :, :DISTANCE_CODES] = np.bincount(image[at] * DISTANCE_CODES + far_symbol, minlength=DISTANCE_CODES * count).reshape(count, -1)[copying]
    lengths = lengths_of(table, 15)
    row, value, width = _code_fields(lengths)
    codes, code_n = codes_of(lengths)
    row_of = np.zeros((2, count), np.int64)
    row_of[0, shared] = count + np.arange(len(shared))
    row_of[1, copying] = count + len(shared) + np.arange(len(copying))
    cut = np.searchsorted(row, [count, count + len(shared)])
    limbs = [-(-k // 32) for _, k in heads]
    pieces = [(
        np.repeat(np.arange(count), limbs),
        np.array([v >> 32 * k & 0xFFFFFFFF for (v, _), m in zip(heads, limbs) for k in range(m)], np.int64),
        np.array([min(32, b - 32 * k) for (_, b), m in zip(heads, limbs) for k in range(m)], np.int64),
    )]
    cached = cache_bits > 0
    pieces.append((np.arange(count), cached | cache_bits << 1, 1 + 4 * cached + int(main)))
    pieces.append((row[: cut[0]], value[: cut[0]], width[: cut[0]]))
    of, same = shared[row[cut[0] : cut[1]] - count], slice(cut[0], cut[1])
    for c, a in zip(counts, alone):
        k, s = np.flatnonzero(a), c[a].argmax(axis=1)
        own = ~a[of]
        one = np.concatenate([k, of[own]])
        order = np.argsort(one, kind="stable")
        pieces.append((one[order], np.concatenate([1 | (s > 1) << 2 | s << 3, value[same][own]])[order], np.concatenate([np.where(s > 1, 11, 4), width[same][own]])[order]))
    k = np.setdiff1d(np.arange(count), copying)
    one = np.concatenate([k, copying[row[cut[1] :] - count - len(shared)]])
    order = np.argsort(one, kind="stable")
    pieces.append((one[order], np.concatenate([np.ones(len(k), np.int64), value[cut[1] :]])[order], np.concatenate([np.full(len(k), 4), width[cut[1] :]])[order]))
    value, width = codes[owner, green], code_n[owner, green]
    for c, a in zip(channels, alone):
        some = ~a[owners]
        p, r = pixel[some], row_of[0][owners[some]]
        value[p] |= codes[r, c[some]] << width[p]
        width[p] += code_n[r, c[some]]
    p, r = np.flatnonzero(copied[place]), row_of[1][image[at]]
    for v, w in ((long_extra, long_n), (codes[r, far_symbol], code_n[r, far_symbol]), (far_extra, far_n)):
        value[p] |= v << width[p]
        width[p] += w
    pieces.append((owner, value, width))
    return _packed(pieces, count)


def _chosen(images: list[np.ndarray]) -> list[tuple]:
    """Each image (all of one width) after the transform of least entropy, as ``webp._transforms`` gives it."""
    height = np.array([len(i) for i in images], np.int64)
    count, across = len(images), images[0].shape[1]
    rows = np.concatenate(images)
    first = np.cumsum(height) - height
    owner = np.repeat(np.arange(count), height)
    step = np.maximum(1, height // SEEN)
    line = np.arange(len(rows)) - first[owner]
    seen = np.flatnonzero(line % step[owner] == 0)
    of, top = owner[seen], line[seen] == 0
    n = np.bincount(of, minlength=count) * across
    times = _times_log(1 << (int(n.max()) - 1).bit_length())
    c = _octets(rows)
    now, above = c[seen], c[np.maximum(seen - 1, 0)]
    above[top] = 0
    offset = (of * 1024)[:, None, None] + np.arange(4) * 256

    def entropy(x):
        own = np.bincount((x + offset).ravel(), minlength=1024 * count)
        return 4 * n * np.log2(n) - times[own].reshape(count, 1024).sum(axis=1)

    tried = np.full((6, count), np.inf)
    tried[0] = entropy(now)
    x = now.copy()
    x[..., 0] -= now[..., 1]
    x[..., 2] -= now[..., 1]
    tried[1] = entropy(x)
    for mode in (1, 2):
        x = now.copy()
        if mode == 1:
            x[:, 1:] -= now[:, :-1]
            x[:, 0] -= above[:, 0]
        else:
            x -= above
            x[top, 1:] -= now[top, :-1]
        x[top, 0, 3] += 1
        tried[1 + mode] = entropy(x)
    blue, green, red = (c[..., k].view(np.int8).astype(np.int64) for k in range(3))
    total = lambda v: np.add.reduceat(v.sum(axis=1), first).astype(np.float64)
    size = (height * across).astype(np.float64)
    sums = [total(v) for v in (blue, green, red)]
    moment = {(a, b): total(p * q) - sums[a] * sums[b] / size for a, p in enumerate((blue, green, red)) for b, q in enumerate((blue, green, red)) if a <= b}
    least = lambda a, b: moment[a, b] ** 2 <= EXPLAINED * moment[a, a] * moment[b, b]
    fit = ~(least(1, 2) & least(0, 1) & least(0, 2))
    whole = lambda v: np.clip(np.round(v), -128, 127).astype(np.int64)
    varied = [np.maximum(1.0, moment[k, k]) for k in range(3)]
    green_red, green_blue = whole(32 * moment[1, 2] / varied[1]), whole(32 * moment[0, 1] / varied[1])
    red_blue = whole((32 * moment[0, 2] - green_blue * moment[1, 2]) / varied[2])
    factors = np.where(fit, (red_blue & 255) << 16 | (green_blue & 255) << 8 | green_red & 255, 0)
    if factors.any():
        x, signed = now.copy(), now.view(np.int8).astype(np.int64)
        x[..., 2] -= (green_red[of][:, None] * signed[..., 1] >> 5).astype(np.uint8)
        x[..., 0] -= ((green_blue[of][:, None] * signed[..., 1] >> 5) + (red_blue[of][:, None] * signed[..., 2] >> 5)).astype(np.uint8)
        tried[4] = np.where(factors > 0, entropy(x), np.inf)
    flat, image = rows.ravel(), np.repeat(owner, across)
    early = np.flatnonzero(np.arange(len(flat)) - first[image] * across < 512)
    key = image[early] << 32 | flat[early]
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-1))
    run, whose = np.diff(start, append=len(key)), key[start] >> 32
    colours = np.bincount(whose, minlength=count)
    few = colours <= 256
    plain = few & (height * across <= 512) & (step == 1) & (colours > 16)
    kept = np.bincount(whose, times[np.where(plain[whose], run, 0)], count)
    tried[5, plain] = (n * np.log2(n) - kept)[plain]
    tried = tried * height / (n // across) + np.array([0, 3, 60, 60, 60, 150])[:, None]
    tried[5] += 26 * colours
    for k in np.flatnonzero(few & ~plain).tolist():
        palette = palette_transform(images[k])
        if palette is not None:
            tried[5, k] = _entropies([palette[1][:: int(step[k])]])[0] * height[k] / (n[k] // across) + palette[0]
    out = []
    for k, best in enumerate(tried.argmin(axis=0).tolist()):
        p = images[k]
        if best == 0:
            out.append((p, None, None))
        elif best == 1:
            out.append((add_green(p, -1), SUBTRACT_GREEN, None))
        elif best < 4:
            out.append((_predict(p, best - 1), PREDICTOR, (best - 1) << 8))
        elif best == 4:
            f = int(factors[k])
            out.append((cross_colour(p, block_of(p.shape, f), 9, forward=True), CROSS_COLOUR, f))
        else:
            out.append(palette_transform(p)[1:])
    return out


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """What ``webp.encode`` gives of each image."""
    if not images:
        return []
    by_width: dict[int, list[int]] = {}
    for k, p in enumerate(images):
        by_width.setdefault(p.shape[1], []).append(k)
    chosen: list[tuple] = [()] * len(images)
    for some in by_width.values():
        for k, c in zip(some, _chosen([images[k] for k in some])):
            chosen[k] = c
    inner = {k: sub_image(images[k].shape, kind, content) for k, (_, kind, content) in enumerate(chosen) if kind not in (None, SUBTRACT_GREEN)}
    written = dict(zip(inner, zip(*put_images([(0, 0)] * len(inner), list(inner.values()), False)))) if inner else {}
    heads = []
    for k, (p, (_, kind, content)) in enumerate(zip(images, chosen)):
        head = BitWriter()
        put_head(head, p.shape, kind, content)
        if k in written:
            stream, n = written[k]
            head.put(int.from_bytes(stream, "little"), int(n))
        head.put(0, 1)
        heads.append((head.value, head.count))
    streams, _ = put_images(heads, [c[0] for c in chosen], True)
    return [riff(s) for s in streams]
