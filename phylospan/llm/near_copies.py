"""SimHash near copies at a similarity of shingle sets: tries of fingerprints find them, the sets decide.

A text's fingerprint is the SimHash of its set of 5-word shingles, 256 bits wide.  Texts with the same set meet
in one key before anything is compared.  One trie of all fingerprints would have to allow more differing bits
(near 10 of 64 at similarity 0.8) than its walk can prune at scale, so every text hangs in several tries, named
by the least of its hashed shingles; two texts of similarity 0.8 share at least one trie with probability 0.9998.
In each trie the members are first held against one leader after another, so that a large group of near copies
gives a number of pairs in proportion to its size.  Pairs within the error budget, and whose sets' bitmaps do not
prove them less similar, are checked on the shingle sets; what they join is a component.  Then each trie is joined with itself: node pairs are walked together, differing bits
are added up, and a node pair is dropped once it passes the budget or has members of one component only.  This
goes in rounds: first each text's nearest pairs leave a task and are checked, at last all that are left, of texts
that no earlier round has joined.  A trie with more
members than :data:`CELL` is dealt out in cells, so no task holds more, whatever the skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import dropped, each_row, fresh, quoted, with_computed, written
from phylospan.llm.components import connected_components
from phylospan.llm.simhash import SEED, _one_row_each, _signed, _starts, _trie_join, _word_runs
from phylospan.shipping import ship

SHINGLE = 5
SIMILAR = 0.8
#: Tries a text hangs in, and least values that name one.
TRIES, WIDTH = 12, 3
#: 64-bit words of a fingerprint; a trie is walked by the first.
WORDS = 4
#: Differing bits allowed in the first word and in all, some 3.7 deviations above those of similarity 0.8; sets of
#: up to eight shingles differ in more bits (fewer, with ties).
FIRST, TOTAL, TINY, TINY_TOTAL = 21, 62, 8, 74
#: Members of a trie that one task holds.
CELL = 4096
#: Bits of a set's bitmap for each of its members at least, and bits at most.
BITMAP, BITMAP_MOST = 4, 1 << 17
#: Of a text's pairs in a cell so many, the nearest, are checked in the first rounds; the last round has all others.
ROUNDS = (1, 8)

_rng = np.random.default_rng(SEED)
_times = _rng.integers(0, 1 << 64, TRIES * WIDTH, dtype=np.uint64) | np.uint64(1)
_plus = _rng.integers(0, 1 << 64, TRIES * WIDTH, dtype=np.uint64)
_spread = _rng.integers(0, 1 << 64, WORDS - 1, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 values of a text's word shingles, sorted, each once.

    Words are those of :func:`phylospan.llm.simhash.fingerprint`; fewer than a shingle are one shingle, none give the empty set.
    """
    found, n, held = [np.empty(0, np.uint64)], 0, []
    for words in _word_runs((text or "").encode().lower()):
        held = held[len(held) - min(len(held), shingle - 1) :] + words if n else held + words
        if len(held) < shingle:
            continue
        joined = b" ".join(held)
        size = np.fromiter(map(len, held), np.int64, len(held)) + 1
        end = np.cumsum(size) - 1
        start = (end + 1 - size).tolist()
        end = end[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        found.append(np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(start, end)], np.uint64)))
        n += len(end)
    if not n and held:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashed shingles: the first word of their own bits, further words of these mixed anew."""
    ones = np.zeros((WORDS, 64), np.int64)
    for lo in range(0, len(shingles), 1 << 12):
        h = shingles[lo : lo + (1 << 12)]
        for k in range(WORDS):
            x = h
            if k:
                x = (h ^ (h >> np.uint64(32))) * _spread[k - 1]
                x = x ^ (x >> np.uint64(29))
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view("<u8")[:, 0]


def trie_names(shingles: np.ndarray) -> list[int]:
    """The tries of a set: each of :data:`WIDTH` least values under hash functions of its own."""
    least = np.full(len(_times), ~np.uint64(0))
    for lo in range(0, len(shingles), 1 << 11):
        np.minimum(least, (shingles[lo : lo + (1 << 11), None] * _times + _plus).min(axis=0), out=least)
    return [_signed(xxhash.xxh3_64_intdigest(least[k * WIDTH : (k + 1) * WIDTH].tobytes(), k)) for k in range(TRIES)]


def bitmap(shingles: np.ndarray) -> bytes:
    """A set's members as bits at their values' low bits, a power of two in all: what one bitmap has beyond another
    is no more than what its set has beyond the other's."""
    n = 1 << max(6, (min(BITMAP * len(shingles), BITMAP_MOST) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[shingles & np.uint64(n - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(bitmaps, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of sets, a number of members that they have in common at most, from their bitmaps and sizes.

    Of two bitmaps the longer one is folded to the other's length."""
    out = np.empty(len(i), np.int64)
    used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    at_i, at_j = at[: len(i)], at[len(i) :]
    length = np.array([len(bitmaps[k]) for k in used], np.int64)
    narrow = np.minimum(length[at_i], length[at_j])
    for n in np.unique(narrow):
        pairs = np.flatnonzero(narrow == n)
        here, row = np.unique(np.concatenate((at_i[pairs], at_j[pairs])), return_inverse=True)
        words = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[used[k]], "<u8").reshape(-1, n // 8), axis=0) for k in here])
        step = max(1, (1 << 22) // int(n))
        for lo in range(0, len(pairs), step):
            some = pairs[lo : lo + step]
            a, b = words[row[lo : lo + len(some)]], words[row[len(pairs) + lo : len(pairs) + lo + len(some)]]
            beyond = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            out[some] = np.minimum(sizes[i[some]] - beyond(a, b), sizes[j[some]] - beyond(b, a))
    return out


def _described(shingle: int):
    """Of a text: the key of its shingle set, its tries, its fingerprint's words with the size of the set, and its bitmap."""

    def row(text):
        s = shingle_set(text, shingle)
        if not len(s):
            return 0, [], [0] * (WORDS + 1), b""
        return _signed(xxhash.xxh3_64_intdigest(s.tobytes()) | 1), trie_names(s), [*wide_fingerprint(s).view(np.int64).tolist(), len(s)], bitmap(s)

    return lambda: row


class _Tries:
    """Whole cells in turn, from batches sorted by ``(trie, one, other)``; columns go on with ``cell, key, root``, the fingerprint's words, the size and the bitmap.

    Gives pairs ``(a, b)`` of keys with the bits that differ, within the budgets and with sizes and bitmaps that allow the
    similarity.  Of many texts that are alike but less similar no pair leaves the task so.
    """

    def __init__(self, similar: float, nearest: int | None = None):
        self.similar, self.nearest = similar, nearest

    def __call__(self, batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8 + WORDS)]
            held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            starts = _starts(held[:3])
            cut = int(starts[-1]) if len(starts) else 0  # the last cell may go on
            if cut:
                yield from self._pairs([c[:cut] for c in held], starts[:-1])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from self._pairs(held, np.zeros(1, np.int64))

    def _pairs(self, cols, starts):
        key, words, size, bitmaps = cols[4], [c.view(np.uint64) for c in cols[6 : 6 + WORDS]], cols[-2], cols[-1]
        for i, j in self.found(cols, words, starts, np.append(starts[1:], len(key))):
            bits = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
            near = (bits <= np.where(np.minimum(size[i], size[j]) <= TINY, TINY_TOTAL, TOTAL)) & (np.minimum(size[i], size[j]) >= self.similar * np.maximum(size[i], size[j]))
            i, j, bits = i[near], j[near], bits[near]
            if len(i):
                both = most_common(bitmaps, size, i, j)
                near = both / (size[i] + size[j] - both) >= self.similar
                i, j, bits = i[near], j[near], bits[near]
            a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
            if self.nearest is not None and len(a):
                of = np.searchsorted(starts, i, "right")
                order = np.lexsort((b, bits, a, of))
                first = _starts([of[order], a[order]])
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                keep = order[rank < self.nearest]
                a, b, bits = a[keep], b[keep], bits[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits)], names=["a", "b", "bits"])


class _Led(_Tries):
    """In each cell, each member paired with the first leader within the budget; one without becomes a leader."""

    def found(self, cols, words, starts, ends):
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            left = np.arange(lo, hi)
            while len(left) > 1:
                first, left = left[0], left[1:]
                near = sum(np.bitwise_count(w[left] ^ w[first]).astype(np.int64) for w in words) <= TINY_TOTAL
                yield np.full(int(near.sum()), first), left[near]
                left = left[~near]


class _Joined(_Tries):
    """In each cell, or between its two, the trie self-join: pairs of different components within the budgets."""

    def found(self, cols, words, starts, ends):
        _, one, other, cell, _, root = cols[:6]
        order = np.lexsort((words[0], np.repeat(np.arange(len(starts)), ends - starts)))
        zero = np.zeros(len(starts), np.int64)
        i, j = _trie_join(words[0][order], starts, ends, starts, ends, zero, zero, FIRST, root[order])
        i, j = order[i], order[j]
        keep = (root[i] != root[j]) & ((one[i] == other[i]) | (cell[i] != cell[j]))
        yield i[keep], j[keep]


def _proposed(cells: DataFrame, sets: DataFrame, how: _Tries) -> DataFrame:
    """``(a, b, bits)``: the pairs that ``how`` finds, once each; fingerprints and bitmaps join the cells' members last."""
    key = ["trie", "one", "other"]
    own = sets.select("key", *[F.col("fp")[k].alias(f"f{k}") for k in range(WORDS + 1)], "bits")
    columns = [*key, "cell", "key", "root", *own.columns[1:]]
    dealt = cells.select(*columns[:6]).join(own, "key").select(*columns).repartition(*key).sortWithinPartitions(*key, "key")
    return written(dealt.mapInArrow(how, "a long, b long, bits long").distinct(), "proposed-pairs")


def _split_cells(members: DataFrame, cell: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members of tries with several components, dealt to the pairs of cells that they must be compared in; and the
    written tables they come from.

    A small trie is one cell.  In a larger one a component of many members has cells of its own, which are
    not compared among themselves; the others share cells by component.
    """
    sizes = members.groupBy("trie", "root").agg(F.count("*").alias("n"))
    tries = sizes.groupBy("trie").agg(F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    part = sizes.join(tries, "trie")
    own = (F.col("all") > cell) & (F.col("n") > cell // 4)
    part = part.select("trie", "root", own.alias("own"), F.when(own, F.ceil(F.col("n") / cell)).otherwise(F.ceil(F.col("all") / cell)).alias("parts"))
    part = written(part, "trie-parts")
    share = F.when(F.col("own"), F.pmod(F.xxhash64("key"), "parts")).otherwise(F.pmod(F.xxhash64("root"), "parts"))
    placed = members.join(part, ["trie", "root"]).withColumn("cell", F.xxhash64(F.when(F.col("own"), F.col("root")), share))
    placed = written(placed.withColumn("all_of", F.when(F.col("own"), F.col("root"))).drop("own", "parts"), "trie-cells")
    cells = placed.groupBy("trie", "cell").agg(F.first("all_of").alias("all_of"))
    a, b = cells.toDF("trie", "one", "all_a"), cells.toDF("trie", "other", "all_b")
    pairs = written(a.join(b, "trie").where("one <= other and not coalesce(all_a = all_b, false)").select("trie", "one", "other"), "cell-pairs")
    sides = pairs.select("trie", "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("cell"))
    return placed.join(sides, ["trie", "cell"]), [part, placed, pairs]


def similar_links(rows: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, cell: int = CELL) -> DataFrame:
    """``(node, root)``: components of keys whose shingle sets are similar, from ``rows(key, tries, fp, bits, text)``."""
    ship(rows.sparkSession)
    sets = written(rows.where("size(tries) > 0").select("key", "tries", "fp", "bits").dropDuplicates(["key"]), "shingle-sets")
    members = sets.select("key", F.explode("tries").alias("trie"))
    shared = members.groupBy("trie").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(shared, "trie"), "trie-members")
    keys = written(members.select("key").distinct(), "shared-keys")
    every, sets = sets, written(sets.join(keys, "key", "left_semi").drop("tries"), "shared-sets")
    for table in (every, keys):
        dropped(table)
    slim = rows.select("key", "text")

    def checked(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        texts = slim.join(keys, "key", "left_semi").dropDuplicates(["key"])
        own = written(each_row(texts, lambda: lambda key, text: (key, shingle_set(text, shingle).view(np.int64)), "key long, shingles array<long>", rows=64), "proposed-sets")
        both = pairs.join(own.toDF("a", "of_a"), "a").join(own.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b", F.size(F.array_intersect("of_a", "of_b")).alias("both"))
        found = written(both.where(F.col("both") / (F.size("of_a") + F.size("of_b") - F.col("both")) >= similar).select("a", "b"), "similar-pairs")
        dropped(own)
        return found

    part = F.pmod(F.xxhash64("key", "trie"), F.ceil(F.col("n") / cell))
    led = members.withColumns({"one": part, "other": part, "cell": part, "root": F.col("key")})
    proposed = _proposed(led, sets, _Led(similar))
    links = checked(proposed.select("a", "b"))
    dropped(proposed)
    roots = connected_components(links, "near-copies")
    tried = []
    for nearest in (*ROUNDS, None):
        rooted = members.drop("n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        rooted = written(rooted, "rooted-members")
        cells, parts = _split_cells(rooted, cell)
        found = _proposed(cells, sets, _Joined(similar, nearest))
        for table in (rooted, *parts):
            dropped(table)
        if found.isEmpty():
            break
        now = found.select("a", "b")
        for before in tried:
            now = now.join(before.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(found)
        links = links.unionByName(checked(now))
        roots = connected_components(links, "near-copies")
    for table in (sets, members, *tried):
        dropped(table)
    return roots


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each component of texts of similarity ``similar`` or more: that of its smallest id.

    All columns are kept, whatever their names.  Null and blank texts are alike.  Of rows that repeat a component's smallest
    id one stays (that with the smallest text); rows with a null id stay, as they cannot be told apart.  An empty table
    gives an empty result.
    """
    key, tries, fp, bits = (fresh(docs, n) for n in ("shingle_key", "shingle_tries", "shingle_fp", "shingle_bits"))
    rows = written(with_computed(docs, [text_col], _described(shingle), f"`{key}` long, `{tries}` array<long>, `{fp}` array<long>, `{bits}` binary"), "described")
    slim = rows.select(quoted(key).alias("key"), quoted(tries).alias("tries"), quoted(fp).alias("fp"), quoted(bits).alias("bits"), quoted(text_col).cast("string").alias("text"))
    return _one_row_each(rows, docs.columns, key, similar_links(slim, shingle, similar, cell), id_col, text_col)
