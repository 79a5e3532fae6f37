"""SimHash near-duplicates: fingerprints of word shingles and a binary trie self-join on them.

Two fingerprints within ``k`` differing bits agree on at least one of ``k + 1`` blocks of bits.  For each
block the fingerprints are rotated so that it comes first, and hung into a binary trie; only the nodes
just below an equal block need to be joined with themselves.  The join walks pairs of nodes together,
from (n, n) to (n0, n0), (n1, n1) and (n0, n1), adds up the bits in which the two paths differ, and drops
a pair whose sum passes the budget.  Node pairs are dealt to tasks; one with more members than a task
should hold is walked some levels further by the cluster first, into the node pairs below it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, fresh, quoted, with_computed, written
from phylospan.llm.components import connected_components
from phylospan.shipping import ship

BITS = 64
BUDGET = 2
SHINGLE = 3
SEED = 42
#: Members of a node pair that one task joins by itself.
NODE_PAIR = 1024
#: Trie levels that the cluster walks at once in larger node pairs.
LEVELS = 6


# --- fingerprints ------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number.

    A-Z are lower-cased, words are runs of anything but space and the controls 9 to 13.  A bit is set if it
    is set in over half of the shingles' XXH64 values, repeats included.  Fewer words than a shingle: the
    whole sequence is the one shingle; no word (or null): 0.
    """
    data = (text or "").encode().lower()
    ones, n, held = np.zeros(BITS, np.int64), 0, []
    for words in _word_runs(data):
        held = held[len(held) - min(len(held), shingle - 1) :] + words if n else held + words
        if len(held) < shingle:
            continue
        bits, count = _counted(held, shingle)
        ones, n = ones + bits, n + count
    if not n:
        return _signed(xxhash.xxh64_intdigest(b" ".join(held), SEED)) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _word_runs(data: bytes, size: int = 1 << 22):
    """The words of a text, those of some megabytes at a time."""
    lo = 0
    while len(data) - lo > size:
        cut = max(data.rfind(c, lo, lo + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            break
        yield data[lo:cut].split()
        lo = cut + 1
    yield data[lo:].split()


def _counted(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """Set bits by place over all shingles of at least as many words, and the number of shingles."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end + 1 - size).tolist()
    end = end[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(end), 1 << 14):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(start[lo : lo + (1 << 14)], end[lo : lo + (1 << 14)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones, len(end)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _row_setup(shingle: int):
    return lambda: lambda text: (fingerprint(text, shingle),)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long)`` per row; see :func:`fingerprint`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return each_row(rows, lambda: lambda doc_id, text: (doc_id, fingerprint(text, shingle)), "doc_id long, fp long")


# --- the trie self-join ------------------------------------------------------------------------------


def _blocks(budget: int) -> list[tuple[int, int]]:
    """``(rotation, width)`` of the ``budget + 1`` blocks."""
    edge = [round(k * BITS / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _rotated(x, by: int):
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, BITS - by))


def _node(x, depth, diff):
    """The first node of the pair that a member is in: the path to it, with the pair's first differing bit 0.

    ``diff`` has the bits in which the two paths differ.  Shifts go by halves, for a shift by 64 is none.
    """
    rest = F.lit(BITS) - depth
    low = F.floor(rest / 2).cast("int")
    high = (rest - low).cast("int")
    path = F.call_function("shiftright", F.call_function("shiftright", x, low), high)
    path = F.call_function("shiftleft", F.call_function("shiftleft", path, low), high)
    other = path.bitwiseXOR(diff)
    # of two paths that differ first at a bit, the one with 0 there is the smaller unsigned number
    sign = F.lit(-(1 << 63)).cast("long")
    return F.when(path.bitwiseXOR(sign) <= other.bitwiseXOR(sign), path).otherwise(other)


def _walked(rows: DataFrame, budget: int) -> DataFrame:
    """Members of node pairs dealt to the node pairs ``LEVELS`` levels below, those within the budget."""
    masks = [sum(1 << b for b in bits) for n in range(budget + 1) for bits in combinations(range(LEVELS), n)]
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("e")) for m in masks])
    step = F.least(F.lit(LEVELS), F.lit(BITS) - F.col("depth"))
    shift = (F.lit(BITS) - F.col("depth") - step).cast("int")
    below = rows.select("turn", (F.col("depth") + step).alias("depth"), "diff", "x", step.alias("step"), shift.alias("shift"), F.explode(table).alias("k"))
    below = below.where("k.e + bit_count(diff) <= %d and k.m < shiftleft(1L, step)" % budget)
    return below.select("turn", "depth", F.col("diff").bitwiseOR(F.call_function("shiftleft", F.col("k.m"), F.col("shift"))).alias("diff"), "x")


def trie_links(fps: DataFrame, budget: int = BUDGET, node_pair: int = NODE_PAIR) -> DataFrame:
    """Links ``(a long, b long)`` of distinct fingerprints ``fps(fp long)``: in each node pair a spanning forest of
    all pairs within ``budget`` bits, so that components are those of all pairs.

    A fingerprint has a bounded number of neighbours (2,080 for two bits), so what a task finds is bounded
    by what it holds.  No task gathers more than ``node_pair`` members of one node pair, whatever the skew.
    """
    turns = [
        fps.select(F.lit(r).alias("turn"), F.lit(w).alias("depth"), F.lit(0).cast("long").alias("diff"), _rotated(F.col("fp"), r).alias("x"))
        for r, w in _blocks(budget)
    ]
    rows = turns[0]
    for t in turns[1:]:
        rows = rows.unionByName(t)
    key = ["turn", "depth", "diff", "node"]
    ready = None
    while True:
        rows = rows.withColumn("node", _node(F.col("x"), F.col("depth"), F.col("diff")))
        sizes = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "node-pairs")
        some = rows.join(sizes.where(F.col("n") <= node_pair).select(*key), key, "left_semi")
        ready = some if ready is None else ready.unionByName(some)
        large = sizes.where(F.col("n") > node_pair).select(*key)
        if large.isEmpty():
            break
        rows = _walked(written(rows.join(large, key, "left_semi").drop("node"), "large-node-pairs"), budget)
    ship(fps.sparkSession)
    dealt = ready.repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "x").mapInArrow(_Joined(budget), "a long, b long")


class _Joined:
    """Joins whole node pairs, a bounded number of members at a time, from batches sorted by node pair."""

    SIZE = 1 << 15

    def __init__(self, budget: int):
        self.budget = budget

    def __call__(self, batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            if len(held[0]) >= self.SIZE:
                starts = _starts(held[:4])
                cut = int(starts[-1])  # the last node pair may go on
                if cut:
                    yield from self.links([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from self.links(held)

    def links(self, cols):
        turn, depth, diff, node, x = cols
        group = np.zeros(len(x), np.int64)
        group[_starts([turn, depth, diff, node])] = 1
        group = np.cumsum(group) - 1
        u = x.view(np.uint64)
        order = np.lexsort((u, group))
        u, group, turn = u[order], group[order], turn[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end = np.r_[first[1:], len(group)]
        g_diff, g_depth, g_node = diff[first].view(np.uint64), depth[first].astype(np.int64), node[first].view(np.uint64)
        # of a pair of two nodes, the members of the first come before those of the second
        apart = g_diff != 0
        middle = end.copy()
        if apart.any():
            high = np.zeros(len(u), bool)
            keep = ~np.uint64(0) << np.minimum(64 - g_depth, 63).astype(np.uint64)
            keep = np.where(g_depth >= 64, ~np.uint64(0), keep)
            high = (u & keep[group]) != g_node[group]
            middle = np.where(apart, end - np.add.reduceat(high.astype(np.int64), first), end)
        pairs = _trie_join(u, first, middle, np.where(apart, middle, first), np.where(apart, end, middle), g_depth, np.bitwise_count(g_diff).astype(np.int64), self.budget)
        a, b = _forest(len(u), *pairs)
        if len(a):
            by = turn[a].astype(np.uint64)
            back = [np.where(by == 0, v, (v >> by) | (v << ((np.uint64(64) - by) & np.uint64(63)))) for v in (u[a], u[b])]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in back], names=["a", "b"])


def _starts(keys) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _trie_join(u, alo, ahi, blo, bhi, depth, err, budget, label=None):
    """Index pairs within the budget, for node pairs given as ranges of the sorted ``u``; equal ranges are a node with itself.

    All node pairs of a level are walked at once; pairs of few members are compared directly.  With labels,
    node pairs whose members all have one label are left out.
    """
    if label is not None:
        change = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(label))
        until = change[np.searchsorted(change, np.arange(len(label)), "right").clip(max=len(change) - 1)]  # the run of equal labels ends here
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(alo):
        na, nb = ahi - alo, bhi - blo
        small = (na * nb <= 36) | (depth >= 64)
        if small.any():
            k = np.flatnonzero(small)
            for lo in range(0, len(k), 1 << 14):
                part = k[lo : lo + (1 << 14)]
                size = na[part] * nb[part]
                which = np.repeat(part, size)
                at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                i, j = alo[which] + at // nb[which], blo[which] + at % nb[which]
                near = (i < j) & (np.bitwise_count(u[i] ^ u[j]) <= budget)
                found_a.append(i[near])
                found_b.append(j[near])
        alo, ahi, blo, bhi, depth, err = (v[~small] for v in (alo, ahi, blo, bhi, depth, err))
        if not len(alo):
            break
        bit = np.uint64(1) << (63 - depth).astype(np.uint64)
        am = _split(u, alo, ahi, bit)
        same = alo == blo
        bm = np.where(same, am, _split(u, blo, bhi, bit))
        kids = [
            (alo, am, blo, bm, err, np.ones(len(alo), bool)),
            (am, ahi, bm, bhi, err, np.ones(len(alo), bool)),
            (alo, am, bm, bhi, err + 1, np.ones(len(alo), bool)),
            (am, ahi, blo, bm, err + 1, ~same),
        ]
        alo, ahi, blo, bhi, err, use = (np.concatenate(v) for v in zip(*kids))
        depth = np.tile(depth + 1, 4)
        use &= (err <= budget) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        if label is not None:
            a, b = np.minimum(alo, len(u) - 1), np.minimum(blo, len(u) - 1)
            use &= (until[a] < ahi) | (until[b] < bhi) | (label[a] != label[b])
        alo, ahi, blo, bhi, depth, err = (v[use] for v in (alo, ahi, blo, bhi, depth, err))
    return np.concatenate(found_a), np.concatenate(found_b)


def _split(u, lo, hi, bit):
    """In each range, sorted and equal above ``bit``, the first place where the bit is set."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        going = lo < hi
        if not going.any():
            return lo
        mid = (lo + hi) // 2
        is_set = (u[np.minimum(mid, len(u) - 1)] & bit) != 0
        hi = np.where(going & is_set, mid, hi)
        lo = np.where(going & ~is_set, mid + 1, lo)


def _forest(n, a, b):
    """Edges of a spanning forest: each linked index with the least index it reaches."""
    if not len(a):
        return a, b
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label, after)  # what a label learns, all under it learn
        after = after[after]
        if (after == label).all():
            break
        label = after
    k = np.flatnonzero(label != np.arange(n))
    return label[k], k


# --- operators ---------------------------------------------------------------------------------------


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Rows whose fingerprints differ in at most ``budget`` bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable.  Copies meet in one fingerprint before anything is joined, so they are never
    paired.  Null and blank texts have fingerprint 0 and link like any other; a null id keeps its row and
    never becomes a component's id (a component of null ids alone has null); repeated rows repeat; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(trie_links(fps.select("fp"), budget), "fingerprint-components")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of its smallest id.

    All columns are kept.  Of a component's rows that repeat its smallest id one stays (that with the smallest text); rows
    with a null id stay, as they cannot be told apart.
    """
    fp = fresh(docs, "fp")
    rows = written(with_computed(docs, [text_col], _row_setup(shingle), f"`{fp}` long"), "fingerprinted")
    roots = connected_components(trie_links(written(rows.select(quoted(fp).alias("fp")).distinct(), "fingerprints"), budget), "fingerprint-components")
    return _one_row_each(rows, docs.columns, fp, roots, id_col, text_col)


def _one_row_each(rows: DataFrame, columns: list[str], key: str, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``rows`` the row of each component's smallest id, for components ``(node, root)`` of the column ``key``; null ids stay.

    Winners are told by component, key and id, for one id may have texts in several components.  Texts are compared, and
    moved for it, only where a component repeats its smallest id."""
    ids = rows.select(quoted(key).alias("fp"), quoted(id_col).cast("long").alias("doc_id"))
    copies = ids.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    fps = written(copies.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n")), "distinct-fingerprints")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("winner")).where("winner is not null")
    winners = rooted.join(least, "root").where("least = winner")
    winners = winners.select("fp", "winner", "root", (F.sum("n").over(Window.partitionBy("root")) > 1).alias("repeated"))
    of, winner, root, repeated = (fresh(rows, n) for n in ("winner_fp", "winner", "winner_root", "winner_repeated"))
    winners = written(winners.toDF(of, winner, root, repeated), "winners")
    kept = lambda which: rows.join(winners.where(which), (quoted(key) == F.col(of)) & (quoted(id_col).cast("long") == F.col(winner)))
    out = kept(~F.col(repeated)).select(*map(quoted, columns))
    if not winners.where(F.col(repeated)).isEmpty():
        several = kept(F.col(repeated))
        first = fresh(several, "first")
        once = several.withColumn(first, F.row_number().over(Window.partitionBy(root).orderBy(quoted(text_col)))).where(F.col(first) == 1)
        out = out.unionByName(once.select(*map(quoted, columns)))
    return out.unionByName(rows.where(quoted(id_col).isNull()).select(*map(quoted, columns)))
