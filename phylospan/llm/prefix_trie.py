"""The trie of conversation prefixes, from sorted conversations and range minima of their common prefixes.

A rebuilt conversation is a sequence of turns, each a digest of its role and text with the text's length.
Sorted, the conversations that begin with the same ``d`` turns stand together, and the interval of a prefix
ends where the least common prefix of neighbours (LCP) falls below ``d``.  In every shard of the sorted order
a sparse table holds the LCP's minima over stretches of powers of two; each candidate prefix searches it to
the left and to the right by halving steps, independently of all others, and the interval gives its members, and by
prefix sums over the sorted order its leaves and its subtree.

Nodes whose interval goes over a shard's border are *open*: all their figures are sums or minima of the
shards' parts, which are added up by the prefix's digest.  Of a shard only the prefixes of its first and last
conversation can be open.  A conversation that a third of the table repeats is thus dealt over shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.llm.common import written
from phylospan.shipping import ship

#: Conversations of a group share the head of their first one; heads have fewer turns than ``HEADS``.
GROUP, HEADS = 100, 6
#: Bytes of a turn: its digest, and the code points of its text.
DIGEST, TURN = 16, 20
#: Bytes of sorted sequences in a shard on average, each conversation counting some bytes of its own.
SHARD_BYTES, OWN_BYTES = 4 << 20, 40
#: Conversations whose ids are joined in one piece of an open node's list.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


# --- sequences ---------------------------------------------------------------------------------------


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the sequences of rebuilt conversations, ``TURN`` bytes a turn.

    Turns are ordered by number, null first, equal ones by role and by digest of role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.concat(digest, F.lpad(F.hex(F.length(text)), 2 * (TURN - DIGEST), "0"))
    number = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(number.isNotNull().alias("k"), number.alias("n"), role.alias("r"), turn.alias("t")).alias("x"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("conv_id", F.col("x.t").alias("t"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")})
    heads = own.where("conv_id = base").select("base", F.slice("t", 1, HEADS - 1).alias("head"))
    both = own.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("turns"))


# --- one shard ---------------------------------------------------------------------------------------


def _units(turns: bytes) -> np.ndarray:
    return np.frombuffer(turns, ">u4").reshape(-1, TURN // 4)


def neighbour_lcp(units: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of turns that each sequence shares with the one before; -1 for the first."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(n, -1, np.int64)
    if n < 2:
        return out
    shared = np.minimum(size[:-1], size[1:])
    begin = np.concatenate(([0], np.cumsum(shared)))
    step = np.arange(begin[-1]) - np.repeat(begin[:-1], shared)
    equal = (units[np.repeat(offsets[:-2], shared) + step] == units[np.repeat(offsets[1:-1], shared) + step]).all(axis=1)
    out[1:] = shared
    differ = np.flatnonzero(~equal)
    if len(differ):
        pair = np.searchsorted(begin, differ, "right") - 1
        np.minimum.at(out, pair + 1, step[differ])
    return out


class Minima:
    """A sparse table: minima of an array over all stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over ``lo .. hi``, ends included."""
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k)) + 1])
        return out

    def reach_right(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The last position up to which all values after ``at`` are ``floor`` or more."""
        now = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            room = now + 1 < len(table)
            ok = room & (table[np.where(room, now + 1, 0)] >= floor)
            now += np.where(ok, 1 << k, 0)
        return now

    def reach_left(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first position from which all values up to ``at``, its own left out, are ``floor`` or more."""
        now = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = now - (1 << k) + 1
            room = start >= 0
            ok = room & (self.levels[k][np.where(room, start, 0)] >= floor)
            now -= np.where(ok, 1 << k, 0)
        return now


def _digests(turns: bytes, depths: list[int]) -> dict[int, bytes]:
    """Digests of prefixes by depth."""
    out, so_far, state = {}, 0, hashlib.sha256()
    for d in sorted(depths):
        state.update(turns[so_far * TURN : d * TURN])
        so_far = d
        out[d] = state.digest() + d.to_bytes(4, "big")
    return out


def shard_nodes(keys: list[bytes], ids: np.ndarray, before: bytes | None, after: bytes | None) -> tuple[list[tuple], list[tuple]]:
    """The nodes of a shard's sorted sequences, and the id lists of open nodes.

    A node is ``(key, parent_key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved,
    ends)``; ``key`` is set for open nodes, whose figures are this shard's part, and ``parent_key`` instead
    of ``parent_conv_id`` where the parent is open.  ``before`` and ``after`` are the neighbouring shards' sequences.
    """
    n = len(keys)
    size = np.array([len(k) // TURN for k in keys], np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    units = _units(b"".join(keys))
    lcp = neighbour_lcp(units, offsets)
    border = lambda a, b: int(neighbour_lcp(_units(a + b), np.array([0, len(a) // TURN, (len(a) + len(b)) // TURN]))[1])
    first = border(before, keys[0]) if before is not None else -1
    last = border(keys[-1], after) if after is not None else -1
    # candidates in order of the sequences and of depth, which is the trie's preorder; of the first sequence all prefixes
    least = np.concatenate(([0], lcp[1:] + 1))
    count = np.maximum(size - least + 1, 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    i = np.repeat(np.arange(n), count)
    d = np.arange(begin[-1]) - np.repeat(begin[:-1] - least, count)
    minima = Minima(lcp)
    left, right = minima.reach_left(i, d), minima.reach_right(i, d)
    starts = (i > 0) | (d > first)
    is_open = ((left == 0) & (d <= first)) | ((right == n - 1) & (d <= last))
    members = right - left + 1
    conv = Minima(ids).least(left, right)
    up = minima.reach_left(i, d - 1)
    parent = np.where(d > 0, begin[up] + d - 1 - least[up], 0)
    text = np.where(d > 0, units[np.minimum(offsets[i] + np.maximum(d, 1) - 1, max(0, len(units) - 1)), -1].astype(np.int64) if len(units) else 0, 0)
    end = begin[right + 1]
    sums = np.concatenate(([0], np.cumsum(text * (members - starts))))
    saved = sums[end] - sums[np.arange(len(d))]
    next_lcp = np.concatenate((lcp[1:], [last]))
    leaf = np.concatenate(([0], np.cumsum(next_lcp < size)))
    leaves = leaf[right + 1] - leaf[left]
    born = np.flatnonzero(starts & (d > 0))
    children = np.bincount(parent[born], minlength=len(d))
    # members that end here stand first, in the order of their ids
    same = np.flatnonzero(np.append((size[1:] != size[:-1]) | (lcp[1:] < size[1:]), True))  # last of each run of equal sequences
    ends_to = same[np.searchsorted(same, left)]
    ending = np.where(size[left] == d, ends_to - left + 1, 0)
    closed_ends = {}
    for k in np.flatnonzero((ending > 0) & ~is_open):
        lo = int(left[k])
        closed_ends[int(k)] = hashlib.sha256(",".join(map(str, ids[lo : lo + int(ending[k])].tolist())).encode()).hexdigest()
    opened = np.flatnonzero(is_open)
    names: dict[int, bytes] = {}
    for side in np.unique(i[opened]):
        mine = opened[i[opened] == side]
        names |= {int(k): v for k, v in zip(mine, _digests(keys[int(side)], d[mine].tolist()).values())}
    pieces = []
    for k in opened:
        lo, m = int(left[k]), int(ending[k])
        for at in range(0, m, PIECE):
            pieces.append((names[int(k)], at // PIECE, ",".join(map(str, ids[lo + at : lo + min(m, at + PIECE)].tolist())).encode()))
    nodes = []
    columns = (conv, d, members, children, leaves, saved, parent)
    for k, (c, depth, m, ch, lv, sv, p) in enumerate(zip(*(x.tolist() for x in columns))):
        above = names.get(p) if depth else None
        nodes.append((names.get(k), above, c, depth, None if not depth or above is not None else int(conv[p]), m, ch, lv, sv, None if k in names else closed_ends.get(k, EMPTY)))
    return nodes, pieces


class _Shards:
    """Reads sorted shards, each between its neighbours' sequences, and gives their nodes and pieces."""

    ddl = "shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece int, ids binary"
    schema = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("piece", pa.int32()), ("ids", pa.binary())])

    def __call__(self, batches):
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if int(shard[lo]) != now:
                    yield from self.done(now, held)
                    now, held = int(shard[lo]), []
                held.append(batch.slice(lo, hi - lo))
        yield from self.done(now, held)

    def done(self, shard, held):
        if not held:
            return
        table = pa.Table.from_batches(held)
        side, ids = table["side"].to_numpy(), table["conv_id"].to_numpy()
        keys = table["turns"].to_pylist()
        inside = np.flatnonzero(side == 1)
        before = keys[0] if side[0] == 0 else None
        after = keys[-1] if side[-1] == 2 else None
        nodes, pieces = shard_nodes(keys[inside[0] : inside[-1] + 1], ids[inside], before, after)
        for lo in range(0, len(nodes), 8192):
            columns = [list(c) for c in zip(*nodes[lo : lo + 8192])]
            size = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[shard] * size, *columns, [None] * size, [None] * size], self.schema.types)], schema=self.schema)
        for lo in range(0, len(pieces), 64):
            part = pieces[lo : lo + 64]
            rows = [{"shard": shard, "key": k, "piece": p, "ids": b} for k, p, b in part]
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


class _Ends:
    """Digests of id lists that come in pieces, in order; a list is hashed as it streams by and never held."""

    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])

    def __call__(self, batches):
        now, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    if now is not None:
                        out.append({"key": now, "ends": state.hexdigest()})
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=self.schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"key": now, "ends": state.hexdigest()}], schema=self.schema)


# --- the operator ------------------------------------------------------------------------------------


def sorted_shards(sequences: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(shard, side, conv_id, turns)``: sorted sequences by shard (side 1), with the last of the shard before
    (side 0) and the first of the one after (side 2)."""
    total = sequences.agg(F.coalesce(F.sum(F.octet_length("turns") + OWN_BYTES), F.lit(0))).first()[0]
    parts = max(1, -(-total // shard_bytes))
    dealt = sequences.repartitionByRange(parts, "turns", "conv_id").select(F.spark_partition_id().alias("shard"), "conv_id", "turns")
    dealt = written(dealt, "trie-shards")
    ends = dealt.groupBy("shard").agg(F.min(F.struct("turns", "conv_id")).alias("lo"), F.max(F.struct("turns", "conv_id")).alias("hi"))
    order = Window.orderBy("shard")  # one row a shard
    ends = ends.select("shard", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    border = lambda c, side: ends.where(F.col(c).isNotNull()).select("shard", F.lit(side).alias("side"), f"{c}.conv_id", f"{c}.turns")
    rows = dealt.select("shard", F.lit(1).alias("side"), "conv_id", "turns").unionByName(border("before", 0)).unionByName(border("after", 2))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "side", "turns", "conv_id")


def conversation_trie(conversations: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` per node.

    Null roles and texts count as empty, null turns come first, equal turns stand in the order of role and
    digest, repeated rows are turns of their own, rows without a ``conv_id`` are left out; an empty table
    has no node.  A long text counts by its digest.  A conversation's turns are held together, ``TURN``
    bytes each.  Turns are told apart by role and text, by 128 bits of their SHA-256 and the text's length.  Other columns are ignored.
    """
    ship(conversations.sparkSession)
    sequences = written(rebuilt_conversations(conversations), "rebuilt")
    parts = written(sorted_shards(sequences, shard_bytes).mapInArrow(_Shards(), _Shards.ddl), "trie-parts")
    nodes = parts.where("ids is null")
    pieces = parts.where("ids is not null").select("key", "ids", "shard", "piece").repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ids")
    ends = pieces.mapInArrow(_Ends(), "key binary, ends string")
    opened = nodes.where("key is not null")
    figures = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = written(opened.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *figures).join(ends, "key", "left"), "trie-open")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = merged.join(names, "parent_key", "left").select(*(F.col("above").alias(c) if c == "parent_conv_id" else F.coalesce("ends", F.lit(EMPTY)).alias(c) if c == "ends_sha256" else F.col(c) for c in out))
    # the names of open parents go back to their shards, so the root's children are not one key
    by_shard = opened.select("shard", F.col("key").alias("parent_key")).join(names, "parent_key")
    closed = nodes.where("key is null").join(by_shard, ["shard", "parent_key"], "left")
    closed = closed.select(*(F.coalesce("parent_conv_id", "above").alias(c) if c == "parent_conv_id" else F.col(c) for c in out))
    return whole.unionByName(closed)
