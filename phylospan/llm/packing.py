"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Only a document longer than a sequence is cut: a shorter first piece, then full pieces, which are
sequences of their own.  The loose pieces, one per document, go to shards of some thousands by a hash.
A shard is evolved on several islands; a chromosome is a partition of the shard's pieces into bins.
Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates, and best-fits the displaced pieces.  Mutation opens the emptiest bins and some others; a piece of
theirs first takes the place of up to three pieces of a bin that it fills better, these look for a place in
turn, and only what finds none is best-fitted.  Islands begin from differently disturbed orders; between
epochs each island's elite moves on to the next island of the shard.  A shard that reaches the proved lower
bound on any island is evolved no further.  Bins left with room are opened again and packed jointly across
shards, level by level, down to one last shard.
"""

from __future__ import annotations

import heapq
import random
import zlib
from array import array
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import each_row, written
from phylospan.llm.pretokens import chunks, tokenizer_path, vocabulary

CAPACITY = 1024
END_ID = 2
SHARD = 8192
ISLANDS = 3
EPOCHS = 3
POPULATION = 6
GENERATIONS = 60
#: A mutation looks for exchanges in so many bins with room, drawn by chance, and tries so many of each one's pieces, the largest.
LOOKED, TRIED = 256, 5


# --- one shard ---------------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: for each threshold t, pieces over ``capacity - t`` stand alone, those over
    half cannot share, and what pieces of ``t`` to half overflow the room beside them needs bins of its own."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number = np.concatenate(([0], np.cumsum(count)))  # of pieces shorter than the index
    total = np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    half = capacity // 2
    t = np.arange(half + 1)
    alone = number[-1] - number[capacity - t + 1]
    large = number[capacity - t + 1] - number[half + 1]
    large_sum = total[capacity - t + 1] - total[half + 1]
    small_sum = total[half + 1] - total[t]
    over = np.maximum(0, -(-(small_sum - (large * capacity - large_sum)) // capacity))
    return int(np.max(alone + large + over))


def best_fit(sizes: list[int], room: np.ndarray, capacity: int) -> list[int]:
    """Bins of pieces of these sizes, each put in turn into the open bin with the least sufficient room, else into a new one.

    ``room[b]`` is 0 or less for bins that nothing goes into; new bins are numbered on from ``len(room)``.
    """
    by_room: dict[int, list[int]] = {}
    open_rooms, new = 0, len(room)
    some = np.flatnonzero(room > 0)
    for b, r in zip(some.tolist(), room[some].tolist()):
        by_room.setdefault(r, []).append(b)
    for r in by_room:
        open_rooms |= 1 << r
    out = []
    for n in sizes:
        fitting = open_rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            there = by_room[r]
            b = there.pop()
            if not there:
                open_rooms ^= 1 << r
        else:
            r, b, new = capacity, new, new + 1
        out.append(b)
        if r > n:
            by_room.setdefault(r - n, []).append(b)
            open_rooms |= 1 << (r - n)
    return out


class Shard:
    """The pieces of a shard, longest first, and the genetic operators on its packings (bin number per piece)."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.as_list = self.lengths.tolist()
        self.rng, self.chance = random.Random(seed), np.random.default_rng(abs(seed))
        self.bound = lower_bound(self.lengths, capacity)

    def fitness(self, packing: np.ndarray) -> tuple[int, int]:
        """To be minimised: the number of bins, then minus the sum of squared fills."""
        fill = np.bincount(packing, weights=self.lengths)
        return len(fill), -int((fill * fill).sum())

    def tidy(self, bin_of: np.ndarray) -> np.ndarray:
        """The packing with its bins numbered without gaps."""
        return (np.cumsum(np.bincount(bin_of) > 0, dtype=np.int32) - 1)[bin_of]

    def seeded(self, noise: float) -> np.ndarray:
        """Best fit in order of decreasing length; with noise the order is disturbed."""
        order = np.arange(len(self.as_list))
        if noise:
            order = np.argsort(-self.lengths * (1 + noise * self.chance.random(len(order))), kind="stable")
        bin_of = np.empty(len(self.as_list), np.int64)
        bin_of[order] = best_fit(self.lengths[order].tolist(), np.zeros(0, np.int64), self.capacity)
        return self.tidy(bin_of)

    def refit(self, bin_of: np.ndarray, loose: np.ndarray, bins: int) -> np.ndarray:
        """Best-fit the ``loose`` pieces into the bins of the others; ``bin_of`` has -1 for them, ``bins`` numbers are in use."""
        fill = np.bincount(bin_of + 1, weights=np.where(bin_of < 0, 0, self.lengths), minlength=bins + 1)[1:].astype(np.int64)
        bin_of[loose] = best_fit(self.lengths[loose].tolist(), np.where(fill > 0, self.capacity - fill, 0), self.capacity)
        return self.tidy(bin_of)

    def crossed(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """``mother`` with some of the father's best-filled bins injected whole."""
        fill = np.bincount(father, weights=self.lengths)
        good = np.flatnonzero(fill >= 0.98 * self.capacity)
        if not len(good):
            good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 20)]
        wanted = max(1, int(len(good) * self.rng.uniform(0.02, 0.12)))
        chosen = np.sort(self.chance.permutation(good)[:wanted])
        bins = int(mother.max()) + 1
        place = np.full(len(fill), -1)
        place[chosen] = np.arange(len(chosen))
        injected = place[father]
        hit = np.zeros(bins, bool)
        hit[mother[injected >= 0]] = True  # bins with duplicates
        bin_of = np.where(hit[mother], -1, mother.astype(np.int64))
        bin_of[injected >= 0] = bins + injected[injected >= 0]
        return self.refit(bin_of, np.flatnonzero(bin_of < 0), bins + len(chosen))

    def mutated(self, packing: np.ndarray) -> np.ndarray:
        """The emptiest bins and a few others opened, their pieces exchanged for better-fitting ones, the rest best-fitted."""
        fill = np.bincount(packing, weights=self.lengths)
        k = min(len(fill), self.rng.randrange(2, 9))
        gone = np.zeros(len(fill), bool)
        gone[np.argpartition(fill, k - 1)[:k]] = True
        gone[self.chance.integers(0, len(fill), k)] = True
        bin_of = np.where(gone[packing], -1, packing.astype(np.int64))
        rest = self.exchanged(bin_of, np.flatnonzero(bin_of < 0))
        return self.refit(bin_of, rest, len(fill))

    def exchanged(self, bin_of: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Put loose pieces in the place of up to three smaller ones that leave the most room, and these in turn.

        Every exchange fills its bin further, each bin changes once; gives the pieces without a place, longest first.
        """
        inside = np.flatnonzero(bin_of >= 0)
        fill = np.bincount(bin_of[inside], weights=self.lengths[inside]).astype(np.int64)
        with_room = np.flatnonzero((fill > 0) & (fill < self.capacity))
        looked = np.zeros(len(fill), bool)
        looked[self.chance.permutation(with_room)[:LOOKED]] = True
        inside = inside[looked[bin_of[inside]]]
        inside = inside[np.argsort(bin_of[inside], kind="stable")]
        first = np.flatnonzero(np.diff(bin_of[inside], prepend=-1))
        size = np.diff(first, append=len(inside))
        choices = [c for n in (1, 2, 3) for c in combinations(range(TRIED), n)]
        out = np.full((len(first), len(choices), 3), len(self.lengths))  # pieces to take out; one beyond the last is none
        for k, c in enumerate(choices):
            full = np.flatnonzero(size > c[-1])
            for n, j in enumerate(c):
                out[full, k, n] = inside[first[full] + j]
        taken = np.append(self.lengths, 0)[out].sum(axis=2)
        row, k = np.nonzero(taken)
        out, taken, number = out[row, k], taken[row, k], bin_of[inside[first]][row]
        reach = taken + self.capacity - fill[number]  # the longest piece that fits instead
        waiting = [(-self.as_list[p], p) for p in loose.tolist()]
        heapq.heapify(waiting)
        changed, rest = np.zeros(len(fill), bool), []
        while waiting:
            n, piece = heapq.heappop(waiting)
            left = np.where((taken < -n) & (reach >= -n) & ~changed[number], reach, 2 * self.capacity)
            best = int(left.argmin()) if len(left) else 0
            if not len(left) or left[best] == 2 * self.capacity:
                rest.append(piece)
                continue
            bin_of[piece] = number[best]
            changed[number[best]] = True
            for p in out[best].tolist():
                if p < len(self.lengths):
                    bin_of[p] = -1
                    heapq.heappush(waiting, (-self.as_list[p], p))
        return np.array(rest, np.int64)

    def evolved(self, people: list[np.ndarray], generations: int, size: int, island: int = 0) -> list[np.ndarray]:
        """The next population, fittest first; ends early at the lower bound.

        A new one has best fit by decreasing length and disturbed orders of it; other islands than the first
        go on from disturbed orders of their own alone, unless best fit is at the bound.
        """
        start = people[:size] or [self.seeded(0.0)]
        if self.fitness(start[0])[0] > self.bound:
            if not people and island:
                start = []
            start += [self.seeded(0.05 + 0.1 * k + 0.03 * island) for k in range(size - len(start))]
        people = start
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
        for g in range(generations):
            if ranked[0][0][0] <= self.bound or len(ranked) < 2:
                break
            a, b = sorted(self.rng.sample(range(len(ranked)), 2))
            child = self.mutated(self.crossed(ranked[a][2], ranked[b][2]))
            fit = self.fitness(child)
            if fit < ranked[-1][0] and all(fit != r[0] for r in ranked):
                ranked[-1] = (fit, size + g, child)
                ranked.sort(key=lambda x: x[:2])
        return [p for _, _, p in ranked]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, seed: int = 0, generations: int = GENERATIONS) -> np.ndarray:
    """Bin numbers for a bounded list of lengths, on one island; the distributed form is :func:`pack_items`."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    shard = Shard(np.asarray(lengths, np.int64)[order], capacity, seed)
    out = np.empty(len(lengths), np.int32)
    if len(lengths):
        out[order] = shard.evolved([], generations, POPULATION)[0]
    return out


# --- distributed -------------------------------------------------------------------------------------


def _evolve(capacity: int, epoch: int):
    def setup():
        def row(shard, island, lengths, people, migrant):
            sizes = np.array(lengths, np.int64)
            work = Shard(sizes, capacity, hash((shard, island, epoch)))
            old = [np.frombuffer(p, np.int32) for p in people or []]
            if migrant is not None:
                old.insert(0, np.frombuffer(migrant, np.int32))
            old.sort(key=work.fitness)
            new = work.evolved(old, GENERATIONS, POPULATION, island)
            bins = int(new[0].max()) + 1
            return shard, island, lengths, [p.tobytes() for p in new], bins, bins <= work.bound

        return row

    return setup


_STATE = "shard long, island int, lengths array<int>, people array<binary>, bins int, proved boolean"


def _solved(shards: DataFrame, capacity: int, n: int) -> DataFrame:
    """``(shard, packing binary)``: the fittest packing of each shard over all islands and epochs.

    Shards that an island has solved leave before the next epoch; the others' islands are dealt to tasks anew.
    """
    spark = shards.sparkSession

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(max(1, min(n * ISLANDS, 4 * spark.sparkContext.defaultParallelism + n * ISLANDS // 8)), "shard", "island")

    start = shards.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "lengths")
    start = start.withColumns({"people": F.lit(None).cast("array<binary>"), "migrant": F.lit(None).cast("binary")})
    state = written(each_row(dealt(start, n), _evolve(capacity, 0), _STATE, rows=1), "islands")
    fittest = F.min_by(F.col("people")[0], F.struct("bins", "island"))
    found = state.groupBy("shard").agg(fittest.alias("packing"), F.min("bins").alias("bins"))
    for epoch in range(1, EPOCHS):
        open_shards = state.groupBy("shard").agg(F.max("proved").alias("solved")).where("not solved").select("shard")
        n = open_shards.count()
        if n == 0:
            break
        elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("people")[0].alias("migrant"))
        now = state.join(open_shards, "shard").join(elite, ["shard", "island"]).select("shard", "island", "lengths", "people", "migrant")
        state = written(each_row(dealt(now, n), _evolve(capacity, epoch), _STATE, rows=1), "islands")
        found = found.unionByName(state.groupBy("shard").agg(fittest.alias("packing"), F.min("bins").alias("bins")))
    return found.groupBy("shard").agg(F.min_by("packing", "bins").alias("packing"))


def _placed(capacity: int, level: int, last: bool):
    def setup():
        def rows(shard, ids, lengths, packing):
            bins = np.frombuffer(packing, np.int32)
            sizes = np.array(lengths, np.int64)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[order])
            first = np.concatenate(([0], np.cumsum(fill)[:-1]))
            offset = ends - sizes[order] - first[bins[order]]
            for k, o in zip(order.tolist(), offset.tolist()):
                b = int(bins[k])
                done = last or int(fill[b]) == capacity
                yield ids[k], lengths[k], (level << 56) + (shard << 16) + b if done else None, o if done else None

        return rows

    return setup


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """``(pid, sequence_id, offset)`` for ``items(pid long, length int)`` with lengths of 1 to ``capacity``.

    A task holds one shard, of ``shard_size`` pieces on average, whatever the input.  Bins that are not
    full go to the next level together with those of other shards until one shard is left, or until a
    level no longer lowers the number of pieces by a tenth; then what is packed stays.
    """
    out, level, n_before = None, 0, None
    rest = items.select("pid", F.col("length").cast("int").alias("length"))
    while True:
        n = rest.count()
        shards_n = max(1, -(-n // shard_size))
        last = shards_n == 1 or (n_before is not None and n > 0.9 * n_before)
        key = F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(shards_n))
        gathered = rest.groupBy(key.alias("shard")).agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), F.col("pid").alias("p")))).alias("x"))
        shards = written(gathered.select("shard", F.col("x.p").alias("ids"), F.transform("x.l", lambda v: -v).alias("lengths")), "shards")
        solved = shards.join(_solved(shards, capacity, shards_n), "shard").select("shard", "ids", "lengths", "packing")
        placed = each_row(solved, _placed(capacity, level, last), "pid long, length int, sequence_id long, offset long", rows=1, many=True)
        placed = written(placed, "placed")
        done = placed.where("sequence_id is not null").select("pid", "sequence_id", "offset")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rest, n_before, level = placed.where("sequence_id is null").select("pid", "length"), n, level + 1


def _cut(path: str, capacity: int):
    def setup():
        encode = vocabulary(path).compiled_encoder()

        def rows(doc_id, text):
            held = array("I")
            for run in chunks(text or ""):
                held.extend(encode(run))
            held.append(END_ID)
            ids = np.frombuffer(held, np.uint32).astype("<u4", copy=False)
            n = len(ids)
            first = n % capacity or capacity
            start, piece = 0, 0
            while start < n:
                end = start + (first if piece == 0 else capacity)
                yield doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())
                start, piece = end, piece + 1

        return rows

    return setup


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece.

    Null text is empty: one piece of the end id alone.  A null or repeated id is carried as it is; rows are
    told apart by a number of their own.  An empty table gives an empty result, other columns are ignored.
    Texts are not shuffled: a piece moves as some forty bytes.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = each_row(rows, _cut(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long", rows=64, many=True)
    pieces = written(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    loose = F.col("length") < capacity
    full = pieces.where(~loose).withColumns({"sequence_id": -1 - F.col("pid"), "offset": F.lit(0).cast("long")})
    packed = pieces.where(loose).join(pack_items(pieces.where(loose), capacity, shard_size), "pid")
    return packed.unionByName(full).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
