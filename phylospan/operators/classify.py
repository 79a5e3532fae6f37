"""Classification: probing the index, scoring root-to-leaf paths, calls, hit lists and output lines.

Three plans give the same rows.  The taxonomy's depth-first numbers are broadcast (see :mod:`~phylospan.operators.tree`),
and many whole reads are settled at once by array steps.  Where the index is small enough for every executor
too, reads are scanned and settled in one Arrow pass and nothing is shuffled.  Otherwise runs of tokens are joined with
the index by minimizer and brought together by read.  Only for a taxonomy beyond the arrays' bound are hits scored
by joins on its closure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64
from phylospan.functions.sequence import mask_low_quality, six_frames, trim_pair_suffix
from phylospan.model import ClassifyOptions
from phylospan.operators.index import BROADCAST_ROWS, TaxIndex
from phylospan.operators.minimizers import minimizer_runs, runs_of
from phylospan.operators.taxonomy import lca_by_closure
from phylospan.operators.tree import Tree
from phylospan.shipping import ship

#: Codes of a run that is no taxon.
AMBIGUOUS, MATE_BORDER, FRAME_BORDER = -1, -2, -3

CALLS = "read long, call long, total long, hit_groups long, hitlist string, hits map<long,long>, kmers map<long,array<long>>"


# --- inputs ------------------------------------------------------------------------------------------


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two files by their record number; records without a mate are left out."""
    mate = lambda df, k: df.select("seq_no", *[F.col(c).alias(f"{c}{k}") for c in ("header", "comment", "seq", "quals", "format")])
    return mate(first, 1).join(mate(second, 2), "seq_no")


def pair_interleaved(records: DataFrame) -> DataFrame:
    """Records ``2i`` and ``2i + 1`` as mates; an odd last record is left out."""
    numbered = records.withColumns({"pair": F.floor(F.col("seq_no") / 2).cast("long"), "side": F.col("seq_no") % 2})
    named = lambda side: numbered.where(f"side = {side}").select(F.col("pair").alias("seq_no"), "header", "comment", "seq", "quals", "format")
    return pair_files(named(0), named(1))


def single_reads(records: DataFrame) -> DataFrame:
    """Records as reads of one mate: ``(read, header, comment1, seq1, quals1, format1, seq2, ...)``."""
    return records.select(F.col("seq_no").alias("seq_no"), *[F.col(c).alias(f"{c}1") for c in ("header", "comment", "seq", "quals", "format")], *[F.lit(None).cast("string").alias(f"{c}2") for c in ("header", "comment", "seq", "quals", "format")])


def prepared(reads: DataFrame, opts: ClassifyOptions) -> DataFrame:
    """Reads with low-quality bases masked; a paired read without its mate is refused."""
    out = reads
    for k in "12":
        out = out.withColumn(f"seq{k}", mask_low_quality(F.col(f"seq{k}"), F.col(f"quals{k}"), opts.minimum_base_quality, F.col(f"format{k}")))
    if opts.paired:
        out = out.withColumn("seq2", F.when(F.col("seq2").isNull(), F.raise_error(F.lit("a paired read lacks its mate"))).otherwise(F.col("seq2")))
    return out


def frames_of(reads: DataFrame, opts: ClassifyOptions) -> DataFrame:
    """``(read, mate, frame, seq)``: the strings that are scanned."""
    mates = [F.struct(F.lit(0).alias("mate"), F.col("seq1").alias("seq"))]
    if opts.paired:
        mates.append(F.struct(F.lit(1).alias("mate"), F.col("seq2").alias("seq")))
    rows = reads.select(F.col("seq_no").alias("read"), F.explode(F.array(*mates)).alias("m")).select("read", "m.mate", F.coalesce("m.seq", F.lit("")).alias("seq"))
    if not opts.translated:
        return rows.select("read", "mate", F.lit(0).alias("frame"), "seq")
    return rows.select("read", "mate", F.posexplode(six_frames(F.col("seq"))).alias("frame", "seq"))


def total_terms(opts: ClassifyOptions, borders: int | None = None) -> int:
    """What total k-mers have beyond the tokens, after so many borders (by default all of a read's).

    Borders count like tokens; of them one is taken off for a pair, and two (of a pair four) for frames.
    """
    frames, mates = (6 if opts.translated else 1), (2 if opts.paired else 1)
    if borders is None:
        borders = frames * mates - 1
    return borders - (1 if opts.paired else 0) - ((4 if opts.paired else 2) if opts.translated else 0)


# --- whole reads -------------------------------------------------------------------------------------


def hit_list(codes: list[int], sizes: list[int], ext) -> str:
    """Runs of equal codes as ``taxid:count``, ``A:count``, ``|:|`` and ``-:-``; ``0:0`` if there are none."""
    out: list[list[int]] = []
    for c, n in zip(codes, sizes):
        if out and out[-1][0] == c:
            out[-1][1] += n
        else:
            out.append([c, n])
    return " ".join(_entry(c, n, ext) for c, n in out) or "0:0"


_MARKS = {MATE_BORDER: "|:|", FRAME_BORDER: "-:-"}


def _entry(code: int, n: int, ext) -> str:
    return f"{ext[code]}:{n}" if code >= 0 else _MARKS.get(code) or f"A:{n}"


CALL_SCHEMA = pa.schema([("read", pa.int64()), ("call", pa.int64()), ("total", pa.int64()), ("hit_groups", pa.int64()), ("hitlist", pa.string()), ("hits", pa.map_(pa.int64(), pa.int64())), ("kmers", pa.map_(pa.int64(), pa.list_(pa.int64())))])


def settle(tree: Tree, opts: ClassifyOptions, reads: np.ndarray, owner: np.ndarray, code: np.ndarray, fresh: np.ndarray, size: np.ndarray, minimizer: np.ndarray, kmers: bool) -> pa.RecordBatch:
    """The rows of whole reads, all at once.

    Every read has the same number of frames (of both mates), numbered through all reads; runs come in order
    with the frame that owns them, a ``code`` (an entry of the tree, 0, or ``AMBIGUOUS``), whether they open a
    hit group if they hit, and how many tokens they have.
    """
    n, frames = len(reads), (6 if opts.translated else 1) * (2 if opts.paired else 1)
    read = owner // frames
    first = np.searchsorted(read, np.arange(n + 1))
    opened = fresh & (code > 0)
    used = np.ones(len(code), bool)
    borders = np.full(n, frames - 1)
    if opts.quick:
        so_far = np.concatenate(([0], np.cumsum(opened)))
        reached = np.flatnonzero((code > 0) & (so_far[1:] - so_far[first[read]] >= opts.minimum_hit_groups))
        stop = np.full(n, len(code))
        np.minimum.at(stop, read[reached], reached)
        at = np.arange(len(code))
        used, opened = at < stop[read], opened & (at <= stop[read])
        stopped = np.flatnonzero(stop < len(code))
        borders[stopped] = owner[stop[stopped]] - stopped * frames
    groups = np.bincount(read[opened], minlength=n)
    total = np.bincount(read[used], size[used], minlength=n).astype(np.int64) + [total_terms(opts, b) for b in range(frames)] @ (borders == np.arange(frames)[:, None])
    total = np.maximum(total, 0)
    hit = np.flatnonzero(used & (code > 0))
    width = len(tree.above)
    key, place = np.unique(read[hit].astype(np.int64) * width + code[hit], return_inverse=True)
    hit_read, hit_entry, hit_n = key // width, key % width, np.bincount(place, size[hit], minlength=len(key)).astype(np.int64)
    need = np.ceil(opts.confidence * total.astype(np.float64)).astype(np.int64)
    call = tree.resolve(hit_read, hit_entry, hit_n, need)
    call[groups < opts.minimum_hit_groups] = 0
    ends = np.searchsorted(hit_read, np.arange(n + 1))
    hits = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tree.node[hit_entry].astype(np.int64)), pa.array(hit_n))
    text = [f"{e}:Q" for e in tree.ext[call].tolist()] if opts.quick else _hit_texts(tree, n, frames, 6 if opts.translated else 1, owner, code, size)
    return pa.RecordBatch.from_arrays([pa.array(reads, pa.int64()), pa.array(tree.node[call].astype(np.int64)), pa.array(total), pa.array(groups.astype(np.int64)), pa.array(text), hits, _kmer_maps(tree, n, read, opened, code, minimizer) if kmers else pa.array([[]] * n, CALL_SCHEMA.field("kmers").type)], schema=CALL_SCHEMA)


def _hit_texts(tree: Tree, n: int, frames: int, per_mate: int, owner, code, size) -> list[str]:
    """The hit lists of all reads: borders stand behind every frame but a read's last."""
    if frames > 1:
        frame = np.arange(n * frames)
        marks = np.where((frame + 1) % per_mate == 0, MATE_BORDER, FRAME_BORDER)
        inner = (frame + 1) % frames != 0
        frame, marks = frame[inner], marks[inner]
        order = np.argsort(np.concatenate((owner * 2, frame * 2 + 1)), kind="stable")
        owner = np.concatenate((owner, frame))[order]
        code, size = np.concatenate((code, marks))[order], np.concatenate((size, np.ones(len(frame), size.dtype)))[order]
    if not len(code):
        return ["0:0"] * n
    read = owner // frames
    start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (read[1:] != read[:-1])))
    count = np.add.reduceat(size.astype(np.int64), start).tolist()
    first = np.searchsorted(read[start], np.arange(n + 1)).tolist()
    codes = code[start].tolist()
    taxa = sorted({c for c in codes if c >= 0})
    ext = dict(zip(taxa, tree.ext[taxa].tolist())) if taxa else {}
    entries = [_entry(c, k, ext) for c, k in zip(codes, count)]
    return [" ".join(entries[a:b]) or "0:0" for a, b in zip(first, first[1:])]


def _kmer_maps(tree: Tree, n: int, read, opened, code, minimizer) -> pa.MapArray:
    """The minimizers that opened hit groups, by taxon, for every read."""
    at = np.flatnonzero(opened)
    at = at[np.lexsort((at, code[at], read[at]))]
    new = np.flatnonzero(np.append(True, (code[at][1:] != code[at][:-1]) | (read[at][1:] != read[at][:-1]))) if len(at) else at
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(minimizer[at].view(np.int64)))
    outer = np.searchsorted(read[at[new]], np.arange(n + 1))
    return pa.MapArray.from_arrays(pa.array(outer, pa.int32()), pa.array(tree.node[code[at[new]]].astype(np.int64)), lists)


# --- one pass over broadcast arrays ------------------------------------------------------------------


class _Arrays:
    """The index as sorted arrays, for the one-pass plan; taxa are entries of the tree."""

    def __init__(self, minimizers, entries):
        self.minimizers, self.entries = minimizers, entries

        # most minimizers of a read are in no index: one bit of a hash tells, before any search
        self.shift = np.uint64(64 - max(10, (16 * len(minimizers)).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._slot(minimizers)] = True

    def _slot(self, m: np.ndarray) -> np.ndarray:
        return (m * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, m: np.ndarray) -> np.ndarray:
        """The entries of minimizers, 0 where there is none."""
        out = np.zeros(len(m), np.int64)
        if len(self.minimizers):
            likely = np.flatnonzero(self.maybe[self._slot(m)])
            keys = m[likely]
            at = np.minimum(np.searchsorted(self.minimizers, keys), len(self.minimizers) - 1)
            out[likely] = np.where(self.minimizers[at] == keys, self.entries[at], 0)
        return out


class _PieceCodes:
    """Pieces ``(read, mate, frame, piece, seq)`` to coded runs; neighbouring runs of no hit become one.

    Such runs' minimizers are none that hits, so they tell hit groups apart no less together.
    """

    schema = pa.schema([("read", pa.int64()), ("mate", pa.int32()), ("frame", pa.int32()), ("piece", pa.int32()), ("run", pa.int32()), ("minimizer", pa.int64()), ("tokens", pa.int64()), ("code", pa.int64())])
    ddl = "read long, mate int, frame int, piece int, run int, minimizer long, tokens long, code long"

    def __init__(self, arrays, tree, options):
        self.arrays, self.tree, self.options = arrays, tree, options

    def __call__(self, batches):
        arrays, tree, o = self.arrays.value, self.tree.value, self.options
        for batch in batches:
            for k in range(batch.num_rows):
                _, m, ambiguous, _, size = runs_of([(batch.column(4)[k].as_py() or "").encode("latin-1", "replace")], o)
                if not len(m):
                    continue
                code = tree.node[arrays.find(m)].astype(np.int64)
                if o.min_hash:
                    code = np.where(fmix64(m) < np.uint64(o.min_hash), 0, code)
                code = np.where(ambiguous, AMBIGUOUS, code)
                first = np.flatnonzero(np.append(True, (code[1:] != 0) | (code[:-1] != 0)))
                place = [np.full(len(first), batch.column(c)[k].as_py()) for c in range(4)]
                columns = (*place, np.arange(len(first)), m[first].view(np.int64), np.add.reduceat(size.astype(np.int64), first), code[first])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


#: Reads whose rows are made at once, and bases after which no more are taken.
READS, BASES = 4096, 1 << 22


class _OnePass:
    def __init__(self, arrays, tree, options, opts: ClassifyOptions, kmers: bool):
        self.arrays, self.tree, self.options, self.opts, self.kmers = arrays, tree, options, opts, kmers

    def __call__(self, batches):
        arrays, tree, o = self.arrays.value, self.tree.value, self.options
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, READS)
                seqs, taken, bases = [], 0, 0
                for frames in part.column(1):
                    seqs += [(s or "").encode("latin-1", "replace") for s in frames.as_py()]
                    taken, bases = taken + 1, bases + sum(map(len, seqs[-len(frames):]))
                    if bases >= BASES:
                        break
                lo += taken
                owner, m, ambiguous, fresh, size = runs_of(seqs, o)
                code = arrays.find(m)
                if o.min_hash:
                    code = np.where(fmix64(m) < np.uint64(o.min_hash), 0, code)
                code = np.where(ambiguous, AMBIGUOUS, code)
                yield settle(tree, self.opts, part.column(0).to_numpy()[:taken], owner, code, fresh, size, m, self.kmers)


def classify_narrow(index: TaxIndex, reads: DataFrame, opts: ClassifyOptions = ClassifyOptions(), kmers: bool = False) -> DataFrame:
    """Calls of prepared reads in one pass without a shuffle, batch or stream; index and taxonomy must fit their bounds."""
    spark = reads.sparkSession
    if index.taxonomy.tree() is None:
        raise ValueError("a taxonomy beyond the bound of the broadcast arrays is asked for in one pass")
    gathered = reads.select(F.col("seq_no").alias("read"), _frame_array(opts).alias("frames"))
    ship(spark)
    return gathered.mapInArrow(_OnePass(index.arrays(), index.taxonomy.tree(), index.options, opts, kmers), CALLS)


def _frame_array(opts: ClassifyOptions):
    mates = ["seq1", "seq2"] if opts.paired else ["seq1"]
    if not opts.translated:
        return F.array(*[F.coalesce(m, F.lit("")) for m in mates])
    return F.flatten(F.array(*[six_frames(F.coalesce(m, F.lit(""))) for m in mates]))


# --- joins -------------------------------------------------------------------------------------------


#: Bases of a piece of a long sequence.
PIECE = 1 << 20


def pieces_of(frames: DataFrame, k: int, piece: int | None = None) -> DataFrame:
    """``frames(read, mate, frame, seq)`` in pieces ``(read, mate, frame, piece, seq)``, dealt out over tasks.

    Pieces overlap by ``k - 1`` bases, so each token lies in one of them, and what is ambiguous in it shows there.
    """
    piece = piece or PIECE
    last = F.greatest(F.floor((F.length("seq") - k) / piece), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("seq"), i * piece + 1, F.lit(piece + k - 1)))
    return frames.select("read", "mate", "frame", F.posexplode(parts).alias("piece", "seq")).repartition("read", "mate", "frame", "piece")


class _Settled:
    """Runs sorted by read, mate, frame and place, an end behind every frame, to the rows of whole reads."""

    def __init__(self, tree, opts: ClassifyOptions, kmers: bool):
        self.tree, self.opts, self.kmers = tree, opts, kmers
        self.frames = (6 if opts.translated else 1) * (2 if opts.paired else 1)

    def __call__(self, batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            read = batch.column(0).to_numpy()
            cut = int(np.searchsorted(read, read[-1]))  # the last read may go on
            if cut or (held and held[-1].column(0)[0].as_py() != read[0]):
                yield self.rows([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield self.rows(held)

    def rows(self, held):
        t = pa.Table.from_batches(held)
        read, end, minimizer, size, code = (t[c].to_numpy() for c in ("read", "end", "minimizer", "tokens", "code"))
        end = end.astype(bool)
        before = np.cumsum(end)  # frames ended up to a row
        last = np.flatnonzero(end)
        reads = read[last[:: self.frames]]
        tree = self.tree.value
        at = ~end
        owner, code, minimizer = before[at], np.where(code > 0, tree.entry[np.maximum(code, 0)], code)[at], minimizer[at]
        # a run opens a hit group where its minimizer is not the frame's last unambiguous one, in whatever piece that was
        fresh = code != AMBIGUOUS
        clear = np.flatnonzero(fresh)
        fresh[clear[1:]] = (minimizer[clear[1:]] != minimizer[clear[:-1]]) | (owner[clear[1:]] != owner[clear[:-1]])
        return settle(tree, self.opts, reads, owner, code, fresh, size[at].astype(np.int64), minimizer.view(np.uint64), self.kmers)


class _Sifted:
    """Frames ``(read, mate, frame, seq)`` to runs; ``ask`` marks those whose minimizer may be in the index, the others
    have their code.  Neighbouring runs that surely hit nothing become one."""

    schema = pa.schema([("read", pa.int64()), ("mate", pa.int32()), ("frame", pa.int32()), ("run", pa.int32()), ("minimizer", pa.int64()), ("tokens", pa.int64()), ("code", pa.int64()), ("ask", pa.bool_())])
    ddl = "read long, mate int, frame int, run int, minimizer long, tokens long, code long, ask boolean"

    def __init__(self, sieve, options):
        self.sieve, self.options = sieve, options

    def __call__(self, batches):
        sieve, o = self.sieve.value, self.options
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                read, mate, frame = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                owner, m, ambiguous, _, size = runs_of([(s or "").encode("latin-1", "replace") for s in part.column(3).to_pylist()], o)
                if not len(m):
                    continue
                ask = ~ambiguous & sieve.maybe(m)
                if o.min_hash:
                    ask &= fmix64(m) >= np.uint64(o.min_hash)
                none = ~ambiguous & ~ask
                first = np.flatnonzero(np.append(True, ~(none[1:] & none[:-1]) | (owner[1:] != owner[:-1])))
                code = np.where(ambiguous, AMBIGUOUS, 0)[first]
                own = owner[first]
                # places count from each frame's start: the plan scans reads twice, and their batches may differ
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                place = np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first))))
                columns = (read[own], mate[own], frame[own], place, m[first].view(np.int64), np.add.reduceat(size.astype(np.int64), first), code, ask[first])
                for at in range(0, len(first), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)], t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


def _by_joins(index: TaxIndex, reads: DataFrame, opts: ClassifyOptions, kmers: bool) -> DataFrame:
    """Runs that may hit meet the index by minimizer, and all come together by read: no closure, and of an index saved
    in buckets no move of the index."""
    ship(reads.sparkSession)
    runs = frames_of(reads, opts).select("read", "mate", "frame", "seq").mapInArrow(_Sifted(index.sieve(), index.options), _Sifted.ddl)
    asked = runs.where("ask").drop("code").join(index.index.select("minimizer", "taxon"), "minimizer", "left").withColumn("code", F.coalesce("taxon", F.lit(0).cast("long")))
    columns = ["read", "mate", "frame", F.lit(0).alias("piece"), "run", "minimizer", "tokens", "code"]
    return _together(index, reads, asked.select(columns).unionByName(runs.where("not ask").select(columns)), opts, kmers)


def _together(index: TaxIndex, reads: DataFrame, runs: DataFrame, opts: ClassifyOptions, kmers: bool) -> DataFrame:
    """The rows of reads from their coded runs ``(read, mate, frame, piece, run, minimizer, tokens, code)``."""
    marks = [F.struct(F.lit(m).alias("mate"), F.lit(f).alias("frame")) for m in range(2 if opts.paired else 1) for f in range(6 if opts.translated else 1)]
    last = F.lit((1 << 31) - 1)
    zero = F.lit(0).cast("long")
    ends = reads.select(F.col("seq_no").alias("read"), F.explode(F.array(*marks)).alias("m")).select("read", "m.mate", "m.frame", last.alias("piece"), last.alias("run"), zero.alias("minimizer"), zero.alias("tokens"), zero.alias("code"), F.lit(True).alias("end"))
    ordered = runs.withColumn("end", F.lit(False)).unionByName(ends).repartition("read").sortWithinPartitions("read", "mate", "frame", "piece", "run")
    ship(reads.sparkSession)
    return ordered.mapInArrow(_Settled(index.taxonomy.tree(), opts, kmers), CALLS)


def classify_long(index: TaxIndex, reads: DataFrame, opts: ClassifyOptions = ClassifyOptions(), kmers: bool = False, piece: int | None = None) -> DataFrame:
    """Calls of prepared reads as long as chromosomes: pieces of each are scanned and looked up by many tasks, and
    the runs that are left, stretches without a hit being one each, come together by read."""
    pieces = pieces_of(frames_of(reads, opts), index.options.k, piece)
    ship(reads.sparkSession)
    return _together(index, reads, pieces.mapInArrow(_PieceCodes(index.arrays(), index.taxonomy.tree(), index.options), _PieceCodes.ddl), opts, kmers)


# --- joins on the closure, for taxonomies beyond the broadcast arrays ---------------------------------


def path_scores(hits: DataFrame, taxonomy) -> DataFrame:
    """``(read, taxon, score)``: the hits of each hit taxon and of all above it, for ``hits(read, taxon, n)``."""
    above = hits.select("read", "taxon").join(taxonomy.closure().select(F.col("node").alias("taxon"), "ancestor"), "taxon")
    return above.join(hits.select("read", F.col("taxon").alias("ancestor"), "n"), ["read", "ancestor"]).groupBy("read", "taxon").agg(F.sum("n").alias("score"))


def resolve_calls(hits: DataFrame, totals: DataFrame, taxonomy, confidence: float) -> DataFrame:
    """``(read, call)`` for ``hits(read, taxon, n)`` and ``totals(read, total)``; reads without hits are left out."""
    scores = path_scores(hits, taxonomy)
    top = scores.withColumn("best", F.max("score").over(Window.partitionBy("read"))).where("score = best")
    call = lca_by_closure(top, ["read"], taxonomy).withColumnRenamed("lca", "top")
    need = F.ceil(F.lit(float(confidence)) * F.col("total").cast("double"))
    closure = taxonomy.closure()
    clade = hits.join(closure.select(F.col("node").alias("taxon"), "ancestor"), "taxon").groupBy("read", "ancestor").agg(F.sum("n").alias("below"))
    wanted = call.join(totals.select("read", need.alias("need")), "read")
    walked = wanted.join(closure.select(F.col("node").alias("top"), "ancestor"), "top").join(clade, ["read", "ancestor"], "left")
    fits = F.when(F.coalesce("below", F.lit(0)) >= F.col("need"), F.col("ancestor")).otherwise(F.lit(0).cast("long"))
    return walked.groupBy("read").agg(F.max(fits).alias("walked"), F.max("top").alias("top"), F.max("need").alias("need")).select("read", F.when(F.col("need") == 0, F.col("top")).otherwise(F.col("walked")).alias("call"))


def _by_closure(index: TaxIndex, reads: DataFrame, opts: ClassifyOptions, kmers: bool) -> DataFrame:
    taxonomy = index.taxonomy
    scanned = minimizer_runs(frames_of(reads, opts), index.options)
    keyed = scanned.withColumn("key", F.when(~F.col("ambiguous") & ~F.col("low"), F.col("minimizer")))
    probed = keyed.join(index.index.select(F.col("minimizer").alias("key"), "taxon"), "key", "left")
    code = F.when(F.col("ambiguous"), F.lit(AMBIGUOUS).cast("long")).otherwise(F.coalesce("taxon", F.lit(0).cast("long")))
    coded = probed.select("read", "mate", "frame", "run", "minimizer", "fresh", "tokens", code.alias("code"))
    opens = (F.col("fresh") & (F.col("code") > 0)).cast("long")
    if opts.quick:
        order = Window.partitionBy("read").orderBy("mate", "frame", "run").rowsBetween(Window.unboundedPreceding, 0)
        running = coded.withColumn("so_far", F.sum(opens).over(order))
        stop = ((F.col("code") > 0) & (F.col("so_far") >= opts.minimum_hit_groups)).cast("int")
        running = running.withColumn("stops", F.max(stop).over(order))
        groups = running.withColumn("first_stop", F.sum("stops").over(order)).where("first_stop <= 1")
        grouped = groups.groupBy("read").agg(F.sum(opens).alias("hit_groups"))
        opened = groups
        coded = running.where("stops = 0")
    else:
        grouped = coded.groupBy("read").agg(F.sum(opens).alias("hit_groups"))
        opened = coded
    hits = coded.where("code > 0").groupBy("read", F.col("code").alias("taxon")).agg(F.sum("tokens").cast("long").alias("n"))
    totals = coded.groupBy("read").agg(F.sum("tokens").alias("tokens"))
    every = reads.select(F.col("seq_no").alias("read")).join(totals, "read", "left")
    terms = F.lit(total_terms(opts))
    if opts.quick:
        frames = 6 if opts.translated else 1
        stopped = groups.where("stops = 1").groupBy("read").agg(F.min(F.col("mate") * frames + F.col("frame")).alias("borders"))
        every = every.join(stopped, "read", "left")
        terms = F.coalesce(F.col("borders") + total_terms(opts, 0), terms)
    every = every.select("read", F.greatest(F.coalesce("tokens", F.lit(0)) + terms, F.lit(0)).cast("long").alias("total"))
    calls = resolve_calls(hits, every, taxonomy, opts.confidence)
    maps = hits.groupBy("read").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("taxon", "n")))).alias("hits"))
    if kmers:
        seen = opened.where((opens > 0)).groupBy("read", F.col("code").alias("taxon")).agg(F.collect_list("minimizer").alias("m"))
        seen = seen.groupBy("read").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("taxon", "m")))).alias("kmers"))
    else:
        seen = every.select("read").where("false").withColumn("kmers", F.lit(None).cast("map<long,array<long>>"))
    out = every.join(grouped, "read", "left").join(calls, "read", "left").join(maps, "read", "left").join(seen, "read", "left")
    call = F.when(F.coalesce("hit_groups", F.lit(0)) < opts.minimum_hit_groups, F.lit(0).cast("long")).otherwise(F.coalesce("call", F.lit(0).cast("long")))
    out = out.select("read", call.alias("call"), "total", F.coalesce("hit_groups", F.lit(0).cast("long")).alias("hit_groups"), F.coalesce("hits", F.expr("cast(map() as map<long,long>)")).alias("hits"), F.coalesce("kmers", F.expr("cast(map() as map<long,array<long>>)")).alias("kmers"))
    if opts.quick:
        numbers = taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
        return out.join(numbers, "call", "left").select("read", "call", "total", "hit_groups", F.concat(F.coalesce("ext_id", F.lit(0)).cast("string"), F.lit(":Q")).alias("hitlist"), "hits", "kmers")
    lists = hitlists(coded.unionByName(_borders(reads, opts)), taxonomy)
    listed = out.join(lists, "read", "left").withColumn("hitlist", F.coalesce("hitlist", F.lit("0:0")))
    return listed.select("read", "call", "total", "hit_groups", "hitlist", "hits", "kmers")


def _borders(reads: DataFrame, opts: ClassifyOptions) -> DataFrame:
    """Rows for the borders between mates and frames; each stands after the last run of its frame."""
    frames = 6 if opts.translated else 1
    marks = [F.struct(F.lit(m).alias("mate"), F.lit(f).alias("frame"), F.lit(FRAME_BORDER if f < frames - 1 else MATE_BORDER).cast("long").alias("code")) for m in range(2 if opts.paired else 1) for f in range(frames) if f < frames - 1 or (opts.paired and m == 0)]
    if not marks:
        marks = [F.struct(F.lit(0).alias("mate"), F.lit(0).alias("frame"), F.lit(None).cast("long").alias("code"))]
    rows = reads.select(F.col("seq_no").alias("read"), F.explode(F.array(*marks)).alias("m"))
    return rows.select("read", "m.mate", "m.frame", F.lit((1 << 31) - 1).alias("run"), F.lit(0).cast("long").alias("minimizer"), F.lit(False).alias("fresh"), F.lit(1).alias("tokens"), "m.code").where("code is not null")


def hitlists(coded: DataFrame, taxonomy) -> DataFrame:
    """``(read, hitlist)`` of ``coded(read, mate, frame, run, code, tokens)``: runs of equal codes, by gaps and islands."""
    place = ["mate", "frame", "run"]
    by_read = Window.partitionBy("read").orderBy(*place)
    island = coded.withColumn("new", (F.lag("code").over(by_read).isNull() | (F.lag("code").over(by_read) != F.col("code"))).cast("int"))
    island = island.withColumn("island", F.sum("new").over(by_read.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = island.groupBy("read", "island").agg(F.first("code").alias("code"), F.sum("tokens").alias("n"))
    ext = taxonomy.nodes.select(F.col("node").alias("code"), "ext_id")
    named = sizes.join(ext, "code", "left")
    text = F.when(F.col("code") == MATE_BORDER, F.lit("|:|")).when(F.col("code") == FRAME_BORDER, F.lit("-:-")).when(F.col("code") == AMBIGUOUS, F.concat(F.lit("A:"), F.col("n").cast("string")))
    text = text.otherwise(F.concat(F.coalesce("ext_id", F.lit(0)).cast("string"), F.lit(":"), F.col("n").cast("string")))
    listed = named.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("island", text.alias("t")))).alias("x"))
    return listed.select("read", F.array_join("x.t", " ").alias("hitlist"))


# --- the operator ------------------------------------------------------------------------------------


def classify(index: TaxIndex, reads: DataFrame, opts: ClassifyOptions = ClassifyOptions(), kmers: bool = False, broadcast_rows: int = BROADCAST_ROWS, long_bases: int | None = None) -> DataFrame:
    """Calls of ``reads`` (see :func:`single_reads`): ``(read, call, total, hit_groups, hitlist, hits, kmers)``.

    ``call`` is an internal number, 0 for unclassified.  ``hits`` counts tokens by taxon; with ``kmers`` the
    minimizers that opened hit groups are kept by taxon, for reports.  A protein index turns on translated
    search.  The sizes of the taxonomy and of the index decide the plan; all give the same rows.  With
    ``long_bases`` reads with more bases are scanned in pieces by many tasks (see :func:`classify_long`); the
    reads are then scanned by two branches of the plan.
    """
    if not index.options.dna and not opts.translated:
        opts = ClassifyOptions(**{**opts.__dict__, "translated": True})
    ready = prepared(reads, opts)
    if index.taxonomy.tree() is None:
        return _by_closure(index, ready, opts, kmers)
    if not index.fits(broadcast_rows):
        return _by_joins(index, ready, opts, kmers)
    if long_bases is None:
        return classify_narrow(index, ready, opts, kmers)
    bases = F.coalesce(F.length("seq1"), F.lit(0)) + F.coalesce(F.length("seq2"), F.lit(0))
    return classify_narrow(index, ready.where(bases <= long_bases), opts, kmers).unionByName(classify_long(index, ready.where(bases > long_bases), opts, kmers))


def output_lines(calls: DataFrame, reads: DataFrame, taxonomy, opts: ClassifyOptions = ClassifyOptions()) -> DataFrame:
    """``(read, call, ext_id, classified, line)``: the tab-separated line of each read."""
    numbers = taxonomy.nodes.select(F.col("node").alias("call"), "ext_id", "name")
    joined = calls.join(reads.select(F.col("seq_no").alias("read"), "header1", "seq1", "seq2"), "read").join(numbers, "call", "left").withColumn("ext_id", F.coalesce("ext_id", F.lit(0).cast("long")))
    head = trim_pair_suffix(F.col("header1")) if opts.paired else F.col("header1")
    length = F.length("seq1").cast("string")
    if opts.paired:
        length = F.concat(length, F.lit("|"), F.coalesce(F.length("seq2"), F.lit(0)).cast("string"))
    taxon = F.col("ext_id").cast("string")
    if opts.use_names:
        taxon = F.concat(F.when(F.col("call") != 0, F.col("name")).otherwise(F.lit("unclassified")), F.lit(" (taxid "), taxon, F.lit(")"))
    line = F.concat_ws("\t", F.when(F.col("call") != 0, F.lit("C")).otherwise(F.lit("U")), head, taxon, length, F.col("hitlist"))
    return joined.select("read", "call", "ext_id", (F.col("call") != 0).alias("classified"), line.alias("line"))


def split_reads(calls: DataFrame, reads: DataFrame, taxonomy, tag: str = "taxid") -> DataFrame:
    """``(read, classified, mate, record)``: FASTA or FASTQ records for the classified and unclassified files.

    A classified header has ``tag|N`` before its comment.
    """
    numbers = taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
    joined = calls.select("read", "call").join(reads.withColumnRenamed("seq_no", "read"), "read").join(numbers, "call", "left")
    sides = [F.struct(F.lit(k).alias("mate"), *[F.col(f"{c}{k}").alias(c) for c in ("header", "comment", "seq", "quals", "format")]) for k in (1, 2)]
    rows = joined.select("read", "call", "ext_id", F.explode(F.array(*sides)).alias("s")).select("read", "call", "ext_id", "s.*").where("seq is not null")
    head = F.concat("header", F.when(F.col("call") != 0, F.concat(F.lit(f" {tag}|"), F.col("ext_id").cast("string"))).otherwise(F.lit("")), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), "comment")).otherwise(F.lit("")))
    fastq = F.concat(F.lit("@"), head, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.coalesce("quals", F.lit("")))
    record = F.when(F.col("format") == "fastq", fastq).otherwise(F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq")))
    return rows.select("read", (F.col("call") != 0).alias("classified"), "mate", record.alias("record"))


def split_names(name: str, paired: bool) -> list[str]:
    """The file names of a split output: of a pair ``#`` becomes ``_1`` and ``_2`` and must be there once."""
    if not paired:
        return [name]
    if name.count("#") != 1:
        raise ValueError("a paired output name has exactly one #")
    return [name.replace("#", "_1"), name.replace("#", "_2")]


def run_stats(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """One row ``(sequences, bases, classified, unclassified, classified_pct, unclassified_pct)``."""
    bases = reads.agg(F.coalesce(F.sum(F.length("seq1") + F.coalesce(F.length("seq2"), F.lit(0))), F.lit(0)).cast("long").alias("bases"))
    counted = calls.agg(F.count("*").alias("sequences"), F.coalesce(F.sum((F.col("call") != 0).cast("long")), F.lit(0).cast("long")).alias("classified"))
    pct = lambda c: F.when(F.col("sequences") > 0, F.lit(100.0) * c / F.when(F.col("sequences") > 0, F.col("sequences")))
    both = counted.crossJoin(bases)  # one row each
    other = F.col("sequences") - F.col("classified")
    return both.select("sequences", "bases", "classified", other.alias("unclassified"), pct(F.col("classified")).alias("classified_pct"), pct(other).alias("unclassified_pct"))


def stats_text(stats, seconds: float) -> str:
    """The run statistics as text, for a row of :func:`run_stats` and the run's seconds."""
    n, mbp, s = stats["sequences"], stats["bases"] / 1e6, max(seconds, 1e-9)
    head = f"{n} sequences ({mbp:.2f} Mbp) processed in {seconds:.3f}s ({n / 1e3 / (s / 60):.1f} Kseq/m, {mbp / (s / 60):.2f} Mbp/m)."
    share = lambda k: 100.0 * k / n if n else float("nan")
    return "\n".join([head, f"  {stats['classified']} sequences classified ({share(stats['classified']):.2f}%)", f"  {stats['unclassified']} sequences unclassified ({share(stats['unclassified']):.2f}%)"])
