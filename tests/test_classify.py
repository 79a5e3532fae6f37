"""Taxonomy, index, classification and reports, against step-by-step models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64
from phylospan.model import ClassifyOptions, IndexOptions
from phylospan.operators import reports
from phylospan.operators.classify import classify, classify_long, hit_list, output_lines, pair_files, pair_interleaved, prepared, run_stats, single_reads, split_names, split_reads, stats_text
from phylospan.operators.index import TaxIndex, build_index, estimate_capacity, sequence_taxa, subsampled
from phylospan.operators.sieve import sieve_of
from phylospan.operators.taxonomy import Taxonomy, lca_by, lca_by_closure, mark, number
from phylospan.operators import tree as trees
from phylospan.operators.tree import Tree
from test_scan import model_tokens
from test_sequences import model_frames

SEQ = "seq_no long, header string, comment string, seq string, quals string, format string"


def tree(spark, n=40, seed=1):
    rng = random.Random(seed)
    ids = [1] + rng.sample(range(2, 1000), n - 1)
    ranks = ["no rank", "superkingdom", "phylum", "genus", "species", "clade"]
    rows = [(1, 0, "root", "no rank")] + [(ids[k], ids[rng.randrange(max(0, k - 8), k)], f"n{ids[k]}", rng.choice(ranks)) for k in range(1, n)]
    return Taxonomy.from_nodes(spark.createDataFrame(rows, "ext_id long, parent_ext long, name string, rank string")), rows


def plain(taxonomy):
    rows = taxonomy.nodes.collect()
    return {r.node: list(r.path) for r in rows}, {0: 0} | {r.node: r.ext_id for r in rows}


def lca(paths, a, b):
    return a or b if not a or not b else max(set(paths[a]) & set(paths[b]))


def model_classify(mates, index, paths, ext, o, opts):
    """Token by token; gives call, hit groups and hit list."""
    hits, codes, groups = {}, [], 0
    stop = False
    for k, frames in enumerate(mates):
        for f, seq in enumerate(frames):
            last = None
            for m, ambiguous in model_tokens(seq, o):
                if ambiguous:
                    codes.append(-1)
                    continue
                low = o.min_hash and int(fmix64(m)) < o.min_hash
                t = 0 if low else index.get(m, 0)
                if m != last:
                    last = m
                    groups += t != 0
                if t:
                    if opts.quick and groups >= opts.minimum_hit_groups:
                        stop = True
                        break
                    hits[t] = hits.get(t, 0) + 1
                codes.append(t)
            if stop:
                break
            if opts.translated and f != 5:
                codes.append(-3)
        if stop:
            break
        if opts.paired and k == 0:
            codes.append(-2)
    total = len(codes)
    if opts.paired:
        total = max(0, total - 1)
    if opts.translated:
        total = max(0, total - (4 if opts.paired else 2))
    best, top = 0, 0
    for t in hits:
        s = sum(n for u, n in hits.items() if u in paths[t])
        if s > top:
            best, top = t, s
        elif s == top:
            best = lca(paths, best, t)
    need = math.ceil(opts.confidence * total)
    have = hits.get(best, 0)
    while best and have < need:
        have = sum(n for u, n in hits.items() if best in paths[u])
        if have >= need:
            break
        best = paths[best][-2] if len(paths[best]) > 1 else 0
    if groups < opts.minimum_hit_groups:
        best = 0
    return best, groups, f"{ext[best]}:Q" if opts.quick else hit_list(codes, [1] * len(codes), ext)


@pytest.fixture(scope="module")
def world(spark):
    taxonomy, _ = tree(spark)
    paths, ext = plain(taxonomy)
    rng = random.Random(4)
    o = IndexOptions(k=9, l=6)
    library = [(k, "".join(rng.choices("ACGT", k=120)) if k % 3 else "ACGTTGCAAC" * 9 + "".join(rng.choices("ACGT", k=40)), rng.choice(list(paths))) for k in range(40)]
    sequences = spark.createDataFrame([(k, s) for k, s, _ in library], "seq_no long, seq string")
    taxa = spark.createDataFrame([(k, t) for k, _, t in library], "seq_no long, taxon long")
    index = build_index(sequences, taxa, taxonomy, o)
    index = TaxIndex(index.index.cache(), taxonomy, o)
    want = {}
    for _, s, t in library:
        for m, ambiguous in model_tokens(s, o):
            if not ambiguous:
                want[m] = lca(paths, want.get(m, 0), t)
    return index, want, paths, ext, library


def test_numbers_are_breadth_first(spark):
    taxonomy, rows = tree(spark)
    nodes = taxonomy.nodes.orderBy("node").collect()
    kids = {}
    for e, p, _, _ in sorted(rows):
        kids.setdefault(p, []).append(e)
    order, queue = [], [1]
    while queue:
        e = queue.pop(0)
        order.append(e)
        queue += kids.get(e, [])
    assert [r.ext_id for r in nodes] == order and [r.node for r in nodes] == list(range(1, len(order) + 1))
    assert all(r.parent < r.node and r.path[-1] == r.node and len(r.path) == r.depth + 1 for r in nodes)
    children = {r.node: (r.first_child, r.child_count) for r in taxonomy.children().collect()}
    assert all(children[r.node][1] == len(kids.get(r.ext_id, [])) for r in nodes)


def test_cycles_and_marks(spark):
    rows = [(1, 0, "r", ""), (2, 1, "a", ""), (3, 2, "b", None), (4, 1, "c", ""), (8, 9, "x", ""), (9, 8, "y", "")]
    df = spark.createDataFrame(rows, "ext_id long, parent_ext long, name string, rank string")
    assert number(df).count() == 4  # what the root does not reach is left out
    assert {r.ext_id for r in mark(df, spark.createDataFrame([(3,), (77,)], "ext_id long")).collect()} == {1, 2, 3}
    assert {r.ext_id for r in mark(df, spark.createDataFrame([], "ext_id long")).collect()} == {1}


def test_lca_and_ancestors(spark):
    taxonomy, _ = tree(spark)
    paths, _ = plain(taxonomy)
    pairs = [(a, b) for a in range(0, 41, 3) for b in range(0, 41)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {(r.a, r.b): r.lca for r in taxonomy.lca_pairs(df).collect()} == {(a, b): lca(paths, a, b) for a, b in pairs}
    assert {(r.a, r.b): r.above for r in taxonomy.is_ancestor(df).collect()} == {(a, b): bool(a and b and a in paths[b]) for a, b in pairs}
    assert taxonomy.closure().count() == sum(map(len, paths.values()))


def test_index(spark, world, tmp_path):
    index, want, _, _, _ = world
    assert {r.minimizer: r.taxon for r in index.index.collect()} == want
    index.save(str(tmp_path / "i"))
    again = TaxIndex.load(spark, str(tmp_path / "i"))
    assert again.options == index.options and {r.minimizer: r.taxon for r in again.index.collect()} == want
    counts = {}
    for t in want.values():
        counts[t] = counts.get(t, 0) + 1
    assert {r.taxon: r.minimizers for r in again.value_counts().collect()} == counts
    half = 1 << 63
    assert {r.minimizer for r in subsampled(index.index, half).collect()} == {m for m in want if int(fmix64(m)) >= half}


def test_capacity(spark, world):
    index, _, _, _, library = world
    df = spark.createDataFrame([(k, s) for k, s, _ in library], "seq_no long, seq string")
    all_ = {m for _, s, _ in library for m, a in model_tokens(s, index.options) if not a}
    for n in (1, 300, 1024):
        seen = sum(int(fmix64(m)) & 1023 < n for m in all_)
        assert tuple(estimate_capacity(df, index.options, n).first()) == (seen, int((seen + 1) * 1024 / n))
    with pytest.raises(ValueError):
        estimate_capacity(df, index.options, 0)


def make_reads(library, rng, n=60):
    rows = []
    for k in range(n):
        text = "".join(s[a : a + rng.randint(0, 60)] for _, s, _ in rng.sample(library, rng.randint(1, 3)) for a in [rng.randrange(100)])
        text = "".join("N" if rng.random() < 0.01 else c for c in text)
        rows.append((k, f"r{k}/1", "c", text, "I" * len(text), "fastq"))
    return rows + [(n, "empty", "", "", "", "fasta"), (n + 1, "none", "", None, "", "fasta"), (n + 2, "odd", "", "NNNNNNNNNNNNNNN", "", "fasta")]


@pytest.mark.parametrize("opts", [ClassifyOptions(), ClassifyOptions(confidence=0.3), ClassifyOptions(confidence=0.07, minimum_hit_groups=3), ClassifyOptions(quick=True, minimum_hit_groups=2), ClassifyOptions(quick=True), ClassifyOptions(paired=True, confidence=0.2), ClassifyOptions(paired=True, quick=True, minimum_hit_groups=2, confidence=0.5)])
def test_all_plans_equal_the_model(spark, world, opts, monkeypatch):
    index, want, paths, ext, library = world
    rng = random.Random(5)
    one, two = make_reads(library, rng), make_reads(library, rng)
    reads = pair_files(spark.createDataFrame(one, SEQ), spark.createDataFrame(two, SEQ)) if opts.paired else single_reads(spark.createDataFrame(one, SEQ))
    if opts.paired:
        reads = reads.na.fill("", ["seq2"])
    expected = {}
    for a, b in zip(one, two):
        mates = [[a[3] or ""], [b[3] or ""]] if opts.paired else [[a[3] or ""]]
        expected[a[0]] = model_classify(mates, want, paths, ext, index.options, opts)
    for plan, rows in (("narrow", 10**6), ("joins", 0), ("closure", 0)):
        if plan == "closure":
            monkeypatch.setattr(trees, "TREE_NODES", 0)
        calls = classify(index, reads, opts, broadcast_rows=rows).collect()
        assert len(calls) == len(one)
        got = {r.read: (r.call, r.hit_groups, r.hitlist) for r in calls}
        if opts.quick and plan == "closure":
            got = {k: (c, expected[k][1], h) for k, (c, _, h) in got.items()}  # groups after the stop are not comparable
        assert got == expected, plan
        if plan == "narrow":  # pieces of 10 bases, whose borders fall everywhere
            for piece in (1, 10) if opts == ClassifyOptions() else (10,):
                assert {r.read: (r.call, r.hit_groups, r.hitlist) for r in classify_long(index, prepared(reads, opts), opts, piece=piece).collect()} == expected
            if not opts.paired:
                assert {r.read: (r.call, r.hit_groups, r.hitlist) for r in classify(index, reads, opts, long_bases=70).collect()} == expected


def test_hits_and_kmers_of_all_plans(spark, world, monkeypatch):
    index, _, _, _, library = world
    reads = single_reads(spark.createDataFrame(make_reads(library, random.Random(3), 30), SEQ))
    found = []
    for rows, limit in ((10**6, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(trees, "TREE_NODES", limit)
        found.append({r.read: (r.total, r.hits, {t: sorted(m) for t, m in r.kmers.items()}) for r in classify(index, reads, kmers=True, broadcast_rows=rows).collect()})
    assert found[0] == found[1] == found[2] and any(h for _, h, _ in found[0].values())
    assert all(sum(h.values()) >= sum(map(len, k.values())) for _, h, k in found[0].values())


def test_no_closure_in_the_plans(spark, world):
    """The closure, an explode of paths, is in no plan of a taxonomy that fits the arrays."""
    index, _, _, _, library = world
    reads = single_reads(spark.createDataFrame(make_reads(library, random.Random(3), 5), SEQ))
    groups = spark.createDataFrame([(1, 4), (1, 9)], "g long, taxon long")
    pairs = spark.createDataFrame([(4, 9)], "a long, b long")
    for df in (classify(index, reads, broadcast_rows=0), lca_by(groups, ["g"], index.taxonomy), index.taxonomy.lca_pairs(pairs), index.taxonomy.is_ancestor(pairs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(path" not in plan and "array_intersect" not in plan and "array_contains" not in plan


def test_wide_borders_are_checked(spark, world, monkeypatch):
    from phylospan.operators import index as indexes
    from phylospan.operators.classify import classify_narrow

    index, _, _, _, library = world
    reads = single_reads(spark.createDataFrame(make_reads(library, random.Random(3), 5), SEQ))
    monkeypatch.setattr(indexes, "BROADCAST_ROWS", 3)
    with pytest.raises(ValueError):
        classify_narrow(TaxIndex(index.index, index.taxonomy, index.options), reads)
    monkeypatch.setattr(trees, "TREE_NODES", 0)
    with pytest.raises(ValueError):
        classify_narrow(index, reads)


def test_minimum_hash(spark, world):
    index, want, paths, ext, library = world
    o = IndexOptions(k=9, l=6, min_hash=1 << 63)
    low = TaxIndex(index.index, index.taxonomy, o)
    reads = make_reads(library, random.Random(6), 20)
    df = single_reads(spark.createDataFrame(reads, SEQ))
    for rows in (10**6, 0):
        got = {r.read: (r.call, r.hit_groups, r.hitlist) for r in classify(low, df, broadcast_rows=rows).collect()}
        assert got == {r[0]: model_classify([[r[3] or ""]], want, paths, ext, o, ClassifyOptions()) for r in reads}


def test_translated(spark):
    taxonomy, _ = tree(spark, 12, 3)
    paths, ext = plain(taxonomy)
    rng = random.Random(7)
    o = IndexOptions(k=5, l=3, dna=False)
    library = [(k, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=50)), rng.choice(list(paths))) for k in range(10)]
    index = build_index(spark.createDataFrame([r[:2] for r in library], "seq_no long, seq string"), spark.createDataFrame([(r[0], r[2]) for r in library], "seq_no long, taxon long"), taxonomy, o)
    want = {r.minimizer: r.taxon for r in index.index.collect()}
    reads = [(k, "h", "", "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randint(0, 90))), "", "fasta") for k in range(25)]
    for paired in (False, True):
        opts = ClassifyOptions(translated=True, paired=paired, confidence=0.02)
        df = pair_files(spark.createDataFrame(reads, SEQ), spark.createDataFrame(reads, SEQ)) if paired else single_reads(spark.createDataFrame(reads, SEQ))
        expected = {r[0]: model_classify([model_frames(r[3])] * (1 + paired), want, paths, ext, o, opts) for r in reads}
        for rows in (10**6, 0):
            assert {r.read: (r.call, r.hit_groups, r.hitlist) for r in classify(index, df, opts, broadcast_rows=rows).collect()} == expected


def test_resolve_by_hand():
    # 1 - (2 - (4, 5), 3): entries 1, 2, 5, 3, 4
    tree = Tree.of(*(np.array(x) for x in ([1, 2, 3, 4, 5], [0, 1, 1, 2, 2], [1, 2, 5, 3, 4], [5, 4, 5, 3, 4], [1, 2, 3, 4, 5])))
    groups = [({}, 0), ({4: 3, 5: 3}, 0), ({4: 3, 3: 1}, 4), ({4: 3}, 9)]
    rows = [(g, tree.entry[t], n) for g, (hits, _) in enumerate(groups) for t, n in hits.items()]
    calls = tree.resolve(*(np.array(c) for c in zip(*rows)), np.array([need for _, need in groups]))
    assert tree.node[calls].tolist() == [0, 2, 1, 0]
    assert hit_list([], [], {}) == "0:0"
    assert hit_list([0, 0, -1, 4, -2, -3, 4], [1, 2, 3, 1, 1, 1, 5], {0: 0, 4: 77}) == "0:3 A:3 77:1 |:| -:- 77:5"


def test_lines_stats_and_splits(spark, world, tmp_path):
    index, _, _, _, library = world
    rows = make_reads(library, random.Random(8), 15)[:16]
    reads = single_reads(spark.createDataFrame(rows, SEQ))
    calls = classify(index, reads)
    ext = {r.read: r.ext_id for r in output_lines(calls, reads, index.taxonomy).collect()}
    lines = {r.read: r.line for r in output_lines(calls, reads, index.taxonomy, ClassifyOptions(use_names=True)).collect()}
    for r in calls.collect():
        first, head, taxon, length, hits = lines[r.read].split("\t")
        assert first == ("C" if r.call else "U") and head == rows[r.read][1] and int(length) == len(rows[r.read][3]) and hits == r.hitlist
        assert taxon.endswith(f"(taxid {ext[r.read]})")
    stats = run_stats(calls, reads).first()
    assert stats.sequences == 16 and stats.bases == sum(len(r[3]) for r in rows) and stats.classified + stats.unclassified == 16
    assert "2.00 Mbp" in stats_text({"sequences": 10, "bases": 2_000_000, "classified": 7, "unclassified": 3}, 1.5)
    parts = split_reads(calls, reads, index.taxonomy).collect()
    assert sum(p.classified for p in parts) == stats.classified and all("|" in p.record for p in parts if p.classified)
    from phylospan.sources import sinks

    assert sinks.write_split(parts_frame := split_reads(calls, reads, index.taxonomy), f"{tmp_path}/c", f"{tmp_path}/u") == [f"{tmp_path}/c", f"{tmp_path}/u"]
    assert spark.read.text(f"{tmp_path}/c").count() == 4 * stats.classified and parts_frame.count() == 16
    sinks.write_lines(output_lines(calls, reads, index.taxonomy), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 16
    counts = calls.where("call <> 0").groupBy(F.col("call").alias("taxon")).agg(F.count("*").alias("reads"))
    sinks.write_report(reports.clade_report(counts, index.taxonomy, stats.unclassified), f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").count() > 1
    sinks.write_unmapped(spark.createDataFrame([("X",)], "accession string"), f"{tmp_path}/unmapped")
    assert spark.read.text(f"{tmp_path}/unmapped").first().value == "X"
    assert split_names("a#.fq", True) == ["a_1.fq", "a_2.fq"] and split_names("a", False) == ["a"]
    with pytest.raises(ValueError):
        split_names("a##", True)


def test_pairs(spark):
    df = spark.createDataFrame([(k, f"r{k}", "", "A", "", "fasta") for k in range(5)], SEQ)
    assert [(r.header1, r.header2) for r in pair_interleaved(df).orderBy("seq_no").collect()] == [("r0", "r1"), ("r2", "r3")]
    assert pair_files(df, df.where("seq_no < 3")).count() == 3
    with pytest.raises(Exception, match="lacks its mate"):
        prepared(single_reads(df), ClassifyOptions(paired=True)).collect()


def test_reports(spark):
    taxonomy, rows = tree(spark, 25, 9)
    paths, ext = plain(taxonomy)
    rng = random.Random(10)
    counts = {n: rng.randint(1, 5) for n in rng.sample(list(paths), 12)}
    df = spark.createDataFrame(list(counts.items()), "taxon long, reads long")
    info = {r.ext_id: r for r in taxonomy.nodes.collect()}
    clade = {n: sum(c for t, c in counts.items() if n in paths[t]) for n in paths}
    kids = {}
    for n, p in paths.items():
        kids.setdefault(p[-2] if len(p) > 1 else 0, []).append(n)
    letters = {"superkingdom": "D", "phylum": "P", "genus": "G", "species": "S"}

    def walk(n, code, depth_code, depth, names, zeros, out, path_out):
        if not zeros and not clade[n]:
            return
        node = info[ext[n]]
        code, depth_code = (letters[node.rank], 0) if node.rank in letters else (code, depth_code + 1)
        out.append((clade[n], counts.get(n, 0), code + (str(depth_code) if depth_code else ""), ext[n], "  " * depth + node.name))
        if node.rank in letters:
            names = [*names, f"{letters[node.rank].lower()}__{node.name}"]
            path_out.append(("|".join(names), clade[n]))
        for k in sorted(kids.get(n, []), key=lambda k: -clade[k]):
            walk(k, code, depth_code, depth + 1, names, zeros, out, path_out)

    for zeros in (False, True):
        out, path_out = [], []
        walk(1, "R", -1, 0, [], zeros, out, path_out)
        got = reports.clade_report(df, taxonomy, 7, zeros=zeros).orderBy("line_no").collect()
        assert got[0].line.split("\t")[1:] == ["7", "7", "U", "0", "unclassified"]
        assert [(r.clade_reads, r.own_reads, r.rank_code, r.ext_id, "  " * r.depth + r.name) for r in got[1:]] == out
        total = 7 + sum(counts.values())
        assert all(float(r.pct) == pytest.approx(100 * r.clade_reads / total, abs=0.0051) for r in got)
        assert [(r.clade_path, r.clade_reads) for r in reports.path_report(df, taxonomy, zeros).orderBy("line_no").collect()] == path_out
    assert reports.clade_report(df.limit(0), taxonomy, 0).count() == 0


def test_report_kmers(spark, world):
    index, want, paths, ext, library = world
    reads = single_reads(spark.createDataFrame(make_reads(library, random.Random(11), 30), SEQ))
    for rows in (10**6, 0):
        calls = classify(index, reads, kmers=True, broadcast_rows=rows).cache()
        counters = {r.taxon: r for r in reports.taxon_counters(calls).collect()}
        assert sum(r.kmers for r in counters.values()) == calls.agg(F.sum("hit_groups")).first()[0]
        top = {r.node: r for r in reports.clade_distinct(calls, index.taxonomy).collect()}
        assert top[1].clade_kmers == sum(r.kmers for r in counters.values())
        seen = {m for r in calls.collect() for ms in r.kmers.values() for m in ms}
        assert top[1].clade_distinct_kmers == len(seen)


def test_sequence_taxa(spark):
    taxonomy, rows = tree(spark)
    paths, ext = plain(taxonomy)
    inner = {e: n for n, e in ext.items()}
    a, b = rows[5][0], rows[9][0]
    heads = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, ["z", "y"]), (4, ["q"])], "seq_no long, ids array<string>")
    got = {r.seq_no: r.taxon for r in sequence_taxa(heads, spark.createDataFrame([("x", a), ("y", b), ("z", 123456)], "seqid string, taxid long"), taxonomy).collect()}
    assert got == {1: inner[a], 2: lca(paths, inner[a], inner[b]), 3: inner[b]}


def test_sieve_lets_all_hits_through_and_few_others(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 62, 5000)
    index = spark.createDataFrame([(int(k), 1) for k in keys], "minimizer long, taxon long").repartition(3)
    s = sieve_of(index, 5000)
    assert s.maybe(keys.view(np.uint64)).all()
    assert s.maybe(rng.integers(0, 1 << 62, 50_000).view(np.uint64)).mean() < 0.06
    assert s.words.nbytes * 8 <= 16 * 5000


def test_a_bucketed_index_is_joined_in_place(spark, world, tmp_path):
    index, want, _, _, library = world
    path = str(tmp_path / "b u")
    index.save(path, buckets=4)
    again = TaxIndex.load(spark, path)
    assert {r.minimizer: r.taxon for r in again.index.collect()} == want and again.options == index.options
    reads = single_reads(spark.createDataFrame(make_reads(library, random.Random(3), 30), SEQ))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = classify(again, reads, broadcast_rows=0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(minimizer") == 1  # of the tokens alone
        assert sorted(map(str, got.collect())) == sorted(map(str, classify(index, reads, broadcast_rows=0).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_of_a_read_keep_their_places_in_any_batch():
    """The join plan scans reads in two branches, whose tasks may see them in another order and other batches."""
    from types import SimpleNamespace

    import pyarrow as pa

    from phylospan.operators.classify import _Sifted

    rng, o = random.Random(8), IndexOptions(k=12, l=8)
    seqs = {r: "".join(rng.choices("ACGTACGTN", k=rng.randint(0, 80))) for r in range(50)}
    sieve = SimpleNamespace(value=SimpleNamespace(maybe=lambda m: m % np.uint64(3) == 0))

    def places(order):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int32()), pa.array([0] * len(ids), pa.int32()), pa.array([seqs[r] for r in ids])], names=["read", "mate", "frame", "seq"]) for ids in order]
        return sorted((r["read"], r["run"], r["minimizer"], r["tokens"]) for b in _Sifted(sieve, o)(iter(batches)) for r in b.to_pylist())

    ids = list(seqs)
    assert places([ids]) == places([ids[30:], ids[:30]]) == places([ids[::-1]])


def test_keys_of_clades_are_counted_without_their_ancestors(spark):
    """Different keys and merged sketches of every clade, against sets; sparse and dense sketches meet."""
    from phylospan.functions.sketch import Sketch, estimates, merged, merged_estimates, sketches

    taxonomy, _ = tree(spark, 30, 5)
    paths, _ = plain(taxonomy)
    rng = random.Random(5)
    rows = [(rng.randrange(1, 31), rng.randrange(60)) for _ in range(400)] + [(7, k) for k in range(1500)]
    df = spark.createDataFrame(rows, "taxon long, m long")
    want = {}
    for t, m in rows:
        for a in paths[t]:
            want.setdefault(a, []).append(m)
    counted = reports.distinct_in_clades(df.groupBy("taxon", "m").agg(F.count("*").alias("c")), taxonomy)
    assert {r.node: (r.total, r.different) for r in counted.collect()} == {a: (len(ms), len(set(ms))) for a, ms in want.items()}
    got = {r.node: (r.observed, r.estimate) for r in reports.clade_sketches(df, taxonomy).collect()}
    for a, ms in want.items():
        sketch_ = Sketch()
        for t in range(1, 31):
            if a in paths[t]:
                sketch_ = sketch_.merge(Sketch().add(np.array([m for x, m in rows if x == t])))
        assert got[a] == (len(ms), sketch_.estimate())
    own, observed = sketches(df, "taxon", "m")
    halves = own.withColumn("g", F.col("g") % 2).groupBy("g", "dense", "slot").agg(F.max("rank").alias("rank"))
    totals = observed.groupBy((F.col("g") % 2).alias("g")).agg(F.sum("observed").alias("observed"))
    assert sorted(map(tuple, merged_estimates(halves, totals).collect())) == sorted(map(tuple, estimates(merged(halves), totals).collect()))
