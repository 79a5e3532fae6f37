"""Scalar functions, masking, sketches, sources and sinks, look-ups, binary files, streaming."""

import bz2
import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospan.functions import dust, sequence, sketch
from phylospan.model import IndexOptions
from phylospan.operators.lookup import lookup_accessions, lookup_any_version
from phylospan.operators.taxonomy import Taxonomy
from phylospan.sources import binary, fastx, taxfiles
from phylospan.sources.splits import parse_lines


def model_frames(dna):
    codons = {a + b + c: sequence.AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("AGCT") for j, b in enumerate("AGCT") for k, c in enumerate("AGCT")}
    dna, n = dna.upper(), len(dna)
    if n < 3:
        return [" " * (n // 3 + 1)] * 6
    frames = [""] * 6
    for i in range(2, n):
        three = dna[i - 2 : i + 1]
        frames[i % 3] += codons.get(three, "X")
        back = three[::-1].translate(str.maketrans("ACGT", "TGCA"))
        frames[3 + i % 3] = codons.get(back, "X") + frames[3 + i % 3]
    return frames


def column(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col.alias("x")).collect()]


def test_six_frames(spark):
    rng = random.Random(1)
    texts = ["AAAGGGCCCTTT", "ATG", "A", "AT", "", "NNNAAAGGGCCC", "acgtn"] + ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randint(0, 50))) for _ in range(60)]
    got = column(spark, [(t,) for t in texts], "s string", sequence.six_frames(F.col("s")))
    assert got == [model_frames(t) for t in texts]
    assert got[0][2] == "KGPF" and [len(f) for f in got[1]] == [0, 0, 1, 0, 0, 1] and got[5][2].startswith("X")


def test_quality_mask(spark):
    rows = [("ACGT", "I!5I", "fastq"), ("ACGT", "I!5I", "fasta"), ("", "", "fastq"), (None, None, "fastq"), ("AC", "", "fastq"), ("A", "\x1f", "fastq")]
    got = column(spark, rows, "s string, q string, f string", sequence.mask_low_quality(F.col("s"), F.col("q"), 20, F.col("f")))
    assert got == ["AxGT", "ACGT", "", None, "AC", "A"]


def test_headers(spark):
    rows = [("r/1",), ("/1",), ("ab/2",), ("a/3",), ("",), ("a/1/2",)]
    assert column(spark, rows, "h string", sequence.trim_pair_suffix(F.col("h"))) == ["r", "/1", "ab", "a/3", "", "a/1"]
    rows = [("id1 x\x01id2\ty\x01 bad\x01id3",), ("",), ("one",)]
    assert column(spark, rows, "h string", sequence.sequence_ids(F.col("h"))) == [["id1", "id2", "id3"], [], ["one"]]
    rows = [(">k:taxid|562|NC_1 z",), ("taxid|9606|x",), ("abc k:taxid|5|",), ("x|y",), (">a|taxid|7|b",)]
    assert column(spark, rows, "h string", sequence.header_taxid(F.col("h"))) == [562, 9606, None, None, 7]
    assert column(spark, [("a\tb\tc",)], "h string", sequence.first_fields(F.col("h"), "\t", 2)) == [["a", "b"]]
    assert column(spark, [("ACGTACGT", "c"), ("ACGTA", ""), ("", None)], "s string, c string", sequence.fasta_text(F.lit("seq1"), F.col("c"), F.col("s"), 4)) == [">seq1 c\nACGT\nACGT", ">seq1\nACGT\nA", ">seq1"]
    assert column(spark, [(1, 3), (0, 0), (12345, 100000)], "a long, b long", sequence.percent(F.col("a"), F.col("b")))[:2] == [" 33.33", "   NaN"]
    assert column(spark, [("AACGN",)], "s string", sequence.reverse_complement_text(F.col("s"))) == ["NCGTT"]
    assert column(spark, [("genus",), ("clade",)], "r string", sequence.rank_letter(F.col("r"))) == ["G", None]


def test_long_sequences_are_translated_in_linear_time():
    """A codon is looked up, not cut out of the text anew: a million bases take well under a second."""
    import time

    rng, begin = random.Random(7), time.process_time()
    long = "".join(rng.choices("ACGTNacgt", k=200)) * 5000
    assert sequence.translations(long[:200]) == model_frames(long[:200]) and sequence.translations(None) == [""] * 6
    frames = sequence.translations(long)
    assert [len(f) for f in frames] == [len(long[k:]) // 3 for k in (1, 2, 0)] * 2 and time.process_time() - begin < 5


# --- dust --------------------------------------------------------------------------------------------


def plain_perfect(run, window=64, threshold=20):
    """All stretches by their definition, brute force."""
    t = [run[k : k + 3] for k in range(len(run) - 2)]
    score = {}
    for a in range(len(t)):
        counts, pairs = {}, 0
        for b in range(a, min(len(t), a + window - 2)):
            pairs += counts.get(t[b], 0)
            counts[t[b]] = counts.get(t[b], 0) + 1
            if b > a:
                score[a, b] = (pairs, b - a)
    marks = [False] * len(run)
    for (a, b), (p, n) in score.items():
        if p * 10 > threshold * n and all(score[c, d][0] * n <= p * score[c, d][1] for c in range(a, b) for d in range(c + 1, b + 1) if (c, d) in score):
            for k in range(a, b + 3):
                marks[k] = True
    return marks


def test_dust():
    assert dust.dust_mask("A" * 20) == "a" * 20
    assert dust.dust_mask("AAAAANNNNAAAAA")[5:9] == "NNNN"
    assert dust.dust_mask("acgtnu") == "ACGTnU" and dust.dust_mask("") == ""
    assert dust.dust_mask("A" * 20, replace_with="N") == "N" * 20
    rng = random.Random(2)
    for _ in range(60):
        run = "".join(rng.choice(["".join(rng.choices("ACGT", k=rng.randint(1, 12))), rng.choice("ACGT") * rng.randint(1, 12), "AC" * rng.randint(1, 8)]) for _ in range(4))[:48]
        got = [c.islower() for c in dust.dust_mask(run)]
        assert got == plain_perfect(run)


def test_dust_by_stretches(monkeypatch):
    """Promising ends do not depend on where the array steps are cut, and leave out no interval."""
    rng = random.Random(4)
    for _ in range(40):
        run = "".join(rng.choices(rng.choice(["ACGT", "AC", "AAAT"]), k=rng.randint(0, 400))) + "ACT" * rng.randint(0, 30)
        want = dust.perfect_intervals(run)
        for stretch in (1, 7, 100):
            monkeypatch.setattr(dust, "STRETCH", stretch)
            assert dust.perfect_intervals(run) == want
        monkeypatch.undo()
    assert dust.perfect_intervals("AC") == [] and dust.perfect_intervals("ACG") == []


def test_dust_of_many_texts():
    """Texts that lie side by side, with runs cut by other letters, are masked at once: each as by itself, and fast."""
    import time

    import pyarrow as pa

    rng = random.Random(6)
    texts = [None, "", "A" * 30, "A" * 30] + ["".join(rng.choices(rng.choice(["ACGTN", "AC", "AAATé"]), k=rng.randint(0, 60))) for _ in range(60)]
    plain = lambda s: "".join(dust.dust_mask(run) for run in re.split("([^ACGT]+)", s))
    assert dust._mask_column(pa.array(["AAAA", *texts]).slice(1), 64, 20).to_pylist() == [s and plain(s) for s in texts]
    many, begin = pa.array(["".join(rng.choices("ACGTACCN", k=3000)) for _ in range(200)]), time.process_time()
    dust._mask_column(many, 64, 20)
    assert time.process_time() - begin < 3  # some 9 s run by run and end by end


def test_dust_table(spark):
    df = spark.createDataFrame([(1, "A" * 30, "x"), (2, None, "y"), (3, "", "z")], "seq_no long, seq string, masked string")
    got = {r.seq_no: (r.seq, r.masked) for r in dust.mask_low_complexity(df).collect()}
    assert got == {1: ("a" * 30, "x"), 2: (None, "y"), 3: ("", "z")}


# --- sketches ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 100, 1000, 5000, 60_000])
def test_sketch_estimates(n):
    s = sketch.Sketch().add(np.arange(n))
    assert s.observed == n and (s.registers is None) == (n <= 1024)
    for estimate in (s.estimate(), s.estimate_linear(), s.estimate_corrected()):
        assert abs(estimate - n) <= 0.05 * n
    again = sketch.Sketch.from_bytes(s.to_bytes())
    assert again.estimate() == s.estimate() and again.observed == n


def test_sketch_merges():
    for a, b in ((500, 400), (500, 5000), (5000, 500), (5000, 6000)):
        x, y = sketch.Sketch().add(np.arange(a)), sketch.Sketch().add(np.arange(a // 2, a // 2 + b))
        whole = max(a, a // 2 + b)
        for m in (x.merge(y), y.merge(x)):
            assert abs(m.estimate() - whole) <= 0.06 * whole and m.observed == a + b
    with pytest.raises(ValueError):
        sketch.Sketch(12).merge(sketch.Sketch(10))


def test_sketch_columns_equal_the_step_by_step_sketch(spark):
    """Groups around the size at which a sketch turns into registers, with repeated, negative and extreme keys."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 50, 1000, 1023, 1024, 1025, 1030, 1500, 4000, 20_000]
    keys = {g: rng.integers(-(1 << 63), (1 << 63) - 1, n) for g, n in enumerate(sizes)}
    keys[0] = np.array([(1 << 63) - 1])
    keys[2] = np.repeat(keys[2][:10], 5)
    rows = spark.createDataFrame([(g, int(k)) for g, x in keys.items() for k in x] + [(None, 1), (3, None)], "g long, k long")
    table, observed = sketch.sketches(rows, "g", "k")
    got = {r.g: (r.observed, r.estimate, r.estimate_linear) for r in sketch.estimates(table, observed).collect()}
    own = {g: sketch.Sketch().add(x) for g, x in keys.items()}
    assert got == {g: (s.observed, s.estimate(), s.estimate_linear()) for g, s in own.items()}
    assert {r.g: r.dense for r in table.select("g", "dense").distinct().collect()} == {g: s.registers is not None for g, s in own.items()}
    # merged: sparse ones with each other, with dense ones, and many sparse ones beyond the size of a dense one
    groups = {0: [0, 2], 1: [4, 10], 2: [3, 4, 5], 3: [9, 10], 4: [8]}
    members = spark.createDataFrame([(g, t) for t, gs in groups.items() for g in gs], "g long, t long")
    both = table.join(members, "g").select(F.col("t").alias("g"), "dense", "slot", "rank")
    totals = observed.join(members, "g").groupBy(F.col("t").alias("g")).agg(F.sum("observed").alias("observed"))
    merged = {r.g: (r.observed, r.estimate, r.estimate_linear) for r in sketch.estimates(sketch.merged(both), totals).collect()}
    for t, gs in groups.items():
        s = own[gs[0]]
        for g in gs[1:]:
            s = s.merge(own[g])
        assert merged[t] == (s.observed, s.estimate(), s.estimate_linear()), t


def test_sketch_of_no_rows(spark):
    assert sketch.estimates(*sketch.sketches(spark.createDataFrame([], "g long, k long"), "g", "k")).count() == 0


# --- sources -----------------------------------------------------------------------------------------

FASTA = ">seq1 some comment\nACGTACGT\nGGGG\n>seq2\nTTTT\n"
FASTQ = "@read1 desc\nACGT\n+\nIIII\n@read2\nTT\nTT\n+x\n@JJ\nJ\n"


def test_parse_lines():
    assert list(parse_lines(FASTA.splitlines(True))) == [("seq1", "some comment", "ACGTACGTGGGG", "", "fasta"), ("seq2", "", "TTTT", "", "fasta")]
    assert list(parse_lines(FASTQ.splitlines(True))) == [("read1", "desc", "ACGT", "IIII", "fastq"), ("read2", "", "TTTT", "@JJJ", "fastq")]
    assert list(parse_lines(["junk\n", "\n", ">a\tb  c\r\n", "AC\r\n"])) == [("a", "b  c", "AC", "", "fasta")]
    assert list(parse_lines([])) == [] and list(parse_lines([">x"])) == [("x", "", "", "", "fasta")]


def test_fastx_source(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(FASTQ)
    with bz2.open(tmp_path / "c.fa.bz2", "wt") as f:
        f.write(FASTA)
    got = fastx.read_fastx(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/*.gz", f"{tmp_path}/c.*"]).orderBy("seq_no").collect()
    assert [r.header for r in got] == ["seq1", "seq2", "read1", "read2", "seq1", "seq2"]
    assert [r.seq_no for r in got] == [0, 1, 1 << 40, (1 << 40) + 1, 2 << 40, (2 << 40) + 1]
    assert fastx.read_fastx(spark, f"{tmp_path}/a.fa", mate=1).first().mate == 1
    spark.dataSource.register(fastx.FastxSource)
    assert [(r.header, r.seq) for r in spark.read.format("fastx").load(f"{tmp_path}/b.fq.gz").collect()] == [("read1", "ACGT"), ("read2", "TTTT")]
    fastx.write_fasta(fastx.read_fastx(spark, f"{tmp_path}/a.fa"), f"{tmp_path}/out", 8)
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ">seq1 some comment\nACGTACGT\nGGGG\n>seq2\nTTTT"


def test_clean(tmp_path):
    for name in ("library", "taxonomy", "keep"):
        (tmp_path / name).mkdir()
    (tmp_path / "seqid2taxid.map").write_text("x")
    fastx.clean(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["keep"]
    with pytest.raises(ValueError):
        fastx.clean("/")


def test_taxdump(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\t\t|\n2\t|\t1\t|\tsuperkingdom\t|\n9\t|\t2\t|\tspecies\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBac\t|\t\t|\tscientific name\t|\n2\t|\tbug\t|\t\t|\tcommon name\t|\n")
    rows = taxfiles.read_taxdump(spark, f"{tmp_path}/nodes.dmp", f"{tmp_path}/names.dmp")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "root", "no rank"), (2, 1, "Bac", "superkingdom"), (9, 2, None, "species")]
    assert [r.name for r in Taxonomy.from_nodes(rows).nodes.orderBy("node").collect()] == ["root", "Bac", ""]
    (tmp_path / "bad.dmp").write_text("0\t|\t1\t|\tx\t|\n")
    with pytest.raises(Exception, match="not allowed"):
        taxfiles.read_taxdump(spark, f"{tmp_path}/bad.dmp", f"{tmp_path}/names.dmp").collect()


def test_maps(spark, tmp_path):
    lines = ["seq1\t10", "seq2 0", "seq3\t20", "seq1 11", "TAXID\tseq4\t5", "bad x", "", "alone"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    assert {r.seqid: r.taxid for r in taxfiles.parse_id_map(df).collect()} == {"seq1": 11, "seq3": 20, "seq4": 5}
    summary = ["# head", "\t".join(["a"] * 5 + ["511145"] + ["b"] * 5 + ["Complete Genome"] + ["c"] * 7 + ["ftp://x"]), "\t".join(["a"] * 5 + ["7"] + ["b"] * 5 + ["Contig"] + ["c"] * 7 + ["ftp://x"]), "\t".join(["a"] * 5 + ["8"] + ["b"] * 5 + ["Chromosome"] + ["c"] * 7 + ["na"]), "short"]
    df = spark.createDataFrame([(x,) for x in summary], "value string")
    assert [tuple(r) for r in taxfiles.parse_assemblies(df).collect()] == [(511145, "Complete Genome", "ftp://x")]
    assert taxfiles.keep_reference_lines(df).count() == 1
    heads = spark.createDataFrame([("k:taxid|562|NC_1 x",), ("plain",)], "header string")
    assert [r.value for r in taxfiles.prelim_map(heads).collect()] == ["TAXID\tk:taxid|562|NC_1\t562"]
    (tmp_path / "m1").write_text("accession\taccession.version\ttaxid\tgi\nACC1\tACC1.1\t111\t0\nACC3\tACC3.1\t5\t0\nACC1\tACC1.2\t9\t0\n")
    (tmp_path / "m2").write_text("accession\taccession.version\ttaxid\tgi\nACC3\tACC3.2\t6\t0\nACC2\tACC2.1\t222\t0\n")
    maps = taxfiles.read_accession_maps(spark, [f"{tmp_path}/m1", f"{tmp_path}/m2"])
    targets = spark.createDataFrame([("s1", "ACC1"), ("s2", "MISS"), ("s3", "ACC3"), ("s4", "ACC1"), ("s5", "ACC2.1")], "seqid string, accession string")
    found, missing = lookup_accessions(targets, maps)
    assert sorted(map(tuple, found.collect())) == [("s1", "ACC1", 111), ("s3", "ACC3", 5), ("s4", "ACC1", 111)]
    assert {r.accession for r in missing.collect()} == {"MISS", "ACC2.1"}
    any_ = {r.seqid: r.taxid for r in lookup_any_version(targets, maps.withColumn("line_no", F.col("file_no") * 100 + F.col("line_no"))).collect()}
    assert any_ == {"s1": 9, "s2": 0, "s3": 6, "s4": 9, "s5": 222}


def test_binary_files(spark, tmp_path):
    o = IndexOptions(k=12, l=8, spaced_seed_mask=3, min_hash=(1 << 64) - 5)
    assert len(binary.pack_options(o)) == 64 and binary.unpack_options(binary.pack_options(o)) == o
    rows = [(1, 0, "root", "no rank"), (7, 1, "a", "genus"), (5, 1, "é", ""), (9, 7, "c", "species")]
    taxonomy = Taxonomy.from_nodes(spark.createDataFrame(rows, "ext_id long, parent_ext long, name string, rank string"))
    again = binary.unpack_taxonomy(spark, binary.pack_taxonomy(taxonomy))
    assert sorted(map(str, again.nodes.collect())) == sorted(map(str, taxonomy.nodes.collect()))
    table = binary.CompactTable.empty(1000, 10)
    assert table.compare_and_set(42, 5, 0) == (True, 5) and table.compare_and_set(42, 9, 99) == (False, 5)
    assert table.compare_and_set(42, 7, 5) == (True, 7) and table.get([42, 43]).tolist() == [7, 0] and table.size == 1
    assert table.compare_and_set(1, 0, 0) == (False, 0)
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 700))
    for k in keys.tolist():
        table.compare_and_set(k, k % 4 + 1, 0)
    back = binary.CompactTable.unpack(table.pack())
    assert back.size == table.size and back.value_counts() == table.value_counts()
    small = binary.CompactTable.empty(2, 4)
    with pytest.raises(ValueError):
        for k in range(50):
            small.compare_and_set(k * 7919, 1, 0)
