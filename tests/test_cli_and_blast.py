"""The command line end to end on small files, BLAST volumes written by hand, and streaming."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from phylospan import cli
from phylospan.model import ClassifyOptions
from phylospan.operators.classify import classify, single_reads
from phylospan.operators.index import TaxIndex
from phylospan.sources import blastdb
from phylospan.streaming import continuous


def ber(tag, value, open_ended=False):
    if open_ended:
        return bytes([tag, 0x80]) + value + b"\0\0"
    n = len(value)
    return bytes([tag, n]) + value if n < 128 else bytes([tag, 0x82]) + struct.pack(">H", n) + value


def defline(title, ids, taxid, members=(), open_ended=False):
    integer = lambda v: ber(2, v.to_bytes(4, "big"))
    body = ber(0xA0, ber(0x1A, title.encode()), open_ended) + ber(0xA1, ber(0x30, b"".join(ids), open_ended), open_ended) + ber(0xA2, integer(taxid), open_ended)
    if members:
        body += ber(0xA3, ber(0x30, b"".join(integer(m) for m in members)))
    return ber(0x30, body, open_ended)


def text_id(kind, acc, version):
    return ber(0xA0 | kind, ber(0x30, ber(0xA1, ber(0x1A, acc.encode())) + ber(0xA3, ber(2, bytes([version])))))


GI = ber(0xA0 | 11, ber(2, bytes([42])))
GENERAL = ber(0xA0 | 10, ber(0x30, ber(0xA0, ber(0x1A, b"DB")) + ber(0xA1, ber(0xA1, ber(0x1A, b"tag7")))))
PDB = ber(0xA0 | 14, ber(0x30, ber(0xA0, ber(0x1A, b"1ABC")) + ber(0xA3, ber(0x1A, b"B"))))


@pytest.mark.parametrize("open_ended", [False, True])
def test_deflines(open_ended):
    block = ber(0x30, defline("title", [GI, text_id(4, "NC_1", 2)], 1000, (1, 2), open_ended) + defline("x" * 200, [GENERAL, PDB], 0, (), open_ended), open_ended)
    lines = blastdb.parse_deflines(block)
    assert lines[0]["title"] == "title" and lines[0]["taxid"] == 1000 and lines[0]["memberships"] == [1, 2]
    assert blastdb.defline_text(lines, "taxid") == "taxid|1000|NC_1.2 title >DB_tag71ABC_B " + "x" * 200
    assert blastdb.longest_printable(b"\x01ab\x00abc\x02xyz") == "abc" and blastdb.longest_printable(b"\0\0") == "sequence_2"


def test_bases():
    assert blastdb.decode_bases(bytes([0b00011011, 0])) == "ACGT"
    assert blastdb.decode_bases(bytes([0b00011011, 0b11000001])) == "ACGTT"
    runs = struct.pack(">II", 1, 15 << 28 | 2 << 24 | 1)
    assert blastdb.decode_bases(bytes([0b00011011, 0]), runs) == "ANNN"
    long = struct.pack(">IQ", 0x80000000 | 2, 5 << 60 | 0 << 48 | 3)
    assert blastdb.decode_bases(bytes([0b00011011, 0]), long) == "ACGR"
    assert blastdb.decode_protein(bytes([0, 1, 27, 99])) == "-AJX"


def volume(path, heads, seqs, ambs, protein=False, version=4):
    text = lambda s: struct.pack(">I", len(s)) + s.encode()
    kind = "p" if protein else "n"
    offsets = lambda parts, base: [base + sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    both = [s + a for s, a in zip(seqs, ambs)]
    h, s = offsets(heads, 0), offsets(both, 1)
    data = struct.pack(">II", version, int(protein)) + (struct.pack(">I", 0) if version == 5 else b"") + text("vol") + (text("lmdb") if version == 5 else b"") + text("today")
    data += struct.pack(">I", len(heads)) + struct.pack("<Q", 99) + struct.pack(">I", 50) + struct.pack(f">{len(h)}I", *h) + struct.pack(f">{len(s)}I", *s)
    if not protein:
        a = [x + len(p) for x, p in zip(s, seqs)] + [s[-1]]
        data += struct.pack(f">{len(a)}I", *a)
    for ext, content in (("in", data), ("hr", b"".join(heads)), ("sq", b"\0" + b"".join(both))):
        (path.parent / f"{path.name}.{kind}{ext}").write_bytes(content)


def test_volumes(spark, tmp_path):
    heads = [ber(0x30, defline(f"seq {k}", [text_id(5, f"A{k}", 1)], k)) for k in range(5)]
    packed = bytes([0b00011011, 0b01000001])
    volume(tmp_path / "n", heads, [packed] * 5, [b"", struct.pack(">II", 1, 15 << 28 | 0), b"", b"", b""], version=5)
    got = blastdb.read_blastdb(spark, str(tmp_path / "n"), "taxid", records=2).orderBy("seq_no").collect()
    assert [r.seq for r in got] == ["ACGTC", "NCGTC", "ACGTC", "ACGTC", "ACGTC"] and [r.seq_no for r in got] == list(range(5))
    assert got[3].header == "taxid|3|A3.1" and got[3].comment == "seq 3"
    volume(tmp_path / "p", heads[:1] + [b"\x00plain text\x01"], [bytes([1, 3, 0]), bytes([4, 0])], [b"", b""], protein=True)
    got = blastdb.read_blastdb(spark, str(tmp_path / "p")).orderBy("seq_no").collect()
    assert [(r.header, r.seq) for r in got] == [("A0.1", "AC"), ("plain", "D")]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lib")
    rng = random.Random(1)
    genomes = {f"s{k}": "".join(rng.choices("ACGT", k=400)) for k in range(4)}
    (folder / "lib.fa").write_text("".join(f">{n} genome\n{s}\n" for n, s in genomes.items()))
    (folder / "map").write_text("".join(f"s{k}\t{10 + k}\n" for k in range(4)))
    (folder / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n5\t|\t1\t|\tgenus\t|\n" + "".join(f"{10 + k}\t|\t{5 if k < 2 else 1}\t|\tspecies\t|\n" for k in range(4)) + "99\t|\t1\t|\tspecies\t|\n")
    (folder / "names").write_text("".join(f"{i}\t|\tname{i}\t|\t\t|\tscientific name\t|\n" for i in (1, 5, 10, 11, 12, 13, 99)))
    cli.main(["build", "--db", str(folder / "db"), "--fasta", str(folder / "lib.fa"), "--id-map", str(folder / "map"), "--nodes", str(folder / "nodes"), "--names", str(folder / "names"), "-k", "21", "-l", "15"])
    reads = [("r1", genomes["s0"][50:150]), ("r2", genomes["s3"][10:110]), ("r3", "".join(rng.choices("ACGT", k=100)))]
    (folder / "reads.fq").write_text("".join(f"@{n}/1 c\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    return folder


def test_classify_command(library, capsys):
    out = library / "out"
    cli.main(["classify", "--db", str(library / "db"), str(library / "reads.fq"), "--output", str(out), "--report", str(library / "rep"), "--report-minimizer-data", "--classified-out", str(library / "c.fq"), "--unclassified-out", str(library / "u.fq")])
    lines = [x.split("\t") for x in out.read_text().splitlines()]
    assert [(x[0], x[1], x[2], x[3]) for x in lines] == [("C", "r1/1", "10", "100"), ("C", "r2/1", "13", "100"), ("U", "r3/1", "0", "100")]
    assert all(sum(int(p.split(":")[1]) for p in x[4].split()) == 80 for x in lines)
    report = [x.split("\t") for x in (library / "rep").read_text().splitlines()]
    assert report[0][1:3] == ["1", "1"] and report[0][-1] == "unclassified" and [r[-1].strip() for r in report[1:]] == ["name1", "name5", "name10", "name13"]
    assert (library / "c.fq").read_text().startswith("@r1/1 taxid|10 c\n") and (library / "u.fq").read_text().count("@r3") == 1
    assert "3 sequences" in capsys.readouterr().err


def test_other_commands(library, capsys):
    cli.main(["inspect", "--db", str(library / "db")])
    text = capsys.readouterr().out
    assert "nucleotide db, k = 21, l = 15" in text and "name13" in text and "name99" not in text
    cli.main(["estimate", str(library / "lib.fa"), "-k", "21", "-l", "15", "-n", "1024"])
    assert 200 < int(capsys.readouterr().out) < 1600
    cli.main(["mask", str(library / "lib.fa")])
    assert capsys.readouterr().out.startswith(">s0 genome\n")
    cli.main(["minimizers", "ACGATCGACGACG"])
    assert [int(x.split()[0], 16) for x in capsys.readouterr().out.splitlines()] == [0x2D8, 0x218, 0x218, 0x218]
    (library / "t").write_text("s1\tACC1\ns2\tMISS\n")
    (library / "m").write_text("a\tb\tc\td\nACC1\tACC1.1\t123\t0\n")
    cli.main(["lookup-accessions", str(library / "t"), str(library / "m"), "--unmapped", str(library / "un")])
    assert capsys.readouterr().out == "s1\t123\n" and (library / "un").read_text() == "MISS\n"
    with pytest.raises(SystemExit):
        cli.main(["classify", "--db", "x", "f", "--use-mpa-style"])
    with pytest.raises(ValueError):
        ClassifyOptions(confidence=2)


def test_streams(spark, library, tmp_path):
    index = TaxIndex.load(spark, str(library / "db"))
    schema = "seq_no long, header string, comment string, seq string, quals string, format string"
    rng = random.Random(2)
    genome = "".join((library / "lib.fa").read_text().split(">")[1].split("\n")[1:])
    rows = [(k, f"r{k}", "", genome[a : a + 60] if k % 2 else "".join(rng.choices("ACGT", k=60)), "", "fasta") for k in range(20) for a in [rng.randrange(300)]]
    frame = spark.createDataFrame(rows, schema)
    for k in range(2):
        frame.where(f"seq_no % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = continuous.read_stream(spark, str(tmp_path / "in" / "*"), schema)
    query = continuous.start_lines(index, stream, str(tmp_path / "out"), str(tmp_path / "cp1"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == 20
    query = continuous.start_counts(index, continuous.read_stream(spark, str(tmp_path / "in" / "*"), schema), "calls_now", str(tmp_path / "cp2"))
    query.processAllAvailable()
    got = {r.call: r.reads for r in spark.table("calls_now").collect()}
    query.stop()
    want = {}
    for r in classify(index, single_reads(frame)).collect():
        want[r.call] = want.get(r.call, 0) + 1
    assert got == want and len(got) == 2


def test_running_report_is_that_of_the_batch(spark, library, tmp_path):
    from phylospan.operators import reports

    index = TaxIndex.load(spark, str(library / "db"))
    schema = "seq_no long, header string, comment string, seq string, quals string, format string"
    rng = random.Random(4)
    genomes = [g.split("\n")[1] for g in (library / "lib.fa").read_text().split(">")[1:]]
    rows = [(k, f"r{k}", "", "".join(rng.choices("ACGT", k=60)) if k % 4 == 3 else genomes[k % 4][a : a + 80], "", "fasta") for k in range(24) for a in [rng.randrange(300)]]
    frame = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "in" / "*")
    query = None
    for k in range(2):  # the second part comes to a query that starts again from its checkpoint
        frame.where(f"seq_no % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        query = continuous.start_report(index, continuous.read_stream(spark, folder, schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
        calls = classify(index, single_reads(frame.where(f"seq_no % 2 <= {k}")), kmers=True)
        order = "line_no"
        want = reports.counter_report(reports.counters(reports.counter_rows(calls)), index.taxonomy).orderBy(order).collect()
        got = spark.read.parquet(str(tmp_path / "out" / f"batch={k}")).orderBy(order).collect()
        assert list(map(tuple, got)) == list(map(tuple, want)) and len(got) > 2
    counts = calls.where("call <> 0").groupBy(F.col("call").alias("taxon")).agg(F.count("*").alias("reads"))
    exact = reports.clade_report(counts, index.taxonomy, calls.where("call = 0").count(), kmers=reports.clade_distinct(calls, index.taxonomy)).orderBy(order).collect()
    same = ("clade_reads", "own_reads", "clade_kmers", "rank_code", "ext_id")
    assert [[r[c] for c in same] for r in got] == [[r[c] for c in same] for r in exact]
    assert all(abs(a.clade_distinct_kmers - b.clade_distinct_kmers) <= 0.06 * b.clade_distinct_kmers + 2 for a, b in zip(got, exact))


def test_outputs_in_one_pass(spark, library, tmp_path):
    from phylospan.operators.classify import output_lines, pair_files, split_reads
    from phylospan.sources.fastx import read_fastx
    from phylospan.sources.sinks import join_parts, write_outputs

    index, opts = TaxIndex.load(spark, str(library / "db")), ClassifyOptions(paired=True)
    records = read_fastx(spark, str(library / "reads.fq"))
    reads = pair_files(records, records).repartition(3)
    calls = classify(index, reads, opts)
    names = {"output": str(tmp_path / "o"), "classified": str(tmp_path / "c#.fq"), "unclassified": str(tmp_path / "u#.fq")}
    folders = write_outputs(calls, reads, index.taxonomy, opts, **names)
    assert [f.rsplit("/", 1)[1] for f in folders] == ["o", "c_1.fq", "c_2.fq", "u_1.fq", "u_2.fq"]
    lines = [r.line for r in output_lines(calls, reads, index.taxonomy, opts).orderBy("read").collect()]
    for f in folders:
        join_parts(spark, f, f + ".txt")
    assert (tmp_path / "o.txt").read_text().splitlines() == lines
    for name, flag in (("c", True), ("u", False)):
        for mate in (1, 2):
            parts = split_reads(calls, reads, index.taxonomy).where((F.col("classified") == flag) & (F.col("mate") == mate)).orderBy("read").collect()
            assert (tmp_path / f"{name}_{mate}.fq.txt").read_text() == "".join(r.record + "\n" for r in parts)
    assert all((tmp_path / f / "_SUCCESS").exists() and not (tmp_path / f / "_temporary").exists() for f in folders)
    with pytest.raises(ValueError, match="already"):
        write_outputs(calls, reads, index.taxonomy, opts, **names)
    with pytest.raises(ValueError, match="one name"):
        write_outputs(calls, reads, index.taxonomy, opts, classified=str(tmp_path / "x#"), unclassified=str(tmp_path / "x#"))


def test_failed_tasks_leave_nothing(spark, tmp_path):
    from phylospan.sources.sinks import TextParts

    spark.dataSource.register(TextParts)
    boom = spark.range(0, 200, 1, 4).select(F.lit(0).alias("target"), F.when(F.col("id") < 199, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("lost"))).alias("value"))
    with pytest.raises(Exception, match="lost"):
        boom.write.format("text_parts").option("targets", str(tmp_path / "t")).mode("append").save()
    assert not [p for p in (tmp_path / "t").rglob("*") if p.is_file()]


def test_build_limits_and_serving(spark, library, tmp_path):
    from phylospan.sources import binary

    build = ["build", "--fasta", str(library / "lib.fa"), "--id-map", str(library / "map"), "--nodes", str(library / "nodes"), "--names", str(library / "names"), "-k", "21", "-l", "15"]
    cli.main([*build, "--db", str(tmp_path / "half"), "--capacity", "1000", "--maximum-capacity", "500", "--taxid-bits", "9", "--compact", str(tmp_path / "files")])
    whole, half = TaxIndex.load(spark, str(library / "db")), TaxIndex.load(spark, str(tmp_path / "half"))
    assert half.options.min_hash == 1 << 63 and 0.3 < half.index.count() / whole.index.count() < 0.7
    assert half.index.join(whole.index, ["minimizer", "taxon"], "left_anti").isEmpty()
    options, _, table = binary.read_index_files(spark, str(tmp_path / "files"))
    assert options == half.options and (table.layout.capacity, table.layout.value_bits) == (500, 9) and table.size() == half.index.count()
    with pytest.raises(ValueError, match="exceeds"):
        cli.main([*build, "--db", str(tmp_path / "x"), "--capacity", "10", "--maximum-capacity", "11"])
    with pytest.raises(ValueError, match="cannot hold"):
        cli.main([*build, "--db", str(tmp_path / "y"), "--taxid-bits", "1", "--compact", str(tmp_path / "z")])
    (tmp_path / "log").write_text(f"{library / 'reads.fq'}\nSTOP\n")
    cli.main(["serve", "--db", str(library / "db"), "--log", str(tmp_path / "log"), "--out", str(tmp_path / "answers"), "--checkpoint", str(tmp_path / "cp")])
    assert '"classified": 2' in (tmp_path / "answers" / "request=0" / "summary.json").read_text()
