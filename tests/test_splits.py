"""Sequence files cut anywhere give the rows of one scan."""

import bz2
import random

import pytest

from phylospan.sources.splits import FASTQ, QUALITY, Scan, State, guess, parse_lines, read_splits

MIXED = ">a x y\nACGT\nAC\n@b\nGG\n+\n@I\n@c z\nAC\nGT\n+c\n@>\n>@\n>d\n\n+\nTT\n@e\n+\n>f\nA\n"
ODD = "junk\n\n@b q\nGG\n>a\nACGT\nCC\n@c\nACGTAC\n@d\nxx\nyyyyyy\nTT\n+\n!!\n\r\n@e\r\nAC\r\n+\r\n@@\r\n@last\nACG\n+\nI"


def test_formats_are_told_record_by_record():
    assert list(parse_lines([">a\n", "ACGT\n", "@b\n", "GG\n", "+\n", "II\n"])) == [("a", "", "ACGT", "", "fasta"), ("b", "", "GG", "II", "fastq")]
    # without its + a record's qualities are still read, before the next one's sequence
    assert list(parse_lines(["@b\n", "GG\n", ">a\n", "ACGT\n", "TT\n"])) == [("b", "", "GG", "ACGT", "fastq"), ("a", "", "TT", "", "fasta")]
    assert [r[0] for r in parse_lines(MIXED.splitlines(True))] == ["a", "b", "c", "d", "e", "f"]


def joined(lines, cuts):
    """The rows of parts scanned apart, each from the state that the part before ends in."""
    out, state, begun = {}, State(), 0
    for lo, hi in zip([0, *cuts], [*cuts, len(lines)]):
        scan = Scan(state, begun)
        for r in [*scan.run(lines[lo:hi]), *scan.open]:
            whole = out.setdefault(r[0], [None, None, r[4], "", ""])
            if r[1]:
                assert whole[0] is None
                whole[0], whole[1] = r[2], r[3]
            whole[3] += "".join(r[5])
            whole[4] += "".join(r[6])
        state, begun = scan.state, scan.begun
    return [(h, c, s, q, f) for _, (h, c, f, s, q) in sorted(out.items())]


@pytest.mark.parametrize("text", [MIXED, ODD, "", "\n\n", ">x", "@x", "@x\n+\n@y\n>z\n"])
def test_every_cut_gives_the_rows_of_one_scan(text):
    lines = text.splitlines(True)
    want = list(parse_lines(lines))
    for a in range(len(lines) + 1):
        assert joined(lines, [a]) == want
        for b in range(a, len(lines) + 1):
            assert joined(lines, [a, b]) == want


def test_random_lines_cut_anywhere():
    rng = random.Random(1)
    for _ in range(400):
        lines = [rng.choice(["@", ">", "+", "", "A", "AC", "@A", ">AC", "+x", "ACGTACGT"]) + "\n" for _ in range(rng.randint(0, 25))]
        cuts = sorted(rng.randint(0, len(lines)) for _ in range(rng.randint(0, 5)))
        assert joined(lines, cuts) == list(parse_lines(lines))


def test_guesses():
    record = ["@r\n", "ACGT\n", "+\n", "@@@@\n"] * 3
    assert guess(record) == State()
    assert guess(record[3:]) == State(QUALITY, 4)
    assert guess(record[1:]) == State(FASTQ, 0) and guess(record[2:]) == State(FASTQ, 4)


def rows(df):
    return [tuple(r)[2:] for r in df.orderBy("seq_no").collect()]


def fastq_text(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        m = rng.randint(0, 60)
        out.append(f"@r{k} c\n{''.join(rng.choices('ACGT', k=m))}\n+\n{''.join(rng.choices('@>+I', k=m))}\n")
    return "".join(out)


def fasta_text(n, seed):
    rng = random.Random(seed)
    return "".join(f">s{k}\n" + "".join("".join(rng.choices("ACGT", k=60)) + "\n" for _ in range(rng.randint(0, 30))) for k in range(n))


@pytest.mark.parametrize("split", [150, 4096])
def test_files_in_small_splits(spark, tmp_path, split):
    texts = {"a.fq": fastq_text(12 if split < 200 else 300, 1), "b.fa": fasta_text(2 if split < 200 else 60, 2), "c.txt": MIXED + ODD, "d e.fa": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "e.fq.bz2").write_bytes(bz2.compress(texts["a.fq"].encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        names = [f"{tmp_path}/{n}" for n in (*texts, "e.fq.bz2")]
        got = read_splits(spark, names)
        want = [r for t in (*texts.values(), texts["a.fq"]) for r in parse_lines(t.split("\n")[:-1] if t.endswith("\n") else t.split("\n"))]
        assert rows(got) == [(h, c, s, q, f) for h, c, s, q, f in want]
        seq_no = sorted(r.seq_no for r in got.select("seq_no").collect())
        for k, t in enumerate((*texts.values(), texts["a.fq"])):
            n = sum(1 for _ in parse_lines(t.split("\n")))
            assert [x - (k << 40) for x in seq_no if x >> 40 == k] == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_border_pieces_are_shuffled(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq_text(50, 3))
    plan = read_splits(spark, str(tmp_path / "a.fq"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan and "Sort" not in plan
