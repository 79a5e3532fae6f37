"""The compact table in ranges against the same on one array, and its files."""

import random

import numpy as np
import pytest

from phylospan.model import ClassifyOptions, IndexOptions
from phylospan.operators.classify import classify, single_reads
from phylospan.operators.index import build_index
from phylospan.sources import binary
from phylospan.sources.compact import CompactIndex, Layout
from test_classify import SEQ, lca, plain, tree


def whole(table):
    cells = b"".join(bytes(r.cells) for r in table.ranges.orderBy("part").collect())
    return binary.CompactTable(np.frombuffer(cells, "<u4"), table.layout.value_bits)


@pytest.mark.parametrize("capacity, cells, n", [(1000, 250, 700), (1003, 1 << 20, 900), (96, 32, 95), (1, 4, 1)])
def test_ranges_answer_as_one_array(spark, tmp_path, capacity, cells, n):
    taxonomy, _ = tree(spark)
    paths, _ = plain(taxonomy)
    rng = np.random.default_rng(capacity)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
    taxa = rng.integers(1, len(paths) + 1, len(keys))
    rows = [(int(k), int(t)) for k, t in zip(keys, taxa)] + [(None, 1), (5, 0)]
    table = CompactIndex.build(spark.createDataFrame(rows, "minimizer long, taxon long").repartition(3), taxonomy, capacity, cells)
    array = whole(table)
    assert len(array.cells) == capacity
    # every key is there, with its taxon or, where others share its cell, with the ancestor of all their taxa
    got = array.get(keys.view(np.uint64))
    assert all(g in paths[t] for g, t in zip(got.tolist(), taxa.tolist())) and (got == taxa).mean() > 0.9
    # and all are asked for by ranges, repeated and foreign ones too
    foreign = rng.integers(-(1 << 63), 1 << 63, 500)
    asked = np.concatenate((keys, keys[: n // 2], foreign))
    found = table.lookup(spark.createDataFrame([(int(k),) for k in asked] + [(None,)], "minimizer long")).collect()
    expected = dict(zip(asked.tolist(), array.get(asked.view(np.uint64)).tolist()))
    assert len(found) == len({r.minimizer for r in found}) and {r.minimizer: r.taxon for r in found} == {k: v for k, v in expected.items() if v}
    assert {r.taxon: r.minimizers for r in table.value_counts().collect()} == array.value_counts()
    # the file is that of the array, and is read by ranges of another size
    array.size = table.size()
    table.save(str(tmp_path / "t"))
    assert (tmp_path / "t").read_bytes() == array.pack() and len(list(tmp_path.iterdir())) == 1
    again = CompactIndex.load(spark, str(tmp_path / "t"), 33)
    assert again.layout == Layout(capacity, table.layout.value_bits, 33) and (whole(again).cells == array.cells).all()
    assert sorted(map(tuple, again.lookup(spark.createDataFrame([(int(k),) for k in asked], "minimizer long")).collect())) == sorted(map(tuple, found))


def test_cells_that_are_shared(spark):
    """With 31 bits of value a cell keeps one bit of a key: most keys meet others, whose taxa then share an ancestor."""
    from phylospan.sources.compact import Filling, find

    taxonomy, _ = tree(spark)
    paths, _ = plain(taxonomy)
    packed = taxonomy.tree().value
    rng = np.random.default_rng(5)
    at, short, taxa = rng.integers(0, 50, 120), rng.integers(0, 3, 120).astype(np.uint32), rng.integers(1, len(paths) + 1, 120)
    filling = Filling(packed, 20, np.zeros(200, np.uint32))
    assert not filling.insert(at[:60], short[:60], packed.entry[taxa[:60]]).any()
    filling = Filling(packed, 20, filling.cells())  # taken up again by another round
    assert not filling.insert(at[60:], short[60:], packed.entry[taxa[60:]]).any()
    cells = filling.cells()
    value, past = find(cells, 20, at, short)
    assert not past.any()
    groups = {}
    for a, s, t in zip(at.tolist(), short.tolist(), taxa.tolist()):
        slot = next(k for k in range(a, 200) if cells[k] >> 20 == s and cells[k] & 0xFFFFF)
        groups[slot] = lca(paths, groups.get(slot, 0), t)
        assert all(cells[k] for k in range(a, slot))
    assert {k: int(cells[k]) & 0xFFFFF for k in np.flatnonzero(cells)} == groups and len(groups) < 120
    assert all(v in paths[t] for v, t in zip(value.tolist(), taxa.tolist()))


def test_full_tables_and_cut_files(spark, tmp_path):
    taxonomy, _ = tree(spark, 10)
    index = spark.createDataFrame([(k * 7919, 1 + k % 9) for k in range(50)], "minimizer long, taxon long")
    with pytest.raises(ValueError, match="full"):
        CompactIndex.build(index, taxonomy, 40, 8)
    empty = CompactIndex.build(index.where("false"), taxonomy, 40, 8)
    assert empty.size() == 0 and empty.lookup(index).count() == 0
    empty.save(str(tmp_path / "t"))
    data = (tmp_path / "t").read_bytes()
    (tmp_path / "cut").write_bytes(data[:-1])
    with pytest.raises(ValueError, match="cut off"):
        CompactIndex.load(spark, str(tmp_path / "cut"))
    with pytest.raises(ValueError):
        Layout(0, 5)


@pytest.mark.parametrize("dna", [True, False])
def test_reads_are_classified_by_index_files(spark, tmp_path, dna):
    taxonomy, rows = tree(spark)
    rng = random.Random(3)
    letters = "ACGT" if dna else "ARNDCQEGHILKMFPSTWYV"
    genomes = [(k, f"s{k}", "", "".join(rng.choices(letters, k=300)), "", "fasta") for k in range(6)]
    sequences = spark.createDataFrame(genomes, SEQ)
    taxa = spark.createDataFrame([(k, 3 * k + 2) for k in range(6)], "seq_no long, taxon long")
    built = build_index(sequences.select("seq_no", "seq"), taxa, taxonomy, IndexOptions(k=15, l=11, dna=dna))
    binary.write_index_files(str(tmp_path / "db"), built, 5000)
    options, again, table = binary.read_index_files(spark, str(tmp_path / "db"))
    assert options == built.options and again.nodes.count() == taxonomy.nodes.count()
    reads = [(k, f"r{k}", "", "".join(rng.choices("ACGT", k=120)) if k % 3 == 0 or not dna else genomes[k % 6][3][20:140], "", "fasta") for k in range(12)]
    reads = single_reads(spark.createDataFrame(reads, SEQ))
    for opts in (ClassifyOptions(), ClassifyOptions(confidence=0.5)):
        exact = {r.read: (r.call, r.hitlist) for r in classify(built, reads, opts).collect()}
        got = {r.read: (r.call, r.hitlist) for r in classify(binary.index_for(table, again, options, reads, opts), reads, opts).collect()}
        assert got == exact


def test_small_tables_are_asked_where_keys_are(spark, monkeypatch):
    """All keys of a table of one range would meet in one task; asked in the scan the answers are the same."""
    from phylospan.operators.minimizers import found_minimizers
    from phylospan.sources import compact

    taxonomy, _ = tree(spark)
    rng, o = random.Random(9), IndexOptions(k=15, l=11)
    genomes = [(k, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=400))) for k in range(8)]
    sequences = spark.createDataFrame([*genomes, (8, None), (9, "")], "seq_no long, seq string").repartition(4)
    built = build_index(sequences.where("seq_no < 5"), spark.createDataFrame([(k, 3 * k + 2) for k in range(5)], "seq_no long, taxon long"), taxonomy, o)
    for capacity in (built.index.count(), 3 * built.index.count()):  # full, with a search past the last cell, and loose
        table = CompactIndex.build(built.index, taxonomy, capacity, capacity // 3)
        found = table.search(sequences, o)
        assert "hashpartitioning(part" not in found._jdf.queryExecution().executedPlan().toString()
        got, asked = sorted(map(tuple, found.collect())), found_minimizers(sequences, o)
        assert got == sorted(map(tuple, table.lookup(asked).collect())) and len(got) >= built.index.count()
        monkeypatch.setattr(compact, "BROADCAST_CELLS", 0)
        assert got == sorted(map(tuple, table.search(sequences, o).collect())) == sorted(map(tuple, table.lookup(asked).collect()))
        monkeypatch.undo()
