"""Registered queries against their SQL twins on the smallest tables, and against brute force where they have none."""

import os

import duckdb
import pytest

import __spark_entry__
from phylospan.functions.dust import dust_mask
from phylospan.plans.catalogue import QUERIES
from phylospan.plans.oracle import ORACLE_SQL

DATA = os.environ.get("PHYLOSPAN_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_registry():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"classify_documents", "classify_long_documents", "compact_probe", "dust_documents", "dust_mask"}


@needs_tables
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_sql(spark, other, name):
    got = QUERIES[name](spark, DATA)
    want = other.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str(tuple(r[c] for c in order)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


@needs_tables
def test_documents_by_brute_force(spark):
    from phylospan.model import IndexOptions
    from phylospan.operators.minimizers import tokens
    from phylospan.plans.bridges import dna, table
    from pyspark.sql import functions as F

    o = IndexOptions()
    known = set()
    for r in table(spark, DATA, "benchmark").select(dna(F.col("text")).alias("s")).collect():
        known |= set(tokens(r.s.encode(), o)[0].tolist())
    got = {r.doc_id: r for r in QUERIES["classify_documents"](spark, DATA).collect()}
    for r in table(spark, DATA, "documents").select("doc_id", dna(F.col("text")).alias("s")).collect():
        m = tokens(r.s.encode(), o)[0].tolist()
        hits = sum(1 for k, v in enumerate(m) if v in known and (not k or m[k - 1] != v))
        assert got[r.doc_id].hit_groups == hits and (got[r.doc_id].taxid > 0) == (hits > 0) and got[r.doc_id].total == len(m)


@needs_tables
def test_masks_and_sketches(spark):
    from phylospan.plans.bridges import BASES_N, dna, table
    from pyspark.sql import functions as F

    masked = {r.item_id: r.seq for r in QUERIES["dust_mask"](spark, DATA).collect()}
    for r in table(spark, DATA, "benchmark").select("item_id", dna(F.col("text")).alias("s")).collect():
        assert masked[r.item_id] == dust_mask(r.s)
    whole = {r.doc_id: r.masked for r in QUERIES["dust_documents"](spark, DATA).collect()}
    for r in table(spark, DATA, "documents").where("doc_id % 20 = 0").select("doc_id", dna(F.col("text"), BASES_N).alias("s")).collect():
        assert whole[r.doc_id] == sum(c in "acgt" for c in dust_mask(r.s))
    exact = {r.supplier: r.distinct_keys for r in QUERIES["distinct_exact"](spark, DATA).collect()}
    for r in QUERIES["distinct_sketch"](spark, DATA).collect():
        assert abs(r.estimate - exact[r.g]) <= 0.06 * exact[r.g] + 1
    rolled = {r.node: r for r in QUERIES["clade_rollup_distinct"](spark, DATA).collect()}
    estimated = {r.node: r for r in QUERIES["clade_rollup_sketch"](spark, DATA).collect()}
    assert set(rolled) == set(estimated)
    for n, r in estimated.items():
        assert r.observed == rolled[n].parts and abs(r.estimate - rolled[n].distinct_parts) <= 0.06 * rolled[n].distinct_parts + 1


@needs_tables
def test_pieces_of_documents_give_the_calls_of_whole_ones(spark):
    rows = [sorted(map(tuple, QUERIES[q](spark, DATA).collect())) for q in ("classify_documents", "classify_long_documents")]
    assert rows[0] == rows[1]


@needs_tables
def test_printed_lines_keep_the_format(spark):
    """Counts of a hit list add up to the read's tokens, neighbours differ, and the called taxon is among them."""
    for r in QUERIES["classify_lines"](spark, DATA).collect():
        flag, header, taxon, length, hits = r.line.split("\t")
        runs = [x.split(":") for x in hits.split(" ")]
        assert header == f"part{r.read}/1" and sum(int(n) for _, n in runs) == int(length) - 11
        assert all(a[0] != b[0] for a, b in zip(runs, runs[1:]))
        called = taxon.rsplit("taxid ", 1)[1].rstrip(")")
        assert (flag == "C") == (called != "0") and taxon.startswith("unclassified") == (flag == "U")


@needs_tables
def test_compact_probe_by_brute_force(spark):
    """Every minimizer that the exact index has is answered, hardly any other, and shared cells are rare."""
    from phylospan.model import IndexOptions
    from phylospan.operators.minimizers import tokens
    from phylospan.plans.bridges import dna, table
    from pyspark.sql import functions as F

    o = IndexOptions()
    found = lambda name: set().union(*(tokens(r.s.encode(), o)[0].tolist() for r in table(spark, DATA, name).select(dna(F.coalesce("text", F.lit(""))).alias("s")).collect()))
    rows = QUERIES["compact_probe"](spark, DATA).collect()
    both = len(found("benchmark") & found("documents"))
    assert both > 0 and sum(r.known for r in rows) == both and sum(r.answered for r in rows) <= both * 1.01 + 5


@needs_tables
def test_the_passages_index_has_no_node_that_no_call_can_be(spark):
    from phylospan.plans.bridges import benchmark_index, market_nodes

    index = benchmark_index(spark, DATA)
    nodes = {r.ext_id: r for r in index.taxonomy.nodes.collect()}
    asked = {100 + r.item_id % 25 for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    above = {r.ext_id: r.parent_ext for r in market_nodes(spark, DATA).collect()}
    want = set()
    for e in asked:
        while e in above:
            want.add(e)
            e = above[e]
    assert set(nodes) == want | {1} and all(nodes[r.ext_id].parent == (nodes[above[r.ext_id]].node if r.ext_id != 1 else 0) for r in nodes.values())
    assert {r.taxon for r in index.index.select("taxon").distinct().collect()} <= {r.node for r in nodes.values()}
