"""The registered queries of the classifier's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions import dust, sequence, sketch
from phylospan.functions.bits import bits_for_taxa, murmur64
from phylospan.model import ClassifyOptions, IndexOptions
from phylospan.operators import reports
from phylospan.operators.classify import classify, output_lines, run_stats, split_reads
from phylospan.operators.index import estimate_capacity, subsampled
from phylospan.operators.lookup import lookup_accessions, lookup_any_version
from phylospan.operators.minimizers import minimizer_tokens, minimizers
from phylospan.operators.taxonomy import clade_sums, mark
from phylospan.plans.bridges import BASES_N, SHORT, benchmark_index, dna, document_reads, market, market_nodes, part_index, part_reads, table
from phylospan.sources.fastx import read_fastx
from phylospan.sources.sinks import write_outputs
from phylospan.sources.taxfiles import parse_assemblies, parse_id_map, prelim_map, read_taxdump
from phylospan.storage import dealt, new_path, spread, written

PROTEIN = IndexOptions(k=6, l=4, dna=False)


# --- taxonomy ----------------------------------------------------------------------------------------


def tax_bfs_ids(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).nodes.select("node", "parent", "ext_id", "name", "rank", "depth")


def tax_closure(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).closure()


def tax_children(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).children()


def tax_mark_prune(spark: SparkSession, d: str) -> DataFrame:
    """Only customers in debt and what is above them."""
    ids = table(spark, d, "customer").where("c_acctbal < 0").select((1_000_000_000 + F.col("c_custkey")).alias("ext_id"))
    return mark(market_nodes(spark, d), ids).select("ext_id", "parent_ext", "name", "rank")


def _trade(spark: SparkSession, d: str, tax) -> DataFrame:
    """Customer and supplier nodes that trade with each other."""
    bought = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    pairs = bought.select((1_000_000_000 + F.col("o_custkey")).alias("ca"), (2_000_000_000 + F.col("l_suppkey")).alias("cb")).distinct()
    node = lambda k: tax.nodes.select(F.col("ext_id").alias(f"c{k}"), F.col("node").alias(k))
    return pairs.join(node("a"), "ca").join(node("b"), "cb").select("a", "b")


def tax_lca_pairs(spark: SparkSession, d: str) -> DataFrame:
    tax = market(spark, d)
    return tax.lca_pairs(_trade(spark, d, tax))


def tax_is_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer's order-mates' nation is above it: nations of suppliers against customers."""
    tax = market(spark, d)
    parents = tax.nodes.select(F.col("node").alias("b"), F.col("parent").alias("p"))
    pairs = _trade(spark, d, tax).join(parents, "b").select(F.col("p").alias("a"), F.col("a").alias("b")).distinct()
    return tax.is_ancestor(pairs)


def _order_counts(spark: SparkSession, d: str, tax) -> DataFrame:
    counted = table(spark, d, "orders").groupBy((1_000_000_000 + F.col("o_custkey")).alias("ext_id")).agg(F.count("*").alias("reads"))
    return tax.internal(counted).where("taxon <> 0").select("taxon", "reads")


def clade_rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    tax = market(spark, d)
    return clade_sums(_order_counts(spark, d, tax), tax, ["reads"])


def clade_rollup_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered below each node, all and different ones."""
    tax = market(spark, d)
    bought = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    rows = tax.internal(bought.select((1_000_000_000 + F.col("o_custkey")).alias("ext_id"), "l_partkey").groupBy("ext_id", "l_partkey").agg(F.count("*").alias("c")))
    found = reports.distinct_in_clades(rows.select("taxon", F.col("l_partkey").alias("m"), "c"), tax)
    return found.select("node", F.col("total").alias("parts"), F.col("different").alias("distinct_parts"))


def clade_rollup_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Different parts ordered below each node, by sketches that are merged up the tree."""
    tax = market(spark, d)
    bought = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    rows = tax.internal(bought.select((1_000_000_000 + F.col("o_custkey")).alias("ext_id"), "l_partkey"))
    return reports.clade_sketches(rows.select("taxon", F.col("l_partkey").alias("m")), tax)


def clade_report(spark: SparkSession, d: str) -> DataFrame:
    tax = market(spark, d)
    return reports.clade_report(_order_counts(spark, d, tax), tax, 7).select("line_no", "clade_reads", "own_reads", "rank_code", "ext_id", "name", "depth")


def clade_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The report as it is printed, with percentages and indents."""
    tax = market(spark, d)
    return reports.clade_report(_order_counts(spark, d, tax), tax, 7).select("line_no", "pct", "line")


def path_report(spark: SparkSession, d: str) -> DataFrame:
    tax = market(spark, d)
    return reports.path_report(_order_counts(spark, d, tax), tax).select("line_no", "clade_path", "clade_reads")


# --- scalar functions --------------------------------------------------------------------------------


def murmur_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", murmur64(F.col("o_orderkey")).alias("h"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sequence.reverse_complement_text(dna(F.col("p_name"), BASES_N)).alias("rc"))


def quality_mask(spark: SparkSession, d: str) -> DataFrame:
    quals = F.translate(F.hex(F.col("p_name").cast("binary")), "0123456789ABCDEF", "!$&(*,.02468:<>@")
    return table(spark, d, "part").select("p_partkey", sequence.mask_low_quality(dna(F.col("p_name")), quals, 15).alias("masked"))


def trim_pair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sequence.trim_pair_suffix(F.concat(F.lit("read"), F.col("o_orderkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 3).cast("string"))).alias("header"))


def seqid_extract(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.col("p_name"), F.lit("\x01"), F.col("p_brand"), F.lit(" x\x01 "), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(sequence.sequence_ids(head), "|").alias("ids"))


def header_taxids(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("db:taxid|"), F.col("p_size").cast("string"), F.lit("|"), F.col("p_partkey").cast("string"), F.lit(" some text"))
    return prelim_map(table(spark, d, "part").select(head.alias("header")))


def first_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(sequence.first_fields(F.concat_ws(".", "p_name", "p_type", "p_brand"), ".", 2), "|").alias("fields"))


def taxdump_scan(spark: SparkSession, d: str) -> DataFrame:
    """The market's nodes written as dump files, with other names beside the scientific ones, and read back."""
    nodes, folder = market_nodes(spark, d), new_path(spark, "dump")
    joined = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|")).alias("value")
    text = lambda c: F.col(c).cast("string")
    nodes.select(joined(text("ext_id"), text("parent_ext"), "rank", F.lit("x"))).write.text(f"{folder}/nodes")
    names = nodes.select(text("ext_id").alias("id"), "name")
    every = names.select(joined("id", F.reverse("name"), F.lit(""), F.lit("synonym"))).union(names.select(joined("id", "name", F.lit(""), F.lit("scientific name"))))
    every.write.text(f"{folder}/names")
    return read_taxdump(spark, f"{folder}/nodes", f"{folder}/names")


def assembly_scan(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines of an assembly summary, of which whole genomes that can be fetched stay; some are comments or short."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("Complete Genome", "Chromosome", "Scaffold", "Contig")]), (F.col("p_size") % 4 + 1).cast("int"))
    fields = [F.lit("f")] * 5 + [F.col("p_partkey").cast("string")] + [F.lit("f")] * 5 + [level] + [F.lit("f")] * 7 + [F.when(F.col("p_partkey") % 5 == 0, F.lit("na")).otherwise(F.concat(F.lit("ftp/"), "p_name"))]
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("#"), F.concat_ws("\t", *fields))).when(F.col("p_partkey") % 11 == 0, F.concat_ws("\t", *fields[:12])).otherwise(F.concat_ws("\t", *fields))
    return parse_assemblies(table(spark, d, "part").select(line.alias("value")))


def fasta_wrap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sequence.fasta_text(F.col("p_name"), F.col("p_type"), dna(F.col("p_name")), 7).alias("record"))


def six_frame(spark: SparkSession, d: str) -> DataFrame:
    part = spread(table(spark, d, "part").select("p_partkey", "p_name"))
    frames = F.posexplode(sequence.six_frames(dna(F.col("p_name"), BASES_N)))
    return part.select("p_partkey", frames.alias("frame", "protein"))


# --- minimizers and index ----------------------------------------------------------------------------


def _names(spark: SparkSession, d: str, alphabet: str | None = None) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("seq_no"), (dna(F.col("p_name"), alphabet) if alphabet else dna(F.col("p_name"))).alias("seq"))


def minimizers_dna(spark: SparkSession, d: str) -> DataFrame:
    return minimizer_tokens(_names(spark, d), SHORT)


def minimizers_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return minimizer_tokens(_names(spark, d, BASES_N), SHORT)


def minimizers_spaced(spark: SparkSession, d: str) -> DataFrame:
    return minimizer_tokens(_names(spark, d), IndexOptions(k=12, l=8, spaced_seed_mask=0b1111110011001111))


def minimizers_protein(spark: SparkSession, d: str) -> DataFrame:
    return minimizer_tokens(table(spark, d, "part").select(F.col("p_partkey").alias("seq_no"), F.upper("p_name").alias("seq")), PROTEIN)


def minimizers_scan(spark: SparkSession, d: str) -> DataFrame:
    """The Arrow scan over whole benchmark passages: distinct minimizers of each."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_no"), dna(F.col("text"), BASES_N).alias("seq"))
    return minimizers(items, SHORT)


def index_build_lca(spark: SparkSession, d: str) -> DataFrame:
    return part_index(spark, d).index.select("minimizer", "taxon")


def index_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return part_index(spark, d).value_counts()


def index_subsample(spark: SparkSession, d: str) -> DataFrame:
    return subsampled(part_index(spark, d).index, 1 << 63)


def capacity(spark: SparkSession, d: str) -> DataFrame:
    return estimate_capacity(_names(spark, d), SHORT, 512)


# --- classification ----------------------------------------------------------------------------------


def _calls(spark: SparkSession, d: str, opts: ClassifyOptions, joins: bool = False) -> DataFrame:
    index = part_index(spark, d)
    got = classify(index, part_reads(spark, d, opts.paired), opts, **({"broadcast_rows": 0} if joins else {}))
    ext = index.taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
    return got.join(ext, "call", "left").select("read", F.coalesce("ext_id", F.lit(0).cast("long")).alias("taxid"), "total", "hitlist", "hit_groups")


def classify_calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d, ClassifyOptions())


def classify_joins(spark: SparkSession, d: str) -> DataFrame:
    """The plan for an index that is not broadcast."""
    return _calls(spark, d, ClassifyOptions(confidence=0.2), joins=True)


def classify_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d, ClassifyOptions(confidence=0.2))


def classify_hit_groups(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d, ClassifyOptions(minimum_hit_groups=4))


def classify_paired(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d, ClassifyOptions(paired=True, confidence=0.1))


def classify_quick(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d, ClassifyOptions(quick=True, minimum_hit_groups=2)).select("read", "taxid", "hitlist")


def classify_lines(spark: SparkSession, d: str) -> DataFrame:
    index, opts = part_index(spark, d), ClassifyOptions(use_names=True)
    reads = part_reads(spark, d)
    return output_lines(classify(index, reads, opts), reads, index.taxonomy, opts).select("read", "line")


def classify_stats(spark: SparkSession, d: str) -> DataFrame:
    index, reads = part_index(spark, d), part_reads(spark, d)
    return run_stats(classify(index, reads, ClassifyOptions(confidence=0.2)), reads).select("sequences", "bases", "classified", "unclassified")


def split_outputs(spark: SparkSession, d: str) -> DataFrame:
    index, reads = part_index(spark, d), part_reads(spark, d)
    return split_reads(classify(index, reads, ClassifyOptions(confidence=0.2)), reads, index.taxonomy).select("read", "classified", "record")


def classify_report(spark: SparkSession, d: str) -> DataFrame:
    """Calls rolled up the tree, with their k-mers and how many of these differ."""
    index = part_index(spark, d)
    calls = written(classify(index, part_reads(spark, d), kmers=True), "calls")
    counts = calls.where("call <> 0").groupBy(F.col("call").alias("taxon")).agg(F.count("*").alias("reads"))
    none = calls.where("call = 0").count()
    kmers = reports.clade_distinct(calls, index.taxonomy)
    return reports.clade_report(counts, index.taxonomy, none, kmers=kmers).select("line_no", "clade_reads", "own_reads", "clade_kmers", "clade_distinct_kmers", "rank_code", "ext_id", "name", "depth")


def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents against the benchmark's passages at the default k and l."""
    index = benchmark_index(spark, d)
    got = classify(index, document_reads(spark, d))
    ext = index.taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
    return got.join(ext, "call", "left").select(F.col("read").alias("doc_id"), F.coalesce("ext_id", F.lit(0).cast("long")).alias("taxid"), "total", "hit_groups")


def _part_stream(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a stream, dealt out over all cores, for a file of one row group is one task."""
    stream = spark.readStream.schema("p_partkey long, p_name string, p_brand string, p_type string").parquet(f"{d}/part.parquet*")
    return stream.repartition(2 * spark.sparkContext.defaultParallelism)


def stream_call_counts(spark: SparkSession, d: str) -> DataFrame:
    """Part names that arrive as a stream, counted by call."""
    import uuid

    from phylospan.operators.classify import classify_narrow

    index = part_index(spark, d)
    stream = _part_stream(spark, d)
    null = lambda c: F.lit(None).cast("string").alias(c)
    reads = stream.select(F.col("p_partkey").alias("seq_no"), null("header1"), null("comment1"), dna(F.concat_ws(" ", "p_name", "p_brand", "p_type"), BASES_N).alias("seq1"), F.lit("").alias("quals1"), F.lit("fasta").alias("format1"), *[null(f"{c}2") for c in ("header", "comment", "seq", "quals", "format")])
    counts = classify_narrow(index, reads).groupBy("call").agg(F.count("*").alias("reads"))
    name = f"calls_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    ext = index.taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
    return spark.table(name).join(ext, "call", "left").select(F.coalesce("ext_id", F.lit(0).cast("long")).alias("taxid"), "reads")


def stream_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of part names that arrive as a stream, after the last of them."""
    from phylospan.operators.classify import classify_narrow

    index, state = part_index(spark, d), new_path(spark, "stream-counters")
    stream = _part_stream(spark, d)
    null = lambda c: F.lit(None).cast("string").alias(c)
    reads = stream.select(F.col("p_partkey").alias("seq_no"), null("header1"), null("comment1"), dna(F.concat_ws(" ", "p_name", "p_brand", "p_type"), BASES_N).alias("seq1"), F.lit("").alias("quals1"), F.lit("fasta").alias("format1"), *[null(f"{c}2") for c in ("header", "comment", "seq", "quals", "format")])
    running = reports.counters(reports.counter_rows(classify_narrow(index, reads, kmers=True)))
    running.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(state)).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return reports.counter_report(spark.read.parquet(state), index.taxonomy).select("line_no", "clade_reads", "own_reads", "clade_kmers", "rank_code", "ext_id", "name", "depth")


def output_files(spark: SparkSession, d: str) -> DataFrame:
    """Output lines and split reads written by one pass, and all files' lines read back."""
    index, opts = part_index(spark, d), ClassifyOptions(use_names=True)
    reads, folder = part_reads(spark, d), new_path(spark, "outputs")
    files = write_outputs(classify(index, reads, opts), reads, index.taxonomy, opts, *[f"{folder}/{k}" for k in ("lines", "classified", "unclassified")])
    kinds = [spark.read.text(f).select(F.lit(k).alias("output"), F.col("value").alias("line")) for f, k in zip(files, ("lines", "classified", "unclassified"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def compact_probe(spark: SparkSession, d: str) -> DataFrame:
    """All minimizers of whole documents asked of the passages' index as a compact table, seven tenths full: by taxon how
    many differ that the table answers, and how many of these the exact index has."""
    from phylospan.operators.classify import frames_of
    from phylospan.sources.compact import CompactIndex

    index = benchmark_index(spark, d)
    # values have room for the whole market, so that the cells keep the same bits of keys
    table_ = CompactIndex.build(index.index, index.taxonomy, index.index.count() * 10 // 7 + 1, value_bits=bits_for_taxa(market_nodes(spark, d).count() + 1))
    answers = table_.search(frames_of(document_reads(spark, d), ClassifyOptions()), index.options)
    both = answers.join(index.index.select("minimizer", F.lit(1).alias("known")), "minimizer", "left")
    ext = index.taxonomy.nodes.select(F.col("node").alias("taxon"), "ext_id")
    return both.groupBy("taxon").agg(F.count("*").alias("answered"), F.count("known").alias("known")).join(ext, "taxon").select(F.col("ext_id").alias("taxid"), "answered", "known")


# --- look-ups, sketches, masking ---------------------------------------------------------------------


def _accessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    maps = table(spark, d, "part").select(F.concat(F.lit("ACC"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("accession"), F.concat(F.lit("ACC"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit("."), (F.col("p_partkey") % 2).cast("string")).alias("accession_version"), F.col("p_size").cast("long").alias("taxid"), (F.col("p_partkey") % 3).alias("file_no"), F.col("p_partkey").alias("line_no"))
    targets = table(spark, d, "lineitem").select(F.concat(F.lit("seq"), F.col("l_suppkey").cast("string")).alias("seqid"), F.concat(F.lit("ACC"), (F.col("l_partkey") - 20).cast("string")).alias("accession")).distinct()
    return targets, maps


def accession_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup_accessions(*_accessions(spark, d))[0]


def accession_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return lookup_accessions(*_accessions(spark, d))[1]


def accession_any_version(spark: SparkSession, d: str) -> DataFrame:
    return lookup_any_version(*_accessions(spark, d))


def id_map(spark: SparkSession, d: str) -> DataFrame:
    return parse_id_map(table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("seq"), F.col("o_custkey").cast("string"), F.lit("\t"), (F.col("o_orderkey") % 7).cast("string")).alias("value")))


def distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return sketch.exact_distinct(table(spark, d, "lineitem"), "l_suppkey", "l_partkey").withColumnRenamed("g", "supplier")


def distinct_sketch(spark: SparkSession, d: str) -> DataFrame:
    return sketch.estimates(*sketch.sketches(table(spark, d, "lineitem"), "l_suppkey", "l_partkey"))


def distinct_sketch_dense(spark: SparkSession, d: str) -> DataFrame:
    """Different items by line number: groups of many keys, whose sketches are registers."""
    return sketch.estimates(*sketch.sketches(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 100_003 + F.col("l_partkey")).alias("item")), "line", "item"))


def fastx_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as sequence files, FASTQ and wrapped FASTA records mixed, and read back by splits."""
    docs = table(spark, d, "documents").select("doc_id", "lang", dna(F.coalesce("text", F.lit("")), BASES_N).alias("seq"), F.translate(F.hex(F.coalesce("text", F.lit("")).cast("binary")), "0123456789ABCDEF", "@>+$&(*,.02468:<").alias("quals"))
    fastq = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("\n"), "seq", F.lit("\n+\n"), "quals")
    text = F.when(F.col("doc_id") % 2 == 0, fastq).otherwise(sequence.fasta_text(F.col("doc_id").cast("string"), F.col("lang"), F.col("seq"), 60))
    folder = new_path(spark, "fastx")
    docs.select(text.alias("value")).write.text(folder)
    read = read_fastx(spark, f"{folder}/*.txt")
    return read.select(F.col("header").cast("long").alias("doc_id"), F.col("comment").alias("lang"), "format", F.length("seq").cast("long").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("quals").cast("binary")).alias("quals_md5"))


def dust_mask(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", dna(F.col("text")).alias("seq"))
    return dust.mask_low_complexity(items)


def dust_mask_parts(spark: SparkSession, d: str) -> DataFrame:
    return dust.mask_low_complexity(dealt(_names(spark, d)))


def dust_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as DNA: masked bases of each, and a digest of the masked text."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", dna(F.col("text"), BASES_N).alias("seq"))
    masked = dust.mask_low_complexity(docs)
    return masked.select("doc_id", F.length(F.regexp_replace("seq", "[^acgt]", "")).cast("long").alias("masked"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def classify_long_documents(spark: SparkSession, d: str) -> DataFrame:
    """As classify_documents, documents of more than 20,000 bases in pieces of 16,384."""
    from phylospan.operators.classify import classify_long, classify_narrow, prepared

    index, opts = benchmark_index(spark, d), ClassifyOptions()
    reads = prepared(document_reads(spark, d), opts)
    long = F.coalesce(F.length("seq1"), F.lit(0)) > 20_000
    got = classify_narrow(index, reads.where(~long), opts).unionByName(classify_long(index, reads.where(long), opts, piece=1 << 14))
    ext = index.taxonomy.nodes.select(F.col("node").alias("call"), "ext_id")
    return got.join(ext, "call", "left").select(F.col("read").alias("doc_id"), F.coalesce("ext_id", F.lit(0).cast("long")).alias("taxid"), "total", "hit_groups")


QUERIES = {f.__name__: f for f in (
    classify_calls, classify_joins, classify_confidence, classify_hit_groups, classify_paired, classify_quick, classify_lines, classify_stats, split_outputs, classify_report, classify_documents, classify_long_documents, stream_call_counts, stream_report, output_files, compact_probe,
    tax_bfs_ids, tax_closure, tax_children, tax_mark_prune, tax_lca_pairs, tax_is_ancestor, clade_rollup_counts, clade_rollup_distinct, clade_rollup_sketch, clade_report, clade_report_lines, path_report,
    murmur_hash, revcomp, quality_mask, trim_pair, seqid_extract, header_taxids, first_fields, taxdump_scan, assembly_scan, fasta_wrap, six_frame,
    minimizers_dna, minimizers_ambiguous, minimizers_spaced, minimizers_protein, minimizers_scan, index_build_lca, index_value_counts, index_subsample, capacity,
    accession_lookup, accession_unmapped, accession_any_version, id_map, distinct_exact, distinct_sketch, distinct_sketch_dense, dust_mask, dust_mask_parts, dust_documents, fastx_scan,
)}
