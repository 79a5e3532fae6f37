"""The command line: ``python -m phylospan.cli <command>``."""

from __future__ import annotations

import argparse
import shutil
import sys
import time
import uuid

from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64, mask_string
from phylospan.model import REVCOM_VERSION, TOGGLE, ClassifyOptions, IndexOptions


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("phylospan").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _seed(text: str) -> int:
    return int(text, 2) if text else 0


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="phylospan")
    sub = main.add_subparsers(dest="command", required=True)

    c = sub.add_parser("classify", help="classify FASTA or FASTQ files")
    c.add_argument("--db", required=True)
    c.add_argument("files", nargs="+")
    c.add_argument("--quick", action="store_true")
    c.add_argument("--confidence", type=float, default=0.0)
    c.add_argument("--minimum-hit-groups", type=int, default=2)
    c.add_argument("--paired", action="store_true")
    c.add_argument("--interleaved", action="store_true")
    c.add_argument("--classified-out")
    c.add_argument("--unclassified-out")
    c.add_argument("--output")
    c.add_argument("--report")
    c.add_argument("--use-mpa-style", action="store_true")
    c.add_argument("--report-zero-counts", action="store_true")
    c.add_argument("--report-minimizer-data", action="store_true")
    c.add_argument("--use-names", action="store_true")
    c.add_argument("--minimum-base-quality", type=int, default=0)

    b = sub.add_parser("build", help="build an index from FASTA, an id map and taxonomy dumps")
    b.add_argument("--db", required=True)
    b.add_argument("--fasta", nargs="+", required=True)
    b.add_argument("--id-map", required=True)
    b.add_argument("--nodes", required=True)
    b.add_argument("--names", required=True)
    b.add_argument("--protein", action="store_true")
    b.add_argument("-k", type=int, default=35)
    b.add_argument("-l", type=int, default=31)
    b.add_argument("--spaced-seed-mask", type=_seed, default=0)
    b.add_argument("--toggle-mask", type=_seed, default=TOGGLE)
    b.add_argument("--min-hash", type=int, default=0)
    b.add_argument("--capacity", type=int, default=0, help="cells of the compact table; estimated if not given")
    b.add_argument("--maximum-capacity", type=int, default=0, help="leave out minimizers of low hash so that the index fits so many cells")
    b.add_argument("--taxid-bits", type=int, default=0, help="at least so many bits of a cell for the taxon")
    b.add_argument("--compact", metavar="FOLDER", help="write the binary index files too")

    e = sub.add_parser("estimate", help="estimate an index's capacity")
    e.add_argument("files", nargs="+")
    e.add_argument("-k", type=int, default=35)
    e.add_argument("-l", type=int, default=31)
    e.add_argument("-n", type=int, default=4)
    e.add_argument("--protein", action="store_true")

    for name in ("inspect", "dump-table"):
        i = sub.add_parser(name, help="describe an index and count its minimizers by taxon")
        i.add_argument("--db", required=True)
        i.add_argument("--skip-counts", action="store_true")
        i.add_argument("--use-mpa-style", action="store_true")
        i.add_argument("--report-zero-counts", action="store_true")

    a = sub.add_parser("lookup-accessions", help="find taxa of accessions")
    a.add_argument("targets")
    a.add_argument("maps", nargs="+")
    a.add_argument("--unmapped", default="unmapped.txt")

    m = sub.add_parser("mask", help="mask low complexity")
    m.add_argument("files", nargs="+")
    m.add_argument("--window", type=int, default=64)
    m.add_argument("--threshold", type=int, default=20)
    m.add_argument("--replace-with")
    m.add_argument("--width", type=int, default=72)

    d = sub.add_parser("blast-to-fasta", help="convert BLAST volumes")
    d.add_argument("prefixes", nargs="+")
    d.add_argument("--tag")
    d.add_argument("--width", type=int, default=80)

    x = sub.add_parser("clean", help="remove a library's working files")
    x.add_argument("folder")

    v = sub.add_parser("serve", help="answer the requests of a growing log until STOP")
    v.add_argument("--db", required=True)
    v.add_argument("--log", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--checkpoint", required=True)
    v.add_argument("--quick", action="store_true")
    v.add_argument("--confidence", type=float, default=0.0)
    v.add_argument("--minimum-hit-groups", type=int, default=2)
    v.add_argument("--minimum-base-quality", type=int, default=0)
    v.add_argument("--use-names", action="store_true")

    n = sub.add_parser("minimizers", help="print a sequence's minimizers")
    n.add_argument("sequence")
    n.add_argument("-k", type=int, default=10)
    n.add_argument("-l", type=int, default=5)
    return main


def _put(lines, path: str | None) -> None:
    out = open(path, "w", encoding="utf-8") if path else sys.stdout
    for line in lines:
        out.write(line + "\n")
    if path:
        out.close()


def _classify(a) -> None:
    from phylospan.operators import reports
    from phylospan.operators.classify import classify, pair_files, pair_interleaved, run_stats, single_reads, split_names, stats_text
    from phylospan.operators.index import TaxIndex
    from phylospan.sources.fastx import read_fastx
    from phylospan.sources.sinks import join_parts, write_outputs

    if a.use_mpa_style and not a.report:
        raise SystemExit("the path report needs --report")
    if a.paired and not a.interleaved and len(a.files) % 2:
        raise SystemExit("paired files come in twos")
    spark, began = _session(), time.time()
    index = TaxIndex.load(spark, a.db)
    paired = a.paired or a.interleaved
    opts = ClassifyOptions(a.confidence, a.minimum_hit_groups, a.quick, paired, not index.options.dna, a.minimum_base_quality, a.use_names)
    if a.interleaved:
        reads = pair_interleaved(read_fastx(spark, a.files))
    elif a.paired:
        reads = pair_files(read_fastx(spark, a.files[::2]), read_fastx(spark, a.files[1::2]))
    else:
        reads = single_reads(read_fastx(spark, a.files))
    reads = reads.persist()
    calls = classify(index, reads, opts, kmers=bool(a.report)).persist()
    outputs = (a.output, a.classified_out, a.unclassified_out)
    if any(outputs):
        # tasks write parts, and copy each to its place in the one file that is asked for
        stage = f"{next(filter(None, outputs))}.{uuid.uuid4().hex}"
        wanted = {f"{stage}/{k}" + ("_#" if paired and k else ""): name for k, name in enumerate(outputs) if name}
        given = [next((s for s, n in wanted.items() if s.startswith(f"{stage}/{k}")), None) for k in range(3)]
        write_outputs(calls, reads, index.taxonomy, opts, *given)
        for staged, name in wanted.items():
            in_pairs = paired and staged.endswith("#")
            for folder, path in zip(split_names(staged, in_pairs), split_names(name, in_pairs)):
                join_parts(spark, folder, path)
        shutil.rmtree(stage)
    if a.report:
        counts = calls.where("call <> 0").groupBy(F.col("call").alias("taxon")).agg(F.count("*").alias("reads"))
        if a.use_mpa_style:
            report = reports.path_report(counts, index.taxonomy, a.report_zero_counts)
        else:
            kmers = reports.clade_distinct(calls, index.taxonomy) if a.report_minimizer_data else None
            report = reports.clade_report(counts, index.taxonomy, calls.where("call = 0").count(), zeros=a.report_zero_counts, kmers=kmers)
        _put((r.line for r in report.orderBy("line_no").toLocalIterator()), a.report)
    print(stats_text(run_stats(calls, reads).first(), time.time() - began), file=sys.stderr)
    calls.unpersist()
    reads.unpersist()


def _build(a) -> None:
    from phylospan.functions.sequence import sequence_ids
    from phylospan.operators.index import TaxIndex, build_index, estimate_capacity, limited, sequence_taxa
    from phylospan.operators.taxonomy import Taxonomy
    from phylospan.sources.binary import write_index_files
    from phylospan.sources.fastx import read_fastx
    from phylospan.sources.taxfiles import read_id_map, read_taxdump

    spark = _session()
    ids = read_id_map(spark, a.id_map)
    taxonomy = Taxonomy.from_nodes(read_taxdump(spark, a.nodes, a.names), ids.select(F.col("taxid").alias("ext_id")))
    seqs = read_fastx(spark, a.fasta).persist()
    head = F.concat_ws(" ", "header", "comment")
    taxa = sequence_taxa(seqs.select("seq_no", sequence_ids(head).alias("ids")), ids, taxonomy)
    options = IndexOptions(a.k, a.l, a.spaced_seed_mask, a.toggle_mask, not a.protein, a.min_hash)
    capacity = a.capacity
    if not capacity and (a.maximum_capacity or a.compact):
        capacity = max(a.maximum_capacity, estimate_capacity(seqs, options).first().capacity)
    options, capacity = limited(options, capacity, a.maximum_capacity)
    build_index(seqs.select("seq_no", "seq"), taxa, taxonomy, options).save(a.db)
    if a.compact:
        write_index_files(a.compact, TaxIndex.load(spark, a.db), capacity, a.taxid_bits)
    seqs.unpersist()


def describe(index) -> list[str]:
    """The comment lines before an index's counts."""
    o = index.options
    lines = [f"# Database options: {'nucleotide' if o.dna else 'protein'} db, k = {o.k}, l = {o.l}", f"# Spaced mask = {mask_string(o.spaced_seed_mask, o.l * o.bits)}", f"# Toggle mask = {mask_string(o.toggle_mask)}", f"# Total taxonomy nodes: {index.taxonomy.nodes.count() + 1}", f"# Table size: {index.index.count()}", f"# Min clear hash value = {o.min_hash}"]
    return lines + (["# Built with outdated revcom version"] if o.revcom_version != REVCOM_VERSION else [])


def _inspect(a) -> None:
    from phylospan.operators import reports
    from phylospan.operators.index import TaxIndex

    index = TaxIndex.load(_session(), a.db)
    _put(describe(index), None)
    if not a.skip_counts:
        counts = index.value_counts().withColumnRenamed("minimizers", "reads")
        report = reports.path_report(counts, index.taxonomy, a.report_zero_counts) if a.use_mpa_style else reports.clade_report(counts, index.taxonomy, 0, zeros=a.report_zero_counts)
        _put((r.line for r in report.orderBy("line_no").toLocalIterator()), None)


def _estimate(a) -> None:
    from phylospan.operators.index import estimate_capacity
    from phylospan.sources.fastx import read_fastx

    print(estimate_capacity(read_fastx(_session(), a.files), IndexOptions(a.k, a.l, dna=not a.protein), a.n).first().capacity)


def _lookup(a) -> None:
    from phylospan.functions.sequence import first_fields
    from phylospan.operators.lookup import lookup_accessions
    from phylospan.sources.taxfiles import read_accession_maps

    spark = _session()
    fields = first_fields(F.col("value"), "\t", 2)
    targets = spark.read.text(a.targets).where(F.size(fields) == 2).select(fields[0].alias("seqid"), fields[1].alias("accession"))
    found, missing = lookup_accessions(targets, read_accession_maps(spark, a.maps))
    _put((f"{r.seqid}\t{r.taxid}" for r in found.toLocalIterator()), None)
    _put((r.accession for r in missing.toLocalIterator()), a.unmapped)


def _records(df, width: int) -> None:
    from phylospan.functions.sequence import fasta_text

    text = fasta_text(F.col("header"), F.col("comment"), F.col("seq"), width)
    _put((r.t for r in df.orderBy("seq_no").select(text.alias("t")).toLocalIterator()), None)


def _mask(a) -> None:
    from phylospan.functions.dust import mask_low_complexity
    from phylospan.sources.fastx import read_fastx

    _records(mask_low_complexity(read_fastx(_session(), a.files), "seq", a.window, a.threshold, a.replace_with), a.width)


def _blast(a) -> None:
    from phylospan.sources.blastdb import read_blastdb

    _records(read_blastdb(_session(), a.prefixes, a.tag), a.width)


def _clean(a) -> None:
    from phylospan.sources.fastx import clean

    clean(a.folder)


def _serve(a) -> None:
    from phylospan.operators.index import TaxIndex
    from phylospan.streaming.session import RequestSession

    index = TaxIndex.load(_session(), a.db)
    opts = ClassifyOptions(a.confidence, a.minimum_hit_groups, a.quick, False, not index.options.dna, a.minimum_base_quality, a.use_names)
    RequestSession(index, a.log, a.out, a.checkpoint, opts).run()


def _minimizers(a) -> None:
    from phylospan.operators.minimizers import tokens

    m, ambiguous = tokens(a.sequence.encode(), IndexOptions(a.k, a.l))
    for v, flag, h in zip(m.tolist(), ambiguous.tolist(), fmix64(m).tolist()):
        print("ambiguous" if flag else f"{v:016x} {h:016x}")


COMMANDS = {"classify": _classify, "build": _build, "estimate": _estimate, "inspect": _inspect, "dump-table": _inspect, "lookup-accessions": _lookup, "mask": _mask, "blast-to-fasta": _blast, "clean": _clean, "serve": _serve, "minimizers": _minimizers}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](a)


if __name__ == "__main__":
    main()
