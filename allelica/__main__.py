"""Command line: ``python -m allelica profile|compare|parse_annotations|quick_profile|recluster|rarefaction_curve|run_statistics ...``."""

from __future__ import annotations

import argparse

from allelica import workflows


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="allelica", description="Strain-level metagenomics analytics on PySpark")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("profile", help="profile one sample")
    p.add_argument("alignment", help="BAM or SAM file")
    p.add_argument("fasta")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--sample", required=True)
    p.add_argument("-g", "--gene_file")
    p.add_argument("-s", "--stb", nargs="*", default=[], dest="stb_files")
    p.add_argument("--pairing_filter", default="paired_only", dest="pairing", choices=["paired_only", "non_discordant", "all_reads"])
    p.add_argument("--priority_reads", dest="priority")
    p.add_argument("--scaffolds_to_profile", dest="scaffolds")
    p.add_argument("--null_model")
    for name, kind, value in (
        ("min_read_ani", float, 0.95), ("min_mapq", int, -1), ("min_insert", int, 50), ("max_insert_relative", float, 3.0), ("min_scaffold_reads", int, 1), ("min_genome_coverage", float, 0.0),
        ("min_cov", int, 5), ("min_freq", float, 0.05), ("min_snp", int, 20), ("window_length", int, 10_000),
    ):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--rarefied_coverage", type=int, default=50, dest="rarefied")
    p.add_argument("--skip_mm_profiling", action="store_true", dest="skip_mm")
    p.add_argument("--fdr", type=float, default=1e-6)
    for flag, name in (("database_mode", "database_mode"), ("mm_level", "mm_level"), ("detailed_mapping_info", "detailed_mapping"), ("use_full_fasta_header", "full_header"), ("skip_genome_wide", "skip_genome_wide")):
        p.add_argument(f"--{flag}", action="store_true", dest=name)

    c = sub.add_parser("compare", help="compare profiled samples")
    c.add_argument("-i", "--input", nargs="+", required=True, dest="stores")
    c.add_argument("-o", "--out", required=True)
    c.add_argument("-s", "--stb", nargs="*", default=[], dest="stb_files")
    c.add_argument("--min_cov", type=int, default=5)
    c.add_argument("--min_freq", type=float, default=0.05)
    c.add_argument("-ani", "--ani_threshold", type=float, default=0.99999, dest="ani")
    c.add_argument("-cov", "--coverage_treshold", type=float, default=0.1, dest="least_compared")
    c.add_argument("--clusterAlg", default="average", dest="method", choices=["single", "complete", "average", "weighted", "centroid", "median", "ward"])
    c.add_argument("-sc", "--scaffolds")
    c.add_argument("--genome")
    c.add_argument("--breadth", type=float, default=0.5)
    for flag, name in (
        ("database_mode", "database_mode"), ("include_self_comparisons", "self_comparisons"), ("store_mismatch_locations", "mismatch_locations"), ("store_coverage_overlap", "coverage_overlap"), ("skip_popANI", "skip_pop_ani"), ("force_compress", "compress"),
    ):
        c.add_argument(f"--{flag}", action="store_true", dest=name)

    a = sub.add_parser("parse_annotations", help="annotation tables")
    a.add_argument("-i", "--input", nargs="+", required=True, dest="stores")
    a.add_argument("-a", "--annotations", nargs="+", required=True, dest="files")
    a.add_argument("-o", "--out", required=True)
    a.add_argument("-s", "--stb", nargs="*", default=[], dest="stb_files")
    a.add_argument("-b", "--min_genome_breadth", type=float, default=0.5)
    a.add_argument("-g", "--min_gene_breadth", type=float, default=0.8)

    q = sub.add_parser("quick_profile", help="which genomes are there")
    q.add_argument("alignment")
    q.add_argument("fasta")
    q.add_argument("-o", "--out", required=True)
    q.add_argument("-s", "--stb", nargs="*", default=[], dest="stb_files")
    q.add_argument("--breadth_cutoff", type=float, default=0.5, dest="breadth")

    r = sub.add_parser("recluster", help="cluster a genome comparison again")
    r.add_argument("table", help="genomeWide_compare table")
    r.add_argument("-o", "--out", required=True)
    r.add_argument("-ani", "--ani", type=float, default=99.0, help="in percent")
    r.add_argument("--clusterAlg", default="single", dest="method")

    f = sub.add_parser("rarefaction_curve", help="genome coverage of growing shares of the reads")
    f.add_argument("alignment")
    f.add_argument("fasta")
    f.add_argument("-o", "--out", required=True)
    f.add_argument("-s", "--stb", nargs="*", default=[], dest="stb_files")
    f.add_argument("--fractions", nargs="+", type=float, default=[k / 10 for k in range(1, 11)])

    t = sub.add_parser("run_statistics", help="reports of a log")
    t.add_argument("log")
    t.add_argument("-o", "--out", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    getattr(workflows, command)(SparkSession.builder.appName(f"allelica {command}").getOrCreate(), **args)


if __name__ == "__main__":
    main()
