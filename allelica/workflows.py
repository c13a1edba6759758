"""Whole workflows: from files to a profile store and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.operators import annotations as an
from allelica.operators import cluster, genes, genomes, irep, linkage, logs, pileup, pooling, quick, reads, variants
from allelica.operators import compare as cmp
from allelica.operators.nullmodel import FDR, from_table, steps
from allelica.plans.lineage import cut
from allelica.plans.mm import collapse
from allelica.sources import alignments, text
from allelica.sources.store import ProfileStore, write_table

K = ["scaffold"]
KR = ["scaffold", "ref_base"]


def open_reads(spark: SparkSession, path: str) -> DataFrame:
    return alignments.bam(spark, path) if path.endswith(".bam") else text.sam(spark, path)


def profile(
    spark: SparkSession,
    alignment: str,
    fasta: str,
    out: str,
    sample: str,
    gene_file: str | None = None,
    stb_files: list[str] = (),
    pairing: str = "paired_only",
    priority: str | None = None,
    min_read_ani: float = 0.95,
    min_mapq: int = -1,
    min_insert: int = 50,
    max_insert_relative: float = 3.0,
    min_scaffold_reads: int = 1,
    min_genome_coverage: float = 0.0,
    min_cov: int = 5,
    min_freq: float = 0.05,
    min_snp: int = 20,
    rarefied: int = 50,
    window_length: int = 10_000,
    skip_mm: bool = False,
    database_mode: bool = False,
    null_model: str | None = None,
    scaffolds: str | None = None,
    fdr: float = FDR,
    mm_level: bool = False,
    detailed_mapping: bool = False,
    full_header: bool = False,
    skip_genome_wide: bool = False,
) -> ProfileStore:
    """Profiles one sample: attributes go to ``out`` and the tables that users read to ``out/output``.

    With ``mm_level`` these tables have a row for each mismatch level, else the last one's.
    """
    if database_mode:
        min_read_ani, skip_mm, min_genome_coverage = reads.DATABASE_MODE["min_read_ani"], True, reads.DATABASE_MODE["min_genome_coverage"]
    store = ProfileStore(spark, out)
    model = from_table(text.null_model(spark, null_model), fdr) if null_model else None if fdr == FDR else steps(fdr)
    ref = text.fasta(spark, fasta, full_header).select("scaffold", "length", "sequence")
    if scaffolds:
        ref = ref.join(text.scaffold_list(spark, scaffolds).distinct(), "scaffold", "left_semi")
    lengths = ref.select("scaffold", "length")
    stb = text.resolve_stb(spark, list(stb_files), lengths)

    aligned = cut(open_reads(spark, alignment))
    first = text.priority_reads(spark, priority) if priority else None
    pairs = reads.pair_reads(aligned)
    judged = cut(reads.evaluate(reads.pairing_filter(pairs, pairing, first), min_read_ani, min_mapq, min_insert, max_insert_relative))
    report = cut(reads.read_report(pairs, judged, first))
    wanted = reads.filter_scaffolds(lengths, report, min_scaffold_reads).select("scaffold", "length")
    if min_genome_coverage > 0:
        wanted = wanted.join(reads.genome_coverage_prefilter(report, lengths, stb, min_genome_coverage).select("scaffold"), "scaffold", "left_semi")
    lengths = cut(wanted)

    bases = alignments.pileup(aligned.join(lengths.select("scaffold"), "scaffold", "left_semi"))
    obs = cut(pileup.keep_pairs(bases.withColumn("mm", F.lit(0)), reads.kept_pairs(judged, skip_mm)))
    plain = cut(pileup.site_counts(obs, K))  # four tables start from it
    counts = pileup.with_reference(plain, ref)
    snv = cut(variants.snvs(variants.evaluate_sites(pileup.cumulative(counts, KR), min_cov, min_freq, model), KR))
    cov = pileup.coverage(plain, K)
    clon = pileup.clonality(pileup.cumulative(plain, K), K, min_cov, rarefied)
    info = cut(pileup.scaffold_info(plain, snv, lengths, K, min_cov, rarefied))
    lk = ["scaffold", "split_number"]
    split = lambda d: d.join(lengths, "scaffold").withColumn("split_number", pileup.split_of(F.col("position"), F.col("length"), window_length)).drop("length")
    linked = linkage.linked_observations(split(obs), linkage.polymorphic(split(snv), lk), lk)
    ld = linkage.linkage(linkage.co_occurrence(linked, lk), split(plain), lk, min_snp)
    ld = cut(linkage.rarefied(ld, min_snp))

    for name, df, what in (
        ("read_report", report, "reads of each scaffold through the filters"), ("counts", counts, "base counts at each position and level"), ("covT", cov, "depth at each level"),
        ("clonT", clon, "clonality at each level"), ("raw_snp_table", snv, "called sites at each level"), ("scaffold_info", info, "scaffolds at each level"), ("linkage", ld, "linkage at each level"), ("lengths", lengths, "scaffold lengths"),
    ):
        store.write(name, df, sample, what)
    last = (lambda d, keys: d) if mm_level else (lambda d, keys: collapse(d, keys).drop("mm"))
    write_table(report, f"{out}/output/mapping_info", "mapping_info", header=f" min_read_ani:{min_read_ani} min_mapq:{min_mapq} min_insert:{min_insert} max_insert_relative:{max_insert_relative} pairing_filter:{pairing}")
    if detailed_mapping:
        write_table(reads.detailed_mapping(judged), f"{out}/output/detailed_mapping_info")
    write_table(last(info, K), f"{out}/output/scaffold_info", "scaffold_info")
    write_table(linkage.published(last(ld, [*lk, "position_A", "position_B"]).drop("split_number")), f"{out}/output/linkage", "linkage")
    calls = snv.where("not cryptic") if mm_level else variants.nonredundant(snv, K).drop("mm")
    if gene_file:
        profile_genes(spark, store, sample, gene_file, out)
        calls = calls.join(store.read("SNP_mutation_types", [sample]).select("scaffold", "position", "gene", "mutation_type", "mutation"), ["scaffold", "position"], "left")
    write_table(calls, f"{out}/output/SNVs", "SNVs")
    if not skip_genome_wide:
        genome_wide(spark, store, sample, stb, out, ref.select("scaffold", "sequence"), mm_level)
    return store


def profile_genes(spark: SparkSession, store: ProfileStore, sample: str, gene_file: str, out: str) -> DataFrame:
    """Gene tables of a stored profile."""
    mine = lambda n: store.read(n, [sample]).drop("sample")
    g = cut(text.genes(spark, gene_file))
    snv = mine("raw_snp_table")
    types = cut(genes.mutations(snv, g, K))
    cov, clon = genes.gene_coverage(mine("covT"), g, K), genes.gene_clonality(mine("clonT"), g, K)
    info = cut(genes.gene_info(g, cov, clon, genes.gene_snp_counts(snv, types, g, K), K).join(g.select("gene", "start", "end", "direction", "partial"), "gene"))
    for name, df, what in (("SNP_mutation_types", types, "what each SNV does"), ("gene_info", info, "genes at the last level"), ("genes_table", g, "genes")):
        store.write(name, df, sample, what)
    write_table(info, f"{out}/output/gene_info", "gene_info")
    return info


def genome_wide(spark: SparkSession, store: ProfileStore, sample: str, stb: DataFrame, out: str, sequences: DataFrame | None = None, mm_level: bool = False) -> DataFrame:
    """Genome tables of a stored profile. iRep is that of pairs with at most one mismatch, and stands at each level."""
    mine = lambda n: store.read(n, [sample]).drop("sample")
    lengths, cov = mine("lengths"), mine("covT")
    info = genomes.genome_scaffold_info(mine("scaffold_info"), stb, lengths, [])
    stats = genomes.masked_stats(cov, stb, lengths, [])
    rollup = genomes.read_rollup(mine("read_report"), stb).withColumnRenamed("reads_filtered_pairs", "filtered_read_pair_count")
    g = genomes.genome_info(info, stats, rollup, genomes.linkage_rollup(mine("linkage").drop("split_number"), stb, []))
    places = cut(genomes.placed(lengths, stb))
    depths = genomes.genome_depths(cov.where("mm <= 1"), places, []).groupBy("genome", "position").agg(F.sum("coverage").alias("coverage"))
    gc = irep.sliding_gc(sequences, places, ["genome"], edge=genomes.EDGE) if sequences is not None else None
    rep = irep.irep(depths, genomes.inner_lengths(places), ["genome"], stb.join(lengths, "scaffold").groupBy("genome").agg(F.count("*").alias("scaffolds")), gc)
    g = cut(g.join(rep.select("genome", "iRep", "iRep_GC_corrected"), "genome", "left"))
    store.write("genome_info", g, sample, "genomes at each level")
    table = g if mm_level else collapse(g, ["genome"]).drop("mm")
    kept = ("reads_unfiltered_reads", "reads_unfiltered_pairs", "reads_mean_PID")
    write_table(table.drop(*[c for c in table.columns if c.startswith("reads_") and c not in kept]), f"{out}/output/genome_info", "genome_info")
    return g


def compare(
    spark: SparkSession,
    stores: list[str],
    out: str,
    stb_files: list[str] = (),
    min_cov: int = 5,
    min_freq: float = 0.05,
    ani: float = 0.99999,
    method: str = "average",
    least_compared: float = 0.1,
    pool: bool = True,
    database_mode: bool = False,
    breadth: float = 0.5,
    scaffolds: str | None = None,
    genome: str | None = None,
    self_comparisons: bool = False,
    mismatch_locations: bool = False,
    coverage_overlap: bool = False,
    skip_pop_ani: bool = False,
    compress: bool = False,
) -> dict[str, DataFrame]:
    """Compares samples of one or several stores: scaffolds, genomes, strain clusters, and pooled SNVs.

    ``scaffolds`` (a list or FASTA file) and ``genome`` restrict what is compared;
    in ``database_mode`` each sample has the scaffolds of the genomes of which it covers ``breadth``.
    """

    def read(name: str) -> DataFrame:
        parts = [ProfileStore(spark, s).read(name) for s in stores]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    cov, snv, counts = read("covT"), cut(read("raw_snp_table")), read("counts")
    lengths = read("lengths").groupBy("scaffold").agg(F.max("length").alias("length"))
    stb = text.resolve_stb(spark, list(stb_files), lengths)
    only = text.scaffold_list(spark, scaffolds) if scaffolds else None
    if genome is not None:
        of = stb.where(F.col("genome") == genome).select("scaffold")
        only = of if only is None else only.join(of, "scaffold", "left_semi")
    if only is not None:
        cov = cov.join(only.distinct(), "scaffold", "left_semi")
    if database_mode:
        cov = cov.join(cmp.database_mode(read("genome_info"), stb, breadth), ["sample", "scaffold"], "left_semi")
    cov = cut(cov)
    tables: dict[str, DataFrame] = {}
    if not skip_pop_ani:
        held = cov if self_comparisons else cov.join(cmp.shared_scaffolds(cov), "scaffold", "left_semi")
        sites = cut(cmp.overlap_sites(cov, cmp.snp_table(snv), min_cov))
        levels = cut(cmp.pair_levels(cov, cmp.sample_pairs(held, self_comparisons=self_comparisons)))
        overlap = cut(cmp.coverage_overlap(sites, levels, min_freq))
        table = cut(cmp.scaffold_comparison(overlap, lengths))
        whole = cut(cmp.genome_comparison(table, stb, genomes.genome_lengths(lengths, stb)))
        others = whole.where("name1 <> name2")
        tables |= {"comparisonsTable": collapse(table, ["scaffold", "name1", "name2"]).drop("mm"), "genomeWide_compare": whole, "strain_clusters": cluster.strain_clusters(others, ani, method, least_compared)}
        if mismatch_locations:
            tables["pairwise_SNP_locations"] = collapse(cmp.snp_differences(sites, levels, min_freq), ["scaffold", "position", "name1", "name2"]).drop("mm")
        if coverage_overlap:
            tables["coverage_overlap"] = overlap.drop("consensus_SNPs", "population_SNPs")
    if pool:
        mine = snv if only is None else snv.join(only.distinct(), "scaffold", "left_semi")
        called = cut(pooling.called_positions(mine))
        data = cut(pooling.pooled_data(called, counts))
        encoded, keys = pooling.encoded(data)
        encoded = encoded.withColumnsRenamed({"sample_key": "sample", "scaffold_key": "scaffold"})
        wide = keys.groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in ("sample", "scaffold")])
        tables |= {"pooled_SNV_info": pooling.pooled_info(called, data), "pooled_SNV_data": encoded, "pooled_SNV_data_keys": wide}
    for name, df in tables.items():
        write_table(df, f"{out}/output/{name}", name, compress=compress)
    return tables


def recluster(spark: SparkSession, table: str, out: str, ani: float = 99.0, method: str = "single") -> DataFrame:
    """Clusters a written ``genomeWide_compare`` table again."""
    d = text.output_table(spark, table)
    got = cluster.recluster(d, ani, method)
    write_table(got, f"{out}/output/strain_clusters")
    return got


def rarefaction_curve(spark: SparkSession, alignment: str, fasta: str, out: str, stb_files: list[str] = (), fractions: list[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Genome coverage of growing shares of the reads."""
    lengths = cut(text.fasta(spark, fasta).select("scaffold", "length"))
    stb = text.resolve_stb(spark, list(stb_files), lengths)
    got = quick.rarefaction(open_reads(spark, alignment), lengths, stb, list(fractions))
    write_table(got, f"{out}/output/rarefaction", sep=",")
    return got


def run_statistics(spark: SparkSession, log: str, out: str) -> dict[str, DataFrame]:
    """Reports of the latest run of a log: the whole run, checkpoints, parallel steps, genes, plots and failures."""
    lines = text.logs(spark, log)
    f = F.col("fields")
    e = lines.select(
        "time", F.col("line").alias("event_id"), "fields", "log_type", f["status"].alias("status"), F.coalesce(f["unit"], f["scaffold"], f["name"]).alias("unit"), f["PID"].alias("pid"),
        F.coalesce(f["process_RAM"], f["RAM"]).cast("double").alias("ram"), F.coalesce(f["command"], f["what"]).alias("command"), F.coalesce(f["class"], F.lit("")).alias("class"), f["plot"].alias("plot"), F.coalesce(f["run_id"], F.lit("0")).alias("run_id"),
    )
    e = cut(logs.latest_run(e))
    workers = logs.parallel_units(e.where("log_type = 'WorkerLog'"), ["command", "unit"])
    groups = logs.parallel_units(e.where("log_type = 'GroupLog'"), ["command", "unit"])
    genes_ = logs.parallel_units(e.where("log_type = 'Special_genes'"), ["command", "unit"]).withColumn("run_id", F.lit("0"))
    tables = {
        "overall": logs.overall(e), "checkpoints": logs.checkpoints(e.where("log_type = 'checkpoint'"), ["class"]), "parallel_steps": logs.multiprocessing(workers, ["command"]), "processes": logs.process_efficiency(workers, ["command"]),
        "groups": logs.multiprocessing(groups, ["command"]), "gene_steps": logs.step_shares(genes_, ["run_id"]), "plots": logs.plots(e.where("log_type = 'Plotting'"), ["run_id"]), "failures": e.where("log_type = 'Failure'").groupBy("unit").agg(F.count("*").alias("failures")),
    }
    for name, df in tables.items():
        write_table(df, f"{out}/output/{name}")
    return tables


def parse_annotations(spark: SparkSession, stores: list[str], files: list[str], out: str, stb_files: list[str] = (), min_gene_breadth: float = 0.8, min_genome_breadth: float = 0.5) -> dict[str, DataFrame]:
    """Annotation tables of the samples' genes."""
    info = whole = None
    for s in stores:
        p = ProfileStore(spark, s)
        g, w = p.read("gene_info"), p.read("genome_info").select("sample", "genome", "mm", "breadth")
        info, whole = (g, w) if info is None else (info.unionByName(g), whole.unionByName(w))
    stb = text.resolve_stb(spark, list(stb_files), info.select("scaffold").distinct())
    found = cut(an.detected_genes(info.join(stb, "scaffold"), collapse(whole, ["sample", "genome"]), min_gene_breadth, min_genome_breadth))
    names = text.annotations(spark, files)
    long, totals = cut(an.long_table(found, names)), an.sample_totals(found, names)
    tables = {"LongFormData": long, "SampleAnnotationTotals": totals, "fractions": an.fraction_table(long, totals)}
    tables |= {f"ParsedGeneAnno_{v}": an.wide_table(long, v, totals) for v in ("genes", "bases", "genomes")}
    for name, df in tables.items():
        write_table(df, f"{out}/output/{name}", sep=",")
    return tables


def quick_profile(spark: SparkSession, alignment: str, fasta: str, out: str, stb_files: list[str] = (), breadth: float = 0.5) -> dict[str, DataFrame]:
    """Which genomes are there: coverage of each, and the scaffolds of those present."""
    lengths = text.fasta(spark, fasta).select("scaffold", "length")
    stb = text.resolve_stb(spark, list(stb_files), lengths)
    g = cut(quick.genome_coverage(quick.contig_coverage(open_reads(spark, alignment), lengths), lengths, stb))
    tables = {"genomeCoverage": g, "scaffolds": quick.present_scaffolds(g, stb, breadth)}
    for name, df in tables.items():
        write_table(df, f"{out}/output/{name}", sep=",")
    return tables
