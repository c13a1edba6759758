"""Queries over sources and sinks: files are written from the driver's tables, read again, and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.bases import BASES
from allelica.operators import annotations as an
from allelica.operators import nullmodel, pooling, quick, reads
from allelica.plans.lineage import cut, shared_folder
from allelica.plans.mm import collapse
from allelica.queries import (
    _QG, FRAGMENTS, NEEDS, K, annotation_map, called, comparison, cov, detected, differences, events, genome_comparison, genome_info, gene_counts, gene_cov, ld, long_annotations, pooled, query, report, scaffold_info, snv,
)
from allelica.sources import adapter as ad
from allelica.sources import alignments, store, text


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def written(lines: Column, df: DataFrame, name: str, sep: str = "\n") -> str:
    """Writes one text column as a folder of text files."""
    path = place(df.sparkSession, name)
    df.select(lines.cast("string").alias("value")).write.option("lineSep", sep).text(path)
    return path


def wrapped(sequence: str) -> Column:
    """A sequence in lines of 60."""
    return F.regexp_replace(sequence, "(.{60})", "$1\n")


# sources


@query("s3_fasta", "SELECT scaffold, length, sequence FROM seqs", "seqs")
def _s3(spark, sf):
    path = written(F.concat(F.lit(">"), "scaffold", F.lit(" 3->5 > exo\n"), wrapped("sequence")), ad.sequences(spark, sf), "ref.fa")
    return text.fasta(spark, path).select("scaffold", "length", "sequence")


@query("s4_fasta_case_kept", "SELECT scaffold || ' a b' AS scaffold, lower(sequence) AS sequence FROM seqs", "seqs")
def _s4(spark, sf):
    path = written(F.concat(F.lit(">"), "scaffold", F.lit(" a b\n"), F.lower(wrapped("sequence"))), ad.sequences(spark, sf), "ref.fa")
    return text.fasta(spark, path, full_header=True, upper=False).select("scaffold", "sequence")


_GENE = r"regexp_replace(gene, '_(\d+)_([ab])$', '_\1\2')"


@query("s5_prodigal_genes", f"""SELECT scaffold, {_GENE} AS gene, start, "end", direction, start % 80 = 0 AS partial, sequence FROM gens""", "gens")
def _s5(spark, sf):
    g = ad.genes(spark, sf).withColumn("gene", F.regexp_replace("gene", r"_(\d+)_([ab])$", "_$1$2"))
    attrs = F.when(F.col("start") % 80 == 0, F.lit("ID=1;partial=10;x=>")).otherwise(F.lit("ID=1;partial=00;x=>"))
    head = F.concat_ws(" # ", "gene", F.col("start") + 1, F.col("end") + 1, "direction", attrs)
    return text.genes(spark, written(F.concat(F.lit(">"), head, F.lit("\n"), wrapped("sequence")), g, "genes.fna"))


@query("s6_genbank_genes", """SELECT scaffold || '.1' AS scaffold, gene, start, "end", direction, partial, sequence FROM gens""", "gens")
def _s6(spark, sf):
    span = F.concat(F.col("start") + 1, F.lit(".."), F.col("end") + 1)
    where = F.when(F.col("direction") == -1, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    cds = F.concat(F.lit("     CDS             "), where, F.lit('\n                     /gene="'), "gene", F.lit('"\n'))
    g = ad.genes(spark, sf).groupBy("scaffold").agg(F.array_join(F.array_sort(F.collect_list(cds)), "").alias("cds"))
    d = ad.sequences(spark, sf).join(g, "scaffold")
    record = F.concat(F.lit("LOCUS       "), "scaffold", F.lit(" bp\nVERSION     "), "scaffold", F.lit(".1\nFEATURES             Location/Qualifiers\n"), "cds", F.lit("ORIGIN\n        1 "), F.lower("sequence"), F.lit("\n//"))
    return text.genbank_genes(spark, written(record, d, "x.gb"))


@query("s7_stb", "SELECT * FROM stb", "stb")
def _s7(spark, sf):
    return text.stb(spark, written(F.concat("scaffold", F.lit(" \t "), "genome", F.lit(" \n")), ad.stb(spark, sf), "m.stb"))


@query("s8_stb_of_fasta_files", "SELECT scaffold, count(*) OVER (PARTITION BY genome) AS scaffolds_of_file FROM stb JOIN lens USING (scaffold)", "stb lens")
def _s8(spark, sf):
    s = ad.sequences(spark, sf).join(ad.stb(spark, sf), "scaffold")
    line = F.concat(F.lit(">"), "scaffold", F.lit("\n"), "sequence")
    paths = [written(line, s.where(F.col("genome") == f"genome_{k}").coalesce(1), f"g{k}.fa") for k in range(3)]
    m = text.resolve_stb(spark, paths)
    return m.join(m.groupBy("genome").agg(F.count("*").alias("scaffolds_of_file")), "genome").select("scaffold", "scaffolds_of_file")


@query("s9_stb_of_nothing", "SELECT scaffold, 'all_scaffolds' AS genome FROM lens", "lens")
def _s9(spark, sf):
    return text.resolve_stb(spark, [], ad.lengths(spark, sf))


@query("s10_scaffold_list", "SELECT 'names' AS kind, scaffold FROM lens UNION ALL SELECT 'fasta', scaffold FROM lens", "lens")
def _s10(spark, sf):
    s = ad.sequences(spark, sf)
    names = text.scaffold_list(spark, written(F.concat(F.lit(" "), "scaffold"), s, "list.txt"))
    fasta = text.scaffold_list(spark, written(F.concat(F.lit(">"), "scaffold", F.lit(" x\n"), "sequence"), s, "list.fa"))
    return names.select(F.lit("names").alias("kind"), "scaffold").unionByName(fasta.select(F.lit("fasta").alias("kind"), "scaffold"))


@query("s11_priority_reads", "SELECT 'read_' || o_orderkey AS pair FROM orders WHERE o_orderkey % 7 = 0")
def _s11(spark, sf):
    o = ad.table(spark, sf, "orders").where("o_orderkey % 7 = 0")
    return text.priority_reads(spark, written(F.concat(F.lit("@read_"), "o_orderkey", F.lit(" 1:N\nACGT\n+\nIIII")), o, "reads.fq"))


_DEPTHS = [(d, *(10.0 ** -(k + d % 3) for k in range(1, 9))) for d in range(1, 60)]


@query("s12_null_model", "SELECT coverage, CASE WHEN coverage % 3 = 0 THEN 6 WHEN coverage % 3 = 1 THEN 5 ELSE 4 END AS min_bases FROM range(1, 60) t(coverage)")
def _s12(spark, sf):
    # probabilities of 1, 2, ... wrong bases fall tenfold, from 0.1, 0.01 or 0.001 on
    lines = [("coverage a b",), *((" ".join(repr(x) for x in row),) for row in _DEPTHS)]
    path = written(F.col("v"), spark.createDataFrame(lines, "v string").coalesce(1), "null.txt")
    model = nullmodel.from_table(text.null_model(spark, path))
    return spark.range(1, 60).select(F.col("id").alias("coverage"), nullmodel.min_bases("id", model).alias("min_bases"))


@query("s13_annotations", "SELECT gene, anno FROM anno", "anno")
def _s13(spark, sf):
    a = cut(annotation_map(spark, sf))
    path = written(F.concat_ws(",", "gene", "anno"), a.unionByName(a).unionByName(spark.createDataFrame([("gene", "anno"), ("one", "two,three")], "gene string, anno string")), "a.csv")
    return text.annotations(spark, [path])


@query("s14_long_annotations", "SELECT * FROM along", "along")
def _s14(spark, sf):
    path = place(spark, "LongFormData")
    store.write_table(long_annotations(spark, sf), path, sep=",")
    return text.long_annotations(spark, path)


@query("s16_output_table", "SELECT scaffold, position, position_coverage, ref_base, con_freq, cryptic FROM snv WHERE sample = 'sample_1' AND mm = 2", "snv", "con_freq")
def _s16(spark, sf):
    path = place(spark, "SNVs")
    store.write_table(snv(spark, sf).where("sample = 'sample_1' and mm = 2").drop("sample", "mm"), path, "SNVs", header="a:1 b:2")
    t = text.output_table(spark, path)
    return t.select("scaffold", F.col("position").cast("long").alias("position"), F.col("position_coverage").cast("long").alias("position_coverage"), "ref_base", "con_freq", "cryptic")


@query(
    "s17_logs",
    "SELECT event_id, 'Checkpoint' AS log_type, run_id, unit, status, strftime(time, '%y-%m-%d %H:%M:%S') AS time FROM evt",
    "evt",
)
def _s17(spark, sf):
    e = events(spark, sf)
    line = F.concat(F.date_format("time", "yy-MM-dd HH:mm:ss"), F.lit(" DEBUG Checkpoint event_id="), "event_id", F.lit(";run_id=old;run_id="), "run_id", F.lit(";unit="), "unit", F.lit(";status="), "status")
    d = text.logs(spark, written(F.concat(line, F.lit("\nnot a log line")), e, "log.log"))
    f = F.col("fields")
    return d.select(f["event_id"].cast("long").alias("event_id"), "log_type", f["run_id"].alias("run_id"), f["unit"].alias("unit"), f["status"].alias("status"), F.date_format("time", "yy-MM-dd HH:mm:ss").alias("time"))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with sequences, as a file would list them."""
    d = ad.reads(spark, sf).where("ref_start % 5 = 0")
    n = F.col("length").cast("int")
    letters = F.substring(F.repeat(F.lit("ACTGN"), 40), (F.col("ref_start") % 4 + 1).cast("int"), n)
    return d.select(
        "scaffold", F.concat(F.lit("r"), "read_name").alias("read_name"), F.col("nm").cast("int").alias("nm"), "mapq", F.col("length").cast("long").alias("length"), "ref_start", "ref_end", F.lit(0).alias("flag"),
        F.concat("length", F.lit("M")).alias("cigar"), letters.alias("sequence"), F.substring(F.repeat(F.lit("I+5"), 60), F.lit(1), n).alias("quality"), F.col("file_order.l_partkey").alias("file_order"),
    )


_READS = """SELECT scaffold, 'r' || read_name AS read_name, nm, mapq, length, ref_start, ref_end, length || 'M' AS cigar, substr(repeat('ACTGN', 40), 1 + CAST(ref_start % 4 AS INTEGER), CAST(length AS INTEGER)) AS sequence,
    substr(repeat('I+5', 60), 1, CAST(length AS INTEGER)) AS quality FROM rds WHERE ref_start % 5 = 0"""
_COLUMNS = ["scaffold", "read_name", "nm", "mapq", "length", "ref_start", "ref_end", "cigar", "sequence", "quality"]


def bam_file(spark: SparkSession, sf: str) -> str:
    path = place(spark, "x.bam")
    r = aligned(spark, sf)
    alignments.write_bam(r, r.groupBy("scaffold").agg((F.max("ref_end") + 1).alias("length")), path)
    return path


@query("s1_bam", _READS, "rds")
def _s1(spark, sf):
    return alignments.bam(spark, bam_file(spark, sf)).select(*_COLUMNS)


@query(
    "s2_pileup",
    f"""SELECT scaffold, position, count(*) AS depth, count(*) FILTER (WHERE base = 'A') AS A FROM
    (SELECT *, substr(sequence, 1 + CAST(i AS INTEGER), 1) AS base, substr(quality, 1 + CAST(i AS INTEGER), 1) AS q, ref_start + i AS position FROM ({_READS} AND length(CAST(read_name AS VARCHAR)) > 0
    QUALIFY count(*) OVER (PARTITION BY scaffold, read_name) = 1), range(200) t(i) WHERE i < length) WHERE q = 'I' AND base IN ('A', 'C', 'G', 'T') GROUP BY 1, 2""",
    "rds",
)
def _s2(spark, sf):
    r = aligned(spark, sf)
    # names that occur once on a scaffold: no mates overlap
    single = r.groupBy("scaffold", "read_name").agg(F.count("*").alias("k")).where("k = 1").select("scaffold", "read_name")
    p = alignments.pileup(r.join(single, ["scaffold", "read_name"]))
    return p.groupBy("scaffold", "position").agg(F.count("*").alias("depth"), F.count_if(F.col("base") == "A").alias("A"))


@query("s19_sam", _READS, "rds")
def _s19b(spark, sf):
    r = aligned(spark, sf)
    line = F.concat_ws("\t", "read_name", "flag", "scaffold", F.col("ref_start") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), "sequence", "quality", F.concat(F.lit("NM:i:"), "nm"))
    return text.sam(spark, written(line, r, "x.sam")).select(*_COLUMNS)


@query("s19_sorted_bam", f"SELECT scaffold, ref_start, count(*) AS reads FROM ({_READS}) GROUP BY 1, 2", "rds")
def _s19c(spark, sf):
    """Reads of a sorted BAM file that come after those before them: all of them."""
    from pyspark.sql.window import Window

    d = alignments.bam(spark, bam_file(spark, sf))
    before = Window.partitionBy("scaffold").orderBy("file_order")
    return d.withColumn("sorted", F.coalesce(F.lag("ref_start").over(before) <= F.col("ref_start"), F.lit(True))).where("sorted").groupBy("scaffold", "ref_start").agg(F.count("*").alias("reads"))


# the profile store


def stored(spark: SparkSession, sf: str) -> store.ProfileStore:
    """Coverage and SNVs of both samples."""
    s = store.ProfileStore(spark, place(spark, "store"))
    for name, df in (("covT", cov(spark, sf)), ("raw_snp_table", snv(spark, sf))):
        for sample in ("sample_0", "sample_1"):
            s.write(name, df.where(F.col("sample") == sample).drop("sample"), sample, f"{name} of a sample")
    return s


@query("s15_store_read", "SELECT sample, scaffold, position, mm, coverage FROM cov WHERE sample = 'sample_1' AND scaffold IN ('scaffold_2', 'scaffold_7')", "cov")
def _s15(spark, sf):
    return stored(spark, sf).read("covT", ["sample_1"], ["scaffold_2", "scaffold_7"])


@query("s18_store_scaffolds", "SELECT DISTINCT scaffold FROM cov", "cov")
def _s18(spark, sf):
    return stored(spark, sf).scaffolds("covT")


@query("k1_catalog", "SELECT * FROM (VALUES ('covT', 'covT of a sample'), ('raw_snp_table', 'raw_snp_table of a sample')) t(name, description)")
def _k1(spark, sf):
    return stored(spark, sf).catalog().select("name", "description")


@query("k4_nested_store", "SELECT sample, scaffold, count(*) AS rows_stored FROM cov GROUP BY 1, 2", "cov")
def _k4(spark, sf):
    return stored(spark, sf).read("covT").groupBy("sample", "scaffold").agg(F.count("*").alias("rows_stored"))


# tables that users read


def reread(df: DataFrame, name: str, table: str = "", sep: str = "\t", **options) -> DataFrame:
    """Writes a table as users get it and reads it with the types it had."""
    path = place(df.sparkSession, name)
    store.write_table(df, path, table, sep=sep, **options)
    back = df.sparkSession.read.csv(path, sep=sep, header=True, comment="#")
    types = dict(df.dtypes)
    return back.select(*[F.col(c).cast(types[c]).alias(c) for c in back.columns])


_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY mm DESC) = 1"
_INFO_D = "breadth coverage coverage_std coverage_SEM nucl_diversity nucl_diversity_median nucl_diversity_rarefied nucl_diversity_rarefied_median breadth_minCov breadth_rarefied breadth_expected conANI_reference popANI_reference"


@query("k2_scaffold_table", f"SELECT * EXCLUDE mm FROM info {_LAST.format('sample, scaffold')}", "info", _INFO_D)
def _k2a(spark, sf):
    return reread(collapse(scaffold_info(spark, sf), K).drop("mm"), "scaffold_info", "scaffold_info")


@query("k2_linkage_table", f"SELECT scaffold, position_A, position_B, distance, r2, d_prime, major_A AS \"allele_A\", minor_A AS \"allele_minor_A\", n1 AS \"count_major\", total FROM lld {_LAST.format('scaffold, split_number, position_A, position_B')}", "lld", "r2 d_prime")
def _k2b(spark, sf):
    from allelica.operators.linkage import nonredundant, published

    d = published(nonredundant(ld(spark, sf), ["scaffold", "split_number"]).drop("mm", "split_number"))
    with store.case_sensitive(spark):
        t = reread(d, "linkage", "linkage")
        # DuckDB's names don't tell upper from lower case
        return cut(t.select("scaffold", "position_A", "position_B", "distance", "r2", "d_prime", "allele_A", F.col("allele_a").alias("allele_minor_A"), F.col("countAB").alias("count_major"), "total"))


@query("k2_snv_table", f"SELECT * EXCLUDE (mm, cryptic) FROM snv WHERE NOT cryptic {_LAST.format('sample, scaffold, position')}", "snv", "ref_freq con_freq var_freq")
def _k2c(spark, sf):
    return reread(called(spark, sf).drop("mm", "cryptic"), "SNVs", "SNVs", compress=True)


_MEANS = "mean_mistmaches mean_insert_distance mean_mapq_score mean_pair_length mean_PID median_insert"


@query("k3_mapping_info", "SELECT * FROM rep", "rep", _MEANS)
def _k3(spark, sf):
    return reread(report(spark, sf).where("scaffold <> 'all_scaffolds'"), "mapping_info", header="min_read_ani:0.95 min_mapq:-1")


@query("k5_pool_keys", "SELECT 'sample' AS kind, sample AS name, dense_rank() OVER (ORDER BY sample) - 1 AS key FROM (SELECT DISTINCT sample FROM pool) UNION ALL SELECT 'scaffold', scaffold, dense_rank() OVER (ORDER BY scaffold) - 1 FROM (SELECT DISTINCT scaffold FROM pool)", "pool")
def _k5(spark, sf):
    return reread(pooling.encoded(pooled(spark, sf))[1], "pooled_SNV_data_keys")


@query("k6_comparison_table", f"SELECT * EXCLUDE mm FROM cmp {_LAST.format('scaffold, name1, name2')}", "cmp", "coverage_overlap percent_genome_compared conANI popANI")
def _k6a(spark, sf):
    return reread(collapse(comparison(spark, sf), ["scaffold", "name1", "name2"]).drop("mm"), "comparisonsTable")


@query("k6_genome_table", "SELECT * FROM gcmp", "gcmp", "coverage_overlap popANI conANI percent_compared")
def _k6b(spark, sf):
    return reread(genome_comparison(spark, sf), "genomeWide_compare")


@query(
    "k6_snp_locations",
    f"""SELECT d.scaffold, d.position, name1, name2, con_base_1, con_base_2, consensus_SNP, population_SNP, p.ref_base AS ref_base_1, q.ref_base AS ref_base_2, p.A + p.C + p.T + p.G AS position_coverage_1, q.A + q.C + q.T + q.G AS position_coverage_2
    FROM (SELECT * FROM dif {_LAST.format('scaffold, position, name1, name2')}) d LEFT JOIN last p ON p.sample = name1 AND p.scaffold = d.scaffold AND p.position = d.position LEFT JOIN last q ON q.sample = name2 AND q.scaffold = d.scaffold AND q.position = d.position""",
    "dif",
)
def _k6c(spark, sf):
    t = reread(collapse(differences(spark, sf), ["scaffold", "position", "name1", "name2"]).drop("mm"), "pairwise_SNP_locations", "pairwise_SNP_locations")
    return t.select("scaffold", "position", "name1", "name2", "con_base_1", "con_base_2", "consensus_SNP", "population_SNP", "ref_base_1", "ref_base_2", "position_coverage_1", "position_coverage_2")


@query("k7_annotation_table", "SELECT sample, anno, genome, genes, bases FROM along", "along")
def _k7(spark, sf):
    return reread(long_annotations(spark, sf), "LongFormData", sep=",")


@query("k8_quick_table", _QG, "ctg stb", "breadth coverage")
def _k8(spark, sf):
    r, lens = ad.reads(spark, sf), ad.lengths(spark, sf)
    return reread(quick.genome_coverage(quick.contig_coverage(r, lens), lens, ad.stb(spark, sf)), "genomeCoverage", sep=",")
