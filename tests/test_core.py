import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from allelica.functions.codons import CODE, SYNONYMOUS, codons
from allelica.operators import cluster, compare, genes, irep, linkage, logs, nullmodel, pileup, quick, reads, variants
from allelica.plans.mm import ani_to_mm, carry_forward, collapse
from allelica.sources import alignments, store, text
from allelica.streaming.counts import running_site_counts

K = ["scaffold"]


def test_null_model_values():
    at = lambda n: [k for d, k in nullmodel.steps() if d <= n][-1]
    assert {n: at(n) for n in (5, 20, 50, 100, 500, 1000, 9999)} == {5: 2, 20: 2, 50: 3, 100: 3, 500: 5, 1000: 6, 9999: 16}
    assert nullmodel.from_table([(5, [0.5, 1e-9]), (9, [0.5, 0.1, 1e-9])]) == ((5, 1), (9, 2))
    assert abs(nullmodel.tail(10, 0.3, 3) - sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3, 11))) < 1e-12


def test_levels(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 3, 2), ("b", 1, 5)], "scaffold string, mm int, v int")
    assert {(r.scaffold, r.v) for r in collapse(df, K).collect()} == {("a", 2), ("b", 5)}
    assert {(r.scaffold, r.v) for r in collapse(df, K, 2).collect()} == {("a", 1), ("b", 5)}
    levels = spark.createDataFrame([("a", m) for m in range(5)] + [("b", 0), ("b", 4)], "scaffold string, mm int")
    got = {(r.scaffold, r.mm, r.v) for r in carry_forward(df, K, levels, K).collect()}
    assert got == {("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 2), ("b", 4, 5)}
    assert ani_to_mm(0.95, 100) == 5 and ani_to_mm(95, 100) == 5 and ani_to_mm(0.975, 100) == 2


def test_read_pairs(spark):
    rows = [("s", "p", 1, 10, 100, 0, 99, 1), ("s", "p", 2, 40, 100, 200, 299, 2), ("s", "q", 0, 5, 90, 50, 139, 3), ("s", "r", 0, 5, 100, 200, 299, 4), ("s", "r", 0, 5, 100, 0, 99, 5), ("t", "q", 3, 7, 90, 1, 90, 6)]
    df = spark.createDataFrame(rows, "scaffold string, read_name string, nm int, mapq int, length int, ref_start long, ref_end long, file_order long")
    p = reads.pair_reads(df)
    got = {(r.scaffold, r.pair): (r.nm, r.insert_distance, r.mapq, r.length, r.reads, r.start, r.stop) for r in p.collect()}
    assert got[("s", "p")] == (3, 299, 40, 200, 2, 0, 0)
    assert got[("s", "r")] == (0, 299, 5, 200, 2, 0, 0)  # turned round
    assert got[("s", "q")] == (0, -1, 5, 90, 1, 50, 139)
    merged = {(r.scaffold, r.pair): r for r in reads.pairing_filter(p, "all_reads").collect()}
    assert (merged[("s", "q")].mapq, merged[("s", "q")].insert_distance, merged[("s", "q")].reads) == (12, -2, 2)
    names = {r.pair for r in reads.pairing_filter(p, "non_discordant").collect()}
    assert names == {"p", "r"}
    priority = spark.createDataFrame([("q",)], "pair string")
    assert reads.pairing_filter(p, "paired_only", priority).count() == 4
    # a merged pair of two reads fails the least insert
    e = {(r.scaffold, r.pair): r.kept for r in reads.evaluate(reads.pairing_filter(p, "all_reads")).collect()}
    assert e[("s", "q")] is False and e[("s", "p")] is True


def test_variant_calls(spark):
    rows = [("s", 0, "A", 0, 20, 0, 0, 0), ("s", 1, "A", 0, 0, 20, 0, 0), ("s", 2, "A", 0, 14, 6, 0, 0), ("s", 3, "A", 0, 6, 14, 0, 0), ("s", 4, "A", 0, 0, 14, 6, 0), ("s", 5, "N", 0, 0, 20, 0, 0), ("s", 6, "A", 0, 2, 2, 0, 0), ("s", 7, "A", 0, 1, 1, 2, 1)]
    sites = spark.createDataFrame(rows, "scaffold string, position long, ref_base string, mm int, A long, C long, T long, G long")
    got = {r.position: (r["class"], r.con_base, r.var_base, r.allele_count) for r in variants.snvs(variants.evaluate_sites(sites), ["scaffold", "ref_base"]).collect()}
    assert got[1] == ("SNS", "C", "A", 1) and got[2] == ("SNV", "A", "C", 2) and got[3] == ("con_SNV", "C", "A", 2) and got[4] == ("pop_SNV", "C", "T", 2)
    assert got[5][0] == "AmbiguousReference" and 0 not in got and 6 not in got and got[7][0] == "SNS"


def test_cryptic(spark):
    rows = [("s", 0, "A", 0, 6, 4, 0, 0), ("s", 0, "A", 1, 400, 4, 0, 0), ("s", 1, "A", 0, 6, 4, 0, 0), ("s", 1, "A", 1, 8, 6, 0, 0)]
    sites = spark.createDataFrame(rows, "scaffold string, position long, ref_base string, mm int, A long, C long, T long, G long")
    got = {(r.position, r.mm): r.cryptic for r in variants.snvs(variants.evaluate_sites(sites), ["scaffold", "ref_base"]).collect()}
    assert got == {(0, 0): True, (1, 0): False, (1, 1): False}


@pytest.mark.parametrize(
    "one, two, con, pop",
    [
        (("A", "C", 2, (10, 10, 0, 0)), ("C", "A", 2, (10, 10, 0, 0)), True, False),
        (("A", "A", 1, (20, 0, 0, 0)), ("C", "A", 1, (0, 20, 0, 0)), True, True),
        (("A", "T", 2, (14, 0, 6, 0)), ("C", "T", 2, (0, 14, 6, 0)), True, False),
        (("A", "T", 2, (14, 0, 6, 0)), ("C", "G", 2, (0, 14, 0, 6)), True, True),
        (("A", "A", 1, (20, 0, 0, 0)), ("A", "C", 2, (14, 6, 0, 0)), False, False),
        (("C", "A", 1, (0, 20, 0, 0)), None, True, True),
        (("C", "G", 2, (0, 14, 0, 6)), None, True, False),
        (None, ("G", "T", 2, (0, 0, 6, 14)), False, False),
    ],
)
def test_consensus_and_population(spark, one, two, con, pop):
    row = {}
    for k, x in ((1, one), (2, two)):
        c, v, a, n = x or (None, None, None, (None,) * 4)
        row |= {f"con_base_{k}": c, f"var_base_{k}": v, f"allele_count_{k}": a, f"ref_base_{k}": "G" if x else None} | {f"{b}_{k}": m for b, m in zip("ACTG", n)}
    kinds = ", ".join(f"{c} {'long' if c[0] in 'ACTG' and c[1] == '_' else 'int' if 'count' in c else 'string'}" for c in row)
    r = compare.with_needs(spark.createDataFrame([tuple(row.values())], kinds)).select(compare.consensus_snp().alias("con"), compare.population_snp().alias("pop")).first()
    assert (r.con, r.pop) == (con, pop)


def test_linkage_formula(spark):
    rows = [(10, 0, 0, 15), (10, 5, 5, 10), (20, 5, 0, 0), (3, 9, 9, 4)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    r2, dp = linkage.disequilibrium(*[F.col(x) for x in "abcd"])
    got = [tuple(r) for r in df.select(r2, dp).collect()]
    assert got[0] == pytest.approx((1.0, 1.0)) and got[2] == (None, None)
    p, q = 15 / 30, 15 / 30
    d = 10 / 30 - p * q
    assert got[1] == pytest.approx((d * d / (p * (1 - p) * q * (1 - q)), d / min(p * (1 - q), (1 - p) * q)))
    assert got[3][1] > 0  # negative D over a negative bound


def test_codons(spark):
    assert len(CODE) == 64 and len(SYNONYMOUS) == 61 and SYNONYMOUS["CTA"] == pytest.approx(4 / 3) and SYNONYMOUS["ATG"] == 0
    r = spark.createDataFrame([("ATGCTAA",), ("AT",), ("",)], "s string").select(codons(F.col("s")).alias("c")).collect()
    assert [x.c for x in r] == [["ATG", "CTA"], [], []]


def test_mutations(spark):
    g = spark.createDataFrame([("s", "g1", 0, 5, 1, False, "ATGCTA"), ("s", "g2", 4, 9, -1, False, "TTTTAG")], "scaffold string, gene string, start long, end long, direction int, partial boolean, sequence string")
    # position 2 of g1: ATG -> ATA is I; position 8 lies in g2 only, its second base (T) counted from the end
    rows = [("s", 2, 0, "G", "A", "G", 2, "SNV", False), ("s", 4, 0, "T", "A", "T", 2, "SNV", False), ("s", 8, 0, "A", "A", "C", 2, "SNV", False), ("s", 30, 0, "A", "C", "A", 1, "SNS", False)]
    snv = spark.createDataFrame(rows, "scaffold string, position long, mm int, ref_base string, con_base string, var_base string, allele_count int, class string, cryptic boolean")
    got = {r.position: (r.mutation_type, r.mutation, r.gene) for r in genes.mutations(snv, g, K).collect()}
    assert got[2] == ("N", "N:M2I", "g1") and got[4] == ("M", None, "g1,g2") and got[30][0] == "I"
    assert got[8] == ("N", "N:F4C", "g2")


def test_irep_known_answer(spark):
    d = spark.range(150_000).select(F.lit("g").alias("genome"), F.col("id").alias("position"), (F.expr("id div 50000") + 5).alias("coverage"))
    d = d.unionByName(d.where("position < 100").withColumn("coverage", F.lit(0)))
    r = irep.irep(d, spark.createDataFrame([("g", 150_000)], "genome string, length long"), ["genome"]).first()
    assert abs(r.raw_iRep - 1.62) <= 0.011 and r.r2 == pytest.approx(0.9004, abs=1e-3) and r.iRep == r.raw_iRep


def test_scaffold_info_zeros(spark):
    sites = spark.createDataFrame([("s", 0, 0, 5, 0, 0, 0), ("s", 1, 0, 3, 0, 0, 0), ("s", 1, 2, 0, 7, 0, 0)], "scaffold string, position long, mm int, A long, C long, T long, G long")
    snv = variants.snvs(variants.evaluate_sites(pileup.cumulative(sites.withColumn("ref_base", F.lit("A")), K + ["ref_base"])), K + ["ref_base"])
    lens = spark.createDataFrame([("s", 4)], "scaffold string, length long")
    got = {r.mm: r for r in pileup.scaffold_info(sites, snv, lens, K).collect()}
    assert got[0].coverage == 2.0 and got[0].coverage_median == 1 and got[0].breadth == 0.5
    assert got[2].coverage == 3.75 and got[2].coverage_median == 2 and got[2].SNV_count == 1 and got[2].breadth_minCov == 0.5
    vals = [5, 10, 0, 0]
    m = sum(vals) / 4
    assert got[2].coverage_std == pytest.approx(math.sqrt(sum((v - m) ** 2 for v in vals) / 4))
    assert got[2].coverage_SEM == pytest.approx(math.sqrt(sum((v - m) ** 2 for v in vals) / 3) / 2)


def test_clustering():
    import numpy as np

    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    for m in cluster.METHODS:
        assert cluster.flat_clusters(cluster.linkage(d, m), 4, 3.0).tolist() == [1, 1, 2, 2]
    assert [h for _, _, h, _ in cluster.linkage(d, "average")] == [1, 2, 9]
    assert cluster.flat_clusters([], 1, 1.0).tolist() == [1]


def test_recluster(spark):
    rows = [("g", a, b, 1.0 - d) for a, b, d in (("a", "b", 0.0), ("a", "c", 6.5e-5), ("b", "c", 6.5e-5), ("a", "d", 0.02), ("b", "d", 0.02), ("c", "d", 0.02))]
    df = spark.createDataFrame(rows, "genome string, name1 string, name2 string, popANI double")
    n = lambda ani: len({r.cluster for r in cluster.recluster(df, ani).collect()})
    assert n(99.0) == 2 and n(99.995) == 3


def test_range_join_bins(spark):
    sites = spark.range(3000).select(F.lit("s").alias("scaffold"), F.col("id").alias("position"))
    g = spark.createDataFrame([("s", "a", 10, 2500), ("s", "b", 999, 1000), ("s", "c", 2999, 5000)], "scaffold string, gene string, start long, end long")
    got = {r.gene: r["count"] for r in genes.in_genes(sites, g, ["gene"], 100).groupBy("gene").count().collect()}
    assert got == {"a": 2491, "b": 2, "c": 1}


def test_contig_coverage(spark):
    r = spark.createDataFrame([("s", 0, 9), ("s", 5, 14), ("s", 5, 14), ("s", 30, 60)], "scaffold string, ref_start long, ref_end long")
    lens = spark.createDataFrame([("s", 40), ("t", 10)], "scaffold string, length long")
    x = quick.contig_coverage(r, lens).first()
    assert (x.covered_bases, x.reads, x.mean) == (25, 4, 1.0)


def test_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text("command line\nx\n20-06-17 18:20:19 DEBUG Checkpoint main start;RAM=5;PID=7\njunk\n")
    r = text.logs(spark, str(tmp_path / "log.txt")).collect()
    assert len(r) == 1 and r[0].before == "command line" and r[0].fields == {"RAM": "5", "PID": "7"} and r[0].log_type == "Checkpoint"
    b = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024**3,)], "n long").select(logs.bytes_text(F.col("n"))).collect()
    assert [x[0] for x in b] == ["0.0B", "1023.0B", "1.0KiB", "5.0GiB"]


def test_fasta_genes_and_maps(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 3->5 exo > first\nacgt\nAC\n>s2\n\n>s3\nNNN")
    got = {r.scaffold: (r.sequence, r.length) for r in text.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"s1": ("ACGTAC", 6), "s2": ("", 0), "s3": ("NNN", 3)}
    (tmp_path / "g.fna").write_text(">s1_1 # 2 # 4 # -1 # ID=1;partial=00;x\nCGT\n>s1_2 # 1 # 3 # 1 # ID=2;partial=01\nACG\n")
    g = {r.gene: (r.scaffold, r.start, r.end, r.direction, r.partial) for r in text.genes(spark, str(tmp_path / "g.fna")).collect()}
    assert g == {"s1_1": ("s1", 1, 3, -1, False), "s1_2": ("s1", 0, 2, 1, True)}
    (tmp_path / "m.stb").write_text("s1 \t g1\ns2\tg1\ns1\tg2 \n")
    assert {(r.scaffold, r.genome) for r in text.resolve_stb(spark, [str(tmp_path / "m.stb")]).collect()} == {("s1", "g2"), ("s2", "g1")}
    assert {r.genome for r in text.resolve_stb(spark, [str(tmp_path / "x.fa")]).collect()} == {"x.fa"}
    (tmp_path / "a.csv").write_text("gene,anno\ng1,k1\ng1,k1\ng2,k2\nbad\n")
    assert text.annotations(spark, [str(tmp_path / "a.csv")]).count() == 2
    gb = "LOCUS       X 12 bp\nVERSION     X.1\nFEATURES             Location/Qualifiers\n     CDS             complement(1..6)\n                     /gene=\"abc\"\n     CDS             join(1..3,7..9)\n                     /locus_tag=\"t2\"\nORIGIN\n        1 atgcta ggcttt\n//\n"
    (tmp_path / "y.gb").write_text(gb)
    y = {r.gene: (r.scaffold, r.start, r.end, r.direction, r.partial, r.sequence) for r in text.genes(spark, str(tmp_path / "y.gb")).collect()}
    assert y == {"abc": ("X.1", 0, 5, -1, False, "TAGCAT"), "t2": ("X.1", 0, 8, 1, True, "ATGGGC")}


def _bam() -> bytes:
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"s1\0" + struct.pack("<i", 100)
    for name, pos, flag, cigar, seq, qual in ((b"r1", 10, 0, [(4, 0), (1, 2), (2, 0)], "ACGTAC", 40), (b"r1", 12, 0, [(3, 0)], "TTT", 40), (b"r2", 5, 4, [], "AC", 40)):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        rec = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in cigar) + packed + bytes([qual] * len(seq)) + b"XAZhi\0NMC\2"
        body += struct.pack("<i", len(rec)) + rec
    return alignments.bgzf(body)


def test_bam_and_pileup(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(_bam())
    d = alignments.bam(spark, str(tmp_path / "x.bam"))
    r = d.orderBy("file_order").collect()
    assert len(r) == 2 and (r[0].scaffold, r[0].nm, r[0].ref_start, r[0].ref_end, r[0].cigar, r[0].sequence) == ("s1", 2, 10, 16, "4M1D2M", "ACGTAC")
    p = {x.position: x.base for x in alignments.pileup(d).collect()}
    assert p == {10: "A", 11: "C", 12: "G", 13: "T", 14: "T", 15: "A", 16: "C"}  # the second mate only adds position 14


def test_overlaps_and_orphans(spark):
    rows = [("r1", 99, "AAAA", "IIII", 1), ("r1", 147, "ACCA", "++I5", 2), ("r2", 97, "GGGG", "IIII", 3), ("r3", 0, "TTTT", "I+II", 4), ("r4", 99, "CCCC", "5555", 5), ("r4", 147, "CCCC", "++++", 6)]
    d = spark.createDataFrame([("s", n, 0, "4M", f, q, qual, k) for n, f, q, qual, k in rows], "scaffold string, read_name string, ref_start long, cigar string, flag int, sequence string, quality string, file_order long")
    got = {(r.pair, r.position): r.base for r in alignments.pileup(d).collect()}
    # I is quality 40, + 10, 5 20: sums of equal bases, 0.8 * 40 of the better one; r2 isn't properly paired
    assert got == {("r1", 0): "A", ("r1", 1): "A", ("r1", 2): "A", ("r1", 3): "A", ("r3", 0): "T", ("r3", 2): "T", ("r3", 3): "T", **{("r4", k): "C" for k in range(4)}}


def test_bam_in_many_shares(spark, tmp_path):
    """Shares of a file, with records that cross members and shares."""
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        n = rng.randrange(20, 150)
        rows.append((f"s{k % 3}", f"read/{k}", rng.randrange(5), 60, n, k, k + n - 1, 99, f"{n}M", "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(33 + rng.randrange(41)) for _ in range(n)), k))
    df = spark.createDataFrame(rows, alignments.READS)
    lens = spark.createDataFrame([("s0", 9000), ("s1", 9000), ("s2", 9000)], "scaffold string, length long")
    alignments.write_bam(df, lens, str(tmp_path / "x.bam"))
    # the same bytes in members that know nothing of records
    whole = b"".join(alignments.inflate((tmp_path / "x.bam").read_bytes().split(alignments.MAGIC)))
    (tmp_path / "y.bam").write_bytes(b"".join(alignments.member(whole[k : k + 5000]) for k in range(0, len(whole), 5000)) + alignments.LAST)
    want = sorted(rows, key=lambda r: (r[0], r[5], r[11]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name in ("x.bam", "y.bam"):
            for size in (old, "30000"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "30000" else "4194304")
                got = alignments.bam(spark, str(tmp_path / name)).orderBy("file_order").collect()
                assert [tuple(r)[:11] for r in got] == [r[:11] for r in want], (name, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr1\t0\ts1\t11\t60\t4M1D2M\t*\t0\t0\tACGTAC\tIIIIII\tNM:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    r = text.sam(spark, str(tmp_path / "x.sam")).collect()
    assert len(r) == 1 and (r[0].nm, r[0].length, r[0].ref_start, r[0].ref_end) == (2, 6, 10, 16)


def test_store(spark, tmp_path):
    s = store.ProfileStore(spark, str(tmp_path / "p"))
    d = spark.createDataFrame([("a", 1), ("b", 2)], "scaffold string, v int")
    s.write("cov", d, "x", "depths")
    s.write("cov", d.limit(1), "y", "depths")
    assert s.read("cov").count() == 3 and s.read("cov", ["x"], ["b"]).first().v == 2
    with pytest.raises(ValueError):
        s.write("cov", d, "x", "something else")
    store.write_table(d.withColumn("position", F.lit(3)), str(tmp_path / "t"), "SNVs", header="k:1")
    t = text.output_table(spark, str(tmp_path / "t"))
    assert t.columns == ["scaffold", "position", "v"] and t.count() == 2


def test_streaming_counts(spark, tmp_path):
    obs = spark.createDataFrame([("s", 1, 0, "A"), ("s", 1, 0, "A"), ("s", 1, 0, "C"), ("s", 1, 0, "N")], "scaffold string, position long, mm int, base string")
    obs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = running_site_counts(stream, K).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("running").first()
    assert (r.A, r.C) == (2, 1)
