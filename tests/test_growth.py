"""Faults that only larger tables show, on small ones."""

import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelica.operators import compare, genes, genomes
from allelica.sources import adapter, alignments


def test_sizes_above_a_tebibyte(spark, tmp_path):
    """The query's largest unit is that of its SQL."""
    keys = [0, 5, 6, 168, 5000, 172384, 172385, 900_000, 54_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in entry.queries()["r9_bytes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == set(con.execute(entry.oracle_sql()["r9_bytes"]).fetchall())


def test_long_reads_pile_up_in_proportion(spark):
    """A base's cost doesn't grow with its place in the read: counted from the start, these take minutes."""
    n = 300_000
    d = spark.range(2).select(
        F.lit("s").alias("scaffold"), F.concat(F.lit("r"), "id").alias("read_name"), F.lit(5).cast("long").alias("ref_start"), F.lit(f"{n}M").alias("cigar"),
        F.repeat(F.lit("ACTGN"), n // 5).alias("sequence"), F.repeat(F.lit("I5I"), n // 3).alias("quality"), F.col("id").alias("file_order"),
    )
    began = time.perf_counter()
    got = alignments.pileup(d).agg(F.count("*"), F.min("position"), F.max("position"), F.count_if(F.col("base") == "A")).first()
    kept = [k for k in range(n) if k % 3 != 1 and k % 5 != 4]
    assert tuple(got) == (2 * len(kept), 5 + kept[0], 5 + kept[-1], 2 * sum(k % 5 == 0 for k in kept))
    assert time.perf_counter() - began < 30


def test_bam_is_written_without_results(spark, tmp_path, monkeypatch):
    """Members of a file are no results of tasks, whatever the number of parts and of empty ones."""
    rows = [("s1" if k % 2 else "s0", f"r{k}", 0, 60, 100, k, k + 99, 0, "100M", "ACGTA" * 20, "I" * 100, k) for k in range(5000)]
    d = spark.createDataFrame(rows, alignments.READS)
    lens = spark.createDataFrame([("s0", 9000), ("s1", 9000)], "scaffold string, length long")
    monkeypatch.setattr(type(d), "toLocalIterator", lambda *_: (_ for _ in ()).throw(AssertionError("members sent to the driver")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for name, part in (("all", d), ("few", d.where("file_order < 3")), ("none", d.where("file_order < 0"))):
            path = str(tmp_path / f"{name}.bam")
            alignments.write_bam(part, lens, path)
            got = alignments.bam(spark, path).orderBy("file_order").collect()
            assert [tuple(r)[:11] for r in got] == [tuple(r)[:11] for r in part.orderBy("scaffold", "ref_start", "file_order").collect()], name
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_have_positions_once(spark):
    """What is joined has a row for each sample and position, whatever the number of levels; counts are those of each level."""
    depth = {("a", 0): {0: 5}, ("a", 1): {0: 2, 3: 3, 7: 1}, ("a", 2): {1: 4}, ("b", 0): {2: 9}, ("b", 1): {0: 6, 5: 1}, ("b", 3): {4: 5}, ("c", 1): {1: 5}}
    rows = [(s, "x", p, m, n) for (s, p), levels in depth.items() for m, n in levels.items()]
    cov = spark.createDataFrame(rows, "sample string, scaffold string, position long, mm int, coverage long")
    calls = [("a", 1, "A", "C", "A", 1, 0, 6, 0, 0), ("b", 1, "A", "A", "C", 2, 5, 2, 0, 0)]
    table = spark.createDataFrame([(s, "x", *r) for s, *r in calls], "sample string, scaffold string, position long, ref_base string, con_base string, var_base string, allele_count int, A long, C long, T long, G long")
    sites = compare.overlap_sites(cov, table)
    assert sorted((r.sample, r.position, r["from"]) for r in sites.collect()) == [("a", 0, 0), ("a", 1, 3), ("b", 0, 2), ("b", 1, 0), ("b", 3, 4), ("c", 1, 1)]
    levels = compare.pair_levels(cov, compare.sample_pairs(cov, self_comparisons=True))
    got = {(r.name1, r.name2, r.mm): (r.compared_bases_count, r.coverage_overlap, r.consensus_SNPs, r.population_SNPs) for r in compare.coverage_overlap(sites, levels).collect()}
    own = {s: {m for (t, _), d in depth.items() if t == s for m in d} for s in "abc"}
    want = {}
    for x, y in (("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")):
        for m in own[x] | own[y]:
            one, two = ({p for (t, p), d in depth.items() if t == s and sum(n for k, n in d.items() if k <= m) >= 5} for s in (x, y))
            if one | two:
                # at position 1, a's consensus C differs from b's A and from the reference that c is taken to have; b has C too, but only c's are no differences by population
                con = int(1 in one & two and (x, y) in (("a", "b"), ("a", "c")))
                want[x, y, m] = (len(one & two), len(one & two) / len(one | two), con, int(con and (x, y) == ("a", "c")))
    assert got == want
    differ = {(r.name1, r.name2, r.mm, r.consensus_SNP, r.population_SNP) for r in compare.snp_differences(sites, levels).collect()}
    assert differ == {(x, y, m, v[2] > 0, v[3] > 0) for (x, y, m), v in want.items() if v[2]}


def test_genes_in_proportion_to_their_number(spark, tmp_path):
    """A gene's bases aren't looked for from the start of its scaffold."""
    spark.createDataFrame([(0,), (10_000_003,)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    adapter.SCHEMAS.clear()
    began = time.perf_counter()
    g = adapter.genes(spark, str(tmp_path))
    n, letters = g.agg(F.count("*"), F.sum(F.length("sequence"))).first()
    assert (n, letters) == (50_000, 25_000 * (24 + 12)) and time.perf_counter() - began < 20
    base = lambda p: "ACTG"[(p * 7 + 3 * 3) % 4]
    for r in g.where("start > 999900 or start < 100").collect():
        forward = "".join(base(p) for p in range(r.start, r.end + 1))
        assert r.sequence == (forward if r.direction == 1 else forward.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    adapter.SCHEMAS.clear()


def test_sites_meet_few_genes():
    """Dense genes: a site isn't compared with all genes of a thousand positions."""
    assert genes.BIN <= 100


def test_scaffold_table_is_made_once(spark):
    """The genome table reads the scaffold table twice; it is made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return x

    names = ["breadth", "coverage", "nucl_diversity", "nucl_diversity_rarefied", "breadth_minCov"]
    counts = ["SNS_count", "SNV_count", "divergent_site_count", "consensus_divergent_sites", "population_divergent_sites"]
    d = spark.createDataFrame([("s", m, 100) for m in range(3)], "scaffold string, mm int, length long")
    d = d.withColumns({c: F.lit(0.5) for c in names} | {c: F.lit(1) for c in counts}).select("scaffold", seen(F.col("mm").cast("double")).cast("int").alias("mm"), "length", *names, *counts)
    stb = spark.createDataFrame([("s", "g")], "scaffold string, genome string")
    got = genomes.genome_scaffold_info(d, stb, d.select("scaffold", "length").distinct(), []).collect()
    assert sorted(r.mm for r in got) == [0, 1, 2] and made.value == 3
