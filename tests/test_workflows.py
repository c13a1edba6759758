import random

from allelica.__main__ import main
from allelica.sources import text


def write_inputs(d):
    rng = random.Random(1)
    ref = "".join(rng.choice("ACGT") for _ in range(900))
    (d / "ref.fa").write_text(f">s1\n{ref[:600]}\n>s2\n{ref[600:]}\n")
    (d / "m.stb").write_text("s1\tg1\ns2\tg2\n")
    orf = ref[99:159]
    (d / "g.fna").write_text(f">s1_1 # 100 # 159 # 1 # ID=1;partial=00\n{orf}\n")
    (d / "a.csv").write_text("gene,anno\ns1_1,K1\n")
    for sample, share in (("x", 0.5), ("y", 0.0)):
        lines = ["@SQ\tSN:s1\tLN:600"]
        for k in range(400):
            start = rng.randrange(0, 400)
            alt = rng.random() < share
            nm, rows = 0, []
            for mate, at in ((1, start), (2, start + 100)):
                seq = list(ref[at : at + 100])
                for p in (120, 130, 300):
                    if alt and at <= p < at + 100:
                        seq[p - at] = "A" if ref[p] != "A" else "C"
                        nm += 1
                rows.append((f"r{k}", 99 if mate == 1 else 147, "s1", at + 1, 60, "100M", "=", 1, 200, "".join(seq), "I" * 100))
            lines += ["\t".join(map(str, r)) + f"\tNM:i:{nm if i == 0 else 0}" for i, r in enumerate(rows)]
        (d / f"{sample}.sam").write_text("\n".join(lines) + "\n")


def test_profile_compare_annotate(spark, tmp_path):
    write_inputs(tmp_path)
    p = lambda n: str(tmp_path / n)
    for s in ("x", "y"):
        main(["profile", p(f"{s}.sam"), p("ref.fa"), "-o", p(f"{s}.store"), "--sample", s, "-g", p("g.fna"), "-s", p("m.stb")])
    snv = {r.position: r for r in text.output_table(spark, p("x.store/output/SNVs")).collect()}
    assert set(snv) == {120, 130, 300} and all(r.allele_count == 2 for r in snv.values())
    assert snv[120].gene == "s1_1" and snv[120].mutation_type in ("S", "N") and snv[300].mutation_type == "I"
    ld = text.output_table(spark, p("x.store/output/linkage")).collect()
    assert any((r.position_A, r.position_B) == (120, 130) and float(r.r2) > 0.99 and float(r.r2_normalized) > 0.99 for r in ld)
    top = next((tmp_path / "x.store/output/linkage").glob("part-*")).read_text().split("\n")[0].split("\t")
    assert top[:15] == "scaffold position_A position_B distance r2 d_prime r2_normalized d_prime_normalized allele_A allele_a allele_B allele_b countab countAb countaB".split()
    info = text.output_table(spark, p("x.store/output/scaffold_info")).collect()
    assert [r.scaffold for r in info] == ["s1"] and info[0].divergent_site_count == 3 and info[0].breadth > 0.9
    g = {r.genome: r for r in text.output_table(spark, p("x.store/output/genome_info")).collect()}
    assert g["g1"].iRep is None and g["g1"].filtered_read_pair_count > 100 and g["g1"].coverage_median > 5
    main(["compare", "-i", p("x.store"), p("y.store"), "-o", p("cmp"), "-s", p("m.stb"), "--store_mismatch_locations", "--store_coverage_overlap"])
    main(["compare", "-i", p("x.store"), p("y.store"), "-o", p("cmp2"), "-s", p("m.stb"), "--genome", "g2", "--include_self_comparisons"])
    assert text.output_table(spark, p("cmp2/output/genomeWide_compare")).count() == 0
    main(["compare", "-i", p("x.store"), p("y.store"), "-o", p("cmp3"), "-s", p("m.stb"), "--database_mode", "--include_self_comparisons", "--skip_popANI"])
    pooled = text.output_table(spark, p("cmp3/output/pooled_SNV_info")).collect()
    assert {r.position for r in pooled} == {120, 130, 300}
    main(["recluster", p("cmp/output/genomeWide_compare"), "-o", p("again")])
    assert text.output_table(spark, p("again/output/strain_clusters")).count() == 2
    c = text.output_table(spark, p("cmp/output/genomeWide_compare")).collect()
    assert len(c) == 1 and c[0].popANI == 1.0 and c[0].compared_bases_count > 400
    assert text.output_table(spark, p("cmp/output/strain_clusters")).select("cluster").distinct().count() == 1
    main(["parse_annotations", "-i", p("x.store"), p("y.store"), "-a", p("a.csv"), "-o", p("anno"), "-s", p("m.stb")])
    long = spark.read.csv(p("anno/output/LongFormData"), header=True).collect()
    assert {(r.sample, r.anno, r.genome) for r in long} == {("x", "K1", "g1"), ("y", "K1", "g1")}
    main(["quick_profile", p("x.sam"), p("ref.fa"), "-o", p("quick"), "-s", p("m.stb")])
    g = {r.genome: float(r.breadth) for r in spark.read.csv(p("quick/output/genomeCoverage"), header=True).collect()}
    assert g["g1"] > 0.9 and g["g2"] == 0


def test_more_commands(spark, tmp_path):
    write_inputs(tmp_path)
    p = lambda n: str(tmp_path / n)
    main(["rarefaction_curve", p("x.sam"), p("ref.fa"), "-o", p("rare"), "-s", p("m.stb"), "--fractions", "0.2", "1.0"])
    r = {(x.genome, float(x.fraction)): int(x.reads) for x in spark.read.csv(p("rare/output/rarefaction"), header=True).collect()}
    assert r["g1", 1.0] == 800 and 0 < r["g1", 0.2] < 300 and r["g2", 1.0] == 0
    main(["profile", p("x.sam"), p("ref.fa"), "-o", p("z.store"), "--sample", "z", "--mm_level", "--detailed_mapping_info", "--fdr", "1e-5", "--skip_genome_wide"])
    assert text.output_table(spark, p("z.store/output/scaffold_info")).select("mm").distinct().count() > 1
    assert text.output_table(spark, p("z.store/output/detailed_mapping_info")).count() == 400
    assert not (tmp_path / "z.store/output/genome_info").exists()


def test_run_statistics(spark, tmp_path):
    line = lambda s, kind, rest: f"20-06-17 18:20:{s:02d} DEBUG {kind} {rest}"
    log = [
        line(0, "program_start", "version=1.0; cmd=profile a b"), line(1, "checkpoint", "class=main;name=main;status=start;RAM=10"), line(2, "WorkerLog", "command=Split;unit=u1;PID=1;status=start;process_RAM=5"),
        line(3, "WorkerLog", "command=Split;unit=u2;PID=2;status=start;process_RAM=6"), line(8, "WorkerLog", "command=Split;unit=u1;PID=1;status=end;process_RAM=9"), line(12, "WorkerLog", "command=Split;unit=u2;PID=2;status=end;process_RAM=9"),
        line(13, "Special_genes", "what=whole;scaffold=s1;PID=1;status=start"), line(13, "Special_genes", "what=load;scaffold=s1;PID=1;status=start"), line(14, "Special_genes", "what=load;scaffold=s1;PID=1;status=end"), line(17, "Special_genes", "what=whole;scaffold=s1;PID=1;status=end"),
        line(20, "Plotting", "plot=a"), line(23, "Plotting", "plot=b"), line(30, "Plotting", "plot=finished"), line(31, "Plotting", "plot=a"), line(40, "checkpoint", "class=main;name=main;status=end;RAM=30"), line(50, "program_end", "loglog=x"),
    ]
    (tmp_path / "log.log").write_text("\n".join(log) + "\n")
    main(["run_statistics", str(tmp_path / "log.log"), "-o", str(tmp_path / "stats")])
    t = lambda n: text.output_table(spark, str(tmp_path / f"stats/output/{n}")).collect()
    o = t("overall")[0]
    assert (o.version, o.command, o.finished, o.runtime) == (1.0, "profile a b", True, 50.0)
    s = t("parallel_steps")[0]
    assert (s.wall, s.processes, s.units, s.longest, s.longest_unit) == (10.0, 2, 2, 9.0, "u2") and s.efficiency == 75.0
    assert [(r.plot, r.runtime) for r in sorted(t("plots"), key=lambda r: r.plot)] == [("a", 3.0), ("b", 7.0)]
    assert [(r.command, r.percent) for r in t("gene_steps")] == [("load", 25.0)]
    assert [(r.unit, r.percent) for r in t("checkpoints")] == [("main", 100.0)]
    assert {r.pid: r.efficiency for r in t("processes")} == {1: 60.0, 2: 100.0}
