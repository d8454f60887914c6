import numpy as np

from lociframe import cli
from lociframe.model import ALLELES_N_BEFORE_D, LOCI_SCHEMA, FilterParams
from lociframe.operators.association import allele_scan, Phenotypes
from lociframe.sources import phen, pileup, sync, vcf
from lociframe.streaming.loci import scan_stream

PILEUP = "\t".join(["Chromosome1", "456527", "C", "4", "....+1c", "JJJJ", "3", ".T.-3atg", "JJJ", "7", ".*.T..T", "JFJFJFJ", "5", "T....", "JJJJJ", "7", "...T...", "JJJJ<7J"])
SYNC = "\t".join(["Chromosome1", "456527", "C", "1:0:999:0:4:0", "0:1:2:0:0:0", "0:2:4:0:0:0", "0:1:4:0:0:0", "0:1:6:0:0:0"])
DEPTHS = ["7,0,1", "5,0,2", "4,2,1", "7,1,0", "6,5,2", "7,0,1", "5,0,1", "5,4,0", "9,0,0", "23,3,10"]
VCF = "\t".join(["chrA", "323723", ".", "C", "A,CCT", ".", ".", ".", "GT:PL:DP:AD", *[f"0/0:1,2,3:9:{d}" for d in DEPTHS]])


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_pileup(spark):
    rows = pileup.parse_lines(lines(spark, PILEUP, "# comment", "chr\tx\tA\t1\t.\tJ", "chr\t5\tA\t2\t.\tJJ"))
    got = rows.collect()
    assert len(got) == 1
    assert ["".join(p.bases) for p in got[0].pools] == ["CCCC", "CTC", "CDCTCCT", "TCCCC", "CCCTCCC"]
    counts = pileup.to_loci(pileup.filter_quality(rows)).first().counts
    assert counts[2] == [0, 2, 4, 0, 1, 0]


def test_pileup_read_ends_and_quality(spark):
    line = "\t".join(["c", "1", "a", "3", "^K.$,+12ACGTACGTACGTt", "J#J"])
    parsed = pileup.parse_lines(lines(spark, line))
    # a reference in lower case is N, or its letter where that is asked for; the read of low quality goes
    assert pileup.to_loci(pileup.filter_quality(parsed)).first().counts == [[0, 1, 0, 0, 0, 1]]
    asked = FilterParams(keep_lowercase_reference=True)
    row = pileup.to_loci(pileup.filter_quality(parsed, asked)).first()
    assert row.counts == [[1, 1, 0, 0, 0, 0]] and row.ref == "A"
    line = "\t".join(["c", "1", "a", "3", "..T", "JJJ", "2", "*,", "JJ"])
    parsed = pileup.parse_lines(lines(spark, line))
    assert pileup.to_loci(pileup.filter_quality(parsed)).first().counts == [[0, 1, 0, 0, 0, 2], [0, 0, 0, 0, 1, 1]]
    assert pileup.to_loci(pileup.filter_quality(parsed, asked)).first().counts == [[2, 1, 0, 0, 0, 0], [1, 0, 0, 0, 1, 0]]
    assert pileup.filter_quality(parsed, asked, 2).count() == 1 and pileup.filter_quality(parsed, asked, 3).count() == 0


def test_sync_round_trip(spark):
    loci = sync.parse_lines(lines(spark, "#chr\tpos", SYNC, "bad\t1\tC\t1:2", "bad\tx\tC\t1:0:0:0:0:0"))
    row = loci.first()
    assert loci.count() == 1 and row.counts[0] == [1, 0, 999, 0, 4, 0]
    assert loci.select(sync.line_of(loci)).first()[0] == SYNC
    assert sync.parse_lines(lines(spark, SYNC), ALLELES_N_BEFORE_D).first().alleles[4] == "N"


def test_vcf(spark):
    rows = vcf.to_sync(vcf.parse_lines(lines(spark, "##x", VCF, VCF.replace("GT:PL:DP:AD", "GT:PL:DP:XX"))))
    assert rows.count() == 1
    assert rows.first().counts[0] == [0, 0, 7, 0, 1, 0] and rows.first().counts[4] == [5, 0, 6, 0, 2, 0]
    assert vcf.sample_names(lines(spark, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tE-0\tE-1")) == ["E-0", "E-1"]


def test_phenotypes():
    p = phen.parse_delimited(["#name,size,a,b", "G1,20, 0.1 ,NA", "G2,30,0.3,2"], values=(2, 3))
    assert p.names == ("G1", "G2") and np.allclose(p.weights, [0.4, 0.6]) and np.isnan(p.values[0, 1]) and p.complete.tolist() == [1]
    z = phen.parse_quantiles(['Pheno_name="x";', "sig=0.07;", "MIN=0.10;", "MAX=1.00;", "perc=[0.2,0.4,0.6,0.8];", "q=[0.2,0.5,0.75,0.97];"])
    assert np.allclose(z.bins, 0.2) and z.q[0] == 0 and abs(z.q[1] - 0.1 / 0.9) < 1e-12


def files(tmp_path):
    rng = np.random.default_rng(7)
    text = ["#chr\tpos\tref\tp"] + ["\t".join([f"c{c}", str(5 * i), "A", *[":".join(map(str, [*rng.integers(1, 20, 4), 0, 0])) for _ in range(5)]]) for c in range(2) for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sync").write_text("\n".join(text) + "\n")
    (tmp_path / "phen.csv").write_text("#name,size,y\n" + "".join(f"G{i},20,{y}\n" for i, y in enumerate([0.1, 0.3, 0.5, 0.7, 0.95])))
    (tmp_path / "phen.py").write_text("sig=0.07;\nMIN=0.10;\nMAX=1.00;\nperc=[.2,.4,.6,.8];\nq=[.2,.5,.75,.97];\n")
    return str(tmp_path / "in" / "x.sync"), str(tmp_path / "phen.csv"), str(tmp_path / "phen.py")


def test_verbs(spark, tmp_path):
    genotypes, phenotypes, quantiles = files(tmp_path)
    names, got = [f"G{i}" for i in range(5)], {}
    for verb in cli.VERBS:
        if verb in ("pileup2sync", "vcf2sync", "genomic_prediction_cross_validation"):
            continue
        args = [verb, "-f", genotypes, "-p", quantiles if verb == "gwalpha" else phenotypes, "-o", str(tmp_path / verb), "--min-depth-set-to-missing", "1"]
        if verb == "gwalpha":
            args += ["--gwalpha-method", "LS", "--min-allele-frequency", "0.3"]
        out = cli.main(args, spark)
        got[verb] = spark.read.csv(out, header=True)
        assert got[verb].count() > 0, verb
    for verb in ("heterozygosity", "watterson_estimator", "tajima_d"):
        assert got[verb].columns == ["window", "chr", "pos_ini", "pos_fin", *names]
        rows = [r.window for r in got[verb].collect()]
        assert rows[0] == "Mean_across_windows" and rows[1].startswith("Window-c0_0_") and len(rows) > 2
    fst = got["fst"].collect()
    assert got["fst"].columns == ["pool", *names] and [r.pool for r in fst] == names
    assert all(float(fst[i][names[i]]) == 0 and fst[i][names[j]] == fst[j][names[i]] for i in range(5) for j in range(5))
    windows = spark.read.csv(str(tmp_path / "fst-windows"), header=True)
    assert windows.columns == ["chr", "pos_ini", "pos_fin", *[f"{a}_vs_{b}" for a in names for b in names]]
    assert got["gudmc"].columns[:5] == ["pop_a", "pop_b", "chr", "pos_ini", "pos_fin"] and {r.pop_a for r in got["gudmc"].collect()} <= set(names)


def test_verbs_that_make_sync_files(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"E{i}" for i in range(10)]]) + "\n" + VCF + "\n")
    (tmp_path / "phen10.csv").write_text("".join(f"G{i},20,{i}\n" for i in range(10)))
    out = cli.main(["vcf2sync", "-f", str(tmp_path / "x.vcf"), "-p", str(tmp_path / "phen10.csv"), "-o", str(tmp_path / "vcf_out")], spark)
    first, second = [r.value for r in spark.read.text(out).collect()]
    assert first == "\t".join(["#chr", "pos", "ref", *[f"E{i}" for i in range(10)]]) and second.startswith("chrA\t323723\tC\t0:0:7:0:1:0")
    (tmp_path / "x.pileup").write_text(PILEUP.replace("456527\tC", "456527\tc") + "\n" + PILEUP.rsplit("\t", 3)[0] + "\n")
    (tmp_path / "phen5.csv").write_text("".join(f"G{i},20,{i}\n" for i in range(5)))
    common = ["pileup2sync", "-f", str(tmp_path / "x.pileup"), "-p", str(tmp_path / "phen5.csv"), "--keep-lowercase-reference", "-o"]
    first, second = [r.value for r in spark.read.text(cli.main([*common, str(tmp_path / "pileup_out")], spark)).collect()]  # the line of four pools goes
    assert first == "#chr\tpos\tref\tG0\tG1\tG2\tG3\tG4" and second.startswith("Chromosome1\t456527\tC\t0:0:4:0:0:0\t0:1:2:0:0:0")


def test_verb_of_genomic_prediction(spark, tmp_path):
    from lociframe.operators.prediction import MODELS

    genotypes, phenotypes, _ = files(tmp_path)
    head = "\n".join(open(genotypes).read().splitlines()[:25]) + "\n"
    (tmp_path / "few.sync").write_text(head)
    args = ["genomic_prediction_cross_validation", "-f", str(tmp_path / "few.sync"), "-p", phenotypes, "--k-folds", "2", "--n-reps", "1", "-o", str(tmp_path / "gp")]
    metrics = spark.read.csv(cli.main(args, spark), header=True)
    assert {r.model for r in metrics.collect()} == set(MODELS)
    rows = spark.read.csv(str(tmp_path / "gp-predictors"), header=True).collect()
    for model in MODELS:
        mine = [r for r in rows if r.model == model]
        assert sum(r.allele == "intercept" for r in mine) == 1 and len(mine) > 24
        assert all((r["lambda"] is None) == model.startswith("ols") for r in mine)


def test_stream_of_files_gives_what_a_table_gives(spark, tmp_path):
    files(tmp_path)
    y = Phenotypes(tuple("abcde"), np.full(5, 20.0), np.arange(5.0)[:, None])
    run = scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), [1.0] * 5, lambda loci: allele_scan(loci, y))
    run.awaitTermination(60)
    from lociframe.operators.filters import filter_loci

    want = allele_scan(filter_loci(sync.read(spark, str(tmp_path / "in")), [1.0] * 5), y).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want > 0


def test_loci_schema(spark):
    assert spark.createDataFrame([], LOCI_SCHEMA).columns == ["chr", "pos", "ref", "alleles", "counts"]


def test_lines_are_counted_by_reason(spark, tmp_path, capsys):
    """Comments, damaged lines and whole ones, in one pass with what is read."""
    from pyspark.sql import Observation

    pools = "\t".join(["1:2:3:0:0:0"] * 5)
    sync_lines = ["#chr\tpos", f"c\t5\tA\t{pools}", f"c\tx\tA\t{pools}", "c\t6\tA", f"c\t7\tA\t{pools}:1", f"c\t8\tA\t{pools.replace('3', 'z', 1)}", f"c\t9\tA\t{pools}", ""]
    text = lambda lines: spark.createDataFrame([(v,) for v in lines], "value string").repartition(3)

    def tallied(module, lines):
        tally = Observation("lines")
        n = module.parse_lines(text(lines), tally=tally).count()
        return n, tally.get

    n, counts = tallied(sync, sync_lines)
    assert n == 2 and counts == {"lines": 8, "kept": 2, "comment": 1, "fields": 2, "position": 1, "counts": 2}
    fields = VCF.split("\t")
    vcf_lines = ["##x", "#CHROM", VCF, "\t".join(fields[:8]), VCF.replace("323723", "?"), VCF.replace("GT:PL:DP:AD", "GT:PL:DP:AC")]
    n, counts = tallied(vcf, vcf_lines)
    assert n == 1 and counts == {"lines": 6, "kept": 1, "comment": 2, "fields": 1, "depths": 1, "position": 1}
    n, counts = tallied(pileup, [PILEUP, "#", PILEUP.replace("456527", ""), PILEUP.replace("....+1c", "...+1c"), "a\tb", ""])
    assert n == 1 and counts == {"lines": 6, "kept": 1, "comment": 1, "fields": 2, "position": 1, "codes": 1}
    (tmp_path / "x.sync").write_text("\n".join(sync_lines) + "\n")
    (tmp_path / "phen.csv").write_text("".join(f"G{i},20,{i}\n" for i in range(5)))
    for verb in ("sync2csv", "heterozygosity"):
        cli.main([verb, "-f", str(tmp_path / "x.sync"), "-p", str(tmp_path / "phen.csv"), "-o", str(tmp_path / verb), "--min-loci-per-window", "1"], spark)
        said = capsys.readouterr().err.strip().splitlines()[-1]
        assert said == "lines: 8, kept: 2, comment: 1, fields: 2, position: 1, counts: 2"


def test_output_is_in_the_inputs_order(spark, tmp_path):
    """Loci that are not sorted stay so in each per-locus verb, unless the genome's order is asked for; many splits of one file."""
    rng = np.random.default_rng(3)
    loci = [(f"c{c}", 5 * i) for c in (2, 0, 1) for i in rng.permutation(300).tolist()]
    lines = ["#chr\tpos\tref\tp"] + ["\t".join([c, str(p), "A", *[":".join(map(str, [*rng.integers(1, 20, 2), 0, 0, 0, 0])) for _ in range(5)]]) for c, p in loci]
    (tmp_path / "x.sync").write_text("\n".join(lines) + "\n")
    (tmp_path / "phen.csv").write_text("".join(f"G{i},20,{i}\n" for i in range(5)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for extra, want in (([], loci), (["--genome-order"], sorted(loci))):
            out = str(tmp_path / f"csv{len(extra)}")
            cli.main(["sync2csv", "-f", str(tmp_path / "x.sync"), "-p", str(tmp_path / "phen.csv"), "-o", out, *extra], spark)
            files_ = sorted(f for f in __import__("os").listdir(out) if f.startswith("part-"))
            rows = [line.split(",")[:2] for f in files_ for line in open(f"{out}/{f}").read().splitlines()[1:]]
            found = [(c, int(p)) for c, p in rows]
            assert list(dict.fromkeys(found)) == want and len(found) == 2 * len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_imputed_frequencies_are_written_wide(spark, tmp_path):
    """A line an allele, a column a pool that is left, all cells filled and of six digits at most."""
    genotypes, phenotypes, _ = files(tmp_path)
    lines = open(genotypes).read().splitlines()
    for k in (7, 19, 40):
        field = lines[k].split("\t")
        lines[k] = "\t".join([*field[:5], "0:0:0:0:0:0", *field[6:]])
    (tmp_path / "holes.sync").write_text("\n".join(lines) + "\n")
    args = ["impute", "-f", str(tmp_path / "holes.sync"), "-p", phenotypes, "--max-missingness-rate", "0.5", "--min-coverage-depth", "0", "--min-depth-set-to-missing", "1", "--frac-top-missing-pools", "0", "--frac-top-missing-loci", "0"]
    for method in ("mean", "aLD-kNNi"):
        got = spark.read.csv(cli.main([*args, "--imputation-method", method, "-o", str(tmp_path / method)], spark), header=True, inferSchema=True)
        assert got.columns == ["chr", "pos", "allele", *[f"G{i}" for i in range(5)]]
        rows = got.collect()
        assert len({(r.chr, r.pos) for r in rows}) == 120 and all(r[f"G{i}"] is not None for r in rows for i in range(5))
        assert all(abs(sum(r.G2 for r in rows if (r.chr, r.pos) == at) - 1) < 1e-5 for at in {(r.chr, r.pos) for r in rows if r.chr == "c0"})
        assert all(len(str(r.G1)) <= 8 for r in rows)


def test_window_ids_are_read_back(spark):
    from pyspark.sql import functions as F

    from lociframe.operators.diversity import window_id, window_of

    rows = [("chr_1_2", 3, 10), ("", 0, 0), ("Window-x_1", 5, 6), ("a b\n", 1, 2)]
    frame = spark.createDataFrame(rows, "chr string, pos_ini long, pos_fin long").select("*", window_of(window_id(F.col("chr"), F.col("pos_ini"), F.col("pos_fin"))).alias("back"))
    assert all(tuple(r.back) == (r.chr, r.pos_ini, r.pos_fin) for r in frame.collect())
    assert [r[0] for r in spark.createDataFrame([("Mean_across_windows",), ("Window-c_1",), (None,)], "w string").select(window_of(F.col("w"))).collect()] == [None] * 3


def test_vcf_lines_are_made_and_split_once(spark):
    """What makes a line, and its split, stand once in the plan, whatever is asked of the parts."""
    from pyspark.sql import functions as F

    from lociframe.sources import vcf

    made = F.concat_ws("\t", F.lit("c"), F.col("id").cast("string"), F.lit("."), F.lit("A"), F.lit("T,AT"), *[F.lit(".")] * 3, F.lit("GT:AD"), F.lit("0/1:3,1,2"), F.lit("0/1:.,4"))
    out = vcf.to_sync(vcf.parse_lines(spark.range(3).select(made.alias("value"))))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1 and plan.count("split(value") == 1
    assert [r.counts for r in out.collect()] == [[[3, 1, 0, 0, 2, 0], [0, 4, 0, 0, 0, 0]]] * 3
