"""Operators on small hand-made relations."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from taxeval.functions import text
from taxeval.operators import catalog, cohort, evaluation, gates, perread, profiles, reads, runs, taxonomy
from taxeval.sources import formats, lines, records, sequences, sinks


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*(cols or df.columns)).collect()], key=str)


@pytest.fixture(scope="module")
def nodes(spark):
    # 30 is a genus below genus 20; 91 and 92 are a cycle; 60's parent is missing.
    data = [(1, 1, "root"), (10, 1, "family"), (20, 10, "genus"), (30, 20, "genus"), (40, 30, "species"), (50, 10, "genus"), (91, 92, "x"), (92, 91, "y"), (60, 999, "species")]
    return spark.createDataFrame(data, "taxid long, parent long, rank string")


def test_closure_stops_at_roots_missing_parents_and_cycles(spark, nodes):
    seeds = spark.createDataFrame([(40,), (60,), (91,), (7,), (None,)], "taxid long")
    got = rows(taxonomy.closure(nodes, seeds))
    assert got == sorted([(40, 40, 0), (40, 30, 1), (40, 20, 2), (40, 10, 3), (40, 1, 4), (60, 60, 0), (60, 999, 1), (91, 91, 0), (91, 92, 1), (7, 7, 0)], key=str)


def test_lift_is_nearest_first_and_depth_counts_known_nodes(spark, nodes):
    closed = taxonomy.closure(nodes, spark.createDataFrame([(40,), (60,), (7,), (20,)], "taxid long"))
    assert rows(taxonomy.lifts(closed, nodes, ["genus"])) == [(20, "genus", 20), (40, "genus", 30)]
    assert rows(taxonomy.depths(closed, nodes)) == sorted([(40, 4), (60, 0), (7, None), (20, 2)], key=str)


def test_descendants_and_exact_ranks_differ_where_a_rank_is_nested(spark, nodes):
    facts = spark.createDataFrame([("t", 20, 40), ("t", 20, 50), ("t", 20, None), ("t", 7, 40)], "tool string, taxid long, pred long")
    r = perread.combined(facts, nodes, ["tool"], ["genus"]).first()
    assert (r["reads"], r["classified"], r["truth_mapped"], r["pred_mapped"], r["exact_pred_mapped"]) == (4, 3, 3, 2, 3)
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 2)
    assert (r["exact_tp"], r["exact_fp"], r["exact_fn"]) == (0, 2, 3)


def test_paths_have_no_limit(spark):
    deep = spark.createDataFrame([(i, i + 1, "species" if i == 0 else "x") for i in range(100)] + [(100, 100, "genus")], "taxid long, parent long, rank string")
    closed = taxonomy.closure(deep, deep.filter("taxid = 0").select("taxid"))
    assert closed.agg(F.max("dist"), F.count("*")).first()[:] == (100, 101)
    assert rows(taxonomy.lifts(closed, deep, ["genus"])) == [(0, "genus", 100)]
    assert rows(taxonomy.depths(closed, deep)) == [(0, 100)]


def test_depths_of_ancestors_are_those_of_their_own_paths(spark, nodes):
    closed = taxonomy.closure(nodes, spark.createDataFrame([(40,), (50,), (60,), (91,)], "taxid long"))
    inside = closed.select("anc").distinct()
    want = rows(taxonomy.depths(taxonomy.closure(nodes, inside), nodes))
    assert rows(profiles.inner_depths(closed, nodes).filter("depth is not null")) == [r for r in want if r[1] is not None]


def test_reads_are_counted_before_they_meet_the_taxonomy(spark, nodes, monkeypatch):
    facts = spark.createDataFrame([("t", 20, 40)] * 500 + [("t", 20, None)] * 300, "tool string, taxid long, pred long")
    seen = []
    lift = perread.lifted_pairs
    monkeypatch.setattr(perread, "lifted_pairs", lambda pairs, *a, **k: seen.append(pairs) or lift(pairs, *a, **k))
    r = perread.combined(facts, nodes, ["tool"], ["genus"]).first()
    assert (r["reads"], r["classified"], r["tp"], r["fn"]) == (800, 500, 500, 300)
    assert seen[0].count() == 2  # no join holds reads


def test_evaluation_of_runs_with_and_without_profiles(spark, nodes):
    reads_ = spark.createDataFrame([("a", 20, 40, 2), ("a", 50, 50, 1), ("b", 20, None, 5), ("d", 40, 40, 3), ("d", 50, 40, 1), ("e", 40, 40, 3), ("e", 50, 50, 1)], "run string, taxid long, pred long, weight long")
    pred = spark.createDataFrame([
        ("a", "native", "species", 40, 2.0), ("a", "native", "genus", 50, 1.0), ("a", "cami", "genus", 20, 9.0), ("d", "reads_tre", "genus", 30, 7.0), ("d", "reads_tre", "species", 40, 2.0), ("e", "named", None, 40, 0.75), ("e", "named", None, 50, 0.25),
    ], "run string, source string, rank string, taxid long, value double")
    source = spark.createDataFrame([("a", "native", True, True), ("a", "cami", True, True), ("b", "native", True, True), ("c", "native", True, True), ("d", "reads_tre", True, True), ("e", "named", True, True), ("f", "named", True, False)], "run string, source string, configured boolean, exists boolean")
    files = spark.createDataFrame([("a", "classify_tsv", True), ("a", "named_profile", False), ("b", "classify_one", False), ("d", "classify_tsv", False), ("d", "classify_one", False), ("f", "classify_tsv", False), ("f", "named_profile", False), ("e", "truth_profile", False)], "run string, output string, exists boolean")
    made = evaluation.evaluate(nodes, ["run"], ["genus"], reads=reads_, sources=source, predicted=pred, files=files).collect()
    got = {(r["run"], r["metric"]): r["value"] for r in made if r["text"] is None}
    assert got["a", "per_read_recall_genus"] == 1.0 and got["b", "per_read_recall_genus"] == 0.0 and got["b", "per_read_unclassified_rate"] == 1.0
    assert got["a", "l1_norm_genus"] == pytest.approx(4 / 3) and got["a", "purity_genus"] == 0.5  # a native profile counts whole: 40, whose genus is 30, and 50
    assert got["b", "l1_norm_genus"] == pytest.approx(1.0) and got["b", "completeness_genus"] == 0.0  # there but empty
    assert got["d", "l1_norm_genus"] == pytest.approx(0.5) and got["d", "purity_genus"] == 1.0  # the tree's most specific rank alone
    assert (got["e", "l1_norm_genus"], got["e", "purity_genus"], got["e", "weighted_unifrac"]) == (0.0, 1.0, 0.0)  # a perfect profile without ranks
    assert not [m for r, m in got if r == "c"]  # no truth
    assert {x for x in got if x[1].endswith("_missing")} == {("b", "classify_one_missing"), ("d", "classify_tsv_missing"), ("f", "named_profile_missing"), ("e", "truth_profile_missing")}
    tags = {(r["run"], r["metric"], r["text"]) for r in made if r["text"] is not None}
    assert tags == {(r, "metric_version", evaluation.VERSION) for r in "abdef"} | {(r, "profile_metric_version", evaluation.VERSION) for r in "abde"}


def test_named_profiles_keep_what_has_no_taxon(spark, nodes):
    named = spark.createDataFrame([("r", "x", 2.0, 40), ("r", "y", 3.0, None), ("r", "z", 1.0, 60)], "run string, name string, value double, taxid long")
    full, lost = profiles.named_to_ranks(named.withColumn("rank", F.lit("")), nodes, ["run"], ["genus"])
    assert rows(full) == sorted([("r", "genus", 30, None, 2.0, 2.0), ("r", "genus", 60, None, None, 1.0), ("r", "genus", None, "y", None, 3.0)], key=str)
    assert rows(lost) == [("r", 1, 3.0)]
    none = spark.createDataFrame([("r", "x", 0.0, None)], "run string, name string, value double, taxid long")
    r = profiles.truth_coverage(none, ["run"]).first()
    assert r["species_unmapped_rate"] == 1.0 and r["mass_mapped_rate"] is None


def test_most_specific_rank_else_the_first_seen(spark):
    df = spark.createDataFrame([("a", "z", 1, 0), ("a", "b", 2, 1), ("c", "genus", 3, 0), ("c", "species", 4, 1)], "run string, rank string, taxid int, at int")
    assert rows(profiles.most_specific(df, ["run"], "at"), "run", "taxid") == [("a", 1), ("c", 4)]


def test_no_mapped_truth_has_no_scores(spark, nodes):
    r = perread.combined(spark.createDataFrame([("t", 7, 40)], "tool string, taxid long, pred long"), nodes, ["tool"], ["genus"]).first()
    assert r["precision"] is None and r["truth_mapped_rate"] == 0.0


def test_pair_fallback(spark):
    truth = spark.createDataFrame([("k", "a/1", 5), ("k", "a/2", 5), ("k", "b/1", 5), ("k", "b/2", 6), ("k", "c/1", 1), ("k", "d", 1), ("k", "e/1", 3), ("k", "e/2", 3)], "k string, read_id string, taxid long")
    pred = spark.createDataFrame([("k", "a/2", 9), ("k", "b/2", 9), ("k", "c", 8), ("k", "d/1", 7), ("k", "e/1", None), ("k", "e/2", 4)], "k string, read_id string, taxid long")
    got = {r["read_id"]: (r["pred"], r["found"]) for r in reads.lookup_predictions(truth, pred, ["k"]).collect()}
    assert got == {"a/1": (9, True), "a/2": (9, True), "b/1": (None, False), "b/2": (9, True), "c/1": (8, True), "d": (None, False), "e/1": (None, True), "e/2": (4, True)}


def test_profile_scores_in_their_ranges(spark, nodes):
    t = spark.createDataFrame([("r", "genus", 20, 1.0), ("r", "genus", 50, 3.0), ("r", "genus", 7, -1.0)], "run string, rank string, taxid long, value double")
    p = spark.createDataFrame([("r", "genus", 50, 2.0), ("r", "genus", 99, 2.0)], "run string, rank string, taxid long, value double")
    r = profiles.opal(t, p, ["run"]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 1)
    assert r["l1_norm"] == pytest.approx(1.0) and r["purity"] == 0.5 and r["completeness"] == 0.5
    assert profiles.unifrac(t, t, nodes, ["run"]).first()["weighted_unifrac"] == 0.0
    assert profiles.unifrac(t, p, nodes, ["run"]).first()["weighted_unifrac"] > 0


def test_source_precedence(spark):
    rows_ = [("a", "abundance_tre", True, False), ("a", "reads_tre", True, True), ("a", "native", True, True), ("b", "native", True, False), ("b", "cami", True, True), ("c", "reads_tre", True, True), ("d", "cami", False, True), ("d", "named", True, True)]
    df = spark.createDataFrame(rows_, "run string, source string, configured boolean, exists boolean")
    assert rows(profiles.chosen_source(df, ["run"])) == [("a", "native"), ("b", None), ("c", "reads_tre"), ("d", "named")]


def test_aliases_and_ids(spark):
    df = spark.createDataFrame([("[Genus] epithet  strain",), ("Genus sp. X (y)",), ("   A/1 b",), ("",)], "s string")
    got = [r[0] for r in df.select(text.name_aliases(F.col("s"))).collect()]
    assert got[0] == ["[Genus] epithet strain", "Genus epithet", "[Genus] epithet"] and got[1] == ["Genus sp. X (y)", "Genus sp. X"]
    assert [r[0] for r in df.select(text.read_id(F.col("s"))).collect()][2:] == ["A/1", ""]


def test_bad_mate_is_an_error(spark):
    df = spark.createDataFrame([("@r/1", 3)], "id string, mate int")
    with pytest.raises(Exception, match="not a mate"):
        df.select(text.mate_marked(F.col("id"), F.col("mate"))).collect()


def test_repeated_single_read_is_an_error_even_without_label(spark):
    df = spark.createDataFrame([("r", 1, ""), ("r", 1, "x")], "read string, mate int, label string")
    with pytest.raises(Exception, match="repeated read"):
        reads.single_read_truth(df).collect()


def test_lines_fastq_and_fasta_across_splits(spark, tmp_path):
    f = tmp_path / "x.fastq"
    f.write_text("".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'IIII' * (i % 7 + 1)}\n" for i in range(4000)))
    g = tmp_path / "x.fa"
    g.write_text("".join(f">s{i} a>b\nAC\nGT\n\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sequences.read_fastq(spark, str(f))
        assert got.count() == 4000 and got.filter("fault is not null").count() == 0
        assert got.filter("header <> concat('@r', rec)").count() == 0
        fa = sequences.read_fasta(spark, str(g))
        assert fa.filter("fault is null and seq = 'ACGT' and header like 's% a>b'").count() == 3000 == fa.count()
        assert lines.read_lines(spark, str(f)).agg(F.max("line_no")).first()[0] == 15999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lengths_of_records_over_many_splits(spark, tmp_path):
    rnd = random.Random(4)
    sequence = {"a": 40_000, "b x": 3, "c": 0, "d": 90_000, "e": 61}
    texts, want = [], []
    for f in range(2):
        lines_ = ["", " AC ", "GGT"] if f else []
        if f:
            want.append((None, 5, 3, "sequence before a header"))
        for name, n in sequence.items():
            seq = "".join(rnd.choice("ACGTacgtN") for _ in range(n))
            lines_ += [f">{name}", *(seq[i : i + 60] for i in range(0, n, 60)), *([""] if n % 2 else [])]
            want.append((name, n, sum(c in "GCgc" for c in seq), None))
        texts.append("\n".join(lines_))
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fa").write_text(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16000", "100000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sequences.fasta_lengths(spark, str(tmp_path))
            assert sorted(map(str, [tuple(r)[1:] for r in got.collect()])) == sorted(map(str, want))
            stats = catalog.length_stats(got.filter("fault is null").select("file", "length", "gc", F.lit(None).cast("long").alias("q30")), ["file"])
            whole = catalog.seq_stats(sequences.read_fasta(spark, str(tmp_path)).filter("fault is null"), ["file"])
            assert rows(stats.select(*whole.columns)) == rows(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def text_exchanges(df):
    """The exchanges of a plan that move texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_records_are_put_together_where_they_are_read(spark, tmp_path):
    for f in range(3):
        text = "".join(f"@r{f}.{i // 2}/{i % 2 + 1}\n{'ACGT' * (i % 9 + 1)}\n+\n{'IIII' * (i % 9 + 1)}\n" for i in range(1501 + f))
        (tmp_path / f"{f}.fastq").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        got = sequences.read_fastq(spark, str(tmp_path))
        assert got.filter("fault is null and header = concat('@r', regexp_extract(file, '([0-9]).fastq', 1), '.', rec div 2, '/', rec % 2 + 1)").count() == 4506 == got.count()
        per = sequences.read_units(spark, str(tmp_path), 4)
        assert len(text_exchanges(per)) == 1  # of the lines at edges
        splits = lines.scanned(spark, str(tmp_path)).select("file", "_split").distinct().count()
        assert splits > 20 and rows(per.groupBy(F.size("lines")).count()) == [(4, 4506)]
        pairs = sequences.read_pairs(spark, str(tmp_path)).select("file", "pair", F.col("r1.header").alias("r1"), F.col("r2.header").alias("r2"))
        assert pairs.count() == 751 + 751 + 752 and rows(reads.checked_pairs(pairs).groupBy("fault").count(), "fault", "count") == sorted([(None, 750 + 751 + 751), ("odd number of records", 2)], key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_tables_with_different_headers_are_one_scan(spark, tmp_path):
    for i in range(300):
        cols = [f"c{i % 7}", "k", f"c{i % 5}"] if i % 3 else ["k"]
        (tmp_path / f"{i:03}.tsv").write_text("\t".join(cols) + "\n" + "".join("\t".join(f"{i}-{r}-{c}" if c != "k" else '"a\tb"' for c in cols) + "\n" for r in range(3)) + "\n")
    (tmp_path / "x.tsv").write_text("")
    got = lines.read_tsv(spark, str(tmp_path))
    assert got.columns == ["k", "c1", "c2", "c4", "c5", "c0", "c3", "c6"] and got.count() == 900
    assert got.filter("k = 'a\tb'").count() == 900 and got.filter("c6 like '6-%'").count() == 0 and got.filter("c6 is not null").count() == sum(3 for i in range(300) if i % 3 and i % 7 == 6)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_faulty_records(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["@a", "AC", "+", "I", "@b", "AC"])], "file string, line_no long, value string")
    assert rows(sequences.fastq_records(df), "rec", "fault") == [(0, "lengths differ"), (1, "truncated")]
    empty = spark.createDataFrame([("f", i, v) for i, v in enumerate(["@a", "", "+", "", "@b", "AC", "+", ""])], "file string, line_no long, value string")
    assert rows(sequences.fastq_records(empty), "rec", "fault") == [(0, "truncated"), (1, "truncated")]
    inner = spark.createDataFrame([("f", ">h\n A C \n\tGT\r\n", True)], "file string, value string, marked boolean")
    assert rows(sequences.fasta_records(inner), "seq") == [("A CGT",)]
    fa = spark.createDataFrame([("f", "AC\n", False), ("f", "\n", False), ("f", ">h\nA\nC\n", False)], "file string, value string, marked boolean")
    assert rows(sequences.fasta_records(fa), "seq", "fault") == [("AC", "sequence before a header"), ("AC", None)]


def test_bad_rows_are_skipped_and_the_right_line_wins(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["r1 x\t\t5:0.3", "r1\tunclassified", "r2\t0", "@x\t3", "r3"])], "file string, line_no long, value string")
    assert rows(formats.parse_classify(df), "read_id", "taxid") == [("@x", 3), ("r1", None), ("r2", 0)]
    two = spark.createDataFrame([("f", 0, "readID\tseqID\ttaxID"), ("f", 1, "a\ts\t4"), ("f", 2, "a\ts\t5"), ("f", 3, "b\ts\t-")], "file string, line_no long, value string")
    assert rows(formats.parse_centrifuger(two), "read_id", "taxid") == [("a", 4), ("b", None)]


def test_formats_keep_to_their_rules(spark):
    of = lambda *values: spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line_no long, value string")
    truth, weight = formats.parse_cami_map(of("@a b\tg\t5\ts\t3", "c\tg\t5", "#x\tg\t5\ts", "d\tg\t5\ts\t-2"))
    assert rows(truth, "read_id") == [("@a b",), ("d",)] and rows(weight, "taxid", "weight") == [(5, 4)]
    row = lambda acc, size: "\t".join([acc, *["x"] * 5, "7", *["x"] * 18, size, *["x"] * 4, "2"])
    two = of(row("A", "1,000"), row("A", "2"), "short").union(of(row("A", "3"), row("B", "4")).withColumn("file", F.lit("g")))
    assert rows(formats.parse_assembly(two, {"f": 0, "g": 1}), "accession", "genome_size") == [("A", 2), ("B", 4)]
    log = formats.parse_time_log(of("\tCommand being timed: \"a Exit status: 9\"", "\tPercent of CPU this job got: 99%", "\tExit status: 1", "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02")).first()
    assert (log["cpu_percent"], log["exit_status"], log["elapsed_seconds"]) == (99.0, 1, 62.0)
    paths = spark.createDataFrame([("/x/GCF_1.1_a.fna",), ("/x/GCF_2.1_a.fna",)], "path string")
    known = spark.createDataFrame([("GCF_1.1",)], "accession string")
    assert rows(formats.missing_assemblies(paths, known)) == [("GCF_2.1",)]
    with pytest.raises(Exception, match="no assembly accession"):
        spark.createDataFrame([("/x/my_GCF_1.1.fna",)], "path string").select(text.accession_of_path(F.col("path"))).collect()


def test_databases_need_their_assemblies(spark):
    builds = spark.createDataFrame([(0, "/i/x.hixf", "l")], "ord int, path string, list string")
    targets = spark.createDataFrame([("l", "A", 5), ("l", "B", 6)], "list string, accession string, bytes long")
    assembly = spark.createDataFrame([("A", 1, 10, 2)], "accession string, species_taxid long, genome_size long, contig_count long")
    with pytest.raises(Exception, match="no assembly for B"):
        catalog.db_catalog(builds, targets, assembly).collect()
    assert rows(catalog.db_catalog(builds, targets.filter("accession = 'A'"), assembly)) == [("x", 5, 2, 10, 1, 1)]


def test_files_without_records_have_zeros(spark):
    df = spark.createDataFrame([("a", "GCAT", "IIII")], "file string, seq string, qual string")
    sizes = spark.createDataFrame([("a", 9), ("b", 0)], "file string, bytes long")
    got = {r["file"]: r for r in catalog.seq_stats(df, ["file"], "seq", "qual", sizes).collect()}
    assert (got["a"]["bytes"], got["a"]["gc_percent"], got["a"]["q30_percent"]) == (9, 50.0, 100.0)
    assert (got["b"]["records"], got["b"]["gc_percent"], got["b"]["n50"]) == (0, 0.0, 0)


def cohort_tables(spark):
    samples = spark.createDataFrame([("run_1_x", "c", "Case", "positive", "e1", 1.0, 2.0, None), ("run_2_x", "c", "Control", "zero", "e2", 0.0, 0.0, 0.5)], "sample string, cohort string, condition string, role string, run_accession string, c1 double, c2 double, total double")
    metadata = spark.createDataFrame([("c", 1, "case", 50, "F", 20.5, 100, 1.0, 2.0), ("c", 2, "control", 60, "M", 21.0, 200, 0.0, 0.0)], "cohort string, paper_sample int, condition string, age int, sex string, bmi double, source_reads long, c1 double, c2 double")
    return samples, metadata, spark.createDataFrame([("run_1_x", 10, 3.0), ("run_2_x", 20, 0.0)], "sample string, input_reads long, expected double")


def test_a_cohort_manifest_is_checked(spark):
    samples, metadata, depth = cohort_tables(spark)
    made = cohort.sample_manifest(samples, metadata, depth, "all")
    assert len(made.columns) == 17 and rows(made, "sample", "paper_sample_id", "condition", "sex", "paper_fna_total_percent") == [("run_1_x", "1", "case", "f", 3.0), ("run_2_x", "2", "control", "m", 0.5)]
    for bad, what in (((samples, metadata.filter("paper_sample = 1"), depth), "metadata"), ((samples, metadata.withColumn("condition", F.lit("case")), depth), "published"), ((samples, metadata.withColumn("c2", F.col("c2") + 1e-6), depth), "published"), ((samples, metadata, depth.limit(1)), "coverage"), ((samples, metadata.union(metadata), depth), "metadata")):
        with pytest.raises(Exception, match=what):
            cohort.sample_manifest(*bad, "all").select("age").collect()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("manifest", "definition")
    cohort.sample_manifest(samples, metadata, depth, "all")
    assert not jobs.getJobIdsForGroup("manifest")  # all checks ride on the job that computes the rows
    sig = spark.createDataFrame([("run_1_x", "a"), ("run_2_x", "b")], "sample string, tool string")
    assert [r["tool"] for r in cohort.signals(sig, made.select("sample", "role"), {"a": "A", "b": "B"}).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="no such tool: b"):
        cohort.signals(sig, made.select("sample", "role"), {"a": "A"}).collect()
    with pytest.raises(Exception, match="no such sample"):
        cohort.signals(sig, made.select("sample", "role").limit(1), {"a": "A", "b": "B"}).collect()
    parts = spark.createDataFrame([(None, 5.0, 100, 1, 1, 2, 1, 1, 4, 0)], "expected double, percent double, input_reads long, strict long, tied long, supported long, non_target long, unmapped long, candidate long, missing long")
    assert rows(cohort.audit(parts), "expected", "supported_rate", "supported_rpm") == [(5.0, 0.5, 20000.0)]
    for bad in (parts.withColumn("supported", F.lit(3)), parts.withColumn("candidate", F.lit(5)), parts.withColumn("missing", F.lit(1))):
        with pytest.raises(Exception, match="add up"):
            cohort.audit(bad).collect()


def test_sums_below_in_ranges(spark):
    import random

    rnd = random.Random(2)
    data = sorted({(rnd.choice("ab"), rnd.randint(0, 300)): rnd.randint(0, 5) for _ in range(400)}.items())
    df = spark.createDataFrame([(k, v, n) for (k, v), n in data], "k string, v int, n int")
    want = [(k, v, sum(n for (j, w), n in data if j == k and w < v)) for (k, v), _ in data]
    assert sorted(tuple(r) for r in cohort.sum_below(df, ["k"], "v", "n", "s").select("k", "v", "s").collect()) == want


def test_conflicting_species_truth_is_an_error(spark):
    r = spark.createDataFrame([("f", "a", "x"), ("f", "a", "y")], "file string, read_id string, label string")
    k = spark.createDataFrame([("x", 1), ("y", 2)], "name string, taxid long")
    with pytest.raises(Exception, match="conflicting taxa"):
        formats.parse_species_truth(r, k)[0].collect()


def test_gates_raise(spark):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    gates.assert_empty(df.filter("n > 1"), "none")
    with pytest.raises(ValueError, match="some"):
        gates.assert_empty(df, "some")
    assert gates.required_columns(df, ["k", "z"]) == ["z"]


def test_metadata_needs_its_columns_and_samples_two_files(spark):
    df = spark.createDataFrame([("long name", 1), ("other", 2)], "cohort string, age int")
    assert rows(formats.project_metadata(df, {"long name": "L"}, ["age"])) == [("L", 1)]
    with pytest.raises(ValueError, match="bmi"):
        formats.project_metadata(df, {"long name": "L"}, ["age", "bmi"])
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "sample string, path string")
    assert rows(gates.paired_files(files)) == [("b", 1)]


def test_written_tables_can_be_removed(spark):
    import os

    from taxeval.operators import durable

    durable.written(spark.range(3), "here")
    folder = durable.shared_folder(spark).removeprefix("file://")
    assert [x for x in os.listdir(folder) if x.startswith("here-")] and durable.remove_written(spark) >= 1
    assert not [x for x in os.listdir(folder) if x.startswith("here-")]


def values(m):
    """A map of values as Python's."""
    return {k: v.toPython() for k, v in m.items()}


def test_run_records_from_files(spark, tmp_path):
    meta = '{"exp": "e", "tool": "t", "dataset": "d%s", "return_code": %s, "elapsed_seconds": 2.5, "resource": {"max_rss_kb": 2097152, "user_time_seconds": 1.5}}'
    for name, head, metrics in (
        ("one/a", meta % (1, 0), '{"x": 1.5, "n": 3, "v": "text", "flag": true, "none": null, "quoted": "3.5", "purity_genus": 1, "profile_metric_version": "%s"}' % evaluation.VERSION), ("one/b", meta % (2, 1), "{}"),
        ("one/c", meta % (3, "null"), "[1]"), ("one/d", "{broken", "{}"), ("two/e", meta % (1, 0), '{"x": 9}'), ("one/f", meta % (4, 0), None),
    ):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "meta.json").write_text(head)
        if metrics is not None:
            (tmp_path / name / "metrics.json").write_text(metrics)
    df = records.read_runs(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    got = {r["dir"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(got) == {"a", "c", "e", "f"} and {k: r["source"] for k, r in got.items()} == {"a": 0, "c": 0, "e": 1, "f": 0}
    a = values(got["a"]["metrics"])
    assert a == {"x": 1.5, "n": 3, "v": "text", "flag": True, "none": None, "quoted": "3.5", "purity_genus": 1, "profile_metric_version": evaluation.VERSION} and isinstance(a["flag"], bool)
    assert got["c"]["metrics"] == {} == got["f"]["metrics"]
    family = {r["dir"].rsplit("/", 1)[1]: (r["has_profile"], r["current"]) for r in runs.metric_family(df, evaluation.VERSION).collect()}
    assert family == {"a": (True, True), "c": (False, False), "e": (False, False), "f": (False, False)}
    named = df.select("*", F.lit("c").alias("collection"), F.lit("").alias("display"), F.col("sample_id").alias("sample"), F.col("elapsed_seconds").alias("elapsed"))
    assert [r["dir"].rsplit("/", 1)[1] for r in runs.prefer_later(named.drop("collection").withColumn("collection", F.lit(""))).orderBy("dir").collect()] == ["c", "f", "e"]
    rolled = runs.collection_aggregate(named).first()
    assert values(rolled["metrics"]) == {"x": 5.25, "n": 3.0, "purity_genus": 1.0}  # texts, booleans and nulls aren't averaged
    summed = {r["dir"].rsplit("/", 1)[1]: values(r["metrics"]) for r in runs.summary_records(named, "e").collect()}
    assert summed["e"] == {"x": 9, "run_elapsed_seconds": 2.5, "resource_max_rss_kb": 2097152, "resource_user_time_seconds": 1.5}


def test_runs_with_equal_keys_keep_their_rows(spark):
    df = spark.createDataFrame([("a", {"x": 1.0}), ("a", {"x": 2.0, "y": 3.0}), ("b", {})], "k string, metrics map<string,double>")
    wide = runs.metric_wide(df, ["k"])
    assert wide.columns == ["k", "x", "y"] and rows(wide.select("k", *[F.to_json(c).alias(c) for c in "xy"])) == sorted([("a", "1.0", None), ("a", "2.0", "3.0"), ("b", None, None)], key=str)


def test_names_of_databases(spark):
    df = spark.createDataFrame([("/a/b/", ""), ("/a/b", None), ("b/.", ""), ("/", ""), (None, "x"), ("/q", "own")], "db string, db_name string").withColumn("metrics", F.create_map().cast("map<string,double>")).withColumn("elapsed", F.lit(1.0)).withColumn("max_rss_kb", F.lit(0)).withColumn("tool", F.lit("t"))
    assert [r["db_name"] for r in runs.run_fields(df, {"t": "T"}).collect()] == ["b", "b", "b", None, "x", "own"]


def test_summary_of_predictions(spark):
    text_lines = ["r1\t12:3", "r2\t\t7|x", "r3\t-", "r4\tNA:1", "r5\tname", "r6", "r7\t12"]
    df = spark.createDataFrame([("f", x.split("\t")) for x in text_lines], "file string, cells array<string>")
    assert rows(perread.run_summary(df, ["file"])) == [("f", 7, 3, 4, 2)]


def test_headers_hold_until_the_next_one(spark, monkeypatch):
    rnd = random.Random(3)
    data = []
    for f in range(30):
        for i in range(rnd.choice([1, 40, 200])):
            head = rnd.random() < (0.5 if f % 2 else 0.02)
            data.append((f"f{f}", i, f"h{i}" if head else None))
    df = spark.createDataFrame(data, "file string, line_no long, head string")
    want, last = [], {}
    for f, i, h in data:
        if h:
            last[f] = h
        else:
            want.append((f, i, last.get(f)))
    for run, most in ((7, 10**6), (64, 0), (4096, 10**6)):
        monkeypatch.setattr(formats, "RUN", run)
        monkeypatch.setattr(formats, "SPLITS", most)
        got = formats.carried(df.filter("head is null").drop("head"), df.filter("head is not null"))
        assert rows(got, "file", "line_no", "head") == sorted(want, key=str)


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x y")], "k string, v string")
    sinks.write_tsv(df, str(tmp_path / "t"), ["v", "k"])
    got = lines.read_tsv(spark, [str(tmp_path / "t")])
    assert got.columns == ["v", "k"] and rows(got) == sorted([(None, "a"), ("x y", "b")], key=str)


def test_cami_profiles_are_written_with_their_header(spark, tmp_path):
    df = spark.createDataFrame([(7, "species", 0.25), (9, "genus", 3.0)], "taxid long, rank string, value double")
    sinks.write_cami(df.coalesce(1), str(tmp_path / "p"))
    (written,) = (tmp_path / "p").glob("*.csv")
    assert written.read_text().splitlines()[0] == "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"
    back = formats.parse_cami_profile(lines.read_lines(spark, str(tmp_path / "p")))
    assert rows(back, "taxid", "rank", "value") == rows(df, "taxid", "rank", "value")
    made = formats.cami_lines(df.withColumn("line_no", F.col("taxid")))
    assert [r["value"].split("\t")[0] for r in made.orderBy("line_no").collect()] == ["@@TAXID", "7", "9"]


def test_weights_of_contigs(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["a\tx\t5\tx\t3", "a\tx\t5\tx\t7", "b\tx\t6\tx", "c\tx\t6\tx\t-2", "d\tx\tbad\tx\t3"])], "file string, line_no long, value string")
    assert rows(formats.cami_weights(df), "read_id", "weight") == [("a", 7), ("b", 1), ("c", 1)]


def test_roll_up_of_published_kind(spark):
    data = [("c", "s1", "t", "d", {"run_elapsed_seconds": 2.0, "resource_max_rss_gb": 1.0, "f1": 0.5}), ("c", "s2", "t", "d", {"run_elapsed_seconds": 3.0, "resource_max_rss_gb": 4.0, "f1": 1.0}), (None, "s3", "t", "d", {"f1": 9.0}), ("c", "s1", "u", None, {}), ("c", "s1", "", "d", {})]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "collection string, sample string, tool string, db_name string, metrics map<string,double>, ord int")
    df = df.withColumn("dataset", F.lit("x")).withColumn("source", F.lit(0)).withColumn("display", F.when(F.col("sample") == "s2", "Shown"))
    got = {(r["dataset"], r["tool"]): r.asDict() | {"metrics": values(r["metrics"])} for r in runs.collection_aggregate(df).collect()}
    assert set(got) == {("c", "t"), ("c", "u"), ("x", "t")}
    assert got["c", "t"]["metrics"] == {"run_elapsed_seconds": 5, "resource_max_rss_gb": 4.0, "f1": 0.75} and isinstance(got["c", "t"]["metrics"]["run_elapsed_seconds"], int) and got["c", "t"]["sample_ids"] == ["s1", "s2"] and got["c", "t"]["display_dataset"] == "Shown"
    assert got["c", "u"]["metrics"] == {} and got["c", "u"]["db_name"] == "" and got["c", "u"]["sample_count"] == 1
    assert got["x", "t"]["metrics"] == {"f1": 9.0} and got["x", "t"]["sample_count"] is None


def test_a_later_run_replaces_an_earlier_one_by_database_name(spark):
    data = [(0, None, "d", None, "t", "/a/x", "x"), (1, None, "d", None, "t", "/b/x", "x"), (2, None, "d", None, "t", "/c", None), (3, None, "d", None, "t", "/e", ""), (4, None, "d", None, "", "/e", "x"), (5, "c", "d", None, "t", "", "x"), (6, "c", "d", "d", "t", "", "x"), (7, "c", "d", "e", "t", "", "x")]
    df = spark.createDataFrame(data, "ord int, collection string, dataset string, sample string, tool string, db string, db_name string").withColumn("source", F.lit(0)).withColumn("display", F.lit(""))
    assert [r[0] for r in rows(runs.prefer_later(df), "ord")] == [1, 3, 4, 6, 7]


def test_auc_is_antisymmetric(spark):
    df = spark.createDataFrame([("k", float(v), bool(p)) for v, p in [(1, 0), (2, 0), (2, 1), (3, 1), (0, 1)]], "k string, v double, p boolean")
    a = cohort.auc(df, ["k"], "v", "p").first()["auc"]
    b = cohort.auc(df.withColumn("v", -F.col("v")), ["k"], "v", "p").first()["auc"]
    assert a == pytest.approx(3.5 / 6) and a + b == pytest.approx(1.0)


def drawn_plainly(data, strata_of, rounds, seed):
    """{(tool, round): auc} of rows (tool, sample, value, positive) by counting pairs."""
    groups = {}
    for sample, stratum in sorted(strata_of.items()):
        groups.setdefault(stratum, []).append(sample)
    out = {}
    for r in range(rounds):
        weight = dict.fromkeys(strata_of, 0)
        for stratum, samples in groups.items():
            for slot in range(len(samples)):
                text = "|".join([str(seed), str(r), *(str(x).lower() if isinstance(x, bool) else str(x) for x in stratum), str(slot)])
                weight[samples[int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % len(samples)]] += 1
        for tool in {t for t, *_ in data}:
            p = [(v, weight[s]) for t, s, v, q in data if t == tool and q]
            z = [(v, weight[s]) for t, s, v, q in data if t == tool and not q]
            total = sum(w for _, w in p) * sum(w for _, w in z)
            out[tool, r] = sum(a * b * (1 if v > u else 0.5 if v == u else 0) for v, a in p for u, b in z) / total if total else None
    return out


def test_bootstrap_by_vectors_against_plain_draws(spark, monkeypatch):
    rnd = random.Random(5)
    data = [(t, f"s{i:02}", float(rnd.choice([1, 2, 2, 3, 5])), i % 3 == 0) for t in "ab" for i in range(14)]
    strata_of = {s: (q, "x" if int(s[1:]) % 2 else "y") for _, s, _, q in data}
    df = spark.createDataFrame([(*r, strata_of[r[1]][1]) for r in data], "tool string, sample string, value double, positive boolean, cohort string")
    for rounds, chunk in ((60, 1000), (60, 7)):
        monkeypatch.setattr(cohort, "ROUNDS", chunk)
        got = {(r["tool"], r["round"]): r["auc"] for r in cohort.bootstrap_auc(df, ["tool"], ["positive", "cohort"], "sample", "value", "positive", rounds, 7).collect()}
        assert got == pytest.approx(drawn_plainly(data, strata_of, rounds, 7))


def test_many_rounds_make_no_rows_of_samples_and_rounds(spark):
    df = spark.createDataFrame([("a", f"s{i}", float(i % 7), i % 2 == 0, "x") for i in range(40)], "tool string, sample string, value double, positive boolean, cohort string")
    units = df.select("positive", "sample", F.row_number().over(Window.partitionBy("positive").orderBy("sample")).cast("long").alias("_i")).withColumn("_n", F.lit(20).cast("long")).withColumn("_i", F.col("_i") - 1)
    weights, each = cohort.draw_weights(units, ["positive"], 10_000, 3)
    assert each == 1000 and weights.count() == 40 * 10
    draws = cohort.bootstrap_auc(df, ["tool"], ["positive"], "sample", "value", "positive", 10_000, 3)
    assert rows(draws.groupBy("tool").agg(F.count("auc"), F.max("round"))) == [("a", 10_000, 9999)]


def test_percentiles_of_counted_values(spark):
    rnd = random.Random(2)
    data = [(k, float(rnd.choice([1, 2, 3, 50, 7.5]) if k == "few" else rnd.random())) for k in ("few", "many") for _ in range(501 if k == "few" else 800)] + [("one", 4.0), ("few", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = cohort.percentiles(df, ["k"], "v", {"low": 0.025, "middle": 0.5, "high": 0.975, "least": 0, "most": 1})
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975), ("least", 0.0), ("most", 1.0))])
    assert [[x if isinstance(x, str) else pytest.approx(x) for x in r] for r in rows(want)] == [list(r) for r in rows(got)]


def test_partial_association_by_cohort_and_pooled(spark):
    rnd = random.Random(6)
    data = []
    for c in "xyz":
        for _ in range(40):
            a, b, age = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(50, 9)
            data.append(("t", c, 2 * a + 0.1 * b + 0.02 * age + rnd.gauss(0, 0.5), a, b, age))
    df = spark.createDataFrame(data, "tool string, cohort string, y double, c2 double, c1 double, age double")
    got = {(r["scope"], r["cohort"], r["predictor"]): r for r in cohort.partial_association(df, ["tool"], "cohort", "y", ["c2", "c1"], ["age"]).collect()}
    assert len(got) == 8 and {k[:2] for k in got} == {("cohort", c) for c in "xyz"} | {("pooled", None)}
    own = cohort.partial_effects(df, ["tool", "cohort"], "y", ["c2", "c1"], ["age"]).collect()
    for r in own:
        one = got["cohort", r["cohort"], r["term"]]
        assert one["standardized_beta"] == r["beta"] and one["samples"] == 40 and one["ci_high"] - one["ci_low"] == pytest.approx(2 * 1.959964 * r["se"], rel=1e-6) and one["tau_squared"] is None
    pooled = got["pooled", None, "c2"]
    assert pooled["samples"] == 120 and 0.9 < pooled["standardized_beta"] < 1 and pooled["p_value"] < 1e-10 and pooled["ci_low"] < pooled["standardized_beta"] < pooled["ci_high"] and pooled["i_squared"] is not None
    assert got["pooled", None, "c1"]["p_value"] > 1e-4 or abs(got["pooled", None, "c1"]["standardized_beta"]) < 0.3


def test_association_tells_means_and_auc(spark):
    df = spark.createDataFrame([("a", float(v), c, float(i)) for i, (v, c) in enumerate([(1, 0), (2, 0), (3, 1), (2, 1), (5, 1), (0, 0)])], "tool string, y double, x int, age double")
    r = cohort.association(df, ["tool"], "y", "x", ["age"]).first()
    assert (r["n_case"], r["n_control"], r["case_mean"], r["control_mean"]) == (3, 3, pytest.approx(10 / 3), 1.0) and r["auc"] == pytest.approx(8.5 / 9)


def test_two_appends_equal_one_full_roll_up(spark, tmp_path):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["c", "d", None]), f"d{rnd.randrange(5)}", f"s{rnd.randrange(3)}", rnd.choice(["t", "u", ""]), rnd.choice(["x", None]), i % 2, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(data, "ord int, collection string, dataset string, sample string, tool string, db_name string, source int, v double").withColumn("display", F.lit(""))
    want = rows(runs.prefer_later(df.filter("tool <> ''")), "ord", "v")
    store = str(tmp_path / "store")
    keys = ["tool", "db_name"]  # coarser than what makes runs replace each other
    first = df.filter("ord < 120 and tool <> ''")
    assert sinks.append_keyed(spark, store, first, keys, runs.prefer_later, 8) <= 8
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    assert sinks.append_keyed(spark, store, df.filter("ord >= 120 and tool = 't' and db_name = 'x'"), keys, runs.prefer_later, 8) <= 4
    assert any(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())  # buckets without new rows weren't touched
    sinks.append_keyed(spark, store, df.filter("ord >= 120 and tool <> '' and not (tool = 't' and db_name <=> 'x')"), keys, runs.prefer_later, 8)
    assert rows(spark.read.parquet(store), "ord", "v") == want
    assert sinks.append_keyed(spark, store, df.limit(0), keys, runs.prefer_later) == 0


def test_digests_of_files(spark, tmp_path):
    import gzip

    from taxeval.sources import digests

    texts = {"a.fa": b">x\nACGT\r\nAC\n", "b": b"no end", "c": b"", "d": b"\n\n", "e.bin": bytes(range(256)) * 3000, "f.txt": b"\n", "g.fa.gz": gzip.compress(b"ACGT\n")}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in digests.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in texts.items()}


def test_states_of_scans_add_up(spark):
    df = spark.createDataFrame([("f", i % 7 + 1, 1, None) for i in range(50)] + [("g", 0, 0, 0)], "file string, length int, gc long, q30 long")
    parts = catalog.length_states(df.limit(20), ["file"]).unionByName(catalog.length_states(df.exceptAll(df.limit(20)), ["file"]))
    assert rows(catalog.stats_of_states(parts, ["file"])) == rows(catalog.length_stats(df, ["file"]))
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "file string, bytes long, modified long")
    assert rows(catalog.not_scanned(files, files.filter("file = 'a'").unionByName(files.filter("file = 'b'").withColumn("modified", F.lit(5).cast("long"))))) == [("b", 2, 6)]


# Published effects, standard errors and meta-analysis of one tool and metric, three cohorts.
EFFECTS = [(0.252721, 0.179609), (-0.210661, 0.180845), (0.112878, 0.088982)]
META = {"effect": 0.064306, "low": -0.178626, "high": 0.307238, "tau2": 0.025053, "q": 3.642451, "i2": 0.450919}


def test_meta_analysis_matches_published_numbers(spark):
    df = spark.createDataFrame([("a", e, s) for e, s in EFFECTS], "k string, effect double, se double")
    r = cohort.meta(df, ["k"]).first()
    for name, want in META.items():
        assert r[name] == pytest.approx(want, abs=2e-5), name
    assert r["p"] == pytest.approx(0.603870, abs=1e-3)  # by the normal distribution, of the effect over its error


def test_standardised_effect_and_p_match_published_numbers(spark):
    d, se = cohort.standardised_effect(F.lit(1.393307), F.lit(74), F.lit(53))
    r = spark.range(1).select(d.alias("d"), se.alias("se")).first()
    assert r["d"] == pytest.approx(0.252721, abs=2e-6) and r["se"] == pytest.approx(0.179609, abs=2e-6)
    assert cohort.student_p(1.393307, 74 + 53 - 6) == pytest.approx(0.166081, abs=2e-6)


def test_ols_recovers_a_line_with_two_slopes(spark):
    df = spark.createDataFrame([("g", float(i), float(i * i % 7), 2.0 + 3 * i - 0.5 * (i * i % 7)) for i in range(40)], "g string, a double, b double, y double")
    got = {r["term"]: r["beta"] for r in cohort.ols(df, ["g"], "y", ["a", "b"]).collect()}
    assert got == pytest.approx({"const": 2.0, "a": 3.0, "b": -0.5}, abs=1e-8)


def test_alignment_fate(spark):
    aln = spark.createDataFrame([(1, "t", 5, 9), (1, "o", 5, 8), (2, "t", 5, 9), (2, "o", 5, 9), (3, "o", 9, 9), (3, "t", 1, 1)], "read int, clade string, nmatch int, aln_len int")
    cand = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "read int")
    assert rows(cohort.alignment_fate(cand, aln, "t", ["read"])) == [(1, "strict"), (2, "tied"), (3, "non_target"), (4, "unmapped")]
