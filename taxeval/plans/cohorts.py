"""Queries on sequences, catalogs and cohort statistics: documents are sequences, labels roles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, cohort, profiles, taxonomy
from ..operators import reads as read_ops
from ..operators.durable import shared_folder, written
from ..sources import sequences
from .bindings import CLOSURE, LIFTS, NODES, Bound, with_sql
from .registry import query, rounded

STATS = """d as (select source as file, length(text)::bigint as n, length(regexp_replace(text, '[^GCgc]', '', 'g'))::bigint as gc, length(regexp_replace(text, '[^?-~]', '', 'g'))::bigint as q30 from documents),
h as (select file, n, count(*) * n as b from d group by 1, 2), r as (select *, sum(b) over (partition by file order by n desc) as cum, sum(b) over (partition by file) as total from h),
n50 as (select file, coalesce(max(n) filter (cum * 2 >= total and total > 0), 0)::bigint as n50 from r group by 1)"""


@query("seq_stats_states", f"with {STATS} select file, count(*) as records, sum(n)::bigint as bases, min(n) as min_length, max(n) as max_length, round(sum(n) / count(*), 6) as mean_length, round(100 * sum(gc) / sum(n), 6) as gc_percent, round(100 * sum(q30) / sum(n), 6) as q30_percent, max(n50) as n50 from d join n50 using (file) group by file")
def q_seq_states(b: Bound) -> DataFrame:
    """seq_stats of two scans whose states are stored and added up."""
    d = b.t("documents")
    size, gc, q30 = (F.length(c).cast("long") for c in ("text", F.regexp_replace("text", "[^GCgc]", ""), F.regexp_replace("text", "[^?-~]", "")))
    scan = lambda rows: written(catalog.length_states(rows.select(F.col("source").alias("file"), size.alias("length"), gc.alias("gc"), q30.alias("q30")), ["file"]), "states")
    return rounded(catalog.stats_of_states(scan(d.filter("doc_id % 3 = 0")).unionByName(scan(d.filter("doc_id % 3 <> 0"))), ["file"]))


@query("seq_stats", f"with {STATS} select file, count(*) as records, sum(n)::bigint as bases, min(n) as min_length, max(n) as max_length, round(sum(n) / count(*), 6) as mean_length, round(100 * sum(gc) / sum(n), 6) as gc_percent, round(100 * sum(q30) / sum(n), 6) as q30_percent, max(n50) as n50 from d join n50 using (file) group by file")
def q_stats(b: Bound) -> DataFrame:
    return rounded(catalog.seq_stats(b.t("documents").select(F.col("source").alias("file"), "text"), ["file"], "text", "text"))


@query("n50", f"with {STATS} select file, n50 from n50")
def q_n50(b: Bound) -> DataFrame:
    return catalog.n50(b.t("documents").select(F.col("source").alias("file"), F.length("text").cast("long").alias("length")), ["file"])


@query("seq_stats_merged", """with d as (select length(text)::bigint as n, length(regexp_replace(text, '[^GCgc]', '', 'g'))::bigint as gc, case when lang = 'lang1' or doc_id % 2 = 0 then length(regexp_replace(text, '[^?-~]', '', 'g'))::bigint end as q30 from documents), h as (select n, count(*) * n as b from d group by 1),
r as (select *, sum(b) over (order by n desc) as cum, sum(b) over () as total from h)
select 'all' as grp, count(*) as records, sum(n)::bigint as bases, min(n) as min_length, max(n) as max_length, round(sum(n) / count(*), 6) as mean_length, round(100 * sum(gc) / sum(n), 6) as gc_percent, round(100 * sum(q30) / sum(n), 6) as q30_percent, (select max(n) filter (cum * 2 >= total) from r)::bigint as n50 from d""")
def q_merged(b: Bound) -> DataFrame:
    """Some of the files are FASTQ: Q30 counts their bases, over all bases of the group."""
    qual = F.when((F.col("lang") == "lang1") | (F.col("doc_id") % 2 == 0), F.col("text"))
    return rounded(catalog.seq_stats(b.t("documents").select(F.lit("all").alias("grp"), "text", qual.alias("qual")), ["grp"], "text", "qual"))


@query("exact_dedup", """with p as (select lang, text, count(*) as n, length(text)::bigint as size from documents group by 1, 2)
select lang, sum(n)::bigint as input_records, count(*) as retained_records, sum(n * size)::bigint as input_bases, sum(size)::bigint as retained_bases, (sum(n) - count(*))::bigint as duplicate_records, (sum(n * size) - sum(size))::bigint as duplicate_bases from p group by lang""")
def q_dedup(b: Bound) -> DataFrame:
    return catalog.exact_copies(b.t("documents").select("lang", "text"), "lang", "text")


@query("dataset_catalog", """with s as (select source as dataset, count(*) as records, sum(n_chars)::bigint as bases, avg(n_chars) as m from documents group by 1)
select dataset, case when dataset = 'src1' then 7 else records end as records, bases, case when m - floor(m) = 0.5 then (2 * round(m / 2))::bigint else round(m)::bigint end as mean_length, case when dataset = 'src1' then 'First' else dataset end as label, 'single FASTQ' as input_type from s where dataset <> 'src2'""")
def q_datasets(b: Bound) -> DataFrame:
    s = b.t("documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("bases"), F.avg("n_chars").alias("mean_length"))
    m = s.filter(F.col("dataset").isin("src1", "src2")).select("dataset", (F.col("dataset") == "src1").alias("public"), F.when(F.col("dataset") == "src1", F.lit(7).cast("long")).alias("records"), F.when(F.col("dataset") == "src1", "First").alias("label"), F.lit(None).cast("string").alias("input"))
    return catalog.dataset_catalog(s, m, ["src3", "src1"])


@query("described_datasets", """with d as (select doc_id, doc_id % 6 as k, doc_id % 4 as m, 1 + doc_id % 3 as n from documents)
select 'd' || doc_id as dataset, case k when 0 then n when 1 then 1 when 2 then 2 else n end::bigint as samples,
  case when k = 5 then 'own' when k = 0 then case when m = 0 then 'paired FASTQ' else 'mixed FASTA/FASTQ' end when k = 1 then 'paired FASTQ' when m = 0 then 'single FASTQ' when m = 1 then 'contig FASTA' when n > 1 then 'mixed FASTA/FASTQ' else 'single FASTQ' end as input_type,
  case when k = 5 then 'label' when m = 0 then 'per-read mapping + profile' when m = 1 then 'profile only' when m = 2 then 'per-read mapping only' else 'unknown' end as truth from d""")
def q_described(b: Bound) -> DataFrame:
    d = b.t("documents").select("doc_id", (F.col("doc_id") % 6).alias("k"), (F.col("doc_id") % 4).alias("m"), (1 + F.col("doc_id") % 3).alias("n"))
    k, m = F.col("k"), F.col("m")
    path = lambda i: F.concat(F.lit("f"), F.col("doc_id"), F.lit("-"), i)
    files = F.transform(F.sequence(F.lit(1).cast("long"), "n"), path)
    none = F.lit(None).cast("string")
    sample = F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda i: F.struct((m == 0).alias("paired"), F.lit(None).cast("array<string>").alias("reads")))
    datasets = d.select(
        F.concat(F.lit("d"), "doc_id").alias("dataset"), F.when(k == 5, "own").alias("input_type"), F.when(k == 5, "label").alias("truth_label"), F.when(m == 0, "dir").alias("truth_dir"), F.when(m <= 1, "p").alias("truth_profile"), F.when(m <= 2, "x").alias("truth_map"),
        (k == 1).alias("paired"), F.when(k == 2, "strain_madness").otherwise(none).alias("kind"), F.when(k == 0, sample).alias("samples"), F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).alias("sample_ids"), files.alias("reads"))
    formats = d.select(m.alias("m"), F.posexplode(files).alias("pos", "path")).select("path", F.when((m == 1) | ((m > 1) & (F.col("pos") % 2 == 1)), "fasta").otherwise("fastq").alias("format"))
    return catalog.described_datasets(datasets, formats)


@query("db_catalog", """select 'db' || n_nationkey as db, sum(o_orderkey)::bigint as file_bytes, count(*) * 3::bigint as contigs, sum(o_custkey)::bigint as bases, count(*) as assemblies, count(distinct o_custkey % 50) as species
from nation join orders on n_nationkey % 5 = o_orderkey % 5 where n_nationkey % 2 = 0 group by n_nationkey""")
def q_dbs(b: Bound) -> DataFrame:
    k = F.col("n_nationkey")
    builds = b.t("nation").select(k.alias("ord"), F.concat(F.lit("/x/db"), k, F.lit(".syldb")).alias("path"), F.when(k % 2 == 0, F.concat(F.lit("list"), k % 5)).alias("list"))
    o = b.t("orders")
    acc = F.concat(F.lit("a"), F.col("o_orderkey")).alias("accession")
    targets = o.select(F.concat(F.lit("list"), F.col("o_orderkey") % 5).alias("list"), acc, F.col("o_orderkey").alias("bytes"))
    assembly = o.select(acc, (F.col("o_custkey") % 50).alias("species_taxid"), F.col("o_custkey").alias("genome_size"), F.lit(3).cast("long").alias("contig_count"))
    return catalog.db_catalog(builds, targets, assembly)


@query("ref_manifest", "select 'GCF_' || lpad(doc_id::varchar, 9, '0') || '.1' as reference_name, 'GCF_' || lpad(doc_id::varchar, 9, '0') || '.1' as accession, sha256(text) as sha256, n_chars as bases, 1 as records, 'RefSeq' as source_kind, lang as clade from documents where doc_id % 3 <> 0 union all select 'agg' || doc_id, '', sha256(text), n_chars, 1, 'paper_aggregate', lang from documents where doc_id % 3 = 0")
def q_manifest(b: Bound) -> DataFrame:
    d = b.t("documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("agg"), "doc_id")).otherwise(F.concat(F.lit("GCF_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".1")))
    path = F.concat(F.lit("/r/"), name, F.lit(".fna")).alias("path")
    made = catalog.reference_manifest(d.select(path, F.col("text").cast("binary").alias("content")), d.select(path, F.lit(1).alias("records"), F.col("n_chars").alias("bases")), d.select(name.alias("reference_name"), F.col("lang").alias("clade")))
    return made.select("reference_name", "accession", "sha256", "bases", "records", "source_kind", "clade")


FASTQ = "select source as file, doc_id as rec, case when doc_id % 7 = 3 or text = '' then 'truncated' when doc_id % 5 = 0 then 'lengths differ' when doc_id % 5 = 1 then 'no @' when doc_id % 5 = 2 then 'no +' end as fault, case when doc_id % 7 = 3 then 0 else length(replace(text, chr(10), ' ')) end::bigint as n from documents"


def fastq(b: Bound) -> DataFrame:
    """Documents as FASTQ lines; the number of a record is its document's."""
    k = F.col("doc_id")
    seq = F.when(k % 7 == 3, "").otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    four = F.array(F.concat(F.when(k % 5 == 1, ">").otherwise("@"), k), seq, F.when(k % 5 == 2, "x").otherwise("+"), F.when(k % 5 == 0, F.concat(seq, F.lit("I"))).otherwise(seq))
    rows = b.t("documents").select(F.col("source").alias("file"), k, F.posexplode(four).alias("pos", "value"))
    return sequences.fastq_records(rows.select("file", (k * 4 + F.col("pos")).alias("line_no"), "value"))


@query("fastq_check", FASTQ)
def q_fastq(b: Bound) -> DataFrame:
    return fastq(b).select("file", "rec", "fault", F.length("seq").cast("long").alias("n"))


@query("head_reads", FASTQ + " where doc_id < 50")
def q_head(b: Bound) -> DataFrame:
    return sequences.head_records(fastq(b), 50).select("file", "rec", "fault", F.length("seq").cast("long").alias("n"))


def as_files(rows: DataFrame, name: str) -> str:
    """A folder of text files with the lines of rows."""
    base = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(base)
    return base


@query("fastq_source", "select doc_id, length(text)::bigint as n, case when text = '' then 'truncated' end as fault, doc_id % 2 = 0 as paired from documents where text is not null and text not like '%' || chr(13) || '%'")
def q_fastq_source(b: Bound) -> DataFrame:
    """Documents as FASTQ files, read back; in a second set of files each even one has a mate."""
    d = b.t("documents").filter(~F.contains("text", F.lit("\r")))
    seq = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    of = lambda head: F.concat_ws("\n", F.concat(F.lit("@"), F.col("doc_id"), F.lit(head)), seq, F.lit("+"), seq)
    read = sequences.read_fastq(b.spark, as_files(d.select(of(" x")), "fastq"))
    pairs = sequences.read_pairs(b.spark, as_files(d.filter("doc_id % 2 = 0").select(F.concat_ws("\n", of("/1"), of("/2"))), "fastq-pairs"))
    heads = read_ops.checked_pairs(pairs.select(F.col("r1.header").alias("r1"), F.col("r2.header").alias("r2"))).filter("fault is null")
    mates = heads.select(F.regexp_extract("r1", "[0-9]+", 0).cast("long").alias("doc_id"), F.lit(True).alias("paired"))
    made = read.select(F.regexp_extract("header", "[0-9]+", 0).cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), "fault")
    return made.join(mates, "doc_id", "left").fillna(False, ["paired"])


@query("fasta_source", r"""with t as (select lang, doc_id, regexp_replace(text, '\s', '', 'g') as s from documents where text is not null)
select lang, count(*) as records, sum(length(s))::bigint as bases, min(length(s))::bigint as min_length, max(length(s))::bigint as max_length, sum(length(regexp_replace(s, '[^GCgc]', '', 'g')))::bigint as gc from t group by 1""")
def q_fasta_source(b: Bound) -> DataFrame:
    """Documents as FASTA files in lines of 60 letters: lengths of records without their sequences."""
    d = b.t("documents").filter("text is not null")
    rows = F.regexp_replace(F.regexp_replace("text", r"\s", ""), "(.{60})", "$1\n")
    got = sequences.fasta_lengths(b.spark, as_files(d.select(F.concat(F.lit(">"), F.col("lang"), F.lit(" "), F.col("doc_id"), F.lit("\n"), rows)), "fasta"))
    made = got.filter("fault is null").groupBy(F.split("header", " ")[0].alias("lang"))
    return made.agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bases"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("gc").alias("gc"))


@query("fasta_check", r"""select source as file, 'd' || doc_id || ' x' as header, length(regexp_replace(text, '^\s+|\s*\n\s*|\s+$', '', 'g'))::bigint as n, null::varchar as fault from documents where doc_id % 10 <> 0
union all select source, null, length(regexp_replace(text, '^\s+|\s*\n\s*|\s+$', '', 'g')), 'sequence before a header' from documents where doc_id % 10 = 0""")
def q_fasta(b: Bound) -> DataFrame:
    k = F.col("doc_id")
    value = F.concat(F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(">d"), k, F.lit(" x\n"))), F.replace(F.col("text"), F.lit(">"), F.lit("")), F.lit("\n\n"))
    rows = b.t("documents").select(F.col("source").alias("file"), value.alias("value"), F.lit(False).alias("marked"))
    return sequences.fasta_records(rows).select("file", "header", F.length("seq").cast("long").alias("n"), "fault")


@query("mark_fastq", "select source as file, count(*) as records, sum(length(replace(text, chr(10), ' ')))::bigint as bases, min('@d' || doc_id || '__mate1') as first_header from documents group by 1")
def q_mark(b: Bound) -> DataFrame:
    rows = b.t("documents").select(F.col("source").alias("file"), F.concat(F.lit("@d"), F.col("doc_id"), F.lit("/1 y")).alias("header"), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("seq"))
    marked = sequences.mark_records(rows, 1)
    return sequences.record_totals(marked, ["file"]).join(marked.groupBy("file").agg(F.min("header").alias("first_header")), "file")


NAMED = """prof as (select 'p' || (c_custkey % 3) as run, case when c_custkey % 4 = 0 then 'unknown ' || c_custkey else c_name end as name, c_acctbal as value from customer where c_acctbal > 0),
res as (select run, prof.name, value, x.taxid from prof left join (select c_name as name, max(1000000 + c_custkey) as taxid from customer group by 1) x using (name))"""


def resolved(b: Bound) -> DataFrame:
    c = b.t("customer").filter("c_acctbal > 0")
    rows = c.select(F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("run"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("unknown "), F.col("c_custkey"))).otherwise(F.col("c_name")).alias("name"), F.col("c_acctbal").alias("value"))
    names = b.names()
    return taxonomy.resolve_names(rows.withColumnRenamed("name", "n"), "n", taxonomy.name_map(names), taxonomy.synonyms(names, b.nodes(), ["synonym"])).withColumnRenamed("n", "name")


@query("named_profile", f"with {NAMED} select run, taxid, round(sum(value), 4) as value, null::bigint as unmapped from res where taxid is not null group by 1, 2 union all select run, null, round(coalesce(sum(value) filter (taxid is null), 0), 4), count(*) filter (taxid is null) from res group by 1")
def q_named(b: Bound) -> DataFrame:
    profile, lost = profiles.named_to_taxids(resolved(b), ["run"])
    none = F.lit(None).cast("long")
    return rounded(profile.withColumn("unmapped", none).unionByName(lost.select("run", none.alias("taxid"), F.col("unmapped_mass").alias("value"), "unmapped")), 4)


@query("truth_coverage", f"with {NAMED} select run, count(*) as species_total, count(taxid) as species_mapped, count(*) - count(taxid) as species_unmapped, round(sum(value), 4) as mass_total, round(sum(case when taxid is not null then value else 0 end), 4) as mass_mapped, round(sum(case when taxid is null then value else 0 end), 4) as mass_unmapped, round((count(*) - count(taxid)) / count(*), 4) as species_unmapped_rate, case when sum(value) > 0 then round(sum(case when taxid is not null then value else 0 end) / sum(value), 4) end as mass_mapped_rate from res group by 1")
def q_truth_coverage(b: Bound) -> DataFrame:
    return rounded(profiles.truth_coverage(resolved(b), ["run"]), 4)


@query("named_to_rank", with_sql(NODES, NAMED, "seeds as (select taxid from res)", CLOSURE, LIFTS) + """select run, r.rank, coalesce(lifted, res.taxid) as taxid, null::varchar as name, round(sum(case when lifted is not null then value end), 4) as mapped, round(sum(value), 4) as "full"
from res cross join (values ('species'), ('genus')) r(rank) left join lifts l on l.seed = res.taxid and l.rank = r.rank where res.taxid is not null group by 1, 2, 3
union all select run, rank, null, name, null, round(sum(value), 4) from res cross join (values ('species'), ('genus')) r(rank) where taxid is null group by 1, 2, 4""")
def q_named_to_rank(b: Bound) -> DataFrame:
    return rounded(profiles.named_to_ranks(resolved(b).withColumn("rank", F.lit("")), b.nodes(), ["run"], ["species", "genus"])[0], 4)


def roles(b: Bound) -> DataFrame:
    """cohort, sample, tool, signal, expected, positive, condition: two tools read the same samples."""
    d = b.t("labels").join(b.t("documents"), "doc_id")
    rows = d.select(F.col("source").alias("cohort"), F.col("doc_id").alias("sample"), (F.col("quality") == 1).alias("positive"), F.col("toxic").alias("condition"), F.col("n_chars").cast("double").alias("n"))
    tool = F.explode(F.array(F.struct(F.lit("a").alias("tool"), F.col("n").alias("signal")), F.struct(F.lit("b").alias("tool"), (F.col("n") % 997).alias("signal")))).alias("t")
    return rows.select("cohort", "sample", "positive", "condition", (F.col("n") * 2).alias("expected"), "n", tool).select("cohort", "sample", "positive", "condition", "expected", "n", "t.*")


ROLES = """base as (select source as cohort, doc_id as sample, quality = 1 as positive, toxic as condition, n_chars::double * 2 as expected, n_chars::double as n from labels join documents using (doc_id)),
roles as (select *, 'a' as tool, n as signal from base union all select *, 'b', n % 997 from base)"""
AUC = """select {k} count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_zero, round((sum(rk) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2) / nullif(count(*) filter (positive) * count(*) filter (not positive), 0), 6) as auc from rk group by {g}"""
RANKS = "rk as (select *, rank() over (partition by {g} order by signal) + (count(*) over (partition by {g}, signal) - 1) / 2 as rk from {t})"


@query("roles", f"with {ROLES} select sample, case when n > 1000 then 'positive' when n < 500 then 'zero' else 'other' end as role from base")
def q_roles(b: Bound) -> DataFrame:
    n = F.col("n_chars")
    return b.t("labels").join(b.t("documents"), "doc_id").select(F.col("doc_id").alias("sample"), cohort.role(n - 1000, F.when(n < 500, 0).otherwise(1)).alias("role"))


@query("auc", f"with {ROLES}, " + RANKS.format(g="tool", t="roles") + AUC.format(k="tool,", g="tool"))
def q_auc(b: Bound) -> DataFrame:
    return rounded(cohort.auc(roles(b), ["tool"], "signal", "positive"))


FLOORS = "fl as (select * from roles, (values (0.0::double), (1000.0), (5000.0)) f(floor) where not positive or expected >= floor)"


@query("floor_auc", f"with {ROLES}, {FLOORS}, " + RANKS.format(g="tool, floor", t="fl") + AUC.format(k="tool, floor,", g="tool, floor"))
def q_floor(b: Bound) -> DataFrame:
    return rounded(cohort.floor_auc(roles(b), ["tool"], "signal", "positive", "expected", [0, 1000, 5000]))


GRID = "gr as (select tool, floor, metric, positive, scheme, case metric when 'signal' then signal else n end as signal from fl, (values ('signal'), ('n')) m(metric), (values ('all'), ('long')) s(scheme) where scheme = 'all' or n >= 300)"


@query("sensitivity_grid", f"with {ROLES}, {FLOORS}, {GRID}, " + RANKS.format(g="scheme, tool, metric, floor", t="gr") + AUC.format(k="scheme, tool, metric, floor,", g="scheme, tool, metric, floor"))
def q_grid(b: Bound) -> DataFrame:
    schemes = {"all": F.lit(True), "long": F.col("n") >= 300}
    return rounded(cohort.sensitivity_grid(roles(b), ["tool"], schemes, ["signal", "n"], "positive", "expected", [0, 1000, 5000]))


@query("signal_summary", f"with {ROLES}, " + RANKS.format(g="tool", t="roles").replace("as rk from roles", "as rk, rank() over (partition by tool order by expected) + (count(*) over (partition by tool, expected) - 1) / 2 as re from roles") + """
select tool, count(*) as n, round(avg(signal) filter (positive), 4) as mean_positive, round(avg(signal) filter (not positive), 4) as mean_zero, round(median(signal) filter (positive), 4) as median_positive, round(median(signal) filter (not positive), 4) as median_zero,
round(corr(signal, expected), 4) as pearson, round(corr(rk, re), 4) as spearman, round(avg(signal) filter (positive) - avg(signal) filter (not positive), 4) as difference, count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_zero,
round((sum(rk) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2) / nullif(count(*) filter (positive) * count(*) filter (not positive), 0), 4) as auc from rk group by tool""")
def q_signal(b: Bound) -> DataFrame:
    return rounded(cohort.signal_summary(roles(b), ["tool"], "signal", "expected", "positive"), 4)


BOOT = """units as (select distinct positive, condition, sample from base), nu as (select *, row_number() over (partition by positive, condition order by sample) - 1 as i, count(*) over (partition by positive, condition) as n from units),
slots as (select positive, condition, n, i as slot, round_ from nu, range(20) r(round_)),
dr as (select positive, condition, round_, ('0x' || substr(md5(concat_ws('|', '7', round_, positive::varchar, condition, slot)), 1, 8))::bigint % n as i from slots),
wt as (select sample, round_, count(*) as w from dr join nu using (positive, condition, i) group by 1, 2),
per as (select tool, round_, signal, coalesce(sum(w) filter (positive), 0) as p, coalesce(sum(w) filter (not positive), 0) as z from roles join wt using (sample) group by 1, 2, 3),
us as (select *, p * (coalesce(sum(z) over (partition by tool, round_ order by signal rows between unbounded preceding and 1 preceding), 0) + z / 2) as u from per),
bs as (select tool, round_, sum(u) / sum(p) / sum(z) as auc from us group by 1, 2)"""


def draws(b: Bound) -> DataFrame:
    rows = roles(b).withColumn("positive_text", F.col("positive").cast("string"))
    return cohort.bootstrap_auc(rows, ["tool"], ["positive", "condition"], "sample", "signal", "positive", 20, 7)


@query("bootstrap_auc", f"with {ROLES}, {BOOT} select tool, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high, count(*) as rounds from bs group by tool")
def q_boot(b: Bound) -> DataFrame:
    return rounded(cohort.bootstrap_interval(draws(b), ["tool"]))


@query("paired_difference", f"with {ROLES}, {BOOT}, d as (select x.auc - y.auc as d from bs x join bs y on x.tool = 'a' and y.tool = 'b' and x.round_ = y.round_) select 'all' as scope, round(avg(d), 6) as difference, round(least(1, 2 * (least(count(*) filter (d <= 0), count(*) filter (d >= 0)) + 1) / (count(*) + 1)), 6) as p from d")
def q_paired(b: Bound) -> DataFrame:
    return rounded(cohort.paired_p(draws(b).withColumn("scope", F.lit("all")), "tool", "a", "b", ["scope"]))


#: Least squares with one covariate in closed form: sums of squares and products about the means.
FITTED = """rows_ as (select tool, asin(sqrt(signal / (n + 1000))) as y, positive::integer as x, n % 17 as c from roles),
m as (select tool, count(*) as n, sum(x) as n1, var_pop(x) * count(*) as xx, var_pop(c) * count(*) as cc, var_pop(y) * count(*) as yy, covar_pop(x, c) * count(*) as xc, covar_pop(x, y) * count(*) as xy, covar_pop(c, y) * count(*) as cy from rows_ group by tool),
f as (select *, (xy * cc - xc * cy) / (xx * cc - xc * xc) as beta, (cy * xx - xc * xy) / (xx * cc - xc * xc) as gamma from m),
g as (select *, sqrt((yy - beta * xy - gamma * cy) / (n - 3) * cc / (xx * cc - xc * xc)) as se from f)"""


@query("ols_assoc", f"""with {ROLES}, {FITTED}, h as (select *, beta / se as t, beta / se * n / sqrt(n1 * (n - n1)) / sqrt(n - 2) as d from g)
select tool, n1::bigint as n_case, (n - n1)::bigint as n_control, round(beta, 6) as beta, round(se, 6) as se, round(t, 4) as t, round(d, 4) as effect, round(sqrt((n - 1) / (n - 3) * 4.0 / n * (1 + d * d / 8)), 4) as effect_se from h""")
def q_ols(b: Bound) -> DataFrame:
    rows = roles(b).withColumn("x", F.col("positive").cast("int")).withColumn("c", F.col("n") % 17).withColumn("all", F.col("n") + 1000)
    made = cohort.association(rows, ["tool"], "signal", "x", ["c"], "all")
    return made.select("tool", "n_case", "n_control", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), *[F.round(c, 4).alias(c) for c in ("t", "effect", "effect_se")])


@query("partial_beta", f"with {ROLES} select tool, 'signal' as term, count(*) as n, round((corr(expected, signal) - corr(expected, sample) * corr(signal, sample)) / (1 - corr(signal, sample) ** 2), 4) as beta from roles group by tool")
def q_partial(b: Bound) -> DataFrame:
    return rounded(cohort.partial_effects(roles(b), ["tool"], "expected", ["signal"], ["sample"]).select("tool", "term", "n", "beta"), 4)


@query("meta", """with recursive e as (select n_regionkey as k, n_nationkey / 10 - 1 as y, (0.1 + (n_nationkey % 3) * 0.1) as s from nation),
s as (select k, 0.0::double as lo, (4 * max(abs(y)) ** 2 * count(*) + 1)::double as hi, 0 as i from e group by k
  union all select k, case when q > n - 1 then (lo + hi) / 2 else lo end, case when q > n - 1 then hi else (lo + hi) / 2 end, i + 1 from (
    select s.k, lo, hi, i, sum(y * y / (e.s * e.s + (lo + hi) / 2)) - sum(y / (e.s * e.s + (lo + hi) / 2)) ** 2 / sum(1 / (e.s * e.s + (lo + hi) / 2)) as q, count(*) as n from s join e on s.k = e.k where i < 100 group by s.k, lo, hi, i)),
q as (select k, count(*) as n, sum(y * y / (s * s)) - sum(y / (s * s)) ** 2 / sum(1 / (s * s)) as q from e group by k),
t as (select s.k, q.n, q.q, case when q.n > 1 and q.q > q.n - 1 then lo else 0 end as tau2 from s join q on s.k = q.k where i = 100),
m as (select t.k, max(t.n) as n, max(t.q) as q, max(tau2) as tau2, sum(y / (e.s * e.s + tau2)) / sum(1 / (e.s * e.s + tau2)) as effect, 1 / sqrt(sum(1 / (e.s * e.s + tau2))) as se from t join e on t.k = e.k group by t.k)
select k as region, n as cohorts, round(tau2, 4) as tau2, round(effect, 4) as effect, round(se, 4) as se, round(effect - 1.959963984540054 * se, 4) as low, round(effect + 1.959963984540054 * se, 4) as high, round(q, 4) as q, round(case when q > 0 then greatest(0, (q - (n - 1)) / q) else 0 end, 4) as i2 from m""")
def q_meta(b: Bound) -> DataFrame:
    e = b.t("nation").select(F.col("n_regionkey").alias("region"), (F.col("n_nationkey") / 10 - 1).alias("effect"), (0.1 + (F.col("n_nationkey") % 3) * 0.1).alias("se"))
    return rounded(cohort.meta(e, ["region"]).drop("p"), 4)


@query("subset_select", f"""with {ROLES}, p as (select *, row_number() over (partition by cohort order by n, sample) - 1 as i, count(*) over (partition by cohort) as c from base where positive),
t as (select * from p where i = 0 or floor(i * least(c, 10) / c) <> floor((i - 1) * least(c, 10) / c)), qt as (select cohort, condition, count(*) as q from t group by 1, 2),
z as (select *, row_number() over (partition by cohort, condition order by sample) as i from base where not positive)
select cohort, sample, 'positive' as role from t union all select cohort, sample, 'zero' from z join qt using (cohort, condition) where i <= q""")
def q_subset(b: Bound) -> DataFrame:
    rows = roles(b).filter("tool = 'a'").select("cohort", "condition", "sample", F.when(F.col("positive"), "positive").otherwise("zero").alias("role"), F.col("n").alias("abundance"))
    return cohort.subset(rows, 10).select("cohort", "sample", "role")


@query("token_match", "select n.n_regionkey as cohort, 'run_' || c_custkey || '_' || n.n_name || '_x' as sample, n.n_name as id from customer join nation n on c_nationkey = n.n_nationkey")
def q_token(b: Bound) -> DataFrame:
    n = b.t("nation")
    s = b.t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("cohort"), F.concat(F.lit("run_"), F.col("c_custkey"), F.lit("_"), "n_name", F.lit("_x")).alias("sample"))
    return cohort.token_match(s, n.select(F.col("n_regionkey").alias("cohort"), F.col("n_name").alias("id")))


MANIFEST = """sel as (select 'run_' || c_custkey || '_x' as sample, c_custkey::varchar as paper_sample_id, 'acc' || c_custkey as run_accession, c_mktsegment as cohort, case when c_custkey % 2 = 0 then 'case' else 'control' end as condition,
  case when c_nationkey > 10 then 'positive' when c_nationkey = 0 then 'zero' else 'other' end as role, (c_custkey % 90)::double as age, case when c_custkey % 3 = 0 then 'f' else 'm' end as sex, c_custkey % 30 + 0.5::double as bmi, c_custkey * 7 as source_reads, c_custkey * 5 as input_reads_used,
  'all' as input_selection, c_nationkey / 2 as paper_fna_c1_percent, c_nationkey / 4 as paper_fna_c2_percent, case when c_custkey % 2 = 0 then abs(c_acctbal) else c_nationkey / 2 + c_nationkey / 4 end as paper_fna_total_percent, abs(c_acctbal) * 3 as expected_c2_reads_at_depth, 'pass' as input_qc from customer)"""


def manifest(b: Bound) -> DataFrame:
    c, k, n = b.t("customer"), F.col("c_custkey"), F.col("c_nationkey")
    sample, c1, c2 = F.concat(F.lit("run_"), k, F.lit("_x")).alias("sample"), (n / 2).alias("c1"), (n / 4).alias("c2")
    case = lambda yes, no: F.when(k % 2 == 0, yes).otherwise(no).alias("condition")
    cohort_ = F.col("c_mktsegment").alias("cohort")
    role = F.when(n > 10, "positive").when(n == 0, "zero").otherwise("other").alias("role")
    samples = c.select(sample, cohort_, case("Case", "Control"), role, F.concat(F.lit("acc"), k).alias("run_accession"), c1, c2, F.when(k % 2 == 0, F.abs("c_acctbal")).alias("total"))
    metadata = c.select(cohort_, k.alias("paper_sample"), case("case", "control"), (k % 90).alias("age"), F.when(k % 3 == 0, "F").otherwise("M").alias("sex"), (k % 30 + 0.5).alias("bmi"), (k * 7).alias("source_reads"), c1, c2)
    return cohort.sample_manifest(samples, metadata, c.select(sample, (k * 5).alias("input_reads"), (F.abs("c_acctbal") * 3).alias("expected")), "all")


@query("cohort_manifest", f"with {MANIFEST} select sample, paper_sample_id, run_accession, cohort, condition, role, age, sex, bmi, source_reads, input_reads_used, input_selection, paper_fna_c1_percent, paper_fna_c2_percent, round(paper_fna_total_percent, 4) as paper_fna_total_percent, round(expected_c2_reads_at_depth, 4) as expected_c2_reads_at_depth, input_qc from sel")
def q_cohort(b: Bound) -> DataFrame:
    return rounded(manifest(b), 4)


@query("signals", f"with {MANIFEST} select sample, case t when 'a' then 'Alpha' else 'Beta' end as tool, (input_reads_used % case t when 'a' then 97 else 89 end)::double as signal, cohort, condition, role, input_reads_used, paper_fna_c2_percent from sel, (values ('a'), ('b')) v(t)")
def q_signals(b: Bound) -> DataFrame:
    m = manifest(b).select("sample", "cohort", "condition", "role", "input_reads_used", "paper_fna_c2_percent")
    k = F.col("c_custkey") * 5
    row = lambda t, v: F.struct(F.lit(t).alias("tool"), v.cast("double").alias("signal"))
    rows = b.t("customer").select(F.concat(F.lit("run_"), F.col("c_custkey"), F.lit("_x")).alias("sample"), F.explode(F.array(row("a", k % 97), row("b", k % 89))).alias("t")).select("sample", "t.*")
    return cohort.signals(rows, m, {"a": "Alpha", "b": "Beta"})


AUDITED = "a as (select o_orderkey, case when o_orderkey % 2 = 0 then 5.0 else o_custkey * o_totalprice / 100 end as expected, o_totalprice as reads, o_custkey % 7 as strict, o_custkey % 3 as tied, o_custkey % 5 as non_target, o_custkey % 2 as unmapped from orders), c as (select *, strict + tied as supported, strict + tied + non_target + unmapped as candidate from a)"


@query("audit", f"with {AUDITED} select o_orderkey, round(expected, 4) as expected, candidate, supported, " + ", ".join(f"round({c} / nullif(candidate, 0), 6) as {c}_rate" for c in ("strict", "tied", "supported", "non_target", "unmapped")) + ", " + ", ".join(f"round(1e6 * {c} / reads, 4) as {c}_rpm" for c in ("candidate", "strict", "supported")) + " from c")
def q_audit(b: Bound) -> DataFrame:
    k = F.col("o_custkey")
    parts = {"strict": k % 7, "tied": k % 3, "non_target": k % 5, "unmapped": k % 2}
    rows = b.t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(5.0)).alias("expected"), k.cast("double").alias("percent"), F.col("o_totalprice").alias("input_reads"), *[c.alias(name) for name, c in parts.items()], F.lit(0).alias("missing"))
    made = cohort.audit(rows.withColumn("supported", F.col("strict") + F.col("tied")).withColumn("candidate", F.col("supported") + F.col("non_target") + F.col("unmapped")))
    rates = [F.round(f"{c}_rate", 6).alias(f"{c}_rate") for c in ("strict", "tied", "supported", "non_target", "unmapped")]
    return made.select("o_orderkey", F.round("expected", 4).alias("expected"), "candidate", "supported", *rates, *[F.round(f"{c}_rpm", 4).alias(f"{c}_rpm") for c in ("candidate", "strict", "supported")])


@query("aln_fate", """with s as (select l_orderkey as k, l_suppkey % 4 as clade, max(l_quantity::integer * 1000 + l_linenumber) as s from lineitem where l_returnflag <> 'R' group by 1, 2),
t as (select k, max(s) as best, max(s) filter (clade = 1) as own, max(s) filter (clade <> 1) as rest from s group by 1)
select o_orderkey as read, case when best is null then 'unmapped' when own = best then case when rest = best then 'tied' else 'strict' end else 'non_target' end as fate from orders left join t on k = o_orderkey""")
def q_fate(b: Bound) -> DataFrame:
    aln = b.t("lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("read"), F.concat(F.lit("c"), F.col("l_suppkey") % 4).alias("clade"), F.col("l_quantity").cast("int").alias("nmatch"), F.col("l_linenumber").alias("aln_len"))
    return cohort.alignment_fate(b.t("orders").select(F.col("o_orderkey").alias("read")), aln, "c1", ["read"])
