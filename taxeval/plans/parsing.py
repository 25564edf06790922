"""Queries on the parsers: lines are built from the driver's tables, with bad rows among them, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import perread, taxonomy
from ..operators import reads as read_ops
from ..sources import formats, sequences
from ..sources.lines import lines_of
from .bindings import CLOSURE, NODES, Bound, with_sql
from .registry import query, rounded


def tabbed(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((c if isinstance(c, Column) else F.col(c)).cast("string"), F.lit("")) for c in cols])


def lines(df: DataFrame, value: Column, order: str | Column, file: Column | None = None) -> DataFrame:
    return lines_of(df, F.lit("f") if file is None else file, F.col(order) if isinstance(order, str) else order, value)


def segment_file() -> Column:
    return F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string"))


@query("nodes_parse", """with p as (select c_custkey % 500 as taxid, c_nationkey as parent, c_mktsegment as rank, c_custkey as o from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0)
select taxid, arg_max(parent, o)::bigint as parent, arg_max(rank, o) as rank from p group by taxid""")
def q_nodes(b: Bound) -> DataFrame:
    v = F.when(F.col("c_custkey") % 7 == 0, F.lit("x1\t|\t2\t|\tgenus\t|")).when(F.col("c_custkey") % 11 == 0, F.lit("5\t|\t1")).otherwise(
        F.concat(F.lit(" "), (F.col("c_custkey") % 500).cast("string"), F.lit("\t|\t"), F.col("c_nationkey").cast("string"), F.lit("\t|\t"), F.col("c_mktsegment"), F.lit("\t|\tmore")))
    return formats.parse_nodes(lines(b.t("customer"), v, "c_custkey"))


@query("names_parse", "select c_custkey as taxid, c_name as name, case c_custkey % 3 when 0 then 'scientific name' else 'synonym' end as name_class, c_custkey as ord from customer where c_custkey % 3 < 2")
def q_names(b: Bound) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "scientific name").when(F.col("c_custkey") % 3 == 1, "synonym").otherwise("type material")
    v = F.concat(F.col("c_custkey").cast("string"), F.lit("\t|\t"), F.col("c_name"), F.lit("\t|\t\t|\t"), kind, F.lit("\t|"))
    return formats.parse_names(lines(b.t("customer"), v, "c_custkey"))


@query("tax_parse", """select 'node' as part, c_custkey::varchar as key, (c_nationkey + 1)::bigint as value, 'species' as rank from customer where c_custkey % 5 <> 0
union all select 'file', 'g' || c_custkey || '.fna', c_custkey, 'file' from customer where c_custkey % 5 = 0
union all select 'name', c_mktsegment, min(c_custkey), 'species' from customer where c_custkey % 5 <> 0 group by c_mktsegment""")
def q_tax(b: Bound) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 5 == 0, tabbed(F.concat(F.lit("g"), k, F.lit(".fna")), k, F.lit("file"))).otherwise(tabbed(k, F.col("c_nationkey") + 1, F.lit("species"), "c_mktsegment"))
    nodes, files, named = formats.parse_tax(lines(b.t("customer"), v, "c_custkey"))
    row = lambda df, part, key, value, rank: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), value.alias("value"), rank.alias("rank"))
    return row(nodes, "node", F.col("taxid"), F.col("parent"), F.col("rank")).union(row(files, "file", F.col("file_id"), F.col("taxid"), F.lit("file"))).union(row(named, "name", F.col("name"), F.col("taxid"), F.col("rank")))


@query("classify_parse", """with v as (select o_orderstatus as file, o_orderkey % 400 as r, o_orderkey as o, case o_orderkey % 4 when 0 then null when 1 then o_custkey when 2 then 0 else o_custkey + 1 end as taxid from orders)
select file, 'read' || r as read_id, arg_max({'t': taxid}, o).t as taxid from v group by 1, 2""")
def q_classify(b: Bound) -> DataFrame:
    n = F.col("o_orderkey") % 4
    rid = F.concat(F.lit("read"), F.col("o_orderkey") % 400)
    v = F.when(n == 0, tabbed(rid, F.lit("unclassified"))).when(n == 1, tabbed(F.concat(rid, F.lit(" extra")), F.lit(""), F.concat(F.col("o_custkey"), F.lit(":0.5")))).when(n == 2, tabbed(rid, F.lit("0"))).otherwise(tabbed(rid, F.col("o_custkey") + 1, F.lit("7")))
    return formats.parse_classify(lines(b.t("orders"), v, "o_orderkey", F.col("o_orderstatus")))


@query("one_parse", """with v as (select o_orderstatus as file, o_orderkey % 301 as r, o_orderkey as o,
  case o_orderkey % 3 when 0 then o_custkey + 5 when 1 then o_custkey else 77 end as taxid from orders where o_orderkey % 7 <> 5)
select file, 'read' || r as read_id, arg_max(taxid, o)::bigint as taxid from v group by 1, 2""")
def q_one(b: Bound) -> DataFrame:
    n = F.col("o_orderkey")
    rid = F.concat(F.lit("read"), n % 301)
    v = F.when(n % 7 == 5, F.concat(F.lit("# "), rid)).when(n % 3 == 0, tabbed(F.lit("H1"), rid, F.concat(F.lit("ref"), F.col("o_custkey")), F.lit("1"))).when(n % 3 == 1, tabbed(rid, "o_custkey")).otherwise(tabbed(rid, F.lit("unknown"), F.lit("x"), F.lit("77")))
    refs = b.t("customer").select(F.concat(F.lit("ref"), F.col("c_custkey")).alias("file_id"), (F.col("c_custkey") + 5).alias("taxid"))
    return formats.parse_one(lines(b.t("orders"), v, "o_orderkey", F.col("o_orderstatus")), refs)


@query("truth_profile_parse", """with v as (select 'p' || (c_custkey % 3) as file, c_mktsegment as name, c_acctbal as value from customer where c_custkey % 13 <> 0),
s as (select file, name, sum(value) as value from v group by 1, 2), t as (select *, sum(value) over (partition by file) as total from s)
select file, name, round(case when total > 1.5 then value / 100 else value end, 4) as value from t""")
def q_truth_profile(b: Bound) -> DataFrame:
    c = b.t("customer")
    v = F.when(F.col("c_custkey") % 13 == 0, tabbed("c_mktsegment", F.lit("n/a"))).otherwise(F.when(F.col("c_custkey") % 3 == 0, tabbed("c_mktsegment", "c_acctbal")).otherwise(tabbed("c_nationkey", "c_acctbal", "c_mktsegment")))
    rows = lines(c, v, F.col("c_custkey") + 10, segment_file())
    heads = c.select((F.col("c_custkey") % 3).alias("k")).distinct().filter("k > 0").select(F.concat(F.lit("p"), F.col("k")).alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit("id\tPercent\tSpecies").alias("value"))
    return rounded(formats.parse_truth_profile(rows.union(heads)), 4)


@query("species_truth", """with k as (select c_name as name, min(c_custkey) as taxid from customer where c_custkey % 4 <> 0 group by 1),
r as (select o_orderpriority as file, 'r' || o_orderkey as read_id, case when o_orderkey % 9 = 0 then '' else c_name end as label from orders join customer on o_custkey = c_custkey)
select file, count(*) as rows, count(*) filter (taxid is null) as unmapped_rows, count(distinct case when taxid is null then label end) as unmapped_names, count(taxid) as truth_reads, coalesce(sum(taxid), 0)::bigint as taxid_sum
from r left join k on label = name where label <> '' group by file""")
def q_species(b: Bound) -> DataFrame:
    known = b.t("customer").filter("c_custkey % 4 <> 0").groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").alias("taxid"))
    o = b.t("orders").join(b.t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    rows = o.select(F.col("o_orderpriority").alias("file"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("read_id"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("c_name")).alias("label"))
    truth, stats = formats.parse_species_truth(rows, known)
    return stats.join(truth.groupBy("file").agg(F.count(F.lit(1)).alias("truth_reads"), F.sum("taxid").alias("taxid_sum")), "file")


@query("cami_map", """with v as (select o_orderstatus as file, case when o_orderkey % 500 = 7 then '@odd 7' else 'c' || (o_orderkey % 500) end as read_id, o_orderkey as o, o_custkey % 80 as taxid,
  case o_orderkey % 3 when 0 then 1 else greatest(1, o_custkey - 5) end as w from orders where o_orderkey % 13 <> 0),
t as (select file, read_id, arg_max(taxid, o) as taxid from v group by 1, 2), n as (select file, taxid, count(*) as reads, min(read_id) as first_id from t group by 1, 2)
select file, taxid::bigint as taxid, sum(w)::bigint as weight, coalesce(max(reads), 0) as reads, max(first_id) as first_id from v left join n using (file, taxid) group by 1, 2""")
def q_cami_map(b: Bound) -> DataFrame:
    """Ids with a blank or a leading @ are kept whole; lines of three cells don't count."""
    k = F.col("o_orderkey")
    w = F.when(k % 3 == 0, "bad").otherwise((F.col("o_custkey") - 5).cast("string"))
    name = F.when(k % 500 == 7, "@odd 7").otherwise(F.concat(F.lit("c"), k % 500))
    v = F.when(k % 13 == 0, tabbed(name, F.lit("genome"), F.col("o_custkey") % 80)).otherwise(tabbed(name, F.lit("genome"), F.col("o_custkey") % 80, F.lit("seq"), w))
    own = lines(b.t("orders"), v, "o_orderkey", F.col("o_orderstatus"))
    truth, abundance = formats.parse_cami_map(own.union(own.limit(3).withColumn("value", F.lit("#SEQUENCEID\tBINID\t5\tx"))))
    return abundance.join(truth.groupBy("file", "taxid").agg(F.count(F.lit(1)).alias("reads"), F.min("read_id").alias("first_id")), ["file", "taxid"], "left").fillna(0, ["reads"])


@query("genome_ids", "select p_partkey, [x for x in [ '/data/x/GCF_' || lpad(p_partkey::varchar, 9, '0') || '.1_asm.fna.gz', 'GCF_' || lpad(p_partkey::varchar, 9, '0') || '.1_asm.fna.gz', 'GCF_' || lpad(p_partkey::varchar, 9, '0') || '.1_asm', 'GCF_' || lpad(p_partkey::varchar, 9, '0') || '.1']] as ids from part".replace("[x for x in [ ", "[").replace("]]", "]"))
def q_genome_ids(b: Bound) -> DataFrame:
    path = F.concat(F.lit("/data/x/GCF_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1_asm.fna.gz"))
    return b.t("part").select("p_partkey", tx.genome_id_candidates(path).alias("ids"))


@query("accession", "select p_partkey, case when p_partkey % 3 = 0 then null else 'GCA_' || lpad(p_partkey::varchar, 9, '0') || '.' || (p_partkey % 9) end as found, case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then 'GCA_' || lpad(p_partkey::varchar, 9, '0') || '.' || (p_partkey % 9) else 'GCF_x' end as by_parts, 'GCF_' || p_partkey || '.1' as of_path from part")
def q_accession(b: Bound) -> DataFrame:
    k = F.col("p_partkey")
    own = F.concat(F.lit("GCA_"), F.lpad(k.cast("string"), 9, "0"), F.lit("."), (k % 9).cast("string"), F.lit("_y.fna"))
    path = F.when(k % 3 == 0, F.concat(F.lit("dir/GCX_"), k)).when(k % 3 == 1, F.concat(F.lit("dir/"), own)).otherwise(F.concat(F.lit("dir/GCF_x_"), own))
    named = F.concat(F.lit("/lists/GCF_"), k, F.lit(".1_z.fna.gz"))
    return b.t("part").select("p_partkey", tx.accession(path).alias("found"), tx.accession_by_parts(path).alias("by_parts"), tx.accession_of_path(named).alias("of_path"))


GENOMES = """v as (select 'p' || (c_custkey % 3) as file, c_custkey as k, abs(c_acctbal) as value from customer), s as (select *, sum(value) over (partition by file) as total from v),
x as (select file, k, case when total > 1.5 then value / 100 else value end as value from s)"""


@query("sylph_profile", f"with {GENOMES} select file, (k % 40)::bigint as taxid, round(sum(value), 4) as value from x where k % 4 <> 0 group by 1, 2 union all select file, -1, round(sum(value), 4) from x where k % 4 = 0 group by 1")
def q_genomes(b: Bound) -> DataFrame:
    c = b.t("customer")
    name = F.concat(F.lit("db/G"), F.col("c_custkey"), F.lit(".fa.gz"))
    heads = c.select(segment_file().alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("Sample\tGenome_file\tSequence_abundance\tTaxonomic_abundance").alias("value"))
    rows = lines(c, tabbed(F.lit("s"), name, F.lit("9"), F.abs(F.col("c_acctbal"))), "c_custkey", segment_file())
    refs = c.filter("c_custkey % 4 <> 0").select(F.concat(F.lit("G"), F.col("c_custkey")).alias("file_id"), (F.col("c_custkey") % 40).alias("taxid"))
    profile, lost = formats.parse_genomes(rows.union(heads), refs)
    return rounded(profile.union(lost.select("file", F.lit(-1).cast("long"), "unmapped_mass")), 4)


@query("cami_profile", """select 'p' || (c_custkey % 3) as file, case when c_nationkey % 2 = 0 then 'species' else 'genus' end as rank, (c_custkey % 60 + 1)::bigint as taxid, round(sum(c_acctbal), 4) as value from customer where c_custkey % 6 <> 5 group by 1, 2, 3""")
def q_cami_profile(b: Bound) -> DataFrame:
    c = b.t("customer")
    k = F.col("c_custkey")
    rank = F.when(k % 6 == 5, "unclassified").otherwise(F.when(F.col("c_nationkey") % 2 == 0, "Species").otherwise("genus"))
    taxid = F.concat((k % 60 + 1).cast("string"), F.when(k % 3 == 0, ":x").when(k % 3 == 1, "|9").otherwise(".1"))
    v = F.when(k % 3 == 0, tabbed("c_acctbal", taxid, rank)).otherwise(tabbed(taxid, rank, F.lit("-"), F.lit("-"), "c_acctbal"))
    head = c.limit(1).select(F.lit("p0").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.lit("@@PERCENTAGE\tTAXID\tRANK").alias("value"))
    return rounded(formats.parse_cami_profile(lines(c, v, "c_custkey", segment_file()).union(head)), 4)


def tre_lines(b: Bound) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 50 == 7, tabbed(F.lit("unclassified"), F.lit("-"), F.lit("-"), k, F.lit("1"))).when(k % 50 == 8, tabbed(F.lit("root"), F.lit("1"), F.lit("-"), k, F.lit("1"))).otherwise(tabbed(F.lit("species"), k % 90 + 2, F.lit("x"), F.col("c_nationkey").cast("double"), F.lit("0.1")))
    return formats.parse_tre(lines(b.t("customer"), v, "c_custkey", segment_file()))


@query("tre_counts", """select 'p' || (c_custkey % 3) as file, 'species' as rank, (c_custkey % 90 + 2)::bigint as taxid, sum(c_nationkey)::double as value from customer where c_custkey % 50 not in (7, 8) and c_nationkey > 0 group by 1, 3
union all select 'p' || (c_custkey % 3), 'root', 1, sum(c_custkey)::double from customer where c_custkey % 50 = 8 group by 1""")
def q_tre(b: Bound) -> DataFrame:
    return formats.tre_profile(tre_lines(b))


@query("tre_summary", """select 'p' || (c_custkey % 3) as file, coalesce(max(c_custkey) filter (c_custkey % 50 = 7), 0) as unclassified, coalesce(max(c_custkey) filter (c_custkey % 50 = 8), 0) as classified,
coalesce(max(c_custkey) filter (c_custkey % 50 = 7), 0) + coalesce(max(c_custkey) filter (c_custkey % 50 = 8), 0) as total,
count(distinct c_custkey % 90) filter (c_custkey % 50 not in (7, 8) and c_nationkey > 0) as taxa from customer group by 1 having bool_or(c_custkey % 50 in (7, 8))""")
def q_tre_summary(b: Bound) -> DataFrame:
    return perread.tre_summary(tre_lines(b), ["file"])


@query("classify_summary", """select l_linestatus as file, count(*) as total, count(*) filter (l_linenumber % 4 in (0, 1)) as unclassified, count(*) filter (l_linenumber % 4 in (2, 3)) as classified,
count(distinct l_suppkey) filter (l_linenumber % 4 = 2) as taxa from lineitem group by 1""")
def q_classify_summary(b: Bound) -> DataFrame:
    n = F.col("l_linenumber") % 4
    k = F.col("l_orderkey") % 3
    none = F.when(k == 0, "0").when(k == 1, "NA|7").otherwise("x9")
    taxon = F.when(k == 0, tabbed("l_orderkey", F.lit(""), F.concat(F.col("l_suppkey") + 1, F.lit("|3")))).otherwise(tabbed("l_orderkey", F.concat(F.col("l_suppkey") + 1, F.lit(":3"))))
    v = F.when(n == 0, tabbed("l_orderkey", F.lit("unclassified"))).when(n == 1, tabbed("l_orderkey", none)).when(n == 2, taxon).otherwise(F.col("l_orderkey").cast("string"))
    return perread.run_summary(b.t("lineitem").select(F.col("l_linestatus").alias("file"), tx.cells(v).alias("cells")), ["file"])


@query("bracken_profile", """select c_custkey as line_no, 'p' || (c_custkey % 3) as file, c_custkey as taxid, case c_custkey % 4 when 0 then 'genus' when 1 then 'p1' when 2 then 'species' else '?' end as rank, c_acctbal as value from customer where c_acctbal > 0 and c_custkey > 0""")
def q_bracken(b: Bound) -> DataFrame:
    c, k = b.t("customer"), F.col("c_custkey")
    level = F.when(k % 4 == 0, "G").when(k % 4 == 1, "P1").when(k % 4 == 2, "S").otherwise("?")
    bad = c.select("*").filter(k % 7 == 0).withColumn("c_custkey", -k)  # signed and other odd taxids don't count
    t = F.when(k < 0, F.when(k % 2 == 0, k.cast("string")).when(k % 3 == 0, "0").otherwise(F.concat(F.lit("+"), -k))).otherwise(k.cast("string"))
    v = F.when(k % 3 == 0, tabbed("c_acctbal", t, level)).otherwise(tabbed("c_name", t, level, F.lit(1), F.lit(2), "c_acctbal", F.lit(0.5)))
    head = c.limit(1).select(F.lit("p0").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.lit("new_est_reads\ttaxonomy_id\ttaxonomy_lvl").alias("value"))
    rows = lines(c.union(bad.select(*c.columns)), v, "c_custkey", segment_file()).withColumn("line_no", F.when(F.col("line_no") < 0, 10**9).otherwise(0) + F.col("line_no"))
    return formats.parse_bracken(rows.union(head)).select("line_no", "file", "taxid", "rank", "value")


@query("kraken2_pred", "select o_orderkey as line_no, 'r' || o_orderkey as read_id, case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then null else nullif(o_custkey, 0) end as taxid from orders")
def q_kraken2(b: Bound) -> DataFrame:
    k = F.col("o_orderkey")
    v = tabbed(F.when(k % 3 == 0, "U").otherwise("C"), F.concat(F.lit("r"), k), F.when(k % 5 == 0, "0").otherwise(F.col("o_custkey").cast("string")), F.lit("150"))
    return formats.parse_kraken2(lines(b.t("orders"), v, "o_orderkey")).select("line_no", "read_id", "taxid")


@query("centrifuger_pred", """select 'r' || (o_orderkey % 700) as read_id, arg_min({'t': case when o_orderkey % 4 = 0 then null else nullif(o_custkey, 0) end}, o_orderkey).t as taxid from orders group by 1 union all select 'ReadID', 77 union all select 'seq', 9""")
def q_centrifuger(b: Bound) -> DataFrame:
    k = F.col("o_orderkey")
    v = tabbed(F.concat(F.lit("r"), k % 700), F.lit("seq"), F.when(k % 4 == 0, "-").otherwise(F.col("o_custkey").cast("string")), F.lit("9"))
    rows = lines(b.t("orders"), v, "o_orderkey")
    head = rows.limit(1).select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("readID\tseqID\ttaxID\tscore").alias("value"))
    odd = rows.limit(3).select("file", "line_no", F.lit("\tseq\t5\t9").alias("value"))  # without its first blank, seq is the read
    named = rows.limit(1).select("file", F.lit(-2).cast("long").alias("line_no"), F.lit("ReadID\tseq\t77\t9").alias("value"))  # a read of that name
    return formats.parse_centrifuger(rows.union(head).union(odd).union(named)).select("read_id", "taxid")


@query("lineage_fill", with_sql(NODES, "seeds as (select 1000000 + c_custkey as taxid from customer)", CLOSURE, "l as (select seed, string_agg(anc::varchar, '|' order by dist desc) as ids from closure group by 1)") + """
select 'a' || c_custkey as accession, case when c_custkey % 2 = 0 then 'a' || c_custkey else c_name end as reference_name, case when c_custkey % 7 = 0 then 'none' else (1000000 + c_custkey)::varchar end as taxid,
case when c_custkey % 5 = 0 then 'given' when c_custkey % 7 = 0 then 'root' else ids end as tax_str, case when c_custkey % 7 = 0 then '1' else ids end as tax_id_str from customer join l on seed = 1000000 + c_custkey""")
def q_lineage_fill(b: Bound) -> DataFrame:
    n, c = b.nodes(), b.t("customer")
    k = F.col("c_custkey")
    none = n.select("taxid", F.lit(None).cast("string").alias("name")).limit(0)
    rows = c.select(F.concat(F.lit("a"), k).alias("accession"), F.when(k % 2 == 0, " ").otherwise(F.col("c_name")).alias("reference_name"), F.when(k % 7 == 0, "none").otherwise((k + 1000000).cast("string")).alias("taxid"), F.when(k % 5 == 0, "given").alias("tax_str"), F.lit("").alias("tax_id_str"))
    return formats.fill_lineage(rows, taxonomy.lineage(n, none, c.select((k + 1000000).alias("taxid"))))


@query("targets", "select case when p_partkey % 2 = 0 then '/abs/' || p_partkey || '.fna' else '/lists/' || p_partkey || '.fna' end as path, (p_size)::bigint as taxid from part")
def q_targets(b: Bound) -> DataFrame:
    k = F.col("p_partkey")
    v = tabbed(F.concat(F.when(k % 2 == 0, "/abs/").otherwise(""), k, F.lit(".fna")), "p_size")
    rows = lines(b.t("part"), v, "p_partkey", F.lit("/lists/t.tsv"))
    return formats.parse_targets(rows.union(rows.limit(2).withColumn("value", F.lit("# comment")))).select("path", "taxid")


def assembly(b: Bound) -> DataFrame:
    k = F.col("p_partkey")
    acc = lambda x: F.concat(F.lit("GCF_"), F.lpad(x.cast("string"), 9, "0"), F.lit(".1"))
    row = lambda x, size: F.array_join(F.concat(F.array(acc(x)), F.array_repeat(F.lit("x"), 5), F.array(F.col("p_size").cast("string")), F.array_repeat(F.lit("x"), 18), F.array(F.concat(size.cast("string"), F.lit(",000"))), F.array_repeat(F.lit("x"), 4), F.array(F.lit("3"))), "\t")
    one = lines(b.t("part"), row(k - k % 4, k), "p_partkey", F.lit("a"))  # four lines for an accession: the last counts
    two = lines(b.t("part"), row(k + 10, k * 0 + 1), "p_partkey", F.lit("b"))
    return formats.parse_assembly(one.union(two).union(one.limit(2).withColumn("value", F.lit("short\trow"))), {"a": 0, "b": 1})


ASSEMBLY = """a as (select p_partkey - p_partkey % 4 as k, p_size::bigint as s, p_partkey * 1000 as g, 0 as f, p_partkey as o from part union all select p_partkey + 10, p_size, 1000, 1, p_partkey from part),
asm as (select 'GCF_' || lpad(k::varchar, 9, '0') || '.1' as accession, arg_max(s, o - f * 100000000) as species_taxid, arg_max(g, o - f * 100000000)::bigint as genome_size, 3::bigint as contig_count from a group by k)"""


@query("assembly", f"with {ASSEMBLY} select * from asm")
def q_assembly(b: Bound) -> DataFrame:
    return assembly(b)


@query("input_list", """with p as (select p_partkey as k, 'GCF_' || lpad(p_partkey::varchar, 9, '0') || case when p_partkey % 5 = 0 then 'v2' else '.1' end as accession from part),
t as (select accession, case when k % 3 = 0 then 'd/my-' || accession || '.fna' else 'd/' || accession || '_x.fna' end as path, k from p),
a as (select 'GCF_' || lpad(p_partkey::varchar, 9, '0') || case when p_partkey % 5 = 0 then 'v2' else '.1' end as accession, (p_size + 1)::bigint as taxid from part where p_partkey % 4 <> 0)
select accession, path, taxid from t join a using (accession) where k % 3 <> 0 or k % 5 <> 0""")
def q_input_list(b: Bound) -> DataFrame:
    """Summaries of 20 columns; some accessions have no number after their dot, some names don't begin with theirs."""
    k = F.col("p_partkey")
    acc = F.concat(F.lit("GCF_"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 5 == 0, "v2").otherwise(".1"))
    t = b.t("part").select(F.when(k % 3 == 0, F.concat(F.lit("d/my-"), acc, F.lit(".fna"))).otherwise(F.concat(F.lit("d/"), acc, F.lit("_x.fna"))).alias("path"))
    row = lambda size: F.array_join(F.concat(F.array(acc), F.array_repeat(F.lit("x"), 5), F.array(size.cast("string")), F.array_repeat(F.lit("x"), 13)), "\t")
    some = b.t("part").filter(k % 4 != 0)
    rows = lines(some, row(F.col("p_size") - 1000), "p_partkey").unionByName(lines(some, row(F.col("p_size") + 1), "p_partkey").withColumn("line_no", F.col("line_no") + 10**9))
    return formats.build_input_list(t, formats.parse_assembly_taxa(rows))


@query("time_log", """select 'e' || event_id as file, (case when event_id % 2 = 0 then user_id * 3600 + 65 else event_id % 60 * 60 end)::double + 1.5 as elapsed_seconds, user_id as max_rss_kb, round(value, 4) as user_seconds, null::double as system_seconds, (event_id % 400)::double as cpu_percent, event_id % 3 as exit_status from events""")
def q_time_log(b: Bound) -> DataFrame:
    """A command line with `: ` in it is no key, and of a repeated key the last good value counts."""
    e = F.col("event_id")
    clock = F.when(e % 2 == 0, F.concat(F.col("user_id"), F.lit(":01:06.5"))).otherwise(F.concat((e % 60).cast("string"), F.lit(":01.5")))
    said = [F.lit('\tCommand being timed: "x User time (seconds): 9"'), F.lit("\tUser time (seconds): 1.5"), F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock), F.concat(F.lit("\tMaximum resident set size (kbytes): "), F.col("user_id")), F.concat(F.lit("\tUser time (seconds): "), F.col("value")),
        F.lit("\tUser time (seconds): bad"), F.lit("\tSystem time (seconds): none"), F.concat(F.lit("\tPercent of CPU this job got: "), e % 400, F.lit("%")), F.concat(F.lit("\tExit status: "), e % 3)]
    rows = b.t("events").select(F.concat(F.lit("e"), e).alias("file"), F.posexplode(F.array(*said)).alias("line_no", "value"))
    return rounded(formats.parse_time_log(rows), 4)


@query("read_id_norm", "select doc_id, regexp_extract(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '^\\S*') as read_id from documents")
def q_read_id(b: Bound) -> DataFrame:
    return b.t("documents").select("doc_id", tx.read_id(F.col("text")).alias("read_id"))


@query("mate_mark", "select conv_id, turn, 'c' || conv_id || '__mate' || (turn % 2 + 1) as read_id from conversations")
def q_mate(b: Bound) -> DataFrame:
    rid = F.concat(F.lit("@c"), F.col("conv_id"), F.when(F.col("turn") % 3 == 0, "/1").when(F.col("turn") % 3 == 1, "__mate7").otherwise(""), F.lit(" x"))
    return b.t("conversations").select("conv_id", "turn", tx.mate_marked(rid, F.col("turn") % 2 + 1).alias("read_id"))


@query("pair_suffix", "select conv_id, turn, '@c' || conv_id || '/1 rest of ' || role as header from conversations")
def q_suffix(b: Bound) -> DataFrame:
    return b.t("conversations").select("conv_id", "turn", tx.pair_suffixed(F.concat(F.lit("@c"), F.col("conv_id"), F.lit(" rest of "), F.col("role")), 1).alias("header"))


@query("tag_reference", """with r as (select p_partkey, 's' || p_partkey || case when p_partkey % 4 = 0 then '|kraken:taxid|9' else '|kraken:taxid|' || p_size end as seq_id, p_size::bigint as taxid from part where p_partkey % 5 <> 0)
select seq_id || case when p_partkey % 3 = 0 then '' else ' d e' end as header, seq_id, taxid from r""")
def q_tag(b: Bound) -> DataFrame:
    k = F.col("p_partkey")
    header = F.concat(F.lit("s"), k, F.when(k % 4 == 0, "|kraken:taxid|9").otherwise(""), F.when(k % 3 == 0, "").otherwise("  d e"))
    records = b.t("part").select(F.concat(F.lit("f"), k).alias("file"), header.alias("header"), F.lit("ACGT").alias("seq"))
    targets = b.t("part").filter("p_partkey % 5 <> 0").select(F.concat(F.lit("f"), k).alias("path"), F.col("p_size").cast("long").alias("taxid"))
    return sequences.tag_records(records, targets).select("header", "seq_id", "taxid")


@query("single_read_truth", "select 'c' || conv_id || '.' || (turn // 2) || '__mate' || (turn % 2 + 1) as read_id, role as label from conversations where role <> 'system'")
def q_single(b: Bound) -> DataFrame:
    rows = b.t("conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.floor(F.col("turn") / 2)).alias("read"), (F.col("turn") % 2 + 1).alias("mate"), F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("label"))
    return read_ops.single_read_truth(rows)


@query("deinterleave", """with r as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as rec, turn from conversations),
p as (select conv_id, rec // 2 as pair, count(*) as n, bool_and(turn % 5 <> 4) as fine from r group by 1, 2)
select 'f' || conv_id as file, pair::bigint as pair, case when n < 2 then 'odd number of records' when not fine then 'not a pair' end as fault from p""")
def q_deinterleave(b: Bound) -> DataFrame:
    from pyspark.sql import Window

    rec = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = b.t("conversations").withColumn("rec", rec)
    head = F.concat(F.lit("@r"), F.floor(F.col("rec") / 2), F.when(F.col("turn") % 5 == 4, "/3").otherwise(F.concat(F.lit("/"), (F.col("rec") % 2 + 1).cast("string"))), F.lit(" x"))
    return read_ops.deinterleave(rows.select(F.concat(F.lit("f"), F.col("conv_id")).alias("file"), "rec", head.alias("header"))).select("file", "pair", "fault")


@query("asset_audit", """select 's' || user_id as sample, sum(event_id % 7) filter (event_id % 2 = 0)::bigint as r1_records, sum(event_id % 7) filter (event_id % 2 = 1)::bigint as r2_records, sum(event_id % 7)::bigint as records, sum(event_id % 11)::bigint as bases, count(*) as truth_rows,
max(event_id) as spots, case when user_id % 3 = 0 then null else min(event_id) end as spots_with_mates, case when user_id % 3 = 0 then null else max(event_id) - min(event_id) end as unpaired_spots from events group by user_id""")
def q_assets(b: Bound) -> DataFrame:
    e, s = b.t("events"), F.concat(F.lit("s"), F.col("user_id")).alias("sample")
    assets = e.select(s, (F.col("event_id") % 2 + 1).alias("mate"), (F.col("event_id") % 7).alias("records"), (F.col("event_id") % 11).alias("bases"), F.lit(1).cast("long").alias("truth_rows"))
    spots = e.groupBy(s).agg(F.max("event_id").alias("spots"), F.min("event_id").alias("m"), F.first("user_id").alias("u")).select("sample", "spots", F.when(F.col("u") % 3 != 0, F.col("m")).alias("spots_with_mates"))
    return read_ops.asset_audit(assets, spots)


@query("name_aliases", "select c_custkey, case when c_custkey % 2 = 0 then ['[Bacillus] subtilis strain ' || c_custkey, 'Bacillus subtilis', '[Bacillus] subtilis'] else ['Vibrio sp. ' || c_custkey || ' (x)', 'Vibrio sp. ' || c_custkey] end as aliases from customer")
def q_aliases(b: Bound) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"[Bacillus]  subtilis" strain '), k)).otherwise(F.concat(F.lit(" Vibrio sp. "), k, F.lit(" (x)")))
    return b.t("customer").select("c_custkey", tx.name_aliases(name).alias("aliases"))


NAMED = """sci as (select c_name as name, max(1000000 + c_custkey) as taxid from customer group by 1),
al as (select 'alias-' || c_mktsegment || ' ' || (c_custkey % 50) as alias, arg_min(c_name, c_custkey) as name from customer group by 1)"""


@query("synonyms", f"with {NAMED} select * from al")
def q_synonyms(b: Bound) -> DataFrame:
    return taxonomy.synonyms(b.names(), b.nodes(), ["synonym"])


@query("resolve_names", f"""with {NAMED}, q as (select c_custkey as k, case c_custkey % 3 when 0 then c_name when 1 then 'alias-' || c_mktsegment || ' ' || (c_custkey % 60) else 'nothing' end as n from customer)
select k, n as name, coalesce(s.taxid, t.taxid) as taxid from q left join sci s on s.name = n left join al on alias = n left join sci t on t.name = al.name""")
def q_resolve(b: Bound) -> DataFrame:
    m = F.col("c_custkey") % 3
    q = b.t("customer").select(F.col("c_custkey").alias("k"), F.when(m == 0, F.col("c_name")).when(m == 1, F.concat(F.lit("alias-"), F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey") % 60)).otherwise("nothing").alias("q"))
    names = b.names()
    return taxonomy.resolve_names(q, "q", taxonomy.name_map(names), taxonomy.synonyms(names, b.nodes(), ["synonym"])).select("k", F.col("q").alias("name"), "taxid")


@query("select_runs", "select event_id from events where event_type in ('click') or user_id::varchar in ('1', '2')")
def q_select(b: Bound) -> DataFrame:
    runs = b.t("events").select("event_id", F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("sample"), F.lit(None).cast("string").alias("collection"), F.lit(None).cast("string").alias("display"))
    return read_ops.select_runs(runs, ["click", "1", "2"]).select("event_id")


@query("cami_write", """select 0::bigint as line_no, array_to_string(['@@TAXID', 'RANK', 'TAXPATH', 'TAXPATHSN', 'PERCENTAGE'], chr(9)) as value
union all select o_custkey + 1, concat_ws(chr(9), o_custkey, 'species', '-', '-', max(o_orderkey)) from orders group by o_custkey""")
def q_cami_write(b: Bound) -> DataFrame:
    made = b.t("orders").groupBy(F.col("o_custkey").alias("taxid")).agg(F.max("o_orderkey").alias("value")).withColumn("rank", F.lit("species"))
    return formats.cami_lines(made.withColumn("line_no", F.col("taxid")))


@query("expand_datasets", """select r_name || case when n_nationkey is null then '' else '-' || n_name end as expanded, r_name as collection, n_name as sample_id, case when n_nationkey % 2 = 0 then 'own' else 'db' || r_regionkey end as db, 'inherited' as label from region join nation on n_regionkey = r_regionkey""")
def q_expand(b: Bound) -> DataFrame:
    n = b.t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "own").alias("db"), F.lit(None).cast("string").alias("label"))).alias("samples"))
    d = b.t("region").join(n, "r_regionkey").select(F.col("r_name").alias("name"), F.concat(F.lit("db"), F.col("r_regionkey")).alias("db"), F.lit("inherited").alias("label"), "samples")
    return formats.expand_datasets(d)


@query("metadata_project", "select doc_id, case source when 'src1' then 'A' else 'B' end as cohort from documents where source in ('src1', 'src2')")
def q_metadata(b: Bound) -> DataFrame:
    return formats.project_metadata(b.t("documents").select("doc_id", F.col("source").alias("cohort")), {"src1": "A", "src2": "B"})
