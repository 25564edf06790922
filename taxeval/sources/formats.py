"""Parsers of taxonomic text formats: lines(file, line_no, value) -> DataFrame.

Bad numbers skip the row. Where a key repeats, the first or the last line wins, by line number, never by arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accession_by_parts, accession_of_path, as_double, as_long, cell, cells, genome_id_candidates, read_id, stripped
from ..operators.durable import written
from ..operators.gates import required_columns
from ..operators.profiles import autoscaled
from .lines import SPLITS

# Name classes that count as synonyms; Bracken level letters; header names, in order of preference.
SYNONYM_CLASSES = ["synonym", "authority", "equivalent name", "genbank synonym", "genbank anamorph", "genbank common name", "common name", "includes"]
BRACKEN_RANKS = {"D": "domain", "P": "phylum", "C": "class", "O": "order", "F": "family", "G": "genus", "S": "species"}
NAME_HEADERS = ["species_label", "species_name", "taxon", "name", "species"]
VALUE_HEADERS = ["truth_abundance", "abundance", "relative_abundance", "percentage", "percent", "value"]
CAMI_COLUMNS = ["@@TAXID", "RANK", "TAXPATH", "TAXPATHSN", "PERCENTAGE"]
#: Lines that look for their header together.
RUN = 4096


def data_lines(lines: DataFrame, comments: str = "#") -> DataFrame:
    """Stripped lines that are neither blank nor comments."""
    kept = lines.withColumn("value", stripped(F.col("value"))).filter("value <> ''")
    return kept.filter(~F.substring("value", 1, 1).isin(*comments)) if comments else kept


def line_order():
    return F.struct("file", "line_no")


def parse_nodes(lines: DataFrame) -> DataFrame:
    """(taxid, parent, rank) of `|`-separated lines; fewer than three cells or bad numbers: skipped; the last wins."""
    c = F.split("value", r"\|", -1)
    rows = lines.filter(F.size(c) >= 3).select(line_order().alias("o"), as_long(c[0]).alias("taxid"), as_long(c[1]).alias("parent"), stripped(c[2]).alias("rank"))
    return rows.filter("taxid is not null and parent is not null").groupBy("taxid").agg(F.max_by(F.struct("parent", "rank"), "o").alias("r")).select("taxid", "r.*")


def parse_names(lines: DataFrame) -> DataFrame:
    """(taxid, name, name_class, ord): scientific names and synonyms; ord is the line number."""
    c = F.split("value", r"\|", -1)
    rows = lines.filter(F.size(c) >= 4).select(as_long(c[0]).alias("taxid"), stripped(c[1]).alias("name"), stripped(c[3]).alias("name_class"), F.col("line_no").alias("ord"))
    return rows.filter((F.col("taxid").isNotNull()) & (F.col("name") != "") & F.col("name_class").isin("scientific name", *SYNONYM_CLASSES))


def parse_tax(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(taxid, parent, rank), ref_files(file_id, taxid), rank_names(rank, name, taxid) of lines with three or four
    cells; rows of rank `file` map a file to its taxon; names: the first wins."""
    c = cells(F.col("value"))
    rows = lines.select(line_order().alias("o"), cell(c, 0).alias("id"), as_long(cell(c, 0)).alias("taxid"), as_long(cell(c, 1)).alias("parent"), cell(c, 2).alias("rank"), cell(c, 3).alias("name")).filter("rank is not null and parent is not null")
    files = rows.filter("rank = 'file' and taxid is null").groupBy(F.col("id").alias("file_id")).agg(F.max_by("parent", "o").alias("taxid"))
    nodes = rows.filter("taxid is not null").groupBy("taxid").agg(F.max_by(F.struct("parent", "rank"), "o").alias("r")).select("taxid", "r.*")
    named = rows.filter("taxid is not null and coalesce(name, '') <> ''").groupBy("rank", "name").agg(F.min_by("taxid", "o").alias("taxid"))
    return nodes, files, named


def parse_classify(lines: DataFrame) -> DataFrame:
    """(file, read_id, taxid): the first word, and of the first non-empty later cell what stands before a colon;
    `unclassified` and other texts are null; the last line of a read wins."""
    rows = lines.withColumn("value", stripped(F.col("value"))).filter("value <> ''")
    c = cells(F.col("value"))
    later = F.get(F.filter(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: stripped(x) != ""), F.lit(0))
    rows = rows.filter(F.size(c) >= 2).select("file", "line_no", read_id(c[0]).alias("read_id"), as_long(F.split(later, ":")[0]).alias("taxid"))
    return rows.groupBy("file", "read_id").agg(F.max_by(F.struct("taxid"), "line_no").alias("r")).select("file", "read_id", "r.taxid")


def parse_one(lines: DataFrame, ref_files: DataFrame) -> DataFrame:
    """(file, read_id, taxid) of match lines; an H cell in front shifts the others. The reference's taxon by the file
    map, else the reference itself if all digits, else the first later cell that is all digits before a colon; lines
    without a taxon don't count, and the last line wins."""
    c = cells(F.col("value"))
    shift = F.when(F.startswith(c[0], F.lit("H")) & (F.size(c) > 2), 1).otherwise(0)
    rest = F.when(F.size(c) > 2, F.slice(c, 3, F.size(c))).otherwise(F.slice(c, 2, F.size(c)))
    rows = data_lines(lines).withColumn("_c", F.slice(c, shift + 1, F.size(c))).filter(F.size("_c") >= 2)
    rows = rows.select("file", "line_no", F.col("_c")[0].alias("read_id"), F.col("_c")[1].alias("file_id"), F.get(F.filter(F.transform(rest, lambda x: F.split(x, ":")[0]), lambda x: x.rlike("^[0-9]+$")), F.lit(0)).alias("_digits"))
    found = rows.join(ref_files.withColumnRenamed("taxid", "_ref"), "file_id", "left")
    taxid = F.coalesce("_ref", F.when(F.col("file_id").rlike("^[0-9]+$"), as_long(F.col("file_id"))), as_long(F.col("_digits")))
    return found.withColumn("taxid", taxid).filter("taxid is not null and read_id <> ''").groupBy("file", "read_id").agg(F.max_by("taxid", "line_no").alias("taxid"))


def headers(lines: DataFrame) -> DataFrame:
    """lines with `head`, the lower-cased cells of the first line of the file, and without it."""
    first = lines.groupBy("file").agg(F.min("line_no").alias("_at"), F.min_by("value", "line_no").alias("_head"))
    return lines.join(first, "file").withColumn("head", F.transform(cells(F.col("_head")), lambda x: F.lower(stripped(x))))


def position(names: list[str]):
    """Where the first of the names is in `head`, from 1; 0: none of them."""
    out = F.lit(0).cast("long")
    for n in reversed(names):
        out = F.when(F.array_position("head", n) > 0, F.array_position("head", n)).otherwise(out)
    return out


def parse_truth_profile(lines: DataFrame) -> DataFrame:
    """(file, name, value). A first line with a known name header is a header; without a known value header the value
    is the second cell, or the first where names are elsewhere. No header: the first two cells. Summed by name, and
    percentages scaled to fractions."""
    rows = headers(data_lines(lines)).withColumn("_n", position(NAME_HEADERS)).withColumn("_v", position(VALUE_HEADERS))
    has = F.col("_n") > 0
    c = cells(F.col("value"))
    name_at = F.when(has, F.col("_n") - 1).otherwise(0)
    value_at = F.when(~has, 1).when(F.col("_v") > 0, F.col("_v") - 1).when(F.col("_n") == 1, 1).otherwise(0)
    rows = rows.filter((~has | (F.col("line_no") > F.col("_at"))) & (name_at != value_at))
    rows = rows.select("file", stripped(F.get(c, name_at.cast("int"))).alias("name"), as_double(F.get(c, value_at.cast("int"))).alias("value"))
    sums = rows.filter("name <> '' and value is not null").groupBy("file", "name").agg(F.sum("value").alias("value"))
    totals = sums.groupBy("file").agg(F.sum("value").alias("_total"))
    return sums.join(totals, "file").withColumn("value", autoscaled(F.col("value"), F.col("_total"))).drop("_total")


def parse_species_truth(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """truth(file, read_id, taxid) and stats(file, rows, unmapped_rows, unmapped_names) of rows(file, read_id, label);
    known(name, taxid). Two taxa for one read are an error."""
    joined = rows.filter("coalesce(read_id, '') <> '' and coalesce(label, '') <> ''").join(known.select(F.col("name").alias("label"), "taxid"), "label", "left")
    none = F.col("taxid").isNull()
    stats = joined.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum(none.cast("long")).alias("unmapped_rows"), F.count_distinct(F.when(none, F.col("label"))).alias("unmapped_names"))
    truth = joined.filter(~none).groupBy("file", "read_id").agg(F.min("taxid").alias("taxid"), F.max("taxid").alias("_most"))
    clash = F.raise_error(F.concat(F.lit("conflicting taxa for "), F.col("read_id"))).cast("long")
    return truth.select("file", "read_id", F.when(F.col("taxid") == F.col("_most"), F.col("taxid")).otherwise(clash).alias("taxid")), stats


def parse_cami_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """truth(file, read_id, taxid), the last line of an id wins, and abundance(file, taxid, weight) over all lines of
    four cells or more; a line counts max(1, reads), 1 where reads are bad. Ids are the whole first cell."""
    rows = cami_rows(lines)
    truth = rows.groupBy("file", "read_id").agg(F.max_by("taxid", "line_no").alias("taxid"))
    return truth, rows.groupBy("file", "taxid").agg(F.sum("weight").alias("weight"))


def cami_rows(lines: DataFrame) -> DataFrame:
    c = cells(F.col("value"))
    weight = F.greatest(F.lit(1).cast("long"), F.coalesce(as_long(cell(c, 4)), F.lit(1).cast("long")))
    return data_lines(lines).filter(F.size(c) >= 4).select("file", "line_no", c[0].alias("read_id"), as_long(cell(c, 2)).alias("taxid"), weight.alias("weight")).filter("taxid is not null")


def cami_weights(lines: DataFrame) -> DataFrame:
    """(file, read_id, weight) of a CAMI map: how many reads an id (a contig, say) stands for, by its last line."""
    return cami_rows(lines).groupBy("file", "read_id").agg(F.max_by("weight", "line_no").alias("weight"))


def parse_genomes(lines: DataFrame, ref_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profile(file, taxid, value) and unmapped(file, count, mass) of native genome profiles; the taxonomic abundance
    is preferred to that of sequences; a genome's taxon by the first of its candidate ids that is known."""
    rows = headers(data_lines(lines, "")).filter("line_no > _at").withColumn("_g", position(["genome_file"])).withColumn("_v", position(["taxonomic_abundance", "sequence_abundance"]))
    c = cells(F.col("value"))
    at = lambda i: F.get(c, (F.col(i) - 1).cast("int"))
    rows = rows.filter("_g > 0 and _v > 0").select("file", "line_no", stripped(at("_g")).alias("genome"), as_double(at("_v")).alias("value")).filter("value is not null")
    rows = rows.join(rows.groupBy("file").agg(F.sum("value").alias("_total")), "file").withColumn("value", autoscaled(F.col("value"), F.col("_total"))).drop("_total")
    tried = rows.select("file", "line_no", F.posexplode(genome_id_candidates(F.col("genome"))).alias("pos", "file_id")).join(ref_files, "file_id")
    found = rows.join(tried.groupBy("file", "line_no").agg(F.min_by("taxid", "pos").alias("taxid")), ["file", "line_no"], "left")
    profile = found.filter("taxid is not null").groupBy("file", "taxid").agg(F.sum("value").alias("value"))
    lost = F.col("taxid").isNull()
    return profile, found.groupBy("file").agg(F.sum(lost.cast("long")).alias("unmapped"), F.sum(F.when(lost, F.col("value")).otherwise(0.0)).alias("unmapped_mass"))


def carried(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows(file, line_no, ...) with what the last one of heads(file, line_no, head) before them says; null before any.

    A head holds from its line to the next one's, as a row for each run of RUN lines that it reaches into: rows meet the
    few heads of their run. These are broadcast up to SPLITS of them; beyond that, rows and heads are dealt by runs.
    """
    run = lambda c: F.expr(f"{c} div {RUN}")
    span = heads.select(F.col("file").alias("_file"), F.col("line_no").alias("_from"), "head").withColumn("_to", F.lead("_from").over(Window.partitionBy("_file").orderBy("_from")))
    last = rows.groupBy(F.col("file").alias("_file")).agg(F.max("line_no").alias("_end"))
    span = span.join(last, "_file").withColumn("_to", F.coalesce("_to", F.col("_end") + 1)).filter("_to > _from + 1")
    span = written(span.withColumn("_run", F.explode(F.sequence(run("_from"), run("(_to - 1)")))).drop("_end"), "heads")
    held = F.broadcast(span) if span.count() <= SPLITS else span
    same = (F.col("file") == F.col("_file")) & (run("line_no") == F.col("_run")) & (F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_to"))
    return rows.join(held, same, "left").drop("_file", "_from", "_to", "_run")


def parse_cami_profile(lines: DataFrame) -> DataFrame:
    """(file, rank, taxid, value), summed. @@ lines name the columns of what follows; without all three names they are the
    first, the second and the last of at least five cells. Taxids like 123:x, 123|x and 123.1 are 123."""
    rows = lines.withColumn("value", stripped(F.col("value"))).filter("value <> ''")
    is_head = F.startswith("value", F.lit("@@"))
    bare = F.regexp_replace("value", "^@+", "")
    parts = F.when(F.contains(bare, F.lit("\t")), F.split(bare, "\t")).otherwise(F.split(bare, r"\s+"))
    named = F.filter(F.transform(parts, lambda x: F.upper(F.regexp_replace(stripped(x), "^@+", ""))), lambda x: x != "")
    whole = F.array_contains(named, "TAXID") & F.array_contains(named, "RANK") & F.array_contains(named, "PERCENTAGE")
    heads = rows.filter(is_head).select("file", "line_no", F.when(whole, named).otherwise(F.array().cast("array<string>")).alias("head"))
    c = cells(F.col("value"))
    rows = carried(rows.filter(~F.substring("value", 1, 1).isin("@", "#")), heads)
    has = F.coalesce(F.size("head") > 0, F.lit(False))
    at = lambda name, d: F.get(c, F.when(has, F.array_position("head", name) - 1).otherwise(d).cast("int"))
    rows = rows.filter(has | (F.size(c) >= 5))
    taxid = F.regexp_extract(stripped(at("TAXID", F.lit(0))), r"^([0-9]+)(?:[:|.].*)?$", 1)
    rows = rows.select("file", F.lower(stripped(at("RANK", F.lit(1)))).alias("rank"), as_long(taxid).alias("taxid"), as_double(at("PERCENTAGE", F.size(c) - 1)).alias("value"))
    return rows.filter("taxid > 0 and rank not in ('', 'unclassified') and value is not null").groupBy("file", "rank", "taxid").agg(F.sum("value").alias("value"))


def parse_tre(lines: DataFrame) -> DataFrame:
    """(file, line_no, rank, taxid, count): the count is the last cell but one; rows of unclassified and root included."""
    c = cells(F.col("value"))
    rows = data_lines(lines, "").filter(F.size(c) >= 3)
    return rows.select("file", "line_no", cell(c, 0).alias("rank"), cell(c, 1).alias("taxid"), as_double(cell(c, -2)).alias("count")).filter("count is not null")


def tre_profile(rows: DataFrame) -> DataFrame:
    """(file, rank, taxid, value) of positive counts, summed."""
    made = rows.withColumn("taxid", as_long(F.col("taxid"))).filter("taxid is not null and count > 0")
    return made.groupBy("file", "rank", "taxid").agg(F.sum("count").alias("value"))


def parse_bracken(lines: DataFrame) -> DataFrame:
    """(file, line_no, taxid, rank, value) of rows with estimated reads. Known level letters become ranks, other levels
    are taken in lower case, and blank ones are species."""
    rows = headers(data_lines(lines))
    has = F.array_contains("head", "taxonomy_id") & F.array_contains("head", "new_est_reads")
    c = cells(F.col("value"))
    at = lambda i, d: F.get(c, F.when(has, i - 1).otherwise(d).cast("int"))
    place = lambda name: F.array_position("head", name)
    level = stripped(at(F.when(place("taxonomy_lvl") > 0, place("taxonomy_lvl")).otherwise(F.nullif(place("taxonomy_level"), F.lit(0).cast("long"))), 2))
    known = F.create_map(*[F.lit(x) for kv in BRACKEN_RANKS.items() for x in kv])[level]
    rank = F.when(F.coalesce(level, F.lit("")) == "", "species").otherwise(F.coalesce(known, F.lower(level)))
    rows = rows.filter(~has | (F.col("line_no") > F.col("_at"))).select("file", "line_no", digits(at(place("taxonomy_id"), 1)).alias("taxid"), rank.alias("rank"), as_double(at(place("new_est_reads"), 5)).alias("value"))
    return rows.filter("taxid > 0 and value > 0")


def digits(c: Column) -> Column:
    """The number that a cell of digits alone is."""
    return F.when(stripped(c).rlike("^[0-9]+$"), as_long(c))


def parse_kraken2(lines: DataFrame) -> DataFrame:
    """(file, line_no, read_id, taxid): U lines and taxids 0, -, unclassified and blank are null."""
    c = cells(F.col("value"))
    rows = data_lines(lines, "").filter(F.size(c) >= 3)
    t = cell(c, 2)
    return rows.select("file", "line_no", cell(c, 1).alias("read_id"), F.when((cell(c, 0) != "U") & ~t.isin("0", "-", "unclassified", ""), as_long(t)).alias("taxid"))


def parse_centrifuger(lines: DataFrame) -> DataFrame:
    """(file, read_id, taxid): without the header row (readID and taxID at their places) and rows without an id; the
    first line of a read wins."""
    c = cells(F.col("value"))
    t = cell(c, 2)
    head = (F.lower(cell(c, 0)) == "readid") & (F.lower(t) == "taxid")
    rows = data_lines(lines, "").filter((F.size(c) >= 3) & ~head & (cell(c, 0) != ""))
    rows = rows.select("file", "line_no", cell(c, 0).alias("read_id"), F.when(~t.isin("0", "-", "unclassified", ""), as_long(t)).alias("taxid"))
    return rows.groupBy("file", "read_id").agg(F.min_by(F.struct("taxid"), "line_no").alias("r")).select("file", "read_id", "r.taxid")


def fill_lineage(df: DataFrame, lineages: DataFrame) -> DataFrame:
    """df(accession, reference_name, taxid, tax_str, tax_id_str) with blanks filled from lineages(seed, names, ids);
    an unknown taxon has root and 1; a blank name becomes the accession."""
    blank = lambda c: F.nullif(stripped(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    joined = df.withColumn("seed", as_long(F.col("taxid"))).join(lineages, "seed", "left")
    return joined.select("accession", F.coalesce(blank("reference_name"), F.col("accession")).alias("reference_name"), "taxid", F.coalesce(blank("tax_str"), "names", F.lit("root")).alias("tax_str"), F.coalesce(blank("tax_id_str"), "ids", F.lit("1")).alias("tax_id_str"))


def parse_targets(lines: DataFrame) -> DataFrame:
    """(file, path, taxid): relative paths are taken from the list's folder; fewer than two cells are an error."""
    c = cells(F.col("value"))
    short = F.raise_error(F.concat(F.lit("target without taxid: "), F.col("value")))
    path = F.when(F.size(c) < 2, short).otherwise(cell(c, 0))
    folder = F.regexp_replace("file", "[^/]*$", "")
    return data_lines(lines).select("file", F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path)).alias("path"), as_long(cell(c, 1)).alias("taxid"))


def parse_assembly(lines: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """(accession, species_taxid, genome_size, contig_count) of tab-separated columns 0, 6, 25 and 30; commas in
    numbers go; an earlier file wins, and of a file the last line of an accession."""
    c = F.split("value", "\t", -1)
    number = lambda i: as_long(F.replace(F.get(c, F.lit(i)), F.lit(","), F.lit("")))
    rows = data_lines(lines).filter(F.size(c) >= 31)
    files = priority or {r[0]: i for i, r in enumerate(lines.select("file").distinct().orderBy("file").collect())}  # a few files
    rank = F.create_map(*[F.lit(x) for kv in files.items() for x in kv])[F.col("file")]
    rows = rows.select(c[0].alias("accession"), F.struct((-rank).alias("f"), "line_no").alias("o"), F.struct(number(6).alias("species_taxid"), number(25).alias("genome_size"), number(30).alias("contig_count")).alias("r"))
    return rows.groupBy("accession").agg(F.max_by("r", "o").alias("r")).select("accession", "r.*")


def missing_assemblies(targets: DataFrame, assembly: DataFrame) -> DataFrame:
    """(accession) of targets(path) that no assembly summary has: an incomplete summary is an error (assert_empty)."""
    return targets.select(accession_of_path(F.col("path")).alias("accession")).distinct().join(assembly.select("accession"), "accession", "left_anti")


def parse_assembly_taxa(lines: DataFrame) -> DataFrame:
    """(accession, species_taxid) of assembly summaries with 20 columns or more; the last line of an accession wins."""
    c = cells(F.col("value"))
    rows = data_lines(lines).filter(F.size(c) >= 20).select(c[0].alias("accession"), "file", "line_no", as_long(c[6]).alias("species_taxid"))
    return rows.filter("accession <> '' and species_taxid is not null").groupBy("accession").agg(F.max_by("species_taxid", F.struct("file", "line_no")).alias("species_taxid"))


def build_input_list(targets: DataFrame, assembly: DataFrame) -> DataFrame:
    """(accession, path, taxid) of targets whose file name has an accession (text.accession_by_parts) that
    assembly(accession, species_taxid) knows, with a species taxon."""
    known = assembly.filter("species_taxid is not null").select("accession", F.col("species_taxid").alias("species"))
    return targets.select(accession_by_parts(F.col("path")).alias("accession"), "path").filter("accession is not null").join(known, "accession").select("accession", "path", F.col("species").alias("taxid"))


def parse_time_log(lines: DataFrame) -> DataFrame:
    """(file, elapsed_seconds, max_rss_kb, user_seconds, system_seconds, cpu_percent, exit_status) of lines with a key
    up to the first `: ` and a value; elapsed as h:mm:ss, m:ss or s. Of a repeated key the last good value counts."""
    line = F.col("value")
    key, v = stripped(F.substring_index(line, ": ", 1)), stripped(F.substr(line, F.locate(": ", line) + 2))
    rows = lines.filter(F.contains(line, F.lit(": "))).select("file", "line_no", key.alias("key"), v.alias("v"))
    seconds = F.aggregate(F.transform(F.split("v", ":"), lambda x: x.try_cast("double")), F.lit(0.0), lambda a, x: a * 60 + x)
    of = lambda name, e: F.max_by(F.when(F.col("key") == name, e), F.when((F.col("key") == name) & e.isNotNull(), F.col("line_no")))
    # The keys of the log.
    return rows.groupBy("file").agg(
        of("Elapsed (wall clock) time (h:mm:ss or m:ss)", seconds).alias("elapsed_seconds"), of("Maximum resident set size (kbytes)", as_long(F.col("v"))).alias("max_rss_kb"),
        of("User time (seconds)", as_double(F.col("v"))).alias("user_seconds"), of("System time (seconds)", as_double(F.col("v"))).alias("system_seconds"),
        of("Percent of CPU this job got", as_double(F.replace(F.col("v"), F.lit("%"), F.lit("")))).alias("cpu_percent"), of("Exit status", as_long(F.col("v"))).alias("exit_status"),
    )


def cami_lines(profile: DataFrame) -> DataFrame:
    """Lines (line_no, value) of a CAMI profile from (taxid, rank, value, and line_no, if there is an order): the header
    is line 0."""
    order = F.col("line_no") + 1 if "line_no" in profile.columns else 1 + F.monotonically_increasing_id()
    rows = profile.select(order.cast("long").alias("line_no"), F.concat_ws("\t", F.col("taxid").cast("string"), "rank", F.lit("-"), F.lit("-"), F.col("value").cast("string")).alias("value"))
    return profile.sparkSession.range(1).select(F.col("id").alias("line_no"), F.lit("\t".join(CAMI_COLUMNS)).alias("value")).unionByName(rows)


def expand_datasets(df: DataFrame) -> DataFrame:
    """A row for each sample of datasets(name, db, label, samples array<struct<id, db, label>>): what a sample says
    replaces what it inherits; datasets without samples stay. A sample without id and a repeated name are errors."""
    rows = df.select("name", F.col("db").alias("_db"), F.col("label").alias("_label"), F.explode_outer("samples").alias("s"))
    bad = F.col("s").isNotNull() & (F.coalesce(F.col("s.id"), F.lit("")) == "")
    own = F.when(bad, F.raise_error(F.concat(F.lit("sample without id in "), F.col("name")))).when(F.col("s").isNull(), F.col("name")).otherwise(F.concat_ws("-", "name", "s.id"))
    made = rows.select(own.alias("expanded"), F.when(F.col("s").isNotNull(), F.col("name")).alias("collection"), F.col("s.id").alias("sample_id"), F.coalesce("s.db", "_db").alias("db"), F.coalesce("s.label", "_label").alias("label"))
    n = F.count(F.lit(1)).over(Window.partitionBy("expanded"))
    return made.withColumn("_n", n).withColumn("expanded", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated dataset "), F.col("expanded")))).otherwise(F.col("expanded"))).drop("_n")


def project_metadata(df: DataFrame, cohorts: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Rows of known cohorts, under their short names. A table without all required columns is an error."""
    if missing := required_columns(df, list(required)):
        raise ValueError(f"metadata without columns {missing}")
    short = F.create_map(*[F.lit(x) for kv in cohorts.items() for x in kv])[F.col("cohort")]
    return df.withColumn("cohort", short).filter("cohort is not null")
