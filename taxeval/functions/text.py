"""Column functions on read ids, file names and taxon names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of sequence files, and words that aren't species epithets.
FASTA_SUFFIXES = (".fa", ".fa.gz", ".fna", ".fna.gz", ".fasta", ".fasta.gz")
NOT_EPITHETS = ("sp", "sp.", "cf", "cf.", "aff", "aff.", "bacterium")
ACCESSION = r"GC[AF]_\d+\.\d+"


def stripped(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cells(line: Column) -> Column:
    """The tab-separated cells of a line; the line is stripped first, so that empty cells at its ends vanish."""
    return F.split(stripped(line), "\t", -1)


def cell(array: Column, i: int) -> Column:
    """A stripped cell, null if there is none. Negative numbers count from the end."""
    return stripped(F.get(array, F.lit(i)) if i >= 0 else F.get(array, F.size(array) + i))


def as_long(c: Column) -> Column:
    """Whole numbers with an optional sign; null otherwise."""
    return F.when(stripped(c).rlike(r"^[+-]?\d{1,19}$"), stripped(c).try_cast("long"))


def as_double(c: Column) -> Column:
    return stripped(c).try_cast("double")


def read_id(c: Column) -> Column:
    """The first word, empty for blanks."""
    return F.regexp_extract(stripped(c), r"(?U)^\S*", 0)


def pair_base(c: Column) -> Column:
    """A read id without /1 or /2."""
    return F.regexp_replace(c, "/[12]$", "")


def mate_marked(c: Column, mate: Column) -> Column:
    """The id of a mate: without @, /1, /2 and __mateN, with __mate1 or __mate2 appended; other mates are an error."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(read_id(c), "^@", ""), "/[12]$", ""), r"__mate\d+$", "")
    return F.when(mate.isin(1, 2), F.concat(bare, F.lit("__mate"), mate.cast("string"))).otherwise(F.raise_error(F.concat(F.lit("not a mate: "), F.coalesce(mate.cast("string"), F.lit("null")))))


def pair_suffixed(header: Column, mate: int) -> Column:
    """/1 or /2 after the first word of a header (or plus) line; the rest stays."""
    return F.regexp_replace(header, r"^([@>+]\S+)", rf"$1/{mate}")


def accession(c: Column) -> Column:
    """The first assembly accession in a text, null if there is none."""
    return F.nullif(F.regexp_extract(c, f"({ACCESSION})", 1), F.lit(""))


def accession_of_path(c: Column) -> Column:
    """The assembly accession that a file's name begins with; any other name is an error."""
    found = F.regexp_extract(file_name(c), f"^({ACCESSION})", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no assembly accession in path: "), F.coalesce(c, F.lit("null")))))


def accession_by_parts(c: Column) -> Column:
    """The accession of a file name: its first two parts between underscores where the first is GCF or GCA, whatever
    the second, else the first accession in it; null if there is none."""
    name = file_name(c)
    parts = F.split(name, "_")
    return F.when((F.size(parts) >= 2) & parts[0].isin("GCF", "GCA"), F.concat_ws("_", parts[0], F.get(parts, F.lit(1)))).otherwise(accession(name))


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def without_fasta_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "(?:" + "|".join(s.replace(".", r"\.") for s in FASTA_SUFFIXES) + ")$", "")


def genome_id_candidates(c: Column) -> Column:
    """What a genome file may be known as: the text itself, its file name, that without suffix, its accession."""
    raw = stripped(c)
    name = file_name(raw)
    found = F.array(raw, name, without_fasta_suffix(name), accession(name))
    return F.array_distinct(F.filter(F.array_compact(found), lambda x: x != ""))


def name_aliases(c: Column) -> Column:
    """Names that a taxon may go by: without double quotes and needless blanks; without parentheses; its binomial, with
    and without brackets around the genus."""
    tidy = lambda x: stripped(F.regexp_replace(x, r"(?U)\s+", " "))
    clean = tidy(F.replace(c, F.lit('"'), F.lit("")))
    short = tidy(F.regexp_replace(clean, r"(?U)\s+\([^)]*\)", ""))
    words = F.split(short, " ")
    unbracketed = lambda x: F.regexp_replace(x, r"^[\[\]]+|[\[\]]+$", "")
    genus, epithet = unbracketed(words[0]), unbracketed(F.get(words, F.lit(1)))
    # What genus names and epithets look like.
    fine = genus.rlike(r"^[A-Za-z][A-Za-z.-]*$") & epithet.rlike(r"^[a-z][a-z.-]*$") & ~F.lower(epithet).isin(*NOT_EPITHETS)
    two = lambda g: F.when(fine, F.concat_ws(" ", g, epithet))
    return F.array_distinct(F.filter(F.array_compact(F.array(clean, short, two(genus), two(words[0]))), lambda x: x != ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
