"""Text expressions: locus keys, percent escapes, attributes, sequences, path names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: IUPAC nucleotide codes and their complements, both cases.
BASES, COMPLEMENTS = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
#: Attributes that name a feature, in order of preference.
ID_KEYS, NAME_KEYS = ("ID", "gene_id"), ("Name", "gene_name")
ALL_NAME_KEYS = ("ID", "gene_id", "Name", "gene_name", "Alias", "gene_synonym")


def locus_key(name: Column) -> Column:
    """Trims blank, tab, line feed, form feed and carriage return; lower-cases A-Z and nothing else."""
    return F.translate(F.btrim(name, F.lit(" \t\n\f\r")), UPPER, LOWER)


def percent_decode(x: Column) -> Column:
    """Strict %HH escapes of UTF-8; a plus sign stands for itself; anything malformed is an error."""
    bad = x.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(bad, F.raise_error(F.concat(F.lit("malformed percent escape in "), x))).otherwise(F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))


def gff_attributes(x: Column) -> Column:
    """Column nine of GFF3 as an array of (key, values), one entry for each key=value part, decoded after splitting."""
    parts = F.filter(F.split(x, ";"), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            percent_decode(F.trim(F.split(p, "=", 2)[0])).alias("key"),
            F.transform(F.split(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")), ","), percent_decode).alias("values"),
        ),
    )


def attribute_values(attributes: Column, *keys: str) -> Column:
    """All values of the keys, in the order of keys."""

    def of(key: str) -> Column:
        return F.flatten(F.transform(F.filter(attributes, lambda a: a["key"] == key), lambda a: a["values"]))

    return reduce(F.concat, map(of, keys))


def first_attribute(attributes: Column, *keys: str) -> Column:
    return F.get(F.filter(attribute_values(attributes, *keys), lambda v: v != ""), F.lit(0))


def strand_code(x: Column) -> Column:
    return (
        F.when(x.isin(".", "?"), 0).when(x == "+", 1).when(x == "-", 2)
        .otherwise(F.raise_error(F.concat(F.lit("unknown strand "), x))).cast("int")
    )


def reverse_complement(seq: Column) -> Column:
    """IUPAC codes, case preserved; any other letter is an error."""
    return F.when(seq.rlike(f"[^{BASES}]"), F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), seq))).otherwise(F.translate(F.reverse(seq), BASES, COMPLEMENTS))


def path_name(sample: Column, haplotype: Column, contig: Column, fragment: Column) -> Column:
    return F.concat(sample, F.lit("#"), haplotype.cast("string"), F.lit("#"), contig, F.when(fragment != 0, F.concat(F.lit("#fragment="), fragment.cast("string"))).otherwise(F.lit("")))


def fasta(header: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def one_line(x: Column) -> Column:
    """For tab-separated files: tabs and line ends become blanks."""
    return F.regexp_replace(x, "[\t\r\n]+", " ")
