"""Chromosome names, sort keys and size suffixes as Column expressions."""

from pyspark.sql import functions as F


def strip_chr(chrom):
    return F.regexp_replace(chrom, "^chr", "")


def chrom_code(chrom, autosomes=29):
    """Numeric chromosome code: X and Y follow the autosomes, M is 90, XY is 91; other names are NULL."""
    return (
        F.when(chrom == "X", autosomes + 1).when(chrom == "Y", autosomes + 2)
        .when(chrom.isin("M", "MT", "Mt"), 90).when(chrom == "XY", 91)
        .otherwise(chrom.try_cast("int"))
    )


def chrom_name(code):
    """Undo the human-centred coding: 23 X, 24 Y, 90 M, and 33..89 stand for 23..79."""
    c = code.try_cast("int")
    return (
        F.when(c == 23, "X").when(c == 24, "Y").when(c == 90, "M")
        .when(c.between(33, 89), (c - 10).cast("string")).when(c.between(0, 22), c.cast("string"))
    )


def natural_key(chrom):
    """Numeric chromosomes first by value, the others by name."""
    return [chrom.try_cast("int").asc_nulls_last(), chrom.asc()]


def version_key(name):
    """Names with numbers compare by the numbers: every digit run is left-padded."""
    return F.regexp_replace(F.regexp_replace(name, r"(\d+)", "0000000000$1"), r"0*(\d{10})(?!\d)", "$1")


def parse_size(text):
    """'5k', '200kb', '1.5m', '3Mb' or a plain number, in base pairs."""
    low = F.lower(text)
    num = F.regexp_extract(low, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(low, r"^[0-9.]+\s*([kmg]?)", 1)
    return (num * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)).cast("long")
