"""Scalar rules of the edge lists, peaks and counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regulation_sign(c: Column) -> Column:
    """Activation 1, Repression -1, anything else 0. Only title and upper case count."""
    return F.when(c.isin("Activation", "ACTIVATION"), 1).when(c.isin("Repression", "REPRESSION"), -1).otherwise(0)


def signal_sign(c: Column) -> Column:
    return F.when(c == "a", 1).when(c == "i", -1).otherwise(0)


def fold_case(c: Column, how: str = "upper") -> Column:
    """'upper', 'lower' or 'none'."""
    if how not in ("upper", "lower", "none"):
        raise ValueError(f"unknown case rule {how!r}")
    return {"upper": F.upper, "lower": F.lower, "none": lambda x: x}[how](c)


def interval_distance(start: Column, end: Column, point: Column) -> Column:
    """Signed distance of an interval from a point; 0 where it covers it."""
    return F.when(start > point, start - point).when(end < point, end - point).otherwise(F.lit(0))


def peak_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def normalise_peak(c: Column) -> Column:
    """``chr-start-end`` becomes ``chr:start-end`` without leading zeros; anything else stays."""
    return F.regexp_replace(c, r"^(.+)-0*(\d+)-0*(\d+)$", "$1:$2-$3")


def parse_peaks(df: DataFrame, peak: str, strict: bool = True) -> DataFrame:
    """Adds ``chrom``, ``start``, ``end``. With ``strict`` a name that does not parse raises, naming up to ten."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    if strict:
        bad = [r[0] for r in df.where(~F.coalesce(F.col(peak).rlike(pattern), F.lit(False))).select(peak).limit(10).collect()]
        if bad:
            raise ValueError(f"peaks that are not chrom:start-end: {bad}")
    part = lambda i: F.nullif(F.regexp_extract(peak, pattern, i), F.lit(""))
    return df.withColumns({"chrom": part(1), "start": part(2).try_cast("bigint"), "end": part(3).try_cast("bigint")})


def add_chr(c: Column) -> Column:
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def strip_prefix(c: Column, prefix: str = "hg38.") -> Column:
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def species_of(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def strip_version(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", "")


def is_mitochondrial(c: Column) -> Column:
    return F.upper(c).startswith("MT-")


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def text_or_zero(c: Column) -> Column:
    """Attribute text for graph export: null becomes "0"."""
    return F.coalesce(c.cast("string"), F.lit("0"))


def pathway_number(c: Column) -> Column:
    """The code without letters; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, "[a-zA-Z]+", ""), F.lit(""))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique_name``: repeated names get ``-1``, ``-2`` ... by ``order``; null stays null.

    Rows are numbered by name and order in ranges, and a name's first number is taken from its others, so a name that a
    third of the rows have is not one task.
    """
    from ..operators.scans import running_sums

    ranked = running_sums(df.withColumns({"_at": F.struct(name, order), "_one": F.lit(1)}), "_at", ["_one"], ["_no"])
    first = ranked.groupBy(F.col(name).alias("_name")).agg(F.min("_no").alias("_first"))
    n = F.col("_no") - F.col("_first")
    joined = ranked.join(first, F.col(name).eqNullSafe(F.col("_name")))
    return joined.select(*df.columns, F.when(F.col(name).isNotNull() & (n > 0), F.concat_ws("-", name, n.cast("string"))).otherwise(F.col(name)).alias("unique_name"))


def first_layer(df: DataFrame, names: tuple[str, ...] = ("log1p", "counts", "x")) -> Column:
    """The value of the best layer that the table has."""
    have = [F.col(n) for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of the layers {names}")
    return F.coalesce(*have)
