"""Joins over genomic positions: binned range join, nearest point, peak annotation, transcription start sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_chr, interval_distance
from .sampling import ticket


def range_join(intervals: DataFrame, points: DataFrame, point: str = "tss", before: int = 0, after: int = 0, width: int = 10_000) -> DataFrame:
    """Pairs of one ``chrom`` with ``start - after <= point <= end + before``.

    Both sides meet in bins of ``width``: an interval goes to every bin it reaches, a point to one, so the join is by
    equality on (chrom, bin) and no pair comes twice. Long chromosomes spread over many bins; no pair list per chromosome.
    """
    lo, hi = F.col("start") - F.lit(after), F.col("end") + F.lit(before)
    left = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    right = points.withColumn("_bin", F.floor(F.col(point) / width))
    return left.join(right, ["chrom", "_bin"]).where((F.col(point) >= lo) & (F.col(point) <= hi)).drop("_bin")


def nearest(peaks: DataFrame, tss: DataFrame, bin_width: int = 50_000) -> DataFrame:
    """Per peak (``peak_id``, ``chrom``, ``start``, ``end``) the closest site (``tss``, ``ord``, ``gene``), least ``ord`` on ties.

    Repeated peaks each keep their row. A peak within one bin is done after the join; only longer ones are folded again,
    with the number of their repeats.

    Sites are folded to one row per (chrom, bin): those in the bin, the last one before it and the first one after it,
    for every bin of the range in use (a genome in bins of 50,000 has 60,000 rows). A peak meets the rows of its own bins by
    equality and picks the best site there, so no pair list per chromosome and no order over the peaks is needed.
    """
    one = tss.groupBy("chrom", "tss").agg(F.min(F.struct("ord", "gene")).alias("m")).select("chrom", F.struct(F.col("tss"), F.col("m.ord").alias("ord"), F.col("m.gene").alias("gene")).alias("s"))
    per = one.groupBy("chrom", F.floor(F.col("s.tss") / bin_width).alias("_bin")).agg(F.array_sort(F.collect_list("s")).alias("sites"))
    used = peaks.select("chrom", F.floor(F.col("start") / bin_width).alias("lo"), F.floor(F.col("end") / bin_width).alias("hi")).unionByName(per.select("chrom", F.col("_bin").alias("lo"), F.col("_bin").alias("hi")))
    dense = used.groupBy("chrom").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("chrom", F.explode(F.sequence("lo", "hi")).alias("_bin"))
    before = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("chrom").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = dense.join(per, ["chrom", "_bin"], "left")
    bins = bins.select("chrom", "_bin", F.array_compact(F.concat(F.coalesce("sites", F.array()), F.array(F.last(F.element_at("sites", -1), True).over(before), F.last(F.element_at("sites", 1), True).over(after)))).alias("near")).where(F.size("near") > 0)
    apart = lambda s: F.greatest(F.col("start") - s["tss"], s["tss"] - F.col("end"), F.lit(0)).cast("long")
    best = F.array_min(F.transform("near", lambda s: F.struct(apart(s).alias("absd"), s["ord"].alias("ord"), s["tss"].alias("tss"), s["gene"].alias("gene"))))
    lo, hi = F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width)
    cols = list(peaks.columns)
    short = peaks.where(lo == hi).withColumn("_bin", lo).join(bins, ["chrom", "_bin"]).select(*cols, best.alias("n"))
    long = peaks.where(lo < hi).groupBy(*cols).agg(F.count(F.lit(1)).alias("_times")).withColumn("_bin", F.explode(F.sequence(lo, hi)))
    long = long.join(bins, ["chrom", "_bin"]).select(*cols, "_times", best.alias("n")).groupBy(*cols, "_times").agg(F.min("n").alias("n"))
    long = long.select(*cols, "n", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_i")).drop("_i")
    r = short.unionByName(long)
    return r.select(*peaks.columns, F.col("n.tss").alias("tss"), F.col("n.ord").alias("ord"), F.col("n.gene").alias("gene"), F.col("n.absd").alias("absd"))


def promoters(peaks: DataFrame, tss: DataFrame, upstream: int = 1000, downstream: int = 100) -> DataFrame:
    """Peaks over promoters: end >= tss - upstream and start <= tss + downstream, on either strand."""
    return range_join(peaks, tss, "tss", before=upstream, after=downstream).withColumn("distance", interval_distance(F.col("start"), F.col("end"), F.col("tss")).cast("double"))


def annotate_peaks(peaks: DataFrame, tss: DataFrame, upstream: int = 1000, downstream: int = 100, distal_max: int = 200_000, keep_intergenic: bool = False) -> DataFrame:
    """``chrom``, ``start``, ``end``, ``gene``, ``distance``, ``peak_type`` (promoter, distal, intergenic).

    A peak can be promoter of one gene and distal to another. Rows with a null are dropped, which takes every intergenic
    row (its distance is null) unless ``keep_intergenic``.
    """
    out = ["peak_id", "chrom", "start", "end", "gene", "distance", "peak_type"]
    prom = promoters(peaks, tss, upstream, downstream).withColumn("peak_type", F.lit("promoter")).select(out)
    near = nearest(peaks, tss).where(F.col("absd") <= distal_max).withColumn("distance", interval_distance(F.col("start"), F.col("end"), F.col("tss")).cast("double"))
    distal = near.join(prom.select("peak_id", "gene"), ["peak_id", "gene"], "left_anti").withColumn("peak_type", F.lit("distal")).select(out)
    parts = [prom, distal]
    if keep_intergenic:
        taken = prom.select("peak_id").union(distal.select("peak_id")).distinct()
        parts.append(peaks.join(taken, "peak_id", "left_anti").select("peak_id", "chrom", "start", "end", F.lit("").alias("gene"), F.lit(None).cast("double").alias("distance"), F.lit("intergenic").alias("peak_type")))
    r = reduce(DataFrame.unionByName, parts).drop("peak_id")
    return r.dropna(subset=[c for c in r.columns if c != "distance" or not keep_intergenic])


def intergenic(peaks: DataFrame, tss: DataFrame, upstream: int = 1000, downstream: int = 100, distal_max: int = 200_000) -> DataFrame:
    """Peaks that are neither over a promoter nor within ``distal_max`` of a site."""
    taken = promoters(peaks, tss, upstream, downstream).select("peak_id").union(nearest(peaks, tss).where(F.col("absd") <= distal_max).select("peak_id")).distinct()
    return peaks.join(taken, "peak_id", "left_anti")


def clean_tss(raw: DataFrame) -> DataFrame:
    """BED rows of sites on numbered chromosomes, X and Y: ``chrom``, ``start``, ``end``, ``name``."""
    kept = raw.where(F.col("chrom").rlike(r"^\d+$|^X$|^Y$")).dropDuplicates(["name", "chrom", "start"])
    return kept.select(add_chr(F.col("chrom")).alias("chrom"), F.col("start"), (F.col("start") + 1).alias("end"), "name").dropna()


def first_window(fragments: DataFrame, chrom: str = "chr1", width: int = 1_000_000) -> DataFrame:
    """The first window of one chromosome that a fragment overlaps."""
    lo = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    return fragments.where((F.col("chrom") == chrom) & (F.col("start") < F.col("end"))).select(lo.alias("w")).agg(F.min("w").alias("window"))


def nucleosome_signal(fragments: DataFrame, barcode: str = "barcode", first: int | None = None, order: str = "ord") -> DataFrame:
    """Fragments of 147 to 293 bases per fragment shorter than 147, by barcode; asked for, of the ``first`` ones by ``order`` only."""
    if first is not None:
        fragments = fragments.orderBy(order).limit(first)
    n = F.col("end") - F.col("start")
    r = fragments.groupBy(barcode).agg(F.count_if((n >= 147) & (n < 294)).alias("mono"), F.count_if(n < 147).alias("free"))
    return r.withColumn("signal", F.try_divide("mono", "free"))


def tss_profile(fragments: DataFrame, tss: DataFrame, group: str, flank: int = 1000, step: int = 100) -> DataFrame:
    """Per group and offset bin: fragments around the sites, over the mean of the two outermost bins."""
    near = range_join(fragments, tss, "tss", before=flank, after=flank)
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    counts = near.withColumn("offset", (F.floor((mid - F.col("tss")) / step) * step).cast("long")).where(F.abs(F.col("offset")) <= flank).groupBy(group, "offset").agg(F.count(F.lit(1)).alias("n"))
    outer = counts.where(F.abs(F.col("offset")) >= flank - step).groupBy(group).agg(F.avg("n").alias("base"))
    return counts.join(outer, group, "left").select(group, "offset", "n", F.try_divide("n", "base").alias("enrichment"))


def sample_sites(tss: DataFrame, n: int = 500, seed: int = 11, key: str = "ord") -> DataFrame:
    """``n`` sites drawn by a hash of their key and the seed (a report over some sites; sampling is the feature)."""
    return tss.orderBy(ticket(key, seed), key).limit(n)


def in_region(fragments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Fragments that overlap a half-open range; over Parquet sorted by position the row groups outside are skipped."""
    return fragments.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
