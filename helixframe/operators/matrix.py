"""Count matrices in long form: ``cell``, ``feature``, ``value`` (zeros are not stored)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip_version
from ..session import checkpointed


def cell_qc(counts: DataFrame, mito: Column | None = None) -> DataFrame:
    """``cell``, ``n_features``, ``total``, ``pct_mt`` (null where the total is 0)."""
    mt = F.sum(F.when(mito, F.col("value")).otherwise(0)) if mito is not None else F.lit(0)
    return counts.groupBy("cell").agg(F.count_if(F.col("value") > 0).alias("n_features"), F.sum("value").alias("total"), F.try_divide(mt * 100.0, F.sum("value")).alias("pct_mt"))


def feature_qc(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total"))


def qc_filter(counts: DataFrame, min_cells: int, features: tuple[int, int], totals: tuple[float, float], max_pct_mt: float = 100.0, mito: Column | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Features in ``min_cells`` cells or in ``keep`` (column ``feature``), cells within all bounds; measured before filtering."""
    good = feature_qc(counts).where(F.col("n_cells") >= min_cells).select("feature")
    if keep is not None:
        good = good.union(keep.select("feature")).distinct()
    cells = cell_qc(counts, mito).where(F.col("n_features").between(*features) & F.col("total").between(*totals) & (F.coalesce("pct_mt", F.lit(0.0)) <= max_pct_mt)).select("cell")
    return counts.join(good, "feature", "left_semi").join(cells, "cell", "left_semi")


def normalise_total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds ``norm`` (value over the cell's total, times ``target``) and ``log1p``."""
    total = counts.groupBy("cell").agg(F.sum("value").alias("_t"))
    return counts.join(total, "cell").withColumn("norm", F.try_divide(F.col("value") * F.lit(target), F.col("_t"))).withColumn("log1p", F.log1p("norm")).drop("_t")


def tfidf(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """Adds ``tfidf`` = log1p(scale * x / cell total) * log1p(cells / feature total)."""
    cells = counts.groupBy("cell").agg(F.sum("value").alias("_c"))
    peaks = counts.groupBy("feature").agg(F.sum("value").alias("_f"))
    n = counts.agg(F.count_distinct("cell").alias("_n"))
    r = counts.join(cells, "cell").join(peaks, "feature").join(F.broadcast(n))
    return r.withColumn("tfidf", F.log1p(F.col("value") * F.lit(scale) / F.col("_c")) * F.log1p(F.col("_n") / F.col("_f"))).drop("_c", "_f", "_n")


def moments(counts: DataFrame, value: str = "value") -> DataFrame:
    """Per feature: ``n`` cells in all, ``mean`` and sample ``variance``, zeros counted."""
    n = counts.agg(F.count_distinct("cell").alias("n"))
    s = counts.groupBy("feature").agg(F.sum(F.col(value)).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2")).join(F.broadcast(n))
    mean = F.col("s1") / F.col("n")
    return s.select("feature", "n", mean.alias("mean"), F.try_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1).alias("variance"))


def variable_features(counts: DataFrame, value: str = "norm", min_mean: float = 0.02, max_mean: float = 4.0, min_disp: float = 0.5, bins: int = 20) -> DataFrame:
    """``feature``, ``mean_log``, ``dispersion``, ``z``, ``variable``: log dispersions standardised within bins of the mean."""
    m = moments(counts, value)
    m = m.select("feature", F.log1p("mean").alias("mean_log"), F.when((F.col("mean") > 0) & (F.col("variance") > 0), F.log(F.col("variance") / F.col("mean"))).alias("dispersion"))
    rng = m.agg(F.min("mean_log").alias("lo"), F.max("mean_log").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("mean_log") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    m = m.join(F.broadcast(rng)).withColumn("bin", b).drop("lo", "hi")
    per = m.groupBy("bin").agg(F.avg("dispersion").alias("am"), F.stddev_samp("dispersion").alias("sd"))
    z = F.when(F.col("sd").isNull() & F.col("dispersion").isNotNull(), 1.0).otherwise(F.try_divide(F.col("dispersion") - F.col("am"), F.col("sd")))
    r = m.join(F.broadcast(per), "bin").withColumn("z", z)
    flag = (F.col("mean_log") > min_mean) & (F.col("mean_log") < max_mean) & (F.col("z") > min_disp)
    return r.select("feature", "mean_log", "dispersion", "z", F.coalesce(flag, F.lit(False)).alias("variable"))


def feature_guard(counts: DataFrame) -> DataFrame:
    """Features with a value and a population variance above 0 over all cells."""
    n = counts.agg(F.count_distinct("cell").alias("n"))
    s = counts.groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("nnz"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")).join(F.broadcast(n))
    mean = F.col("s1") / F.col("n")
    return s.withColumn("variance", F.col("s2") / F.col("n") - mean * mean).where("nnz > 0 AND variance > 0 AND NOT isnan(variance)").select("feature", "nnz", "variance")


def collapse_symbols(counts: DataFrame, how: str = "sum", order: str | None = None) -> DataFrame:
    """Values of features of one symbol (trimmed, version dropped, upper case) become one: sum, mean, max, min, median, first."""
    v = F.col("value")
    ways = {"sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "min": F.min(v), "median": F.median(v), "first": F.min_by("value", order or "feature")}
    if how not in ways:
        raise ValueError(f"unknown policy {how!r}")
    return counts.groupBy(F.upper(strip_version(F.trim("feature"))).alias("symbol"), "cell").agg(ways[how].alias("value"))


def intersect_cells(*tables: DataFrame) -> list[DataFrame]:
    """Every table with the cells that all of them have."""
    cells = reduce(lambda a, b: a.join(b, "cell", "left_semi"), [t.select("cell").distinct() for t in tables])
    return [t.join(cells, "cell", "left_semi") for t in tables]


def row_normalise(w: DataFrame) -> DataFrame:
    """``i``, ``j``, ``w`` with rows that add up to 1; a zero row stays zero."""
    total = w.groupBy("i").agg(F.sum("w").alias("_t"))
    return w.join(total, "i").select("i", "j", (F.col("w") / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t"))).alias("w"))


def diffusion_weights(w: DataFrame, hops: int = 2) -> DataFrame:
    """Row-normalised W + I, multiplied by itself ``hops - 1`` times and normalised after each; checkpointed between hops."""
    nodes = w.select(F.col("i").alias("n")).union(w.select("j")).distinct()
    own = nodes.select(F.col("n").alias("i"), F.col("n").alias("j"), F.lit(1.0).alias("w"))
    base = row_normalise(w.select("i", "j", F.col("w").cast("double").alias("w")).union(own).groupBy("i", "j").agg(F.sum("w").alias("w")))
    out = base
    for hop in range(1, hops):
        base = checkpointed(base) if hop == 1 else base
        right = base.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("w").alias("w2"))
        out = row_normalise(out.join(right, F.col("j") == F.col("k")).groupBy("i", "j2").agg(F.sum(F.col("w") * F.col("w2")).alias("w")).withColumnRenamed("j2", "j"))
        if hop + 1 < hops:
            out = checkpointed(out)
    return out


def smooth(weights: DataFrame, x: DataFrame) -> DataFrame:
    """W times X: ``cell``, ``feature``, ``value``."""
    return weights.join(x.withColumnRenamed("cell", "j"), "j").groupBy(F.col("i").alias("cell"), "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def scale(counts: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``scaled`` = (x - mean) / sd with sample sd (0 becomes 1) for the stored values; see ``moments`` for the zeros."""
    m = moments(counts, value)
    sd = F.when(F.coalesce("variance", F.lit(0.0)) <= 0, 1.0).otherwise(F.sqrt("variance"))
    return counts.join(m.select("feature", "mean", sd.alias("sd")), "feature").withColumn("scaled", (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def rank_features(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster``, ``feature``, ``t``, ``p``, ``p_adj``: each cluster against the rest, variance of the rest overestimated.

    Every feature is ranked in every cluster of two cells or more, also where all its values there are zero; without any
    variance t is 0 for equal means, else infinite. The p-value uses the normal distribution; adjustment is
    Benjamini-Hochberg within a cluster. Moments include zeros and are folded per (cluster, feature) before any join.
    """
    x = counts.join(clusters, "cell")
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n1"))
    total = clusters.agg(F.count(F.lit(1)).alias("n"))
    per = x.groupBy("cluster", "feature").agg(F.sum("value").alias("a1"), F.sum(F.col("value") * F.col("value")).alias("a2"))
    allf = per.groupBy("feature").agg(F.sum("a1").alias("t1"), F.sum("a2").alias("t2"))
    grid = allf.crossJoin(F.broadcast(size.crossJoin(total).where("n1 > 1 AND n - n1 > 1")))
    r = grid.join(per, ["cluster", "feature"], "left").fillna(0, ["a1", "a2"])
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    m1, m2 = F.col("a1") / n1, (F.col("t1") - F.col("a1")) / n2
    v1 = (F.col("a2") - n1 * m1 * m1) / (n1 - 1)
    v2 = (F.col("t2") - F.col("a2") - n2 * m2 * m2) / (n2 - 1)
    real = lambda v, least: F.when(v > least, v).otherwise(0.0)  # noqa: E731  what rounding leaves counts as 0
    se = F.sqrt(real(v1, 1e-12 * m1 * m1) / n1 + real(v2, 1e-12 * m2 * m2) / n1)
    diff = F.when(F.abs(m1 - m2) > 1e-12 * F.greatest(F.abs(m1), F.abs(m2)), m1 - m2).otherwise(0.0)
    t = F.when(se > 0, diff / F.nullif(se, F.lit(0.0))).when(diff == 0, 0.0).otherwise(F.signum(diff) * float("inf"))
    r = r.select("cluster", "feature", t.alias("t"))
    z = F.abs("t") / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * z)
    erfc = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-z * z)
    r = r.withColumn("p", F.least(erfc, F.lit(1.0)))
    w = Window.partitionBy("cluster").orderBy(F.desc("p"), F.desc("feature"))
    m = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    rank = m - F.row_number().over(w) + 1
    return r.withColumn("q", F.col("p") * m / rank).withColumn("p_adj", F.least(F.min("q").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("q")


def pivot_wide(counts: DataFrame, cells: list[str]) -> DataFrame:
    """Features as rows and the named cells as columns, missing values 0: for export of small tables only."""
    return counts.groupBy("feature").pivot("cell", cells).agg(F.sum("value")).fillna(0)
