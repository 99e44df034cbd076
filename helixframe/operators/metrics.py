"""Binary-classifier metrics and curves over ``label`` (0 or 1) and ``score``, computed per distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import ticket
from .scans import running_sums


def _safe(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 of ``score >= threshold``; an empty denominator gives 0."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    c = c.withColumn("accuracy", _safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    c = c.withColumns({"precision": _safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumns({"f1": _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "n_pos": F.col("tp") + F.col("fn"), "n_neg": F.col("fp") + F.col("tn")})


def by_score(df: DataFrame) -> DataFrame:
    """Per distinct score: positives, negatives and their running sums from the highest score down.

    Rows are folded to one per distinct score before anything is ordered, and the running sums are blocked, so the order
    over all scores is never one task.
    """
    g = df.where("score IS NOT NULL AND label IS NOT NULL").groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return running_sums(g, "score", ["p", "n"], ["tp", "fp"], descending=True)


def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by the rank sum with average ranks; null with a single class."""
    g = by_score(df)
    # a positive beats the negatives below its score, and half of those at it
    t = g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum(F.col("p").cast("double") * F.col("fp")).alias("above"), F.sum(F.col("p").cast("double") * F.col("n")).alias("tied"))
    return t.select(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), (F.col("all_p") * F.col("all_n") - F.col("above") + F.col("tied") / 2) / (F.col("all_p").cast("double") * F.col("all_n"))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum over thresholds of the recall step times the precision; null with a single class."""
    t = by_score(df).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return t.select(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("s") / F.col("all_p")).alias("average_precision"))


def early_precision(df: DataFrame, key: str, threshold: float = 0.5, top: int = 10_000) -> DataFrame:
    """Precision of ``score >= threshold`` among the ``top`` rows by score; equal scores go by ``key``."""
    best = df.orderBy(F.desc("score"), F.asc(key)).limit(top)
    return confusion(best, threshold).select(F.col("precision").alias("early_precision"))


def roc_points(df: DataFrame) -> DataFrame:
    """``fpr``, ``tpr``, ``score``: the curve from (0, 0), whose score is null, one point per distinct score."""
    g = by_score(df)
    t = g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    points = g.join(F.broadcast(t)).select(F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"), "score")
    return points.unionByName(t.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("score")))


def pr_points(df: DataFrame) -> DataFrame:
    """``recall``, ``precision``, ``score``: one point per distinct score and the end (0, 1), whose score is null."""
    g = by_score(df)
    t = g.agg(F.sum("p").alias("all_p"))
    points = g.join(F.broadcast(t)).select(F.try_divide("tp", "all_p").alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), "score")
    return points.unionByName(t.select(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("score")))


def histogram(df: DataFrame, edges: int = 75) -> DataFrame:
    """``label``, ``bin`` (from 1), ``lo``, ``n`` over ``edges - 1`` equal bins of the pooled range; the last bin is closed."""
    rng = df.agg(F.min("score").alias("lo0"), F.max("score").alias("hi0"))
    bins = edges - 1
    width = (F.col("hi0") - F.col("lo0")) / bins
    b = F.when(F.col("hi0") == F.col("lo0"), 1).otherwise(F.least(F.floor((F.col("score") - F.col("lo0")) * bins / (F.col("hi0") - F.col("lo0"))) + 1, F.lit(bins)))
    return df.where("score IS NOT NULL").join(F.broadcast(rng)).select("label", b.cast("int").alias("bin"), (F.col("lo0") + (b - 1) * width).alias("lo")).groupBy("label", "bin", "lo").agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, points: int = 50, adjust: float = 1.0) -> DataFrame:
    """``label``, ``x``, ``density``: Gaussian kernel density of every class on a common grid, bandwidth by Scott's rule.

    Scores are folded to one row per class and distinct score; the grid is a fixed number of points per row.
    """
    g = df.where("score IS NOT NULL AND label IS NOT NULL").groupBy("label", "score").agg(F.count(F.lit(1)).alias("w"))
    stats = df.groupBy("label").agg(F.count("score").alias("m"), F.stddev_samp("score").alias("sd"))
    rng = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    h = F.col("sd") * F.pow(F.col("m"), F.lit(-0.2)) * adjust
    grid = g.join(stats, "label").join(F.broadcast(rng)).where("sd > 0").select("label", "score", "w", "m", h.alias("h"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))).alias("x"))
    u = (F.col("x") - F.col("score")) / F.col("h")
    return grid.groupBy("label", "x").agg((F.sum(F.col("w") * F.exp(-u * u / 2) / F.col("h")) / F.first("m") / F.sqrt(F.lit(2.0) * F.pi())).alias("density"))


def random_baseline(df: DataFrame, seed: int = 42) -> DataFrame:
    """The table with scores uniform between the least and the greatest, drawn by a hash of the row key ``id``."""
    rng = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(rng)).select("id", "label", (F.col("lo") + u * (F.col("hi") - F.col("lo"))).alias("score"))


def permuted(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``label``, ``score``: the scores dealt out anew among the rows, in an order drawn by hashes of the unique ``key``.

    Labels are numbered in one drawn order and scores in another, both by range-partitioned running sums.
    """
    rows = df.where("score IS NOT NULL AND label IS NOT NULL")
    one = F.lit(1).alias("_one")
    labels = running_sums(rows.select("label", ticket(key, seed).alias("_t"), one), "_t", ["_one"], ["_rank"]).select("label", "_rank")
    scores = running_sums(rows.select("score", ticket(key, seed + 1).alias("_t"), one), "_t", ["_one"], ["_rank"]).select("score", "_rank")
    return labels.join(scores, "_rank").select("label", "score")


def classification_metrics(df: DataFrame, key: str, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """One row with all measures of a classifier and the areas of a random one (``rand_``: its scores dealt out anew).

    ``auroc``, ``auprc``, ``rand_auroc``, ``rand_auprc`` (null with a single class), ``accuracy``, ``precision``,
    ``early_precision`` (10,000 best), ``recall``, ``f1``, ``n_edges``, ``n_pos``, ``n_neg``, ``score_threshold``.
    """
    rows = df.where("score IS NOT NULL AND label IS NOT NULL")
    drawn = permuted(rows, key, seed)
    out = confusion(rows, threshold).select("accuracy", "precision", "recall", "f1", (F.col("n_pos") + F.col("n_neg")).alias("n_edges"), "n_pos", "n_neg", F.lit(float(threshold)).alias("score_threshold"))
    parts = [auroc(rows), average_precision(rows).withColumnRenamed("average_precision", "auprc"), auroc(drawn).withColumnRenamed("auroc", "rand_auroc"), average_precision(drawn).withColumnRenamed("average_precision", "rand_auprc"), early_precision(rows, key, threshold)]
    for p in parts:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out


def curves(df: DataFrame, kind: str = "both", key: str = "id", seed: int = 42) -> DataFrame:
    """``curve`` ('roc' or 'prc'), ``model`` ('scores' or 'random'), ``x``, ``y``, ``score``: what a figure of the curves shows.

    The random model has uniform scores between the least and the greatest. Another ``kind`` than 'both', 'roc' or 'prc' is
    an error.
    """
    if kind not in ("both", "roc", "prc"):
        raise ValueError("kind must be 'both', 'roc' or 'prc'")
    out = None
    for model, rows in (("scores", df), ("random", random_baseline(df.withColumn("id", F.col(key)), seed))):
        for name, points, x, y in (("roc", roc_points, "fpr", "tpr"), ("prc", pr_points, "recall", "precision")):
            if kind in ("both", name):
                part = points(rows).select(F.lit(name).alias("curve"), F.lit(model).alias("model"), F.col(x).alias("x"), F.col(y).alias("y"), "score")
                out = part if out is None else out.unionByName(part)
    return out


def score_panel(df: DataFrame, kind: str = "kde", n_bins: int = 75, balance: bool = True, key: str = "id", seed: int = 42) -> DataFrame:
    """Histogram ('hist') or density ('kde') of the scores by class, over balanced classes unless ``balance`` is off."""
    from .sampling import balance_classes

    if kind not in ("hist", "kde"):
        raise ValueError("kind must be 'hist' or 'kde'")
    rows = balance_classes(df, "label", key, seed) if balance else df
    return histogram(rows, n_bins) if kind == "hist" else kde(rows)
