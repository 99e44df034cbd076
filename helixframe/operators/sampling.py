"""Reproducible samples: rows ordered by a hash of their key and a seed. Sampling is the feature here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import running_sums


def ticket(key: str, seed: int):
    """The place of a row in a drawn order: a hash of the seed and its key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def exact_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly round(fraction * rows) rows with the least tickets; ``key`` is unique."""
    t = df.select(key, ticket(key, seed).alias("_t"), F.lit(1).alias("_one"))
    ranked = running_sums(t, "_t", ["_one"], ["_rank"])
    n = t.agg(F.round(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("_n"))
    keep = ranked.join(F.broadcast(n)).where("_rank <= _n").select(key)
    return df.join(keep, key, "left_semi")


def balance_classes(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the rarest one has, least tickets first; equal classes stay whole."""
    t = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.concat_ws("/", F.col(label).cast("string"), ticket(key, seed)).alias("_t"), F.lit(1).alias("_one"))
    ranked = running_sums(t, "_t", ["_one"], ["_rank"])
    sizes = t.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"))
    firsts = ranked.groupBy("_l").agg(F.min("_rank").alias("_from"))
    least = sizes.agg(F.min("_n").alias("_least"))
    keep = ranked.join(firsts, "_l").join(F.broadcast(least)).where("_rank - _from < _least").select(F.col("_k").alias(key))
    return df.join(keep, key, "left_semi")
