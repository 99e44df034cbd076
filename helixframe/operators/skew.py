"""A few keys holding most records: two-stage salted aggregation.

Pass one counts rows per key (one pre-aggregated row per key and partition is shuffled). Keys with at least
``heavy_share`` of all rows are heavy; there can be no more than ``1 / heavy_share`` of them, which bounds the list
that reaches the driver. Pass two gives rows of heavy keys a salt, aggregates by (key, salt), and merges the partial
results by key. The salt is a hash of the row, as random as drawn but the same when a lost task runs again; for
distinct counts it is a hash of the counted value, so the parts are disjoint and their counts add up.

Defined cases: the null key is a group of its own, salted like any other where it is heavy; null measures count for
``rows`` only; an empty input gives an empty result; column names of the input may clash with those of the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, heavy_share: float = 0.02) -> tuple[list, int]:
    """Values of ``key`` (null too) with at least ``heavy_share`` of all rows, at most 1 / heavy_share of them; and the number of rows."""
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"))  # the shuffle of the counts is reused
    keys = counts.join(F.broadcast(total.withColumnRenamed("n", "t")), F.col("n") >= F.col("t") * F.lit(heavy_share)).select("k", "n", F.lit(False).alias("all"))
    rows = keys.unionByName(total.select(F.lit(None).cast(df.schema[key].dataType).alias("k"), "n", F.lit(True).alias("all"))).collect()
    return [r["k"] for r in rows if not r["all"]], sum(r["n"] or 0 for r in rows if r["all"])


def salted_aggregate(
    df: DataFrame,
    key: str,
    measures: Mapping[str, str] | None = None,
    distinct: Sequence[str] = (),
    distinct_name: str = "n_distinct",
    heavy_share: float = 0.02,
    salts: int = 32,
    salt_by: Sequence[str] = (),
    heavy: Sequence | None = None,
) -> DataFrame:
    """``key``, ``rows`` and per measure ``name -> column``: ``name_n``, ``name_sum``, ``name_min``, ``name_max``.

    With ``distinct`` also ``distinct_name``: the number of distinct combinations of these columns in which none is null.
    The salt of a row is a hash of the ``distinct`` columns or else of ``salt_by`` or else of the measures (with none of
    these the number of its partition). ``heavy`` are the heavy keys, where the caller knows them.
    """
    measures = dict(measures or {})
    if heavy is None:
        heavy = heavy_keys(df, key, heavy_share)[0]
    names = list(measures)
    ds, ss = [f"_d{i}" for i in range(len(distinct))], [f"_r{i}" for i in range(len(salt_by))]
    picked = df.select(F.col(key).alias("_k"), *[F.col(measures[n]).alias(f"_m{i}") for i, n in enumerate(names)], *[F.col(c).alias(a) for c, a in zip(distinct, ds)], *[F.col(c).alias(a) for c, a in zip(salt_by, ss)])
    by = ds or ss or [c for c in picked.columns if c != "_k"]
    spread: Column = F.xxhash64(*by) if by else F.spark_partition_id()
    is_heavy = F.col("_k").isin([k for k in heavy if k is not None]) if any(k is not None for k in heavy) else F.lit(False)
    if any(k is None for k in heavy):
        is_heavy = F.col("_k").isNull() | is_heavy
    salted = picked.withColumn("_s", F.when(is_heavy, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(0)).drop(*ss)
    partial = [F.count(F.lit(1)).alias("_rows")]
    for i, _ in enumerate(names):
        m = F.col(f"_m{i}")
        partial += [F.count(m).alias(f"_n{i}"), F.sum(m).alias(f"_sum{i}"), F.min(m).alias(f"_min{i}"), F.max(m).alias(f"_max{i}")]

    def merged() -> list[Column]:
        out = [F.sum("_rows").alias("_rows")]
        for i, _ in enumerate(names):
            out += [F.sum(f"_n{i}").alias(f"_n{i}"), F.sum(f"_sum{i}").alias(f"_sum{i}"), F.min(f"_min{i}").alias(f"_min{i}"), F.max(f"_max{i}").alias(f"_max{i}")]
        return out

    if ds:  # equal values share a salt, so a first step per value leaves disjoint parts
        each = salted.groupBy("_k", "_s", *ds).agg(*partial)
        whole = F.sum(F.when(F.expr(" AND ".join(f"{d} IS NOT NULL" for d in ds)), 1).otherwise(0))
        parts = each.groupBy("_k", "_s").agg(*merged(), whole.alias("_dist"))
    else:
        parts = salted.groupBy("_k", "_s").agg(*partial)
    done = parts.groupBy("_k").agg(*merged(), *([F.sum("_dist").alias("_dist")] if ds else []))
    cols = [F.col("_k").alias(key), F.col("_rows").alias("rows")]
    for i, n in enumerate(names):
        cols += [F.col(f"_n{i}").alias(f"{n}_n"), F.col(f"_sum{i}").alias(f"{n}_sum"), F.col(f"_min{i}").alias(f"{n}_min"), F.col(f"_max{i}").alias(f"{n}_max")]
    return done.select(*cols, *([F.col("_dist").alias(distinct_name)] if ds else []))
