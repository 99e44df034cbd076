"""Running sums in a global order, blocked so that no task sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_sums(df: DataFrame, order: str, values: Sequence[str], names: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds the inclusive running sums ``names`` of ``values`` in the order of the unique column ``order``.

    Rows are range-partitioned by ``order``; the sums of the partitions (one row each) give every partition what came
    before it. The range-partitioned rows are checkpointed, so both passes see the same partitions, also after a loss.
    """
    by = F.desc(order) if descending else F.asc(order)
    placed = checkpointed(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_p").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    sums = sums.select("_p", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i, _ in enumerate(values)])
    inside = Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(sums), "_p")
    return out.select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"_b{i}")).alias(n) for i, (v, n) in enumerate(zip(values, names))])
