"""Overlapping and gapped intervals: a sweep line over plus and minus events, blocked so that no group is one task.

Boundaries become events, the prefix sum of the events is the number of active intervals, a stretch begins where that
number leaves zero and ends where it returns. A prefix sum over one hot group (entity) would be a single sorted task, so
positions are cut into blocks of ``block`` units. What is active, opened and closed before a block follows from the sums
of the blocks before it (one small row per block); it enters the block as one more event, so that the blocks are swept
side by side, each in a single sorted pass. A stretch that crosses blocks leaves a left and a right part; these, at most
two per block, are put together afterwards.

Repeated rows are made distinct before the first shuffle (partial aggregation) and after it. The sweep's result is written
once to the shared folder, since whole stretches and parts go different ways.

Defined cases: rows with a null key, a null end or ``start >= end`` take no part; repeated rows count once; touching
intervals form one stretch; an empty input gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import written

# What an event does. They are ordered by place, at one place as numbered: intervals open before others end.
_AFTER_END, _INSIDE, _OPEN, _SHUT, _OUT = range(5)


def covered_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, block: int = 4_000_000, least: int = 1, longest_gap: int | None = None) -> DataFrame:
    """``keys`` plus ``kind`` ('covered' or 'gap'), ``range_start``, ``range_end`` and ``n_intervals`` (0 for a gap).

    ``n_intervals`` counts the distinct intervals of the stretch. Positions are whole numbers (for times: microseconds or
    days). Stretches of fewer than ``least`` intervals and gaps longer than ``longest_gap`` (None: any) are left out.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    kind_of = {f.name: f.dataType for f in df.select(F.col(start).alias("a"), F.col(end).alias("z")).schema}
    if any(not isinstance(t, IntegralType) for t in kind_of.values()):
        raise TypeError("positions must be whole numbers")
    at = lambda c: F.floor(F.col(c) / F.lit(block))
    spans = (
        df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_z"))
        .where(" AND ".join(f"{a} IS NOT NULL" for a in ks) + " AND _a < _z")
        .groupBy(*ks, "_a", "_z")
        .agg(F.lit(1).alias("_one"))
        .select(*ks, F.explode(F.when(at("_a") == at("_z"), F.array(at("_a"))).otherwise(F.array(at("_a"), at("_z")))).alias("_b"), "_a", "_z")
    )
    opens, shuts = at("_a") == F.col("_b"), at("_z") == F.col("_b")
    event = lambda pos, what: pos * F.lit(8) + F.lit(what)
    # what the blocks before one leave to it: active and opened intervals, and the last end, which counts if none is active
    sums = spans.groupBy(*ks, "_b").agg(F.count_if(opens).alias("o"), F.count_if(shuts).alias("s"), F.max(F.when(shuts, F.col("_z"))).alias("z"))
    earlier = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*ks, "_b", (F.col("o") - F.col("s")).alias("d"), F.sum("o").over(earlier).alias("seen"), F.sum(F.col("o") - F.col("s")).over(earlier).alias("active"), F.max("z").over(earlier).alias("z"))
    into = F.when(F.col("seen").isNull(), None).when(F.col("active") > 0, event(F.col("_b") * block - 1, _INSIDE)).otherwise(event(F.col("z"), _AFTER_END))
    out_of = F.when(F.coalesce("active", F.lit(0)) + F.col("d") > 0, event(F.col("_b") * block + (block - 1), _OUT))
    carry = carried.select(*ks, "_b", into.alias("_a"), out_of.alias("_z"), F.coalesce("active", F.lit(0)).alias("_n"), F.coalesce("seen", F.lit(0)).alias("_m"))
    own = spans.select(*ks, "_b", F.when(opens, event(F.col("_a"), _OPEN)).alias("_a"), F.when(shuts, event(F.col("_z"), _SHUT)).alias("_z"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast("long").alias("_m"))
    events = (
        own.unionByName(carry)
        .repartition(*ks, "_b")
        .select(F.xxhash64(*ks, "_b").alias("_h"), *ks, "_b", "_n", "_m", F.explode(F.array("_a", "_z")).alias("_e"))
        .where("_e IS NOT NULL")
        .withColumn("_w", F.col("_e").bitwiseAND(7))
    )
    # one sort per block: the hash comes first, since whole keys of one group have long common prefixes
    place = Window.partitionBy("_h", *ks, "_b").orderBy("_e")
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("_w") <= _INSIDE
    swept = events.select(
        "_h", *ks, "_b", "_e", "_w",
        F.sum(F.when(starts, F.col("_n")).when(F.col("_w") == _OPEN, 1).when(F.col("_w") == _SHUT, -1).otherwise(0)).over(so_far).alias("_active"),
        F.sum(F.when(starts, F.col("_m")).when(F.col("_w") == _OPEN, 1).otherwise(0)).over(so_far).alias("_seen"),
    )
    turns = swept.where(starts | (F.col("_w") == _OUT) | ((F.col("_w") == _OPEN) & (F.col("_active") == 1)) | ((F.col("_w") == _SHUT) & (F.col("_active") == 0)))
    pos = lambda c: F.shiftright(c, 3)
    was = F.col("_pe").bitwiseAND(7)
    parts = (
        turns.select(*ks, "_b", "_e", "_w", "_seen", F.lag("_e").over(place).alias("_pe"), F.lag("_seen").over(place).alias("_ps"))
        .where("_pe IS NOT NULL")
        .select(
            *ks, "_b",
            F.when(F.col("_w") == _OPEN, "gap").when((F.col("_w") == _SHUT) & (was == _OPEN), "covered").when((F.col("_w") == _SHUT) & (was == _INSIDE), "left").when((F.col("_w") == _OUT) & (was == _OPEN), "right").alias("kind"),
            pos("_pe").alias("s"), pos("_e").alias("e"),
            F.when(F.col("_w") == _OPEN, 0).when(was == _INSIDE, F.col("_seen")).when(F.col("_w") == _OUT, F.col("_ps") - 1).otherwise(F.col("_seen") - F.col("_ps") + 1).alias("n"),
        )
        .where("kind IS NOT NULL")
    )

    def wanted(rows: DataFrame) -> DataFrame:
        long = F.lit(False) if longest_gap is None else (F.col("kind") == "gap") & (F.col("e") - F.col("s") > longest_gap)
        return rows.where(~long & ~((F.col("kind") == "covered") & (F.col("n") < least)))

    parts = written(wanted(parts))
    # a part that leaves its block to the right is followed by the one that comes into a later block from the left
    row = Window.partitionBy(*ks).orderBy("_b", "kind")
    joined = (
        parts.where("kind IN ('left', 'right')")
        .select(*ks, "_b", "kind", "e", "n", F.lag("s").over(row).alias("s"), F.lag("n").over(row).alias("before"))
        .where("kind = 'left'")
        .select(*ks, F.lit("covered").alias("kind"), "s", "e", (F.col("n") - F.col("before")).alias("n"))
    )
    whole = parts.where("kind IN ('covered', 'gap')").select(*ks, "kind", "s", "e", "n").unionByName(wanted(joined))
    return whole.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "kind", F.col("s").cast(kind_of["a"]).alias("range_start"), F.col("e").cast(kind_of["z"]).alias("range_end"), F.col("n").alias("n_intervals"))
