"""Top N items within every group: bounded heaps built before the shuffle and merged afterwards.

Each task folds its rows, batch by batch, into at most ``n`` best items per group (score first, then the item in byte
order; an item counts once, with its highest score), and sends only these on. A partial result may be sent at any time
and merged later, so a task that meets very many groups empties its heaps once they hold ``flush_rows`` rows: memory is
bounded by that parameter, not by the number of groups. After the shuffle by group the same fold merges the partial heaps;
the partition is sorted by group, so a single group is open at a time. A hot group sends ``n`` rows per task at most.

Defined cases: rows with a null group or null score take no part; a null item is an item and comes last among equal
scores; NaN ranks above every number, as in Spark's ordering; groups with fewer than ``n`` items give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COLS = ["g", "i", "x", "s"]


def _held(b: pa.RecordBatch) -> pa.Table:
    """The batch with every column nullable, as folded tables are: tables of unlike schemas can't be put together."""
    return pa.Table.from_arrays(b.columns, names=_COLS)


def _best(t: pa.Table, n: int, by_group_only: bool = False) -> pa.Table:
    """The ``n`` best items of every group, sorted by group, score descending, item ascending."""
    t = t.group_by(["g", "i"]).aggregate([("x", "max"), ("s", "max")]).rename_columns(_COLS)
    t = t.set_column(3, "s", pc.if_else(t.column("x"), 0.0, t.column("s")))  # NaN scores are equal
    t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("x", "descending"), ("s", "descending"), ("i", "ascending")]))
    g = t.column("g").combine_chunks().dictionary_encode()
    codes = (g if isinstance(g, pa.DictionaryArray) else g.chunk(0)).indices.to_numpy()
    if not len(codes):
        return t
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(codes)]])))
    return t.append_column("r", pa.array(rank + 1, pa.int32())).filter(pc.less(pa.array(rank), n))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, flush_rows: int = 1_000_000) -> DataFrame:
    """``group``, ``item``, ``score`` and ``rank_no`` (from 1). Strings compare by their UTF-8 bytes."""
    if n < 1:
        raise ValueError("n must be at least 1")
    # the kernels skip NaN: for the heaps a score is a pair of "is NaN" and a number
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.isnan(s).alias("x"), F.when(F.isnan(s), 0.0).otherwise(s).alias("s")).where("g IS NOT NULL AND s IS NOT NULL")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = f"g {kind['g']}, i {kind['i']}, x boolean, s double"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows_in = kept = 0
        for b in batches:
            held.append(_held(b))
            rows_in += b.num_rows
            if rows_in < max(200_000, 2 * kept):
                continue
            t = _best(pa.concat_tables(held), n).select(_COLS)
            held, kept = [t], t.num_rows
            rows_in = kept
            if kept > flush_rows:
                yield from t.to_batches(max_chunksize=50_000)
                held, rows_in, kept = [], 0, 0
        if held:
            yield from _best(pa.concat_tables(held), n).select(_COLS).to_batches(max_chunksize=50_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = _held(b)
            t = t if held is None else pa.concat_tables([held, t])
            best = _best(t, n)
            last = t.column("g")[t.num_rows - 1]
            open_ = pc.equal(best.column("g"), last)
            yield from best.filter(pc.invert(open_)).to_batches()
            held = best.filter(open_).select(_COLS)
        if held is not None:
            yield from _best(held, n).to_batches()

    heaps = rows.mapInArrow(build, ddl)
    out = heaps.repartition("g").sortWithinPartitions("g").mapInArrow(merge, ddl + ", r int")
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.when(F.col("x"), F.lit(float("nan"))).otherwise(F.col("s")).alias(score), F.col("r").alias("rank_no"))
