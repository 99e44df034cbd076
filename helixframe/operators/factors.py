"""Principal components and truncated SVD of sparse rows, by a block Krylov method over the table.

Rows stay where they are, as (``idx``, ``val``) pairs of arrays. A pass multiplies the table with a narrow matrix of
features by directions and adds up the product with its transpose: every task folds its rows to one such matrix, which is
summed in blocks of features, so neither a dense row nor a features by features matrix is ever built. Centring and scaling
enter the products; they never touch the rows. The narrow matrix is the one thing that is sent around, its size is the
number of features times the directions, and it is checked against ``most_bytes`` first.

The directions of all passes are kept as one basis (block Krylov), in which the best are looked for after each pass; it has
``k + extra`` directions at least. Passes go on until the singular values asked for stay within ``tolerance``; with as many
directions as features they are exact. Signs are made definite: the largest weight of each axis is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .scans import running_sums

BLOCK = 512  # features that are summed together
CHUNK = 100_000  # stored values that are multiplied at a time
DIRECTIONS = 16  # of a pass, where no more are asked for


def sparse_rows(counts: DataFrame, value: str = "value") -> tuple[DataFrame, int]:
    """``cell``, ``idx``, ``val`` (features numbered in their own order, from 0), and the number of features.

    The numbers come from a range-partitioned running sum, so the list of features stays a table.
    """
    numbers = running_sums(counts.where("feature IS NOT NULL").select("feature").distinct().withColumn("_one", F.lit(1)), "feature", ["_one"], ["_n"]).select("feature", (F.col("_n") - 1).cast("int").alias("i"))
    numbers = checkpointed(numbers)
    n = numbers.count()
    entries = counts.join(numbers, "feature").groupBy("cell", "i").agg(F.sum(F.col(value).cast("double")).alias("v"))
    rows = entries.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("l"))
    return rows.select("cell", F.col("l.i").alias("idx"), F.col("l.v").alias("val")), n


def dense_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``idx``, ``val`` of vectors that are stored whole."""
    v = F.col(vector).cast("array<double>")
    return df.where(F.col(vector).isNotNull()).select(key, F.sequence(F.lit(0), F.size(v) - 1).alias("idx"), v.alias("val"))


def folded_rows(folded: DataFrame, features: list[str]) -> DataFrame:
    """``sparse_rows`` of cells that stand in one row each: ``cell`` and ``l``, an array of (``feature``, ``value``).

    ``features`` are numbered as they come; others take no part, nor does a cell that has none of them.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    shared, n = folded.sparkSession.sparkContext.broadcast(features), len(features)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(pc.struct_field(lists.flatten(), [0]), value_set=known)
            val = pc.struct_field(lists.flatten(), [1]).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            used = at.is_valid().to_numpy(zero_copy_only=False)
            key = row[used] * n + pc.drop_null(at).to_numpy().astype(np.int64)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sums, key = np.add.reduceat(np.nan_to_num(val[used][order], nan=0.0), first), key[first]
            rows, sizes = np.unique(key // n, return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array((key % n).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(sums))], ["cell", "idx", "val"])

    kind = folded.schema["cell"].dataType.simpleString()
    return folded.select("cell", "l").mapInArrow(number, f"cell {kind}, idx array<int>, val array<double>")


def _products(batch, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """(feature, value, row, rows' products with ``w``) of chunks of whole rows; ``batch``: an Arrow batch with ``idx`` and ``val``."""
    import pyarrow.compute as pc

    at_idx, at_val = batch.schema.get_field_index("idx"), batch.schema.get_field_index("val")
    sizes = pc.fill_null(pc.list_value_length(batch.column(at_idx)), 0).to_numpy()
    indices, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (at_idx, at_val))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(sizes):
        z = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        idx, val = indices[ends[at] : ends[z]].astype(np.int64), values[ends[at] : ends[z]].astype(np.float64)
        row = np.repeat(np.arange(z - at), sizes[at:z])
        y = np.zeros((z - at, w.shape[1]))
        full = np.flatnonzero(sizes[at:z])
        if len(full):
            y[full] = np.add.reduceat(w[idx] * val[:, None], ends[at:z][full] - ends[at], axis=0)
        yield idx, val, row, y
        at = z


def _gathered(rows: DataFrame, n: int, width: int, fold) -> np.ndarray:  # noqa: ANN001
    """Sum over all tasks of the ``n`` by ``width`` matrices that ``fold`` makes of a task's batches.

    A task's matrix is what costs, and its rows stream by: so there are no more than two tasks a core.
    """
    import pandas as pd
    import pyarrow as pa

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fold(batches)
        for b in range(0, n, BLOCK):
            if m[b : b + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([m[b : b + BLOCK].tobytes()], pa.binary())], ["b", "m"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(x) for x in pdf.m)
        return pd.DataFrame({"b": [int(pdf.b.iloc[0])], "m": [s.tobytes()]})

    out = np.zeros((n, width))
    rows = rows.select("idx", "val").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    for r in rows.mapInArrow(task, "b int, m binary").groupBy("b").applyInPandas(total, "b int, m binary").toLocalIterator():
        part = np.frombuffer(bytes(r["m"])).reshape(-1, width)
        out[r["b"] : r["b"] + len(part)] = part
    return out


def _orthogonal(z: np.ndarray, basis: list[np.ndarray], most: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for what ``z`` has beyond the basis, ``most`` at most; columns without any are drawn anew."""
    for _ in range(3):
        size = np.linalg.norm(z, axis=0)
        for _ in range(2):
            for v in basis:
                z = z - v @ (v.T @ z)
        left = np.linalg.norm(z, axis=0)
        gone = left <= 1e-12 * np.maximum(size, 1e-300)
        z[:, gone] = rng.standard_normal((len(z), int(gone.sum())))
        z = z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
        q, r = np.linalg.qr(z)
        weak = np.abs(np.diag(r)) <= 1e-10
        if not gone.any() and not weak.any():
            break
        q[:, weak] = rng.standard_normal((len(z), int(weak.sum())))
        z = q
    for v in basis:
        q = q - v @ (v.T @ q)
    return np.linalg.qr(q)[0][:, :most]


def _parts(c: np.ndarray, basis: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of ``c`` that belong to each block of the basis."""
    return np.split(c, np.cumsum([v.shape[1] for v in basis])[:-1])


def decompose(rows: DataFrame, key: str, n: int, k: int, centre: bool = True, scale: bool = False, extra: int = 54, tolerance: float = 1e-6, most_passes: int = 60, most_bytes: int = 512 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, offsets, singular values): ``val @ axes[idx] - offsets`` are a row's coordinates, ``k`` of them at most."""
    width = min(n, k + extra)
    if n * width * 8 > most_bytes:
        raise ValueError(f"{n} features by {width} directions exceed {most_bytes} bytes")
    spark = rows.sparkSession

    def sums(batches) -> np.ndarray:  # noqa: ANN001
        m = np.zeros((n, 2))
        for b in batches:
            for idx, val, _, _ in _products(b, np.zeros((n, 1))):
                m[:, 0] += np.bincount(idx, val, n)
                m[:, 1] += np.bincount(idx, val * val, n)
        return m

    count = rows.count()
    if not count or not n:
        return np.zeros((n, 0)), np.zeros(0), np.zeros(0)
    s = _gathered(rows, n, 2, sums) if centre or scale else np.zeros((n, 2))
    mean = s[:, 0] / count
    sd = np.sqrt(np.maximum(s[:, 1] - count * mean * mean, 0) / max(count - 1, 1)) if scale else np.ones(n)
    sd[sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300)] = 1.0
    mean = mean if centre else np.zeros(n)
    rng = np.random.default_rng(0)
    block = min(width, max(k, DIRECTIONS))
    basis = [np.linalg.qr(rng.standard_normal((n, block)))[0]]
    inner = np.zeros((0, 0))
    last = None
    for _ in range(most_passes):
        q = basis[-1]
        w = q / sd[:, None]
        shared = spark.sparkContext.broadcast((w, mean @ w))

        def square(batches, shared=shared) -> np.ndarray:  # noqa: ANN001
            w, off = shared.value
            m = np.zeros((n + 1, w.shape[1]))  # the last row sums the coordinates themselves
            for b in batches:
                for idx, val, row, y in _products(b, w):
                    y -= off
                    m[n] += y.sum(0)
                    if len(idx):
                        order = np.argsort(idx.astype(np.uint16) if n <= 1 << 16 else idx, kind="stable")  # short numbers sort by radix
                        i = idx[order]
                        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                        m[i[first]] += np.add.reduceat(val[order, None] * y[row[order]], first, axis=0)
            return m

        m = _gathered(rows, n + 1, q.shape[1], square)
        shared.destroy()
        z = (m[:n] - np.outer(mean, m[n])) / sd[:, None]
        # the products of the new block with the whole basis; those among the blocks before are known
        new = np.concatenate([v.T @ z for v in basis])
        old, inner = inner, np.zeros((len(new), len(new)))
        inner[: len(old), : len(old)] = old
        inner[:, len(old) :] = new
        inner[len(old) :] = new.T
        inner[len(old) :, len(old) :] = (new[len(old) :] + new[len(old) :].T) / 2
        values, vectors = np.linalg.eigh(inner)
        order = np.argsort(-values)
        top = np.sqrt(np.maximum(values[order][:k], 0))
        if len(inner) == n or len(inner) >= width and last is not None and len(last) == len(top) and np.all(np.abs(top - last) <= tolerance * max(top[0], 1e-300)):
            break
        last = top
        if (len(inner) + block) * n * 8 > most_bytes:  # the best directions so far begin a basis of their own
            basis, inner = [np.linalg.qr(sum(v @ c for v, c in zip(basis, _parts(vectors[:, order[:block]], basis), strict=True)))[0]], np.zeros((0, 0))
        else:
            basis.append(_orthogonal(z, basis, n - len(inner), rng))
    size = sum(v.shape[1] for v in basis)
    axes = sum(v @ c for v, c in zip(basis, _parts(vectors[:size, order[:k]], basis), strict=False))
    axes *= np.where(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    w = axes / sd[:, None]
    return w, mean @ w, top


def _coordinates(rows: DataFrame, key: str, axes: np.ndarray, offsets: np.ndarray) -> DataFrame:
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast((axes, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, off = shared.value
        for b in batches:
            y = np.concatenate([y - off for _, _, _, y in _products(b, w)] or [np.zeros((0, w.shape[1]))])
            ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["key", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "idx", "val").mapInArrow(place, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


def pca(rows: DataFrame, key: str, n: int, k: int, scale: bool = False) -> DataFrame:
    """``key``, ``embedding``: coordinates on the first ``k`` principal components of the centred (and, asked for, scaled) rows."""
    axes, offsets, _ = decompose(rows, key, n, min(k, n), True, scale)
    return _coordinates(rows, key, axes, offsets)


def lsi(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """Left singular vectors of the (tf-idf) rows without the first one: ``key``, ``embedding`` of up to ``k - 1`` coordinates."""
    axes, offsets, s = decompose(rows, key, n, min(k, n), False)
    kept = np.flatnonzero(s > 1e-9 * max(s.max(initial=0), 1e-300))[1:]
    return _coordinates(rows, key, axes[:, kept] / s[kept], offsets[kept] / s[kept])
