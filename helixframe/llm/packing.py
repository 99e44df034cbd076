"""Filling containers of fixed capacity: best-fit decreasing over a segment tree of remaining capacities.

Documents are counted in tokens and spread by a hash over blocks of about ``block_tokens`` tokens, so no task holds more
than one block. Inside a block items go, largest first, into the tightest open container that still holds them; the
segment tree over remaining capacities finds it in logarithmic time. Containers that end up less than ``keep_fill`` full
are opened again and their items packed once more, over fewer blocks: the waste is that of a few last containers, not of
one per block. An item is never split unless it alone exceeds the capacity; then it fills containers of its own and its
rest is packed like any other item.

Defined cases: null and empty texts have no tokens and take no place; equal sizes go by document id; repeated rows are
items of their own (told apart by their number among equal ids); an empty input gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokenizer import DEFAULT_RANKS


class OpenBins:
    """Open containers by remaining capacity: a segment tree of counts, and a stack of containers per leaf."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.stacks.setdefault(remaining, []).append(container)
        i = remaining + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(remaining, container) with the smallest remaining capacity of at least ``need``."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a subtree to the right has an open container
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - self.size
        container = self.stacks[remaining].pop()
        while i:
            tree[i] -= 1
            i >>= 1
        return remaining, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of every item, and what is left of every container. Sizes lie between 1 and ``capacity``."""
    bins, left, place = OpenBins(capacity), [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = bins.take_tightest(sizes[k])
        if got is None:
            left.append(capacity)
            got = capacity, len(left) - 1
        rest, b = got[0] - sizes[k], got[1]
        place[k], left[b] = b, rest
        if rest:
            bins.add(rest, b)
    return place, left


def count_tokens(docs: DataFrame, doc_id: str, text: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every row."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokenizer import load

        t = load(ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [t.count(x) if x else 0 for x in b.text]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long")


def _pack(items: DataFrame, capacity: int, blocks: int, turn: int) -> DataFrame:
    """Items with ``container_id`` and ``left_over``; one group per block."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy_no", "part_no"], kind="stable")
        place, left = best_fit_decreasing([int(x) for x in pdf.n_tokens], capacity)
        pdf["container_id"] = [f"{turn}-{b}-{p}" for b, p in zip(pdf.block, place)]
        pdf["left_over"] = [left[p] for p in place]
        return pdf.drop(columns="block")

    kind = dict(items.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, copy_no int, part_no int, n_parts int, token_start long, n_tokens long, container_id string, left_over long"
    block = F.pmod(F.xxhash64("doc_id", "copy_no", "part_no"), F.lit(blocks)).cast("int")
    return items.withColumn("block", block).groupBy("block").applyInPandas(one, ddl)


def pack_documents(docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, block_tokens: int = 8_000_000, keep_fill: float = 0.98) -> DataFrame:
    """``container_id``, ``doc_id``, ``copy_no``, ``part_no``, ``n_parts``, ``token_start``, ``n_tokens``: one row per placed item.

    Token counts are checkpointed: their sum sets the number of blocks.
    """
    counted = checkpointed(count_tokens(docs, doc_id, text, ranks).where("n_tokens > 0"))
    per_id = counted.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") - whole * capacity
    parts = per_id.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no")).withColumn("n_parts", F.ceil(F.col("n_tokens") / capacity).cast("int"))
    shape = ["doc_id", "copy_no", "part_no", "n_parts", "token_start", "n_tokens"]
    full = (
        parts.where(whole > 0)
        .select("doc_id", "copy_no", "n_parts", F.explode(F.sequence(F.lit(1), whole)).alias("part_no"))
        .select("doc_id", "copy_no", "part_no", "n_parts", ((F.col("part_no") - 1) * F.lit(capacity)).cast("long").alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"))
        .withColumn("container_id", F.concat_ws("-", F.lit("f"), "doc_id", "copy_no", "part_no"))
    )
    items = parts.where(rest > 0).select("doc_id", "copy_no", F.col("n_parts").alias("part_no"), "n_parts", (whole * F.lit(capacity)).cast("long").alias("token_start"), rest.alias("n_tokens"))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    first = checkpointed(_pack(items.select(shape), capacity, max(1, -(-total // block_tokens)), 1))
    well = F.col("left_over") <= capacity * (1 - keep_fill)
    loose = first.where(~well).select(shape)
    spare = loose.agg(F.sum("n_tokens")).first()[0] or 0
    second = _pack(loose, capacity, max(1, -(-spare // block_tokens)), 2)
    cols = ["container_id", *shape]
    return first.where(well).select(cols).unionByName(second.select(cols)).unionByName(full.select(cols))
