"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).csv(path)


def bed(df: DataFrame, path: str) -> None:
    """TSV without header."""
    csv(df, path, "\t", False)


def parquet_by(df: DataFrame, path: str, *keys: str, files_per_key: int = 1) -> None:
    """Parquet in one folder per key value; rows of a key are brought together first, so there are few files.

    With hot keys let ``files_per_key`` tasks write each of them.
    """
    spread = [F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))] if files_per_key > 1 else []
    (df.repartition(*keys, *spread) if keys else df).write.mode("overwrite").partitionBy(*keys).parquet(path)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as node and edge tables; attribute nulls become "0" as in text exports."""
    clean = lambda d: d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c) for c in d.columns])
    clean(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    clean(edges).write.mode("overwrite").parquet(f"{path}/edges")


def graphml(edges: DataFrame, path: str) -> None:
    """Edges as XML rows of a graph."""
    edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target")).write.mode("overwrite").format("xml").option("rowTag", "edge").option("rootTag", "graph").save(path)


def graphml_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (``id`` and attributes) and edges (``src``, ``dst`` and attributes) as XML; null attributes become "0"."""

    def put(df: DataFrame, tag: str, ends: dict[str, str]) -> None:
        rest = [c for c in df.columns if c not in ends]
        data = F.array(*[F.struct(F.lit(c).alias("_key"), F.coalesce(F.col(c).cast("string"), F.lit("0")).alias("_VALUE")) for c in rest]).alias("data")
        df.select(*[F.col(c).alias(a) for c, a in ends.items()], *([data] if rest else [])).write.mode("overwrite").format("xml").option("rowTag", tag).option("rootTag", "graph").save(f"{path}/{tag}s")

    put(nodes, "node", {"id": "_id"})
    put(edges, "edge", {"src": "_source", "dst": "_target"})


def fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), F.col("id"), F.lit(" "), F.col("description"), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)
