"""Gene identifiers: dictionaries from annotation tables and the chain that resolves a symbol through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import normalise_symbol, split_synonyms

#: Curated aliases. The normal form removes blanks, so the two keys with a blank match no normalised name.
CURATED = {"HIF2A": "EPAS1", "P53": "TP53", "P73": "TRP73", "P63": "TP63", "NFKB": "NFKB1", "NFKB P65": "RELA", "NFKB P50": "NFKB1", "MYC/MAX": "MYC"}


def alias_first_wins(genes: DataFrame, order: str) -> DataFrame:
    """``alias``, ``symbol``: the first gene by ``order`` that claims an alias has it."""
    a = genes.select(normalise_symbol(F.col("symbol")).alias("symbol"), F.explode(F.array_distinct(F.transform(split_synonyms(F.col("synonyms")), normalise_symbol))).alias("alias"), F.col(order).alias("_o"))
    return a.where("alias <> '' AND symbol <> ''").groupBy("alias").agg(F.min_by("symbol", F.struct("_o", "symbol")).alias("symbol"))


def id_last_wins(rows: DataFrame, id_col: str, symbol: str, order: str) -> DataFrame:
    """``id``, ``symbol``: the last row by ``order`` counts."""
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max_by(symbol, F.struct(order, symbol)).alias("symbol"))


def ensembl_of(genes: DataFrame, prefix: str = "Ensembl:") -> DataFrame:
    """``ensembl`` and the gene's columns, one row per cross reference of that kind."""
    refs = F.filter(F.split(F.coalesce("dbxrefs", F.lit("")), r"\|"), lambda x: x.startswith(prefix))
    return genes.select("*", F.explode(F.transform(refs, lambda x: F.substring_index(x, ":", -1))).alias("ensembl"))


def dictionaries(genes: DataFrame, order: str) -> dict[str, DataFrame]:
    """official (``symbol``), ensembl and entrez (``id``, ``symbol``), alias (``alias``, ``symbol``)."""
    g = genes.withColumn("symbol", normalise_symbol(F.col("symbol")))
    return {
        "official": g.where("symbol <> ''").select("symbol").distinct(),
        "ensembl": id_last_wins(ensembl_of(g), "ensembl", "symbol", order),
        "entrez": id_last_wins(g.where("symbol <> ''"), "gene_id", "symbol", order),
        "alias": alias_first_wins(genes, order),
    }


def resolve(values: DataFrame, column: str, dicts: dict[str, DataFrame], fallback: DataFrame | None = None, ensembl_prefix: str = "ENS") -> DataFrame:
    """Distinct ``column``, ``symbol``, ``how``: curated, official, Ensembl, Entrez, alias, fallback, else itself.

    Runs over distinct values; the dictionaries' sizes decide whether Spark broadcasts them.
    """
    spark = values.sparkSession
    v = values.select(F.col(column).alias("raw")).distinct().withColumn("n", normalise_symbol(F.col("raw")))
    cur = F.create_map(*[F.lit(x) for kv in CURATED.items() for x in kv])
    v = v.withColumn("c", F.coalesce(cur[F.col("n")], F.col("n")))
    v = v.join(dicts["official"].select(F.col("symbol").alias("c"), F.lit(True).alias("is_official")), "c", "left")
    v = v.join(dicts["ensembl"].select(F.upper("id").alias("c"), F.col("symbol").alias("by_ens")), "c", "left")
    v = v.join(dicts["entrez"].select(F.col("id").alias("c"), F.col("symbol").alias("by_entrez")), "c", "left")
    v = v.join(dicts["alias"].select(F.col("alias").alias("c"), F.col("symbol").alias("by_alias")), "c", "left")
    if fallback is None:
        fallback = spark.createDataFrame([], "query string, symbol string")
    v = v.join(fallback.groupBy(F.col("query").alias("c")).agg(F.min("symbol").alias("by_fallback")), "c", "left")
    ens, num = F.col("c").startswith(ensembl_prefix) & F.col("by_ens").isNotNull(), F.col("c").rlike(r"^\d+$") & F.col("by_entrez").isNotNull()
    plain = ~F.col("c").startswith(ensembl_prefix) & ~F.col("c").rlike(r"^\d+$")
    steps = [(F.col("c") == "", F.lit(""), "empty"), (F.col("is_official"), F.col("c"), "official"), (ens, F.col("by_ens"), "ensembl"), (num, F.col("by_entrez"), "entrez"), (F.col("by_alias").isNotNull(), F.col("by_alias"), "alias"), (plain & F.col("by_fallback").isNotNull(), F.col("by_fallback"), "fallback")]
    symbol, how = F.when(F.lit(False), F.col("c")), F.when(F.lit(False), "self")
    for cond, to, name in steps:
        symbol, how = symbol.when(cond, to), how.when(cond, name)
    return v.select(F.col("raw").alias(column), symbol.otherwise(F.col("c")).alias("symbol"), how.otherwise("self").alias("how"))


def standardise_edges(edges: DataFrame, dicts: dict[str, DataFrame], fallback: DataFrame | None = None) -> DataFrame:
    """The edge table with TF and TG resolved; rows with an empty end are dropped."""
    both = edges.select(F.explode(F.array("TF", "TG")).alias("name"))
    r = resolve(both, "name", dicts, fallback).select("name", "symbol")
    out = edges
    for c in ("TF", "TG"):
        out = out.join(r.select(F.col("name").alias("_n"), F.col("symbol").alias("_s")), F.col(c).eqNullSafe(F.col("_n")), "left").withColumn(c, F.coalesce("_s", F.lit(""))).drop("_n", "_s")
    return out.where("TF <> '' AND TG <> ''")


def coverage(dicts: dict[str, DataFrame]) -> DataFrame:
    """Sizes of the four dictionaries."""
    c = {n: d.agg(F.count(F.lit(1)).alias(f"n_{n}")) for n, d in dicts.items()}
    out = c["official"]
    for n in ("ensembl", "entrez", "alias"):
        out = out.join(F.broadcast(c[n]))
    return out


class Canonicaliser:
    """Gene names to canonical symbols, from an annotation (``gene_id``, ``gene_name``, ``ord``) and a gene table.

    Later sources win where they name the same identifier, as if they had been loaded one after the other.
    """

    def __init__(self, annotation: DataFrame | None = None, genes: DataFrame | None = None, order: str = "ord", fallback: DataFrame | None = None, ensembl_prefix: str = "ENS") -> None:
        if annotation is None and genes is None:
            raise ValueError("an annotation or a gene table is needed")
        self.fallback, self.prefix = fallback, ensembl_prefix
        self.dicts = dictionaries(genes, order) if genes is not None else None
        if annotation is not None:
            a = annotation.select(F.substring_index("gene_id", ".", 1).alias("id"), normalise_symbol(F.col("gene_name")).alias("symbol"), "ord").where("symbol IS NOT NULL AND symbol <> ''")
            own = {"official": a.select("symbol").distinct(), "ensembl": id_last_wins(a, "id", "symbol", "ord")}
            if self.dicts is None:
                none = a.limit(0)
                self.dicts = {**own, "entrez": none.select("id", "symbol"), "alias": none.select(F.col("id").alias("alias"), "symbol")}
            else:
                later = self.dicts["ensembl"]
                self.dicts["ensembl"] = later.unionByName(own["ensembl"].join(later, "id", "left_anti"))
                self.dicts["official"] = self.dicts["official"].union(own["official"]).distinct()

    def series(self, values: DataFrame, column: str) -> DataFrame:
        """Distinct ``column`` with ``symbol`` and ``how`` it was found."""
        return resolve(values, column, self.dicts, self.fallback, self.prefix)

    def table(self, edges: DataFrame, tf: str = "TF", tg: str = "TG") -> tuple[DataFrame, int]:
        """The table with both columns resolved and without rows that have an empty end; and how many these were."""
        named = edges.withColumnsRenamed({tf: "TF", tg: "TG"})
        out = standardise_edges(named, self.dicts, self.fallback)
        return out.withColumnsRenamed({"TF": tf, "TG": tg}).select(edges.columns), named.count() - out.count()

    def coverage(self) -> DataFrame:
        return coverage(self.dicts)
