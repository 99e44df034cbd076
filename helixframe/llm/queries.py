"""Queries of the subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import leaks, lookalikes, mapping, packing, splitting, topn

NAMED = {"trrust_raw": "record_id", "trrust_pkn": "pkn_id", "kegg_pkn": "edge_id"}
TAXON = "910090"


def _typed(spark: SparkSession, d: str, tables: list[str]) -> DataFrame:
    """``table_name``, ``row_id``, ``field``, ``value`` of every TF and TG."""
    parts = [
        table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(NAMED[t]).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("TF", "TG")])).alias("x")).select("table_name", "row_id", "x.*")
        for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def gene_names(genes: DataFrame, taxon: str = TAXON) -> DataFrame:
    """``gene_id``, ``name``, ``rank`` (0 symbol, 1 identifiers, 2 synonyms) of every name of the taxon's genes."""
    xrefs = F.split(F.coalesce("dbxrefs", F.lit("")), r"\|")
    n = lambda c, rank: F.struct(c.alias("name"), F.lit(rank).alias("rank"))
    names = F.concat(
        F.array(n(F.col("symbol"), 0), n(F.col("gene_id"), 1), n(F.col("locus"), 1)),
        F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"[|,;/]"), lambda x: n(x, 2)),
        F.transform(xrefs, lambda x: n(x, 1)),
        F.transform(xrefs, lambda x: n(F.element_at(F.split(x, ":"), -1), 1)),
    )
    return genes.where(F.col("tax_id") == taxon).select("gene_id", F.explode(names).alias("x")).select("gene_id", "x.*").where("name IS NOT NULL AND trim(name) NOT IN ('', '-')")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    genes = table(spark, d, "gene_info")
    symbols = genes.where((F.col("tax_id") == TAXON) & F.col("symbol").isNotNull()).select(F.col("symbol").alias("value")).distinct()
    cases = _typed(spark, d, list(NAMED)).where("value IS NOT NULL").join(symbols, "value", "left_anti")
    found = mapping.map_values(cases, "value", gene_names(genes), "gene_id", "name", "rank")
    return cases.join(found, "value", "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("table_name", "row_id", "field", F.coalesce("target", F.lit("-")).alias("gene_id"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that no gene was meant by, with how often each was typed."""
    return _mapped(spark, d).where("target IS NULL").groupBy("table_name", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of the corpus: those typed, those of string_pkn and those of the reference list."""
    typed = _typed(spark, d, list(NAMED)).select("value")
    string = table(spark, d, "string_pkn").select(F.explode(F.array("TF", "TG")).alias("value"))
    genes = table(spark, d, "gene_info").select(F.explode(F.array("symbol", "locus", "synonyms")).alias("value"))
    return typed.unionByName(string).unionByName(genes)


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.repair_text(_typed(spark, d, ["trrust_raw", "trrust_pkn"]), ["table_name", "row_id", "field"], "value", _names(spark, d), "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("table_name", "row_id", "field", "plain")


def p4_decided(spark: SparkSession, d: str) -> DataFrame:
    """Repaired fields by the number of their tokens that the vocabulary lacks: 0 where it decides everything."""
    return _repaired(spark, d).groupBy("table_name", "n_unknown").agg(F.count(F.lit(1)).alias("fields"), F.count_distinct("value").alias("texts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "string_pkn"), "TF", "TG", "string_combined_score", 10).select("TF", "TG", "rank_no")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return packing.pack_documents(_documents(spark, d), capacity=2048)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    used = p8_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * 2048)).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_documents(spark, d), table(spark, d, "bench_items")).where("kind = 'quoted'").select("doc_id", "item_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Quoted and re-parameterised items in every document."""
    return leaks.leaked(_documents(spark, d), table(spark, d, "bench_items"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 512 tokens, 32 of them shared with the piece before, of every longer document."""
    return splitting.split_documents(_documents(spark, d), limit=512, overlap=32)


def p10_excess(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pieces by the number of pieces above the least, and how many pieces end inside words."""
    first = p10_pieces(spark, d)
    return first.groupBy((F.col("n_pieces") - F.col("n_least")).alias("excess")).agg(
        F.count_if(F.col("piece_no") == 1).alias("documents"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("ends_at") == "character").alias("inside_words")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p4_found, p4_decided, p6_found, p8_containers, p8_fill, p9_found, p9_kinds, p10_pieces, p10_excess)}
ORACLES = {
    "p6_found": """
WITH b AS (SELECT TF, TG, max(string_combined_score) AS s FROM string_pkn WHERE TF IS NOT NULL AND string_combined_score IS NOT NULL GROUP BY 1, 2),
r AS (SELECT TF, TG, CAST(row_number() OVER (PARTITION BY TF ORDER BY s DESC, TG NULLS LAST) AS INTEGER) AS rank_no FROM b)
SELECT * FROM r WHERE rank_no <= 10"""
}
