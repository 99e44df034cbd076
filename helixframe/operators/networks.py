"""Prior-knowledge networks: edge lists of TFs and their targets from three kinds of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_case, regulation_sign, signal_sign
from .graph import last_writer_wins

#: Organism code to species name, pathway organism and taxon.
ORGANISMS = {"mm10": ("mouse", "mmu", "10090"), "hg38": ("human", "hsa", "9606")}
SCORES = ["combined_score", "experimental", "database", "coexpression", "textmining", "neighborhood", "fusion", "cooccurence"]


def organism(code: str) -> tuple[str, str, str]:
    if code not in ORGANISMS:
        raise ValueError(f"unknown organism {code!r}")
    return ORGANISMS[code]


def regulation_edges(raw: DataFrame, case: str = "upper") -> DataFrame:
    """Curated pairs rolled up: greatest sign, sorted distinct regulation terms and literature ids, number of rows."""
    d = raw.where("TF IS NOT NULL AND TG IS NOT NULL").select(fold_case(F.col("TF"), case).alias("TF"), fold_case(F.col("TG"), case).alias("TG"), "Regulation", "PMIDs")
    ids = F.filter(F.transform(F.split("PMIDs", ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.groupBy("TF", "TG").agg(
        F.max(regulation_sign(F.col("Regulation"))).alias("trrust_sign"),
        F.array_join(F.array_sort(F.collect_set("Regulation")), ";").alias("trrust_regulation"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(ids)))), ",").alias("trrust_pmids"),
        F.count(F.lit(1)).alias("trrust_support_n"),
    )


def association_edges(links: DataFrame, names: DataFrame, min_score: int | None = None, case: str = "upper") -> DataFrame:
    """Scored links with both ends named (the last name of an id counts), unnamed ends dropped; only the combined score is scaled to 0..1."""
    kept = links if min_score is None else links.where(F.col("combined_score") >= min_score)
    order = "ord" if "ord" in names.columns else "preferred_name"
    one = names.groupBy("id").agg(F.max_by("preferred_name", order).alias("name"))
    a, b = one.select(F.col("id").alias("protein1"), F.col("name").alias("_a")), one.select(F.col("id").alias("protein2"), F.col("name").alias("_b"))
    r = kept.join(a, "protein1").join(b, "protein2")
    have = [s for s in SCORES if s in links.columns]
    value = lambda s: F.col(s) / F.lit(1000.0) if s == "combined_score" else F.col(s)
    label = lambda s: "string_combined_score" if s == "combined_score" else f"string_{s}_score"
    return r.select(fold_case(F.col("_a"), case).alias("TF"), fold_case(F.col("_b"), case).alias("TG"), *[value(s).alias(label(s)) for s in have])


def pathway_edges(edges: DataFrame, case: str = "upper") -> DataFrame:
    """Pathway graphs (``src``, ``dst``, ``signal``, ``pathway``, ``ord``) as one edge list with sign and provenance."""
    last = last_writer_wins(edges, ["src", "dst"], "ord", ["signal"])
    where = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("pathway")).alias("p"))
    r = last.join(where, ["src", "dst"]).select(F.col("src").alias("TF"), F.col("dst").alias("TG"), signal_sign(F.col("signal")).alias("kegg_signal"), F.size("p").alias("kegg_n_pathways"), F.array_join("p", ",").alias("kegg_pathways"))
    return r.dropDuplicates().withColumns({"TF": fold_case(F.col("TF"), case), "TG": fold_case(F.col("TG"), case)})


def network_union(parts: dict[str, DataFrame]) -> DataFrame:
    """``TF``, ``TG``, ``sources`` (sorted, comma-joined), ``n_sources`` over edge tables named by source."""
    rows = reduce(DataFrame.unionByName, [p.select("TF", "TG", F.lit(n).alias("source_db")) for n, p in parts.items()])
    s = rows.where("TF IS NOT NULL AND TG IS NOT NULL").groupBy("TF", "TG").agg(F.array_sort(F.collect_set("source_db")).alias("s"))
    return s.select("TF", "TG", F.array_join("s", ",").alias("sources"), F.size("s").alias("n_sources"))


def network_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("TF").alias("n_tf"), F.count_distinct("TG").alias("n_tg"), F.count(F.lit(1)).alias("n_edges"))


def peak_edges(peaks: DataFrame) -> DataFrame:
    """Distinct ``source_id``, ``peak_id`` (chrom:start-end): made distinct on the coordinates, spelt out late."""
    d = peaks.select("source_id", "peak_chr", "peak_start", "peak_end").distinct()
    return d.select("source_id", F.concat(F.col("peak_chr"), F.lit(":"), F.col("peak_start").cast("string"), F.lit("-"), F.col("peak_end").cast("string")).alias("peak_id"))


def association_graph(edges: DataFrame, as_directed: bool = False, order: str | None = None) -> DataFrame:
    """The edges of a graph of associations, one per pair of ends, the last by ``order`` (any, if none) with its scores.

    Directed: every edge and its reverse; else keyed on the lesser and the greater end.
    """
    from .graph import symmetrised

    scores = [c for c in edges.columns if c.startswith("string_")]
    e = edges.where("TF IS NOT NULL AND TG IS NOT NULL").withColumn("_o", F.col(order) if order else F.monotonically_increasing_id())
    if as_directed:
        e = symmetrised(e, "TF", "TG")
    ends = [F.col("TF"), F.col("TG")] if as_directed else [F.least("TF", "TG").alias("TF"), F.greatest("TF", "TG").alias("TG")]
    return e.groupBy(*ends).agg(F.max_by(F.struct(*scores), "_o").alias("_s")).select("TF", "TG", "_s.*")
