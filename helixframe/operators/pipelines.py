"""Composite pipelines over long count tables and edge sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_zero, parse_peaks, species_of, strip_prefix
from ..session import checkpointed, written
from ..sources import files, sinks
from . import factors, genomic, graph, matrix, networks, sampling


def rna_qc(counts: DataFrame, mito: Column, min_cells: int = 20, features: tuple[int, int] = (500, 2500), totals: tuple[float, float] = (1000, 5000), max_pct_mt: float = 20.0, keep: DataFrame | None = None, only_variable: bool = False) -> DataFrame:
    """``cell``, ``feature``, ``value``, ``norm``, ``log1p``, ``variable``: filtered, normalised on what is left, flagged."""
    kept = matrix.normalise_total(matrix.qc_filter(counts, min_cells, features, totals, max_pct_mt, mito, keep))
    return _flagged(kept, matrix.variable_features(kept, "norm", 0.02, 4.0, 0.5), keep, only_variable)


def atac_qc(counts: DataFrame, min_cells: int = 10, features: tuple[int, int] = (200, 15000), totals: tuple[float, float] = (500, 50000), only_variable: bool = False) -> DataFrame:
    """As ``rna_qc`` for peaks, with ``tfidf`` from the values before normalisation."""
    kept = matrix.qc_filter(counts, min_cells, features, totals)
    kept = matrix.normalise_total(matrix.tfidf(kept))
    return _flagged(kept, matrix.variable_features(kept, "norm", 0.05, 1.5, 0.5), None, only_variable)


def atac_clusters(kept: DataFrame, tss: DataFrame, components: int = 50, pcs: int = 50, neighbours: int = 10, graph_pcs: int = 30, upstream: int = 1000, downstream: int = 100, distal_max: int = 200_000) -> dict[str, DataFrame]:
    """What follows ``atac_qc`` (``kept`` is its result), over the variable peaks and all its cells.

    ``lsi``: ``cell``, ``embedding`` of the tf-idf values without the first component; ``pca``: the same of the scaled ``log1p``
    (sample sd); ``neighbours``: ``i``, ``j``, ``rank_no`` over the first ``graph_pcs`` coordinates; ``clusters``: ``cell``, ``cluster``
    (label propagation); ``annotation``: the variable peaks by their genes (peak names are chrom:start-end). No more components
    are taken than there are variable peaks; none of them is an error.
    """
    picked = kept.where("variable").select("cell", "feature", "tfidf", "log1p")
    first = picked.agg(F.min("feature").alias("feature"), F.count_distinct("feature").alias("n"))
    n = first.first()["n"]
    if not n:
        raise ValueError("no variable peaks")
    # a cell without any variable peak is a row of zeros, not a missing row
    bare = kept.select("cell").distinct().join(picked, "cell", "left_anti").crossJoin(F.broadcast(first.select("feature"))).select("cell", "feature", F.lit(0.0).alias("tfidf"), F.lit(0.0).alias("log1p"))
    x = checkpointed(picked.unionByName(bare))
    rows, width = factors.sparse_rows(x, "tfidf")
    lsi = factors.lsi(checkpointed(rows), "cell", width, components)
    rows, width = factors.sparse_rows(x, "log1p")
    emb = checkpointed(factors.pca(checkpointed(rows), "cell", width, pcs, scale=True))
    ids = emb.select("cell", F.slice("embedding", 1, graph_pcs).alias("embedding"), F.xxhash64("cell").alias("id"))
    knn = checkpointed(graph.neighbour_graph(ids, "id", "embedding", neighbours))
    groups = graph.communities(knn.select(F.col("query_id").alias("i"), F.col("neighbour_id").alias("j"), (1.0 / F.col("rank_no")).alias("w")))
    names = ids.select("cell", "id")
    pairs = knn.join(names.select(F.col("cell").alias("i"), F.col("id").alias("query_id")), "query_id").join(names.select(F.col("cell").alias("j"), F.col("id").alias("neighbour_id")), "neighbour_id")
    peaks = parse_peaks(picked.select(F.col("feature").alias("peak_id")).distinct(), "peak_id")
    return {
        "lsi": lsi, "pca": emb, "neighbours": pairs.select("i", "j", "rank_no"), "clusters": names.join(groups, F.col("id") == F.col("node")).select("cell", F.col("label").alias("cluster")),
        "annotation": genomic.annotate_peaks(peaks, tss, upstream, downstream, distal_max),
    }


def _flagged(kept: DataFrame, flags: DataFrame, keep: DataFrame | None, only_variable: bool) -> DataFrame:
    out = kept.join(flags.select("feature", "variable"), "feature", "left")
    if not only_variable:
        return out
    if keep is None:
        return out.where("variable")
    named = keep.select("feature").distinct().withColumn("_keep", F.lit(True))
    return out.join(named, "feature", "left").where("variable OR _keep").drop("_keep")


def integrate(rna: DataFrame, atac: DataFrame, components: int = 15, neighbours: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of both modalities, guarded features, joint components, neighbour graph, clusters and ranked features.

    The components are those of the joined modalities (in place of a joint factor model: coordinates differ from it).
    Returns ``cell, embedding``; ``cell, cluster``; ranked features per cluster.
    """
    named = [t.where("cell IS NOT NULL").select("cell", F.lit(name).alias("kind"), F.concat(F.lit(name), "feature").alias("feature"), finite_or_zero(F.col("value").cast("double")).alias("value")) for name, t in (("rna:", rna), ("atac:", atac))]
    # every cell becomes one row, once: each modality is read, and its rows are shuffled, a single time
    cells = reduce(DataFrame.unionByName, named).groupBy("cell").agg(F.collect_list(F.struct("feature", "value")).alias("l"), (F.max(F.col("kind") == "rna:") & F.max(F.col("kind") == "atac:")).alias("both"))
    folded = written(cells.where("both").select("cell", "l"))
    both = folded.select("cell", F.inline("l"))
    guard = checkpointed(matrix.feature_guard(both).where("feature IS NOT NULL").select("feature"))
    features = [r[0] for r in guard.orderBy("feature").toLocalIterator()]
    emb = written(factors.pca(written(factors.folded_rows(folded, features)), "cell", len(features), components))
    both = both.join(guard, "feature", "left_semi").select("cell", "feature", "value")
    ids = emb.select("cell", "embedding", F.xxhash64("cell").alias("id"))
    knn = checkpointed(graph.neighbour_graph(ids, "id", "embedding", neighbours))
    groups = graph.communities(knn.select(F.col("query_id").alias("i"), F.col("neighbour_id").alias("j"), (1.0 / F.col("rank_no")).alias("w")))
    clusters = ids.join(groups, F.col("id") == F.col("node")).select("cell", F.col("label").alias("cluster"))
    return emb, clusters, matrix.rank_features(both, clusters)


def one_species(peaks: DataFrame, species: str = "hg38", columns: tuple[str, ...] = ("feature", "gene_ids", "interval")) -> DataFrame:
    """Peaks of a mixed experiment: those of one species (``interval`` up to its first dot), its prefix taken off the names.

    A table whose intervals name no species comes back as it is.
    """
    if peaks.where(F.col("feature").contains(species)).isEmpty():
        return peaks
    own = peaks.where(species_of(F.col("interval")) == species)
    return own.withColumns({c: strip_prefix(F.col(c), f"{species}.") for c in columns if c in peaks.columns})


def save_processed(rna: DataFrame, atac: DataFrame, folder: str) -> dict[str, str]:
    """Both modalities as long Parquet tables (``feature``, ``cell``, ``value`` float; the first layer there is of log1p, counts, value).

    RNA names come in upper case. Features by cells as columns are for small exports (``matrix.pivot_wide``).
    """
    paths = {"rna": f"{folder}/scRNA_seq_processed", "atac": f"{folder}/scATAC_seq_processed"}
    for name, table in (("rna", rna), ("atac", atac)):
        layer = next(c for c in ("log1p", "counts", "value") if c in table.columns)
        feature = F.upper("feature") if name == "rna" else F.col("feature")
        table.select(feature.alias("feature"), "cell", F.col(layer).cast("float").alias("value")).write.mode("overwrite").parquet(paths[name])
    return paths


def metacells(connectivities: DataFrame, rna: DataFrame, atac: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Both modalities smoothed over the cell graph; RNA features collapsed to symbols afterwards."""
    w = checkpointed(matrix.diffusion_weights(connectivities, hops))
    return matrix.collapse_symbols(matrix.smooth(w, rna), "sum"), matrix.smooth(w, atac)


def stability_samples(tables: list[DataFrame], fraction: float = 0.7, repeats: int = 10) -> list[list[DataFrame]]:
    """``repeats`` exact samples of the cells that all tables share."""
    shared = matrix.intersect_cells(*tables)
    cells = shared[0].select("cell").distinct()
    return [[t.join(sampling.exact_fraction(cells, "cell", fraction, seed), "cell", "left_semi") for t in shared] for seed in range(repeats)]


#: Fixed value: names of nodes, in upper case, that stand for a whole pathway.
PATHWAY_NODES = r"^(PATH:|MMU\d{5}|HSA\d{5}|KO\d{5})$"


def pathway_network(tables: dict[str, DataFrame], names: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``signal``, ``pathway``, ``ord`` of pathway XML, from files to one network of genes.

    Within a pathway the genes of an entry are one node. There every gene, compound, gene path becomes an edge with signal
    '0' over an existing one; then nodes are split at '-' (entries of several genes, and symbols with a hyphen), each part
    getting all edges, and self loops go. The pathways are put together, the last one's signal counting; nodes that stand for
    pathways go. At last compounds are bypassed over all pathways, between genes that are an entry of their own, and removed;
    a bypass replaces a direct edge and has the pathways of both hops.
    """
    edges = checkpointed(files.kgml_edges(tables, names, ordered=True, joined=True))
    typed = checkpointed(files.kgml_nodes(tables, names, joined=True).select("pathway", "node", "type").distinct())
    x = tables["reactions"]
    made = x.select("pathway", F.explode("substrates").alias("node")).union(x.select("pathway", F.explode("products")))
    genes = typed.where("type = 'gene'").select("pathway", "node").distinct()
    compounds = typed.where("type = 'compound'").select("pathway", "node").union(made).distinct().join(genes, ["pathway", "node"], "left_anti")

    def within(end: str, nodes: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(nodes.select("pathway", F.col("node").alias(end)), ["pathway", end], "left_semi")

    into = within("dst", compounds, within("src", genes, edges)).select("pathway", F.col("src").alias("a"), F.col("dst").alias("via")).distinct()
    out = within("src", compounds, within("dst", genes, edges)).select("pathway", F.col("src").alias("via"), F.col("dst").alias("b")).distinct()
    place = F.struct("pathway", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"))
    local = into.join(out, ["pathway", "via"]).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("0").alias("signal"), "pathway", place.alias("ord")).distinct()
    rows = edges.select("src", "dst", "signal", "pathway", "ord").unionByName(local)
    # the edges of split nodes are put over those that were there before
    complex_ = (F.col("src").contains("-") | F.col("dst").contains("-")).alias("split")
    rows = rows.withColumn("ord", F.struct("pathway", complex_, F.col("ord.kind").alias("kind"), F.col("ord.n").alias("n")))
    rows = checkpointed(graph.split_complexes(rows))
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    rows = graph.without_pathway_nodes(nodes, rows, "node", "src", "dst", PATHWAY_NODES)[1]
    one = genes.where("NOT contains(node, '-')").select("node").distinct()
    gone = checkpointed(compounds.select("node").union(nodes.where("rlike(node, '^CPD:C[0-9]{5}$')")).distinct().join(one, "node", "left_anti"))
    both = one.union(gone)
    hop = lambda a, b: rows.join(gone, F.col(a) == F.col("node"), "left_semi").join(both, F.col(b) == F.col("node"), "left_semi")
    plain = rows.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
    kept = checkpointed(plain.unionByName(hop("src", "dst")).unionByName(hop("dst", "src")))
    signals = graph.last_writer_wins(plain, ["src", "dst"], "ord", ["signal"])
    whole = graph.collapse_compounds(kept, gone).join(signals, ["src", "dst"], "left")
    signal = F.when(F.col("via").isNotNull(), "0").otherwise(F.col("signal"))
    return whole.select("src", "dst", signal.alias("signal"), F.explode(F.split("pathways", ",")).alias("pathway"), F.lit(0).alias("ord"))


def build_networks(spark: SparkSession, code: str, regulation: str, links: str, info: str, pathways: str, out: str, min_score: int | None = None, case: str = "upper", genes: str | None = None, orthologs: str | None = None) -> dict[str, DataFrame]:
    """All three edge lists of an organism, written as CSV under ``out`` with their source named; existing ones are kept.

    ``genes`` (the organism's gene list) and ``orthologs`` (the flat hierarchy) are the dictionaries of the pathways' codes.
    """
    networks.organism(code)
    dicts = [read(spark, path) for read, path in ((files.organism_genes, genes), (files.flat_hierarchy, orthologs)) if path is not None]
    names = reduce(DataFrame.unionByName, dicts) if dicts else None
    made = {
        "trrust": lambda: networks.regulation_edges(files.regulation_tsv(spark, regulation), case),
        "string": lambda: networks.association_edges(files.protein_links(spark, links), files.protein_info(spark, info), min_score, case),
        "kegg": lambda: networks.pathway_edges(pathway_network(files.kgml(spark, pathways), names), case),
    }
    result = {}
    for name, build in made.items():
        path = f"{out}/{name}"
        if not files.present(spark, path):
            sinks.csv(build().withColumn("source_db", F.lit(name)), path)
        result[name] = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return result
