"""Queries over peaks, count matrices, classifier scores and samples, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import factors, genomic, graph, matrix, metrics, pipelines, sampling
from ..session import checkpointed
from ..sources.tables import table
from .views import sql, view


def _peaks(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "peaks").select("chrom", F.col("pstart").alias("start"), F.col("pend").alias("end"))
    return p.withColumn("peak_id", scalars.peak_name(F.col("chrom"), F.col("start"), F.col("end")))


def _tss(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "tss")


def _out(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "peak_start", "end": "peak_end"})


def peak_parse(s: SparkSession, d: str) -> DataFrame:
    return _out(scalars.parse_peaks(_peaks(s, d).select("peak_id"), "peak_id"))


def peak_normalise(s: SparkSession, d: str) -> DataFrame:
    p = _peaks(s, d).select(F.concat_ws("-", "chrom", F.lpad(F.col("start").cast("string"), 9, "0"), F.col("end").cast("string")).alias("raw"))
    return p.select("raw", scalars.normalise_peak(F.col("raw")).alias("peak"))


def promoter_peaks(s: SparkSession, d: str) -> DataFrame:
    return genomic.promoters(_peaks(s, d), _tss(s, d)).select("peak_id", "gene", "tss", "distance")


def nearest_tss(s: SparkSession, d: str) -> DataFrame:
    return genomic.nearest(_peaks(s, d), _tss(s, d)).select("peak_id", "gene", "tss", F.col("absd").alias("distance"))


def peak_annotation(s: SparkSession, d: str) -> DataFrame:
    return _out(genomic.annotate_peaks(_peaks(s, d), _tss(s, d), distal_max=50_000))


def intergenic_peaks(s: SparkSession, d: str) -> DataFrame:
    return genomic.intergenic(_peaks(s, d), _tss(s, d), distal_max=50_000).select("peak_id")


def tss_clean(s: SparkSession, d: str) -> DataFrame:
    return _out(genomic.clean_tss(view(s, d, "tss_raw").withColumnRenamed("pos", "start")))


def _fragments(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "chip_peaks").where("source_id IS NOT NULL AND peak_chr IS NOT NULL AND peak_start < peak_end")
    return p.select(F.col("peak_chr").alias("chrom"), F.col("peak_start").alias("start"), F.col("peak_end").alias("end"), F.col("source_id").alias("barcode"))


def nucleosome_signal(s: SparkSession, d: str) -> DataFrame:
    return genomic.nucleosome_signal(_fragments(s, d)).select("barcode", "mono", "free", F.round("signal", 6).alias("signal"))


def first_fragment_window(s: SparkSession, d: str) -> DataFrame:
    return genomic.first_window(_fragments(s, d))


def tss_enrichment(s: SparkSession, d: str) -> DataFrame:
    p = _peaks(s, d).withColumn("group", F.col("start") % 3)
    return genomic.tss_profile(p, _tss(s, d), "group").select(F.col("group").alias("barcode_group"), F.col("offset").alias("offset_bp"), "n", F.round("enrichment", 6).alias("enrichment"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "counts")


def _mt():
    return F.substring("feature", 2, 9).cast("int") % 20 == 0


def cell_qc(s: SparkSession, d: str) -> DataFrame:
    return matrix.cell_qc(_counts(s, d), _mt()).select("cell", "n_features", "total", F.round("pct_mt", 6).alias("pct_mt"))


def gene_qc(s: SparkSession, d: str) -> DataFrame:
    return matrix.feature_qc(_counts(s, d))


def _filtered(s: SparkSession, d: str) -> DataFrame:
    return matrix.qc_filter(_counts(s, d), 20, (10, 60), (200, 2000), 8.0, _mt())


def qc_filtered(s: SparkSession, d: str) -> DataFrame:
    return _filtered(s, d).select("cell", "feature", "value")


def lib_normalise(s: SparkSession, d: str) -> DataFrame:
    return matrix.normalise_total(_counts(s, d)).select("cell", "feature", F.round("norm", 5).alias("norm"), F.round("log1p", 6).alias("log1p"))


def tfidf(s: SparkSession, d: str) -> DataFrame:
    return matrix.tfidf(_counts(s, d)).select("cell", "feature", F.round("tfidf", 6).alias("tfidf"))


def hvg(s: SparkSession, d: str) -> DataFrame:
    r = matrix.variable_features(matrix.normalise_total(_counts(s, d)))
    return r.select("feature", *[F.round(c, 5).alias(c) for c in ("mean_log", "dispersion", "z")], "variable")


def feature_guard(s: SparkSession, d: str) -> DataFrame:
    return matrix.feature_guard(_counts(s, d)).select("feature", "nnz", F.round("variance", 6).alias("variance"))


def symbol_collapse(s: SparkSession, d: str, how: str = "sum") -> DataFrame:
    return matrix.collapse_symbols(view(s, d, "versioned"), how).select("symbol", "cell", F.round(F.col("value").cast("double"), 6).alias("value"))


def row_normalise(s: SparkSession, d: str) -> DataFrame:
    return matrix.row_normalise(view(s, d, "sim_edges")).select("i", "j", F.round("w", 8).alias("w"))


def diffuse_hop1(s: SparkSession, d: str) -> DataFrame:
    return matrix.diffusion_weights(view(s, d, "sim_edges"), 1).select("i", "j", F.round("w", 8).alias("w"))


def metacell_hop2(s: SparkSession, d: str) -> DataFrame:
    w = matrix.diffusion_weights(view(s, d, "sim_edges"), 2)
    x = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    return matrix.smooth(w, x).select("cell", "feature", F.round("value", 5).alias("value"))


def intersect_cells(s: SparkSession, d: str) -> DataFrame:
    a, b = matrix.intersect_cells(_counts(s, d), view(s, d, "counts2"))
    return a.select(F.lit("rna").alias("modality"), "cell", "feature", "value").unionByName(b.select(F.lit("atac").alias("modality"), "cell", "feature", "value"))


def scaled_counts(s: SparkSession, d: str) -> DataFrame:
    return matrix.scale(_counts(s, d)).select("cell", "feature", F.round("scaled", 6).alias("scaled"))


def pca_embed(s: SparkSession, d: str) -> DataFrame:
    return factors.pca(factors.dense_rows(table(s, d, "embeddings"), "vec_id", "embedding"), "vec_id", 64, 5)


def lsi_embed(s: SparkSession, d: str) -> DataFrame:
    return factors.lsi(factors.dense_rows(table(s, d, "embeddings"), "vec_id", "embedding"), "vec_id", 64, 6)


def knn_exact(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return graph.nearest_neighbours(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


def cluster(s: SparkSession, d: str) -> DataFrame:
    """Communities of the nearest-neighbour graph of all embeddings."""
    e = table(s, d, "embeddings")
    knn = checkpointed(graph.neighbour_graph(e, "vec_id", "embedding", 15))
    return graph.communities(knn.select(F.col("query_id").alias("i"), F.col("neighbour_id").alias("j"), (1.0 / F.col("rank_no")).alias("w")))


def rank_features(s: SparkSession, d: str) -> DataFrame:
    n = matrix.normalise_total(_counts(s, d))
    clusters = n.select("cell").distinct().select("cell", (F.substring("cell", 2, 9).cast("int") % 4).alias("cluster"))
    r = matrix.rank_features(n.select("cell", "feature", F.col("log1p").alias("value")), clusters)
    return r.select("cluster", "feature", *[F.round(c, 6).alias(c) for c in ("t", "p", "p_adj")])


def rna_pipeline(s: SparkSession, d: str) -> DataFrame:
    r = pipelines.rna_qc(_counts(s, d), _mt(), 20, (10, 60), (200, 2000), 8.0)
    return r.select("cell", "feature", F.round("norm", 5).alias("norm"), F.round("log1p", 6).alias("log1p"), "variable")


def joint_clusters(s: SparkSession, d: str) -> DataFrame:
    return pipelines.integrate(_counts(s, d), view(s, d, "counts2"), 5, 10)[1]


def _scored(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "scored")


def confusion_metrics(s: SparkSession, d: str) -> DataFrame:
    r = metrics.confusion(_scored(s, d))
    return r.select("tp", "fp", "fn", "tn", "n_pos", "n_neg", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def auroc(s: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(_scored(s, d)).select(F.round("auroc", 8).alias("auroc"))


def avg_precision(s: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(s, d)).select(F.round("average_precision", 8).alias("average_precision"))


def early_precision(s: SparkSession, d: str) -> DataFrame:
    return metrics.early_precision(view(s, d, "scored_big"), "id").select(F.round("early_precision", 8).alias("early_precision"))


def roc_points(s: SparkSession, d: str) -> DataFrame:
    return metrics.roc_points(_scored(s, d)).select(F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"), "score")


def pr_points(s: SparkSession, d: str) -> DataFrame:
    return metrics.pr_points(_scored(s, d)).select(F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"), "score")


def score_histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_scored(s, d)).select("label", "bin", "n")


def kde(s: SparkSession, d: str) -> DataFrame:
    return metrics.kde(_scored(s, d)).select("label", F.round("x", 8).alias("x"), F.round("density", 6).alias("density"))


def random_scores(s: SparkSession, d: str) -> DataFrame:
    return metrics.random_baseline(_scored(s, d))


def class_balance(s: SparkSession, d: str) -> DataFrame:
    return sampling.balance_classes(_scored(s, d), "label", "id")


def subsample_70(s: SparkSession, d: str) -> DataFrame:
    return sampling.exact_fraction(table(s, d, "customer"), "c_custkey", 0.7, 1).select("c_custkey")


def group_profile(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type", F.hour("ts").cast("long").alias("hour_of_day")).agg(F.round(F.avg("value"), 6).alias("mean_value"))


QUERIES = {f.__name__: f for f in (
    peak_parse, peak_normalise, promoter_peaks, nearest_tss, peak_annotation, intergenic_peaks, tss_clean, nucleosome_signal, first_fragment_window, tss_enrichment, cell_qc, gene_qc, qc_filtered,
    lib_normalise, tfidf, hvg, feature_guard, row_normalise, diffuse_hop1, metacell_hop2, intersect_cells, scaled_counts, pca_embed, lsi_embed, knn_exact, cluster, rank_features, confusion_metrics,
    rna_pipeline, joint_clusters, auroc, avg_precision, early_precision, roc_points, pr_points, score_histogram, kde, random_scores, class_balance, subsample_70, group_profile,
)}
_WAYS = {"sum": "sum(value)", "mean": "avg(value)", "max": "max(value)", "min": "min(value)", "median": "median(value)", "first": "arg_min(value, feature)"}
for _how in _WAYS:
    QUERIES[f"symbol_collapse_{_how}"] = partial(symbol_collapse, how=_how)

_PID = "p.chrom || ':' || p.pstart || '-' || p.pend"
_DIST = "CASE WHEN pstart > tss THEN pstart - tss WHEN pend < tss THEN pend - tss ELSE 0 END"
_NEAR = f"""cand AS (SELECT {_PID} AS peak_id, p.chrom, pstart, pend, gene, tss, ord, {_DIST} AS d FROM @peaks p JOIN @tss t ON p.chrom = t.chrom),
prom AS (SELECT * FROM cand WHERE pend >= tss - 1000 AND pstart <= tss + 100),
near AS (SELECT peak_id, arg_min(struct_pack(chrom := chrom, pstart := pstart, pend := pend, gene := gene, tss := tss, d := d), struct_pack(a := abs(d), o := ord)) AS n FROM cand GROUP BY 1)"""
_SCORES = """g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM @scored GROUP BY 1),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g), t AS (SELECT sum(p) AS pp, sum(n) AS nn FROM g)"""
_VAR = "(sum(v * v) - n * (sum(v) / n) * (sum(v) / n)) / (n - 1)"
ORACLES = {
    "peak_parse": sql(f"SELECT {_PID} AS peak_id, chrom, pstart AS peak_start, pend AS peak_end FROM @peaks p"),
    "peak_normalise": sql(f"SELECT chrom || '-' || lpad(CAST(pstart AS VARCHAR), 9, '0') || '-' || pend AS raw, {_PID} AS peak FROM @peaks p"),
    "promoter_peaks": sql(f"WITH {_NEAR} SELECT peak_id, gene, tss, CAST(d AS DOUBLE) AS distance FROM prom"),
    "nearest_tss": sql(f"WITH {_NEAR} SELECT peak_id, n.gene AS gene, n.tss AS tss, abs(n.d) AS distance FROM near"),
    "peak_annotation": sql(f"""WITH {_NEAR} SELECT chrom, pstart AS peak_start, pend AS peak_end, gene, CAST(d AS DOUBLE) AS distance, 'promoter' AS peak_type FROM prom
 UNION ALL SELECT n.chrom, n.pstart, n.pend, n.gene, CAST(n.d AS DOUBLE), 'distal' FROM near WHERE abs(n.d) <= 50000 AND NOT EXISTS (SELECT 1 FROM prom q WHERE q.peak_id = near.peak_id AND q.gene = near.n.gene)"""),
    "intergenic_peaks": sql(f"WITH {_NEAR} SELECT {_PID} AS peak_id FROM @peaks p WHERE {_PID} NOT IN (SELECT peak_id FROM prom UNION SELECT peak_id FROM near WHERE abs(n.d) <= 50000)"),
    "tss_clean": sql("SELECT DISTINCT 'chr' || chrom AS chrom, pos AS peak_start, pos + 1 AS peak_end, name FROM @tss_raw WHERE regexp_full_match(chrom, '[0-9]+|X|Y')"),
    "nucleosome_signal": """SELECT source_id AS barcode, mono, free, round(mono / nullif(free, 0), 6) AS signal FROM (SELECT source_id, count(*) FILTER (peak_end - peak_start BETWEEN 147 AND 293) AS mono,
 count(*) FILTER (peak_end - peak_start < 147) AS free FROM chip_peaks WHERE source_id IS NOT NULL AND peak_chr IS NOT NULL AND peak_start < peak_end GROUP BY 1)""",
    "first_fragment_window": "SELECT CAST(min(peak_start // 1000000) AS BIGINT) AS \"window\" FROM chip_peaks WHERE source_id IS NOT NULL AND peak_chr = 'chr1' AND peak_start < peak_end",
    "tss_enrichment": sql("""WITH c AS (SELECT pstart % 3 AS barcode_group, CAST(floor((floor((pstart + pend) / 2) - tss) / 100.0) * 100 AS BIGINT) AS offset_bp FROM @peaks p JOIN @tss t ON p.chrom = t.chrom AND tss BETWEEN pstart - 1000 AND pend + 1000),
 k AS (SELECT barcode_group, offset_bp, count(*) AS n FROM c WHERE abs(offset_bp) <= 1000 GROUP BY 1, 2), o AS (SELECT barcode_group, avg(n) AS b FROM k WHERE abs(offset_bp) >= 900 GROUP BY 1)
SELECT k.barcode_group, offset_bp, n, round(n / b, 6) AS enrichment FROM k LEFT JOIN o ON k.barcode_group = o.barcode_group"""),
    "cell_qc": sql("SELECT cell, count(*) FILTER (value > 0) AS n_features, CAST(sum(value) AS BIGINT) AS total, round(sum(CASE WHEN CAST(substr(feature, 2) AS INT) % 20 = 0 THEN value ELSE 0 END) * 100.0 / sum(value), 6) AS pct_mt FROM @counts GROUP BY 1"),
    "gene_qc": sql("SELECT feature, count(*) FILTER (value > 0) AS n_cells, CAST(sum(value) AS BIGINT) AS total FROM @counts GROUP BY 1"),
    "qc_filtered": sql("""WITH q AS (SELECT cell FROM @counts GROUP BY 1 HAVING count(*) FILTER (value > 0) BETWEEN 10 AND 60 AND sum(value) BETWEEN 200 AND 2000
 AND sum(CASE WHEN CAST(substr(feature, 2) AS INT) % 20 = 0 THEN value ELSE 0 END) * 100.0 / sum(value) <= 8), f AS (SELECT feature FROM @counts GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 20)
SELECT cell, feature, CAST(value AS BIGINT) AS value FROM @counts WHERE cell IN (SELECT cell FROM q) AND feature IN (SELECT feature FROM f)"""),
    "rna_pipeline": sql(f"""WITH q AS (SELECT cell FROM @counts GROUP BY 1 HAVING count(*) FILTER (value > 0) BETWEEN 10 AND 60 AND sum(value) BETWEEN 200 AND 2000
 AND sum(CASE WHEN CAST(substr(feature, 2) AS INT) % 20 = 0 THEN value ELSE 0 END) * 100.0 / sum(value) <= 8), f AS (SELECT feature FROM @counts GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 20),
 k AS (SELECT cell, feature, value FROM @counts WHERE cell IN (SELECT cell FROM q) AND feature IN (SELECT feature FROM f)),
 x AS (SELECT cell, feature, value * 10000.0 / CAST(sum(value) OVER (PARTITION BY cell) AS DOUBLE) AS v, (SELECT count(DISTINCT cell) FROM k) AS n FROM k),
 m AS (SELECT feature, sum(v) / n AS mean, {_VAR} AS var FROM x GROUP BY feature, n), l AS (SELECT feature, ln(1 + mean) AS mean_log, CASE WHEN mean > 0 AND var > 0 THEN ln(var / mean) END AS dispersion FROM m),
 r AS (SELECT *, CASE WHEN max(mean_log) OVER () = min(mean_log) OVER () THEN 0 ELSE least(floor((mean_log - min(mean_log) OVER ()) * 20 / (max(mean_log) OVER () - min(mean_log) OVER ())), 19) END AS bin FROM l),
 z AS (SELECT *, CASE WHEN stddev_samp(dispersion) OVER (PARTITION BY bin) IS NULL AND dispersion IS NOT NULL THEN 1.0 ELSE (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0) END AS z FROM r)
SELECT cell, x.feature, round(v, 5) AS norm, round(ln(1 + v), 6) AS log1p, coalesce(mean_log > 0.02 AND mean_log < 4 AND z > 0.5, false) AS variable FROM x JOIN z ON x.feature = z.feature"""),
    "rank_features": sql("""WITH x AS (SELECT cell, feature, CAST(substr(cell, 2) AS INT) % 4 AS cluster, ln(1 + value * 10000.0 / CAST(sum(value) OVER (PARTITION BY cell) AS DOUBLE)) AS v FROM @counts),
 s AS (SELECT cluster, count(DISTINCT cell) AS n1, (SELECT count(DISTINCT cell) FROM x) AS n FROM x GROUP BY 1), t AS (SELECT feature, sum(v) AS t1, sum(v * v) AS t2 FROM x GROUP BY 1), a AS (SELECT cluster, feature, sum(v) AS a1, sum(v * v) AS a2 FROM x GROUP BY 1, 2),
 m AS (SELECT s.cluster, t.feature, n1, n - n1 AS n2, coalesce(a1, 0) / n1 AS m1, (t1 - coalesce(a1, 0)) / (n - n1) AS m2, coalesce(a2, 0) AS a2, t2 - coalesce(a2, 0) AS r2 FROM s CROSS JOIN t LEFT JOIN a ON a.cluster = s.cluster AND a.feature = t.feature),
 w AS (SELECT *, (m1 - m2) / sqrt(((a2 - n1 * m1 * m1) / (n1 - 1) + (r2 - n2 * m2 * m2) / (n2 - 1)) / n1) AS t, 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) AS k FROM m),
 p AS (SELECT cluster, feature, t, least(k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-t * t / 2), 1) AS p FROM w),
 o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, feature) AS rank, count(*) OVER (PARTITION BY cluster) AS m FROM p)
SELECT cluster, feature, round(t, 6) AS t, round(p, 6) AS p, round(least(min(p * m / rank) OVER (PARTITION BY cluster ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adj FROM o"""),
    "lib_normalise": sql("SELECT cell, feature, round(value * 10000.0 / t, 5) AS norm, round(ln(1 + value * 10000.0 / t), 6) AS log1p FROM (SELECT *, CAST(sum(value) OVER (PARTITION BY cell) AS DOUBLE) AS t FROM @counts)"),
    "tfidf": sql("SELECT cell, feature, round(ln(1 + value * 10000.0 / c) * ln(1 + n / f), 6) AS tfidf FROM (SELECT *, CAST(sum(value) OVER (PARTITION BY cell) AS DOUBLE) AS c, CAST(sum(value) OVER (PARTITION BY feature) AS DOUBLE) AS f, (SELECT count(DISTINCT cell) FROM @counts) AS n FROM @counts)"),
    "hvg": sql(f"""WITH x AS (SELECT feature, value * 10000.0 / CAST(sum(value) OVER (PARTITION BY cell) AS DOUBLE) AS v, (SELECT count(DISTINCT cell) FROM @counts) AS n FROM @counts),
 m AS (SELECT feature, sum(v) / n AS mean, {_VAR} AS var FROM x GROUP BY feature, n), l AS (SELECT feature, ln(1 + mean) AS mean_log, CASE WHEN mean > 0 AND var > 0 THEN ln(var / mean) END AS dispersion FROM m),
 r AS (SELECT *, CASE WHEN max(mean_log) OVER () = min(mean_log) OVER () THEN 0 ELSE least(floor((mean_log - min(mean_log) OVER ()) * 20 / (max(mean_log) OVER () - min(mean_log) OVER ())), 19) END AS bin FROM l),
 z AS (SELECT *, CASE WHEN stddev_samp(dispersion) OVER (PARTITION BY bin) IS NULL AND dispersion IS NOT NULL THEN 1.0 ELSE (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0) END AS z FROM r)
SELECT feature, round(mean_log, 5) AS mean_log, round(dispersion, 5) AS dispersion, round(z, 5) AS z, coalesce(mean_log > 0.02 AND mean_log < 4 AND z > 0.5, false) AS variable FROM z"""),
    "feature_guard": sql("SELECT * FROM (SELECT feature, count(*) FILTER (value <> 0) AS nnz, round(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 6) AS variance FROM (SELECT feature, CAST(value AS DOUBLE) AS value, (SELECT count(DISTINCT cell) FROM @counts) AS n FROM @counts) GROUP BY feature, n) WHERE nnz > 0 AND variance > 0"),
    "row_normalise": sql("SELECT i, j, round(w / CAST(sum(w) OVER (PARTITION BY i) AS DOUBLE), 8) AS w FROM @sim_edges"),
    "diffuse_hop1": sql("""WITH n AS (SELECT i AS x FROM @sim_edges UNION SELECT j FROM @sim_edges), e AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, CAST(w AS DOUBLE) AS w FROM @sim_edges UNION ALL SELECT x, x, 1.0 FROM n) GROUP BY 1, 2)
SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 8) AS w FROM e"""),
    "metacell_hop2": sql("""WITH n AS (SELECT i AS x FROM @sim_edges UNION SELECT j FROM @sim_edges), e AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, CAST(w AS DOUBLE) AS w FROM @sim_edges UNION ALL SELECT x, x, 1.0 FROM n) GROUP BY 1, 2),
 b AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM e), h AS (SELECT a.i, c.j, sum(a.w * c.w) AS w FROM b a JOIN b c ON a.j = c.i GROUP BY 1, 2), m AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM h),
 x AS (SELECT c_nationkey AS cell, c_mktsegment AS feature, count(*) AS value FROM customer GROUP BY 1, 2)
SELECT i AS cell, feature, round(sum(w * value), 5) AS value FROM m JOIN x ON m.j = x.cell GROUP BY 1, 2"""),
    "intersect_cells": sql("""WITH k AS (SELECT cell FROM @counts INTERSECT SELECT cell FROM @counts2) SELECT 'rna' AS modality, cell, feature, CAST(value AS BIGINT) AS value FROM @counts WHERE cell IN (SELECT cell FROM k)
 UNION ALL SELECT 'atac', cell, feature, CAST(value AS BIGINT) FROM @counts2 WHERE cell IN (SELECT cell FROM k)"""),
    "scaled_counts": sql(f"""WITH x AS (SELECT feature, CAST(value AS DOUBLE) AS v, (SELECT count(DISTINCT cell) FROM @counts) AS n FROM @counts), m AS (SELECT feature, sum(v) / n AS mean, {_VAR} AS var FROM x GROUP BY feature, n)
SELECT cell, c.feature, round((value - mean) / CASE WHEN coalesce(var, 0) <= 0 THEN 1 ELSE sqrt(var) END, 6) AS scaled FROM @counts c JOIN m ON c.feature = m.feature"""),
    "knn_exact": """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))), 6) AS d
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT query_id, neighbour_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS INTEGER) AS rank_no FROM d)
SELECT * FROM r WHERE rank_no <= 10""",
    "confusion_metrics": sql("""WITH c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM @scored)
SELECT tp, fp, fn, tn, tp + fn AS n_pos, fp + tn AS n_neg, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c"""),
    "auroc": sql("""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM @scored)
SELECT round(CAST((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS DOUBLE), 8) AS auroc FROM r"""),
    "avg_precision": sql(f"WITH {_SCORES} SELECT round(sum(p * tp / (tp + fp)) / max(pp), 8) AS average_precision FROM c, t"),
    "early_precision": sql("SELECT round(coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5), 0), 0), 8) AS early_precision FROM (SELECT * FROM @scored_big ORDER BY score DESC, id LIMIT 10000)"),
    "roc_points": sql(f"WITH {_SCORES} SELECT round(fp / nn, 8) AS fpr, round(tp / pp, 8) AS tpr, score FROM c, t UNION ALL SELECT 0.0, 0.0, NULL"),
    "pr_points": sql(f"WITH {_SCORES} SELECT round(tp / pp, 8) AS recall, round(tp / (tp + fp), 8) AS precision, score FROM c, t UNION ALL SELECT 0.0, 1.0, NULL"),
    "score_histogram": sql("""WITH r AS (SELECT min(score) AS lo, max(score) AS hi FROM @scored)
SELECT label, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((score - lo) * 74 / (hi - lo)) + 1, 74) END AS INTEGER) AS bin, count(*) AS n FROM @scored, r GROUP BY 1, 2"""),
    "class_balance": sql("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS r FROM @scored), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM @scored GROUP BY label))
SELECT id, label, score FROM t, m WHERE r <= n"""),
    "subsample_70": "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('1:' || c_custkey)) AS r FROM customer) WHERE r <= round((SELECT count(*) FROM customer) * 0.7)",
    "group_profile": "SELECT event_type, hour(ts) AS hour_of_day, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "kde": sql("""WITH g AS (SELECT label, score, count(*) AS w FROM @scored GROUP BY 1, 2), s AS (SELECT label, count(*) AS m, stddev_samp(score) * pow(count(*), -0.2) AS h FROM @scored GROUP BY 1),
 r AS (SELECT min(score) AS lo, max(score) AS hi FROM @scored), x AS (SELECT lo + i * (hi - lo) / 49 AS x FROM r, range(50) k(i))
SELECT g.label, round(x, 8) AS x, round(sum(w * exp(-((x - score) / h) * ((x - score) / h) / 2) / h) / max(m) / sqrt(2 * pi()), 6) AS density FROM g JOIN s ON g.label = s.label, x GROUP BY g.label, x.x"""),
    **{f"symbol_collapse_{h}": sql(f"SELECT upper(regexp_replace(trim(feature), '\\.[0-9]+$', '')) AS symbol, cell, round(CAST({e} AS DOUBLE), 6) AS value FROM @versioned GROUP BY 1, 2") for h, e in _WAYS.items()},
}
