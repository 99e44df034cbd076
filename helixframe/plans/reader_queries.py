"""Queries that write driver tables in the domain's file formats and read them back with the readers, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, symbols
from ..operators import factors, genomic, identifiers, matrix, metrics, networks, pipelines, sampling
from ..session import checkpointed, shared_folder
from ..sources import files, sinks
from ..sources.tables import table
from . import network_queries
from .views import sql, view

TAXON = "910090"


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def string_from_files(s: SparkSession, d: str) -> DataFrame:
    """Links and names through gzip text."""
    at = _folder(s)
    view(s, d, "links_raw").write.option("sep", " ").option("header", True).option("compression", "gzip").csv(f"{at}/links")
    view(s, d, "names").withColumnRenamed("id", "#string_protein_id").write.option("sep", "\t").option("header", True).csv(f"{at}/info")
    return networks.association_edges(files.protein_links(s, f"{at}/links"), files.protein_info(s, f"{at}/info"), 800)


def regulation_from_tsv(s: SparkSession, d: str) -> DataFrame:
    """Pairs with repeated terms and ids through a headerless TSV, rolled up."""
    at = _folder(s)
    term = F.element_at(F.array(*map(F.lit, ("Activation", "Repression", "Unknown", "activation"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    pairs = table(s, d, "part").select(F.lower("p_brand").alias("TF"), "p_type", term.alias("Regulation"), F.concat_ws(", ", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("PMIDs"))
    sinks.csv(pairs, at, "\t", False)
    return networks.regulation_edges(files.regulation_tsv(s, at), "upper")


def codes_from_text(s: SparkSession, d: str) -> DataFrame:
    """The four kinds of code lists: flat hierarchy, two columns, organism genes, pathways; and the list of TFs."""
    at, p = _folder(s), table(s, d, "part").select(F.format_string("K%05d", "p_partkey").alias("code"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    p.select(F.explode(F.array(F.concat(F.lit("D      "), "code", F.lit("  "), "name", F.lit(", ALT; text")), F.lit("C    00010 group"))).alias("v")).write.text(f"{at}/flat")
    p.select("code", "name").write.option("sep", "\t").csv(f"{at}/two")
    p.select(F.concat_ws("\t", F.concat(F.lit("mmu:"), "code"), F.lit("CDS"), F.lit("1"), F.concat("name", F.lit(", ALT; text"))).alias("v")).write.text(f"{at}/organism")
    p.select(F.concat_ws("\t", F.concat(F.lit("path:"), "code"), "name").alias("v")).write.text(f"{at}/pathways")
    table(s, d, "nation").select(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("source_id")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/tfs")
    parts = {"flat": files.flat_hierarchy(s, f"{at}/flat"), "two": files.code_names(s, f"{at}/two"), "organism": files.organism_genes(s, f"{at}/organism"), "pathways": files.pathway_list(s, f"{at}/pathways").withColumn("name", F.lit(None).cast("string")), "tfs": files.tf_list(s, f"{at}/tfs").select(F.col("source_id").alias("code"), F.lit(None).cast("string").alias("name"))}
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("kind"), "code", "name") for k, x in parts.items()])


def species_peaks(s: SparkSession, d: str) -> DataFrame:
    """Peaks of a mixed experiment, those of one species kept and named without it."""
    name = F.concat_ws(".", F.when(F.col("pstart") % 3 == 0, "mm10").otherwise("hg38"), scalars.peak_name(F.col("chrom"), F.col("pstart"), F.col("pend")))
    p = view(s, d, "peaks").select(name.alias("feature"), name.alias("interval"))
    return pipelines.one_species(p).select("feature", "interval")


def saved_tables(s: SparkSession, d: str) -> DataFrame:
    """Both modalities saved and read again."""
    at = _folder(s)
    paths = pipelines.save_processed(view(s, d, "versioned").withColumnRenamed("value", "counts"), view(s, d, "counts2"), at)
    return reduce(DataFrame.unionByName, [s.read.parquet(p).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total")).withColumn("modality", F.lit(k)) for k, p in paths.items()])


def peaks_from_bed(s: SparkSession, d: str) -> DataFrame:
    at = _folder(s)
    sinks.bed(view(s, d, "peaks"), at)
    return files.bed(s, at)


def sites_from_bed(s: SparkSession, d: str) -> DataFrame:
    at = _folder(s)
    sinks.bed(view(s, d, "tss").select("chrom", "tss", F.col("tss") + 1, "gene"), at)
    return files.tss_bed(s, at).select("chrom", "tss", "gene")


def counts_from_mtx(s: SparkSession, d: str) -> DataFrame:
    """The count table as a Matrix Market triple and back."""
    at, c = _folder(s), checkpointed(view(s, d, "counts"))
    one = F.lit(1).alias("_one")
    names = {k: checkpointed(factors.running_sums(c.select(k).distinct().select(k, one), k, ["_one"], ["no"]).select(k, "no")) for k in ("feature", "cell")}
    for k, n in names.items():
        n.orderBy("no").select(k).write.text(f"{at}/{k}")
    e = c.join(names["feature"].withColumnRenamed("no", "r"), "feature").join(names["cell"].withColumnRenamed("no", "c"), "cell")
    head = s.range(1).select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate real general"), F.lit(f"{names['feature'].count()} {names['cell'].count()} {c.count()}"))).alias("value")).coalesce(1)
    head.withColumn("file", F.lit(0)).unionByName(e.select(F.concat_ws(" ", "r", "c", "value").alias("value"), F.lit(1).alias("file"))).write.partitionBy("file").text(f"{at}/matrix")
    return files.mtx(s, f"{at}/matrix", f"{at}/cell", f"{at}/feature").select("feature", "cell", F.col("value").cast("long").alias("value"))


def counts_from_csv(s: SparkSession, d: str) -> DataFrame:
    """Market segments by nations as a wide matrix with header and back."""
    at = _folder(s)
    c = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("feature"), F.concat(F.lit("n"), "c_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("value"))
    matrix.pivot_wide(c, [f"n{i}" for i in range(25)]).write.option("header", True).csv(at)
    return files.count_matrix(s, at).select("feature", "cell", F.col("value").cast("long").alias("value"))


def _gene_text(s: SparkSession, d: str) -> str:
    at = _folder(s)
    g = table(s, d, "gene_info")
    cols = ["tax_id", "gene_id", "symbol", "locus", "synonyms", "dbxrefs"]
    lines = g.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("-")) for c in cols]).alias("value"))
    lines.unionByName(s.range(1).select(F.lit("#tax_id GeneID Symbol").alias("value"))).write.text(at)
    return at


def genes_from_text(s: SparkSession, d: str) -> DataFrame:
    return files.gene_info(s, _gene_text(s, d), TAXON).drop("ord").distinct()


def canonical_table(s: SparkSession, d: str) -> DataFrame:
    """Links standardised by a canonicaliser made of an annotation and a gene table, both read from text."""
    at = _folder(s)
    g = table(s, d, "gene_info").where((F.col("tax_id") == TAXON) & F.col("symbol").isNotNull())
    attributes = F.concat(F.lit('gene_id "GX'), "gene_id", F.lit('.3"; gene_name "'), "symbol", F.lit('";'))
    line = lambda kind: F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.lit(kind), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    g.select(F.explode(F.array(F.lit("# comment"), line("gene"), line("transcript"), F.lit("too short"))).alias("value")).write.text(at)
    names = identifiers.Canonicaliser(files.gtf_genes(s, at), files.gene_info(s, _gene_text(s, d), TAXON))
    e = table(s, d, "string_pkn").select("TF", "TG").where("TF IS NOT NULL")
    return names.table(e)[0].groupBy("TF", "TG").agg(F.count(F.lit(1)).alias("n"))


def graph_round_trip(s: SparkSession, d: str) -> DataFrame:
    at, e = _folder(s), view(s, d, "graph_edges")
    sinks.graphml_graph(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.substring("id", 1, 1)), e.withColumn("weight", F.lit(None).cast("int")), at)
    nodes, edges = files.graphml_graph(s, at)
    kinds = nodes.select("id", F.col("attributes")["kind"].alias("kind"))
    return edges.select("src", "dst", F.col("attributes")["pathway"].alias("pathway"), F.col("attributes")["weight"].alias("weight")).join(kinds.withColumnsRenamed({"id": "src", "kind": "src_kind"}), "src")


def partitioned_round_trip(s: SparkSession, d: str) -> DataFrame:
    at = _folder(s)
    sinks.parquet_by(table(s, d, "customer").select("c_custkey", "c_mktsegment"), at, "c_mktsegment", files_per_key=3)
    return s.read.parquet(at).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Best protein records as FASTA, read as lines again."""
    at = _folder(s)
    r = view(s, d, "records").where("gene IS NOT NULL").select("gene", "ord", "id", "description", F.when(F.col("ord") % 50 == 0, F.array(F.lit("RefSeq Select"))).otherwise(F.array().cast("array<string>")).alias("keywords"), F.repeat(F.lit("A"), (F.col("n_chars") % 1000).cast("int")).alias("seq"))
    sinks.fasta(files.best_records(r), at)
    return s.read.text(at).where("startswith(value, '>')").select(F.substring_index(F.substring("value", 2, 200), " ", 1).alias("id"))


def mito_share(s: SparkSession, d: str) -> DataFrame:
    """Cell measures with mitochondrial genes told by their names, in either case."""
    c = view(s, d, "counts").withColumn("feature", F.when(F.substring("feature", 2, 9).cast("int") % 20 == 0, F.concat(F.lit("mt-"), "feature")).otherwise(F.col("feature")))
    return matrix.cell_qc(c, scalars.is_mitochondrial(F.col("feature"))).select("cell", "n_features", "total", F.round("pct_mt", 6).alias("pct_mt"))


def symbol_forms(s: SparkSession, d: str) -> DataFrame:
    """Every name of string_pkn with every Greek letter; spreadsheet dates and other forms from the orders."""
    names = table(s, d, "string_pkn").select(F.explode(F.array("TF", "TG")).alias("n")).where("n IS NOT NULL").distinct()
    greek = names.select("n", F.explode(F.array(*map(F.lit, symbols.GREEK))).alias("k")).select(F.concat(F.lit("É "), "n", "k").alias("raw"))
    o = table(s, d, "orders").select(F.explode(F.array(*[F.concat(F.format_string("%02d", (F.col("o_orderkey") % 31 + 1).cast("int")), F.lit(x)) for x in ("-Sep", "-mar", "-Jan", " NF-kB", "NF-kappaB1")])).alias("raw"))
    return greek.union(o).distinct().select("raw", symbols.normalise_symbol(F.col("raw")).alias("symbol"))


def directed_associations(s: SparkSession, d: str) -> DataFrame:
    return networks.association_graph(table(s, d, "string_pkn").select("TF", "TG", "string_combined_score", "link_id"), True, "link_id")


def undirected_associations(s: SparkSession, d: str) -> DataFrame:
    return networks.association_graph(table(s, d, "string_pkn").select("TF", "TG", "string_combined_score", "link_id"), False, "link_id")


def stability_samples(s: SparkSession, d: str) -> DataFrame:
    """Ten samples of 70 % of the customers."""
    c = table(s, d, "customer").select("c_custkey")
    return reduce(DataFrame.unionByName, [sampling.exact_fraction(c, "c_custkey", 0.7, k).select(F.lit(k).alias("sample_no"), "c_custkey") for k in range(10)])


def classifier_report(s: SparkSession, d: str) -> DataFrame:
    r = metrics.classification_metrics(view(s, d, "scored"), "id")
    return r.select(*[F.round(c, 8).alias(c) for c in ("auroc", "auprc", "rand_auroc", "rand_auprc", "accuracy", "precision", "early_precision", "recall", "f1")], "n_edges", "n_pos", "n_neg", "score_threshold")


def balanced_histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.score_panel(view(s, d, "scored"), "hist").select("label", "bin", "n")


def sampled_sites(s: SparkSession, d: str) -> DataFrame:
    return genomic.sample_sites(view(s, d, "tss")).select("ord", "gene")


def region_fragments(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "peaks").select("chrom", F.col("pstart").alias("start"), F.col("pend").alias("end"))
    return genomic.in_region(p, "chr3", 1_000_000, 5_000_000).select("chrom", F.col("start").alias("pstart"), F.col("end").alias("pend"))


QUERIES = {f.__name__: f for f in (
    regulation_from_tsv, codes_from_text, species_peaks, saved_tables, string_from_files, peaks_from_bed, sites_from_bed, counts_from_mtx, counts_from_csv, genes_from_text, canonical_table, graph_round_trip, partitioned_round_trip, fasta_round_trip,
    mito_share, symbol_forms, directed_associations, undirected_associations, stability_samples, classifier_report, balanced_histogram, sampled_sites, region_fragments,
)}

_TICKET = "row_number() OVER (ORDER BY md5('{seed}:' || id))"
_CURVE = """g{n} AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM {rows} GROUP BY 1),
c{n} AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g{n}),
a{n} AS (SELECT (CAST(sum(p) AS DOUBLE) * sum(n) - sum(CAST(p AS DOUBLE) * fp) + sum(CAST(p AS DOUBLE) * n) / 2) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS auprc FROM c{n})"""
_GREEK = ", ".join(f"('{k}', '{v}')" for k, v in symbols.GREEK.items())
_SYMBOL = "upper(replace(strip_accents(symbol), ' ', ''))"
ORACLES = {
    "regulation_from_tsv": """WITH r AS (SELECT lower(p_brand) AS TF, p_type AS TG, ['Activation', 'Repression', 'Unknown', 'activation'][CAST(p_partkey % 4 + 1 AS INT)] AS g, p_size AS x, p_partkey % 7 AS y FROM part),
 i AS (SELECT TF, TG, array_to_string(list_sort(list(DISTINCT CAST(v AS VARCHAR))), ',') AS ids FROM (SELECT TF, TG, unnest([x, y]) AS v FROM r) GROUP BY 1, 2)
SELECT upper(r.TF) AS TF, upper(r.TG) AS TG, CAST(max(CASE WHEN g = 'Activation' THEN 1 WHEN g = 'Repression' THEN -1 ELSE 0 END) AS INTEGER) AS trrust_sign, string_agg(DISTINCT g, ';' ORDER BY g) AS trrust_regulation, max(ids) AS trrust_pmids, count(*) AS trrust_support_n
FROM r JOIN i ON r.TF = i.TF AND r.TG = i.TG GROUP BY 1, 2""",
    "codes_from_text": """WITH p AS (SELECT 'K' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS code, replace(p_name, ' ', '_') AS name FROM part)
SELECT 'flat' AS kind, * FROM p UNION ALL SELECT 'two', * FROM p UNION ALL SELECT 'organism', * FROM p UNION ALL SELECT 'pathways', code, NULL FROM p UNION ALL SELECT DISTINCT 'tfs', upper(n_name), NULL FROM nation""",
    "species_peaks": sql("SELECT chrom || ':' || pstart || '-' || pend AS feature, chrom || ':' || pstart || '-' || pend AS \"interval\" FROM @peaks WHERE pstart % 3 <> 0"),
    "saved_tables": sql("SELECT upper(feature) AS feature, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, 'rna' AS modality FROM @versioned GROUP BY 1 UNION ALL SELECT feature, count(*), CAST(sum(value) AS BIGINT), 'atac' FROM @counts2 GROUP BY 1"),
    "canonical_table": f"WITH {network_queries._DICTS}, n AS (SELECT name, {network_queries._NORM('strip_accents(name)')} AS c FROM (SELECT TF AS name FROM string_pkn UNION SELECT TG FROM string_pkn) WHERE name IS NOT NULL), r AS (" + network_queries._RESOLVE.format(extra="", how="", join="") + """)
SELECT a.symbol AS TF, b.symbol AS TG, count(*) AS n FROM string_pkn s JOIN r a ON s.TF = a.name JOIN r b ON s.TG = b.name WHERE a.symbol <> '' AND b.symbol <> '' GROUP BY 1, 2""",
    "string_from_files": sql("SELECT upper(a.preferred_name) AS TF, upper(b.preferred_name) AS TG, combined_score / 1000.0 AS string_combined_score FROM @links_raw l JOIN @names a ON a.id = protein1 JOIN @names b ON b.id = protein2 WHERE combined_score >= 800"),
    "peaks_from_bed": sql("SELECT chrom AS peak_chr, pstart AS peak_start, pend AS peak_end FROM @peaks"),
    "sites_from_bed": sql("SELECT chrom, tss, gene FROM @tss"),
    "counts_from_mtx": sql("SELECT feature, cell, CAST(value AS BIGINT) AS value FROM @counts"),
    "counts_from_csv": "SELECT c_mktsegment AS feature, 'n' || c_nationkey AS cell, count(*) AS value FROM customer GROUP BY 1, 2",
    "genes_from_text": f"SELECT DISTINCT tax_id, coalesce(gene_id, '-') AS gene_id, coalesce(symbol, '-') AS symbol, coalesce(locus, '-') AS locus, coalesce(synonyms, '-') AS synonyms, coalesce(dbxrefs, '-') AS dbxrefs FROM gene_info WHERE tax_id = '{TAXON}'",
    "graph_round_trip": sql("SELECT src, dst, pathway, '0' AS weight, substr(src, 1, 1) AS src_kind FROM @graph_edges"),
    "partitioned_round_trip": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1",
    "fasta_round_trip": sql("SELECT id FROM (SELECT gene, id, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN ord % 50 = 0 THEN 0 ELSE 1 END, CASE WHEN id LIKE 'NP%' THEN 0 ELSE 1 END, CASE WHEN id LIKE 'XP%' THEN 1 ELSE 0 END, CASE WHEN description LIKE 'LOW%' THEN 1 ELSE 0 END, n_chars % 1000 DESC, ord) AS r FROM @records WHERE gene IS NOT NULL) WHERE r = 1"),
    "mito_share": sql("SELECT CAST(cell AS VARCHAR) AS cell, count(*) FILTER (value > 0) AS n_features, CAST(sum(value) AS BIGINT) AS total, round(sum(CASE WHEN CAST(substr(feature, 2) AS INT) % 20 = 0 THEN value ELSE 0 END) * 100.0 / sum(value), 6) AS pct_mt FROM @counts GROUP BY 1"),
    "symbol_forms": f"""WITH n AS (SELECT TF AS n FROM string_pkn UNION SELECT TG FROM string_pkn), g(k, v) AS (VALUES {_GREEK}),
 o AS (SELECT DISTINCT o_orderkey % 31 + 1 AS day FROM orders), f(x) AS (VALUES ('-Sep'), ('-mar'), ('-Jan'), (' NF-kB'), ('NF-kappaB1'))
SELECT 'É ' || n || k AS raw, 'E' || upper(strip_accents(n)) || v AS symbol FROM n, g WHERE n IS NOT NULL
UNION ALL SELECT lpad(CAST(day AS VARCHAR), 2, '0') || x, CASE x WHEN '-Sep' THEN 'SEPT' || day WHEN '-mar' THEN 'MARCH' || day WHEN '-Jan' THEN lpad(CAST(day AS VARCHAR), 2, '0') || '-JAN' WHEN ' NF-kB' THEN lpad(CAST(day AS VARCHAR), 2, '0') || 'NFKB' ELSE lpad(CAST(day AS VARCHAR), 2, '0') || 'NFKB1' END FROM o, f""",
    "directed_associations": "SELECT TF, TG, arg_max_null(string_combined_score, link_id) AS string_combined_score FROM (SELECT TF, TG, string_combined_score, link_id FROM string_pkn UNION ALL SELECT TG, TF, string_combined_score, link_id FROM string_pkn) WHERE TF IS NOT NULL AND TG IS NOT NULL GROUP BY 1, 2",
    "undirected_associations": "SELECT least(TF, TG) AS TF, greatest(TF, TG) AS TG, arg_max_null(string_combined_score, link_id) AS string_combined_score FROM string_pkn WHERE TF IS NOT NULL AND TG IS NOT NULL GROUP BY 1, 2",
    "stability_samples": "SELECT CAST(k AS INTEGER) AS sample_no, c_custkey FROM (SELECT k, c_custkey, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || c_custkey)) AS r FROM customer, range(10) t(k)) WHERE r <= round((SELECT count(*) FROM customer) * 0.7)",
    "classifier_report": sql(f"""WITH x AS (SELECT * FROM @scored), l AS (SELECT label, {_TICKET.format(seed=42)} AS r FROM x), s AS (SELECT score, {_TICKET.format(seed=43)} AS r FROM x), z AS (SELECT label, score FROM l JOIN s ON l.r = s.r),
{_CURVE.format(n=1, rows="x")}, {_CURVE.format(n=2, rows="z")},
 k AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM x),
 e AS (SELECT coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5), 0), 0) AS ep FROM (SELECT * FROM x ORDER BY score DESC, id LIMIT 10000))
SELECT round(a1.auroc, 8) AS auroc, round(a1.auprc, 8) AS auprc, round(a2.auroc, 8) AS rand_auroc, round(a2.auprc, 8) AS rand_auprc, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
 round(ep, 8) AS early_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, tp + fp + fn + tn AS n_edges, tp + fn AS n_pos, fp + tn AS n_neg, CAST(0.5 AS DOUBLE) AS score_threshold FROM a1, a2, k, e"""),
    "balanced_histogram": sql("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS r FROM @scored), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM @scored GROUP BY label)),
 b AS (SELECT label, score FROM t, m WHERE r <= n), w AS (SELECT min(score) AS lo, max(score) AS hi FROM b)
SELECT label, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((score - lo) * 74 / (hi - lo)) + 1, 74) END AS INTEGER) AS bin, count(*) AS n FROM b, w GROUP BY 1, 2"""),
    "sampled_sites": sql("SELECT ord, gene FROM @tss ORDER BY md5('11:' || ord), ord LIMIT 500"),
    "region_fragments": sql("SELECT chrom, pstart, pend FROM @peaks WHERE chrom = 'chr3' AND pstart < 5000000 AND pend > 1000000"),
}
