"""Queries over networks, graphs and identifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, symbols
from ..operators import graph, identifiers, networks
from ..sources.files import best_records
from ..sources.tables import table
from .views import sql, view

TAXON = "910090"


def trrust_edge_rollup(s: SparkSession, d: str) -> DataFrame:
    return networks.regulation_edges(table(s, d, "trrust_raw"), "none")


def string_edges_scored(s: SparkSession, d: str) -> DataFrame:
    return networks.association_edges(view(s, d, "links_raw"), view(s, d, "names"), 800)


def undirected_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.undirected(table(s, d, "string_pkn"), "TF", "TG", "link_id", ["string_combined_score", "link_id"])


def symmetrised_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.symmetrised(table(s, d, "kegg_pkn").select("TF", "TG", "kegg_signal", "edge_id"), "TF", "TG")


def chip_distinct_edges(s: SparkSession, d: str) -> DataFrame:
    return networks.peak_edges(table(s, d, "chip_peaks"))


def edge_stats(s: SparkSession, d: str) -> DataFrame:
    return networks.network_stats(table(s, d, "string_pkn"))


def network_union_provenance(s: SparkSession, d: str) -> DataFrame:
    return networks.network_union({n: table(s, d, f"{n}_pkn") for n in ("trrust", "string", "kegg")})


def pathway_edge_list(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "kegg_pkn").select(F.col("TF").alias("src"), F.col("TG").alias("dst"), F.when(F.col("kegg_signal") > 0, "a").when(F.col("kegg_signal") < 0, "i").otherwise("0").alias("signal"), F.col("edge_id").alias("ord"), F.explode(F.split("kegg_pathways", ",")).alias("pathway"))
    return networks.pathway_edges(e.where("src IS NOT NULL AND dst IS NOT NULL"), "none")


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = view(s, d, "graph_edges")
    return e, e.select(F.explode(F.array("src", "dst")).alias("node")).where("startswith(node, 'C')").distinct()


def compound_bypass(s: SparkSession, d: str) -> DataFrame:
    return graph.bypass(*_graph(s, d))


def collapse_with_provenance(s: SparkSession, d: str) -> DataFrame:
    return graph.collapse_compounds(*_graph(s, d))


def self_loop_isolate_filter(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "graph_edges")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.without_isolates(nodes, graph.without_self_loops(e, "src", "dst"), "node", "src", "dst")


def complex_split(s: SparkSession, d: str) -> DataFrame:
    return graph.split_complexes(view(s, d, "complex_edges"))


def group_expand(s: SparkSession, d: str) -> DataFrame:
    h = view(s, d, "hierarchy")
    return graph.expand_groups(h, h.where("startswith(parent, 'R')").select(F.col("parent").alias("root")).distinct())


_SUBTYPES = {"1-URGENT": ["inhibition", "phosphorylation"], "2-HIGH": ["expression"], "3-MEDIUM": ["phosphorylation", "dephosphorylation"], "4-NOT SPECIFIED": ["phosphorylation"], "5-LOW": ["binding"]}


def relation_classify(s: SparkSession, d: str) -> DataFrame:
    sub = F.create_map(*[x for k, v in _SUBTYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("o_orderpriority")]
    return table(s, d, "orders").select("o_orderkey", graph.relation_signal(F.coalesce(sub, F.array().cast("array<string>"))).alias("signal"))


def lww_compose(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "trrust_raw").where("TF IS NOT NULL AND TG IS NOT NULL")
    return graph.last_writer_wins(e, ["TF", "TG"], "record_id", ["Regulation", "PMIDs"])


def symbol_normalise(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "string_pkn").select(F.explode(F.array("TF", "TG")).alias("raw")).where("raw IS NOT NULL").distinct()
    return names.select("raw", symbols.normalise_symbol(F.concat(F.lit(" "), F.lower("raw"), F.lit("\tβ"))).alias("symbol"))


def _genes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gene_info").where(F.col("tax_id") == TAXON).withColumn("ord", F.col("gene_id").cast("long"))


def synonym_explode(s: SparkSession, d: str) -> DataFrame:
    return _genes(s, d).select("gene_id", "symbol", F.explode(symbols.split_synonyms(F.col("synonyms"))).alias("synonym")).distinct()


def alias_first_wins(s: SparkSession, d: str) -> DataFrame:
    return identifiers.alias_first_wins(_genes(s, d), "ord")


def id_resolve_all(s: SparkSession, d: str) -> DataFrame:
    """Every name of kegg_pkn. SQL has no word for the normal form of all of them, so there is none; tested by brute force."""
    names = table(s, d, "kegg_pkn").select(F.explode(F.array("TF", "TG")).alias("name")).where("name IS NOT NULL")
    return identifiers.resolve(names, "name", identifiers.dictionaries(_genes(s, d), "ord"))


def coverage_report(s: SparkSession, d: str) -> DataFrame:
    return identifiers.coverage(identifiers.dictionaries(_genes(s, d), "ord"))


def fallback_lookup_all(s: SparkSession, d: str) -> DataFrame:
    """Every TF and TG of string_pkn: the dictionaries come before a fallback table made of some of the names."""
    names = table(s, d, "string_pkn").select(F.explode(F.array("TF", "TG")).alias("name")).where("name IS NOT NULL")
    known = table(s, d, "string_pkn").where("startswith(TG, 'QM1')").select(F.col("TG").alias("query"), F.concat(F.lit("F"), F.col("TG")).alias("symbol")).distinct()
    return identifiers.resolve(names, "name", identifiers.dictionaries(_genes(s, d), "ord"), known)


def unique_names(s: SparkSession, d: str) -> DataFrame:
    return scalars.unique_names(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


def layer_pick(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("log1p"), F.col("p_retailprice").alias("x"))
    return p.select("p_partkey", scalars.first_layer(p).alias("value"))


def best_record(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "records").where("gene IS NOT NULL").select("gene", "ord", "id", "description", F.when(F.col("ord") % 50 == 0, F.array(F.lit("RefSeq Select"))).otherwise(F.array().cast("array<string>")).alias("keywords"), F.repeat(F.lit("A"), (F.col("n_chars") % 1000).cast("int")).alias("seq"))
    return best_records(r).select("gene", "id")


QUERIES = {f.__name__: f for f in (
    trrust_edge_rollup, string_edges_scored, undirected_edges, symmetrised_edges, chip_distinct_edges, edge_stats, network_union_provenance, pathway_edge_list, compound_bypass,
    collapse_with_provenance, self_loop_isolate_filter, complex_split, group_expand, relation_classify, lww_compose, symbol_normalise, synonym_explode, alias_first_wins,
    id_resolve_all, coverage_report, fallback_lookup_all, unique_names, layer_pick, best_record,
)}

_NORM = lambda c: f"upper(regexp_replace(trim({c}), '[ \\t]', '', 'g'))"
_DICTS = f"""g AS (SELECT *, CAST(gene_id AS BIGINT) AS ord, {_NORM('strip_accents(symbol)')} AS sym FROM gene_info WHERE tax_id = '{TAXON}'),
official AS (SELECT DISTINCT sym AS symbol FROM g),
ens AS (SELECT id, arg_max(sym, ord) AS symbol FROM (SELECT unnest(string_split(dbxrefs, '|')) AS x, sym, ord, split_part(x, ':', 2) AS id FROM g) WHERE x LIKE 'Ensembl:%' GROUP BY id),
entrez AS (SELECT gene_id AS id, arg_max(sym, ord) AS symbol FROM g GROUP BY 1),
ali AS (SELECT {_NORM('strip_accents(a)')} AS alias, arg_min(sym, ord) AS symbol FROM (SELECT unnest(regexp_split_to_array(synonyms, '[|,;/]')) AS a, sym, ord FROM g) WHERE trim(a) NOT IN ('', '-') GROUP BY 1)"""
_RESOLVE = """SELECT name, CASE WHEN c = '' THEN '' WHEN o.symbol IS NOT NULL THEN c WHEN c LIKE 'ENS%' AND ens.symbol IS NOT NULL THEN ens.symbol
 WHEN regexp_full_match(c, '[0-9]+') AND entrez.symbol IS NOT NULL THEN entrez.symbol WHEN ali.symbol IS NOT NULL THEN ali.symbol {extra} ELSE c END AS symbol,
 CASE WHEN c = '' THEN 'empty' WHEN o.symbol IS NOT NULL THEN 'official' WHEN c LIKE 'ENS%' AND ens.symbol IS NOT NULL THEN 'ensembl'
 WHEN regexp_full_match(c, '[0-9]+') AND entrez.symbol IS NOT NULL THEN 'entrez' WHEN ali.symbol IS NOT NULL THEN 'alias' {how} ELSE 'self' END AS how
FROM n LEFT JOIN official o ON o.symbol = c LEFT JOIN ens ON upper(ens.id) = c LEFT JOIN entrez ON entrez.id = c LEFT JOIN ali ON ali.alias = c {join}"""
_SIGN = "CASE WHEN Regulation IN ('Activation', 'ACTIVATION') THEN 1 WHEN Regulation IN ('Repression', 'REPRESSION') THEN -1 ELSE 0 END"
_BYPASS = """c AS (SELECT DISTINCT node FROM (SELECT src AS node FROM @graph_edges UNION SELECT dst FROM @graph_edges) WHERE node LIKE 'C%'),
i AS (SELECT DISTINCT src AS a, dst AS via, pathway AS p1 FROM @graph_edges WHERE dst LIKE 'C%' AND src NOT LIKE 'C%'),
o AS (SELECT DISTINCT src AS via, dst AS b, pathway AS p2 FROM @graph_edges WHERE src LIKE 'C%' AND dst NOT LIKE 'C%'),
h AS (SELECT a, b, i.via, p1, p2 FROM i JOIN o ON i.via = o.via WHERE a <> b),
y AS (SELECT a AS src, b AS dst, max(via) AS via, list_distinct(list_concat(list(DISTINCT p1), list(DISTINCT p2))) AS p FROM h GROUP BY 1, 2),
b AS (SELECT src, dst, via, array_to_string(list_sort(p), ',') AS pathways FROM y)"""
ORACLES = {
    "trrust_edge_rollup": f"""WITH r AS (SELECT * FROM trrust_raw WHERE TF IS NOT NULL AND TG IS NOT NULL),
 a AS (SELECT TF, TG, CAST(max({_SIGN}) AS INTEGER) AS trrust_sign, coalesce(string_agg(DISTINCT Regulation, ';' ORDER BY Regulation), '') AS trrust_regulation, count(*) AS trrust_support_n FROM r GROUP BY 1, 2),
 p AS (SELECT TF, TG, array_to_string(list_sort(list(DISTINCT x)), ',') AS ids FROM (SELECT TF, TG, trim(unnest(string_split(PMIDs, ',')), ' ') AS x FROM r) WHERE x <> '' GROUP BY 1, 2)
SELECT a.*, coalesce(ids, '') AS trrust_pmids FROM a LEFT JOIN p ON a.TF = p.TF AND a.TG = p.TG""",
    "string_edges_scored": sql("SELECT upper(a.preferred_name) AS TF, upper(b.preferred_name) AS TG, combined_score / 1000.0 AS string_combined_score FROM @links_raw l JOIN @names a ON a.id = protein1 JOIN @names b ON b.id = protein2 WHERE combined_score >= 800"),
    "undirected_edges": "SELECT least(TF, TG) AS u, greatest(TF, TG) AS v, arg_max_null(string_combined_score, link_id) AS string_combined_score, max(link_id) AS link_id FROM string_pkn WHERE TF IS NOT NULL AND TG IS NOT NULL GROUP BY 1, 2",
    "symmetrised_edges": "SELECT TF, TG, kegg_signal, edge_id FROM kegg_pkn UNION ALL SELECT TG, TF, kegg_signal, edge_id FROM kegg_pkn",
    "chip_distinct_edges": "SELECT source_id, peak_chr || ':' || peak_start || '-' || peak_end AS peak_id FROM (SELECT DISTINCT source_id, peak_chr, peak_start, peak_end FROM chip_peaks)",
    "edge_stats": "SELECT count(DISTINCT TF) AS n_tf, count(DISTINCT TG) AS n_tg, count(*) AS n_edges FROM string_pkn",
    "network_union_provenance": """SELECT TF, TG, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, CAST(count(DISTINCT s) AS INTEGER) AS n_sources FROM (SELECT TF, TG, 'trrust' AS s FROM trrust_pkn
 UNION ALL SELECT TF, TG, 'string' FROM string_pkn UNION ALL SELECT TF, TG, 'kegg' FROM kegg_pkn) WHERE TF IS NOT NULL AND TG IS NOT NULL GROUP BY 1, 2""",
    "pathway_edge_list": """WITH e AS (SELECT TF, TG, edge_id, sign(coalesce(kegg_signal, 0)) AS g, unnest(string_split(kegg_pathways, ',')) AS p FROM kegg_pkn WHERE TF IS NOT NULL AND TG IS NOT NULL)
SELECT TF, TG, CAST(arg_max(g, edge_id) AS INTEGER) AS kegg_signal, CAST(count(DISTINCT p) AS INTEGER) AS kegg_n_pathways, string_agg(DISTINCT p, ',' ORDER BY p) AS kegg_pathways FROM e GROUP BY 1, 2""",
    "compound_bypass": sql(f"WITH {_BYPASS} SELECT * FROM b"),
    "collapse_with_provenance": sql(f"""WITH {_BYPASS}, t AS (SELECT src, dst, string_agg(DISTINCT pathway, ',' ORDER BY pathway) AS pathways FROM @graph_edges WHERE src NOT LIKE 'C%' AND dst NOT LIKE 'C%' GROUP BY 1, 2)
SELECT coalesce(b.src, t.src) AS src, coalesce(b.dst, t.dst) AS dst, b.via, coalesce(b.pathways, t.pathways) AS pathways FROM b FULL JOIN t ON b.src = t.src AND b.dst = t.dst"""),
    "self_loop_isolate_filter": sql("WITH e AS (SELECT src, dst FROM @graph_edges WHERE src <> dst) SELECT src AS node FROM e UNION SELECT dst FROM e"),
    "complex_split": sql("SELECT DISTINCT * FROM (SELECT unnest(string_split(src, '-')) AS src, dst, kind FROM (SELECT src, unnest(string_split(dst, '-')) AS dst, kind FROM @complex_edges)) WHERE src <> dst"),
    "group_expand": sql("WITH w AS (SELECT DISTINCT parent AS root, parent AS leaf FROM @hierarchy WHERE parent LIKE 'R%' UNION SELECT root, child FROM w JOIN @hierarchy ON leaf = parent) SELECT root, leaf FROM w WHERE leaf NOT IN (SELECT parent FROM @hierarchy)"),
    "relation_classify": "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'i' WHEN o_orderpriority LIKE '2-%' THEN 'a' WHEN o_orderpriority LIKE '3-%' THEN 'i' WHEN o_orderpriority LIKE '4-%' THEN 'a' ELSE '0' END AS signal FROM orders",
    "lww_compose": "SELECT TF, TG, arg_max(Regulation, record_id) AS Regulation, arg_max(PMIDs, record_id) AS PMIDs FROM trrust_raw WHERE TF IS NOT NULL AND TG IS NOT NULL GROUP BY 1, 2",
    "symbol_normalise": "SELECT DISTINCT raw, upper(strip_accents(raw)) || 'B' AS symbol FROM (SELECT TF AS raw FROM string_pkn UNION SELECT TG FROM string_pkn) WHERE raw IS NOT NULL",
    "synonym_explode": f"SELECT DISTINCT gene_id, symbol, trim(a) AS synonym FROM (SELECT gene_id, symbol, unnest(regexp_split_to_array(synonyms, '[|,;/]')) AS a FROM gene_info WHERE tax_id = '{TAXON}') WHERE trim(a) NOT IN ('', '-')",
    "alias_first_wins": f"WITH {_DICTS} SELECT * FROM ali",
    "coverage_report": f"WITH {_DICTS} SELECT (SELECT count(*) FROM official) AS n_official, (SELECT count(*) FROM ens) AS n_ensembl, (SELECT count(*) FROM entrez) AS n_entrez, (SELECT count(*) FROM ali) AS n_alias",
    "fallback_lookup_all": f"WITH {_DICTS}, n AS (SELECT name, {_NORM('strip_accents(name)')} AS c FROM (SELECT TF AS name FROM string_pkn UNION SELECT TG FROM string_pkn) WHERE name IS NOT NULL) " + _RESOLVE.format(extra="WHEN k.query IS NOT NULL THEN 'F' || c", how="WHEN k.query IS NOT NULL THEN 'fallback'", join="LEFT JOIN (SELECT DISTINCT TG AS query FROM string_pkn WHERE TG LIKE 'QM1%') k ON k.query = c"""),
    "unique_names": "SELECT p_partkey, p_name, CASE WHEN n > 0 THEN p_name || '-' || n ELSE p_name END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)",
    "layer_pick": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS value FROM part",
    "best_record": sql("SELECT gene, id FROM (SELECT gene, id, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN ord % 50 = 0 THEN 0 ELSE 1 END, CASE WHEN id LIKE 'NP%' THEN 0 ELSE 1 END, CASE WHEN id LIKE 'XP%' THEN 1 ELSE 0 END, CASE WHEN description LIKE 'LOW%' THEN 1 ELSE 0 END, n_chars % 1000 DESC, ord) AS r FROM @records WHERE gene IS NOT NULL) WHERE r = 1"),
}
