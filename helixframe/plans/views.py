"""Small SQL views that let the star-schema tables stand in for domain inputs, in words that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

VIEWS = {
    "links_raw": "SELECT 'P' || l_suppkey AS protein1, 'P' || l_partkey AS protein2, CAST(max(l_quantity) * 20 AS INT) AS combined_score FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    "names": "SELECT 'P' || p_partkey AS id, p_name || ' ' || (p_partkey % 97) AS preferred_name FROM {part} WHERE p_partkey % 10 <> 0",
    "graph_edges": """SELECT DISTINCT 'S' || (l_suppkey % 40) AS src, 'C' || (l_partkey % 50) AS dst, 'p' || l_linenumber AS pathway FROM {lineitem}
        UNION SELECT DISTINCT 'C' || (l_partkey % 50), 'G' || (o_custkey % 60), 'q' || (l_linenumber % 3) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        UNION SELECT DISTINCT 'S' || (l_suppkey % 40), 'G' || (o_custkey % 60), 'd' FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_partkey % 97 = 0
        UNION SELECT DISTINCT 'S' || (l_suppkey % 40), 'S' || (l_suppkey % 40), 'self' FROM {lineitem} WHERE l_suppkey % 3 = 0""",
    "complex_edges": "SELECT DISTINCT p_brand || '-' || p_type AS src, p_name AS dst, p_size % 3 AS kind FROM {part}",
    "hierarchy": """SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM {nation}
        UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM {customer} UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM {supplier}""",
    "peaks": "SELECT DISTINCT 'chr' || (l_suppkey % 20 + 1) AS chrom, (l_orderkey * 7919 + l_partkey * 131) % 20000000 AS pstart, (l_orderkey * 7919 + l_partkey * 131) % 20000000 + 500 AS pend FROM {lineitem}",
    "tss": "SELECT CAST(p_partkey AS BIGINT) AS ord, 'chr' || (p_partkey % 20 + 1) AS chrom, (p_partkey * 104729) % 20000000 AS tss, 'G' || p_partkey AS gene FROM {part}",
    "tss_raw": "SELECT n_name AS name, CASE n_nationkey % 7 WHEN 1 THEN 'X' WHEN 2 THEN 'Y' WHEN 3 THEN 'MT' WHEN 4 THEN 'GL1' ELSE CAST(n_regionkey + 1 AS VARCHAR(9)) END AS chrom, n_nationkey * 1000 AS pos FROM {nation}",
    "counts": "SELECT 'c' || o_custkey AS cell, 'f' || (l_partkey % 500) AS feature, sum(CAST(l_quantity AS BIGINT)) AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey % 500",
    "counts2": "SELECT 'c' || o_custkey AS cell, 's' || l_suppkey AS feature, sum(CAST(l_quantity AS BIGINT)) AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY o_custkey, l_suppkey",
    "versioned": "SELECT 'c' || o_custkey AS cell, CASE WHEN l_partkey % 2 = 0 THEN 'Gene' || (l_partkey % 100) || '.' || (l_partkey % 3) ELSE ' gene' || (l_partkey % 100) END AS feature, sum(CAST(l_quantity AS BIGINT)) AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "sim_edges": "SELECT c_nationkey AS i, s_nationkey AS j, count(*) AS w FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey",
    "scored": "SELECT link_id AS id, CASE WHEN string_experimental_score > 100 THEN 1 ELSE 0 END AS label, string_combined_score AS score FROM {string_pkn} WHERE string_combined_score IS NOT NULL",
    "scored_big": "SELECT l_orderkey * 16 + l_linenumber * 2 + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS id, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS label, l_quantity / 50 AS score FROM {lineitem}",
    "records": "SELECT source AS gene, doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN 'NP_' WHEN 1 THEN 'XP_' ELSE 'Q' END || doc_id AS id, CASE WHEN n_files > 3 THEN 'LOW QUALITY protein' ELSE 'protein' END AS description, n_chars FROM {documents}",
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, d, t) for t in set(_NAME.findall(text))})


def sql(text: str) -> str:
    """The query with a WITH clause for every view that it names as {{view}}-free plain names after ``@``."""
    used = [v for v in VIEWS if re.search(rf"@{v}\b", text)]
    body = re.sub(r"@(\w+)", r"v_\1", text)
    clauses = ",\n".join(f"v_{v} AS ({_NAME.sub(r'\1', VIEWS[v])})" for v in used)
    if not used:
        return body
    return f"WITH RECURSIVE {clauses},\n{body[4:].lstrip()}" if body.lstrip().upper().startswith("WITH") else f"WITH {clauses}\n{body}"
