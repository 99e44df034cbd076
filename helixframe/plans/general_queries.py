"""Queries of the general problems: packed fields, intervals, small files, skewed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, packed, skew, smallfiles
from ..sources.tables import table

PACKED = {"trrust_raw": ("record_id", ["PMIDs"]), "trrust_pkn": ("pkn_id", ["trrust_pmids", "trrust_regulation"])}


def _packed_long(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.explode(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("source"), F.col(c).alias("value")) for c in cols])).alias("x")).select("x.*")
        for t, (_, cols) in PACKED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    taken = packed.infer_delimiters(_packed_long(spark, d), "source", "value")
    out = []
    for t, (key, cols) in PACKED.items():
        rows = packed.explode_packed(table(spark, d, t), {c: taken.get(f"{t}.{c}", []) for c in cols}, [key])
        out.append(rows.select(F.lit(t).alias("table_name"), F.col(key).alias("row_id"), "field", "pos", "value"))
    return reduce(DataFrame.unionByName, out)


def p1_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The scores that decide which delimiters a source is split at."""
    return packed.score_delimiters(_packed_long(spark, d), "source", "value").select("source", F.explode("scores").alias("s")).select("source", "s.*")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = intervals.covered_and_gaps(table(spark, d, "chip_peaks"), ["source_id", "peak_chr"], "peak_start", "peak_end", least=2, longest_gap=2000)
    merged = (F.col("kind") == "covered") & (F.col("n_intervals") >= 2)
    gap = (F.col("kind") == "gap") & (F.col("range_end") - F.col("range_start") <= 2000)
    return r.where(merged | gap).select("source_id", "peak_chr", F.when(F.col("kind") == "gap", "gap").otherwise("merged").alias("kind"), F.col("range_start").cast("int").alias("range_start"), F.col("range_end").cast("int").alias("range_end"))


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every covered stretch and every gap, of any length."""
    return intervals.covered_and_gaps(table(spark, d, "chip_peaks"), ["source_id", "peak_chr"], "peak_start", "peak_end")


RECORD = ["source_id", "peak_chr", "peak_start", "peak_end"]


def p5_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every part of the joined files with its records, length and checksum; where it lies depends on the tasks."""
    frames = smallfiles.frames_of_records(table(spark, d, "chip_peaks"), "file_id", RECORD)
    return smallfiles.consolidate(frames, ["file_id", "frame_no", "n_records"]).select("file_id", "frame_no", "n_records", "length", "checksum")


def _digests(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.file_digests(p5_manifest(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.equal_pairs(_digests(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Contents delivered more than once: the first file, files and links between them."""
    return smallfiles.equal_files(_digests(spark, d)).select("class_id", "n_files", "n_links")


def p5_declared(spark: SparkSession, d: str) -> DataFrame:
    """Files whose declared number of rows is not the number delivered."""
    found = table(spark, d, "chip_peaks").where("file_id IS NOT NULL").groupBy("file_id").agg(F.count(F.lit(1)).alias("found"))
    said = table(spark, d, "chip_files").select("file_id", F.col("n_rows").cast("long").alias("declared"))
    return said.join(found, "file_id", "left").select("file_id", "declared", F.coalesce("found", F.lit(0)).alias("found")).where("declared IS NULL OR declared <> found")


def p5_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The well-sized files that hold every record once per delivering file: parts, bytes and checksum of each."""
    frames = smallfiles.frames_of_records(table(spark, d, "chip_peaks"), "file_id", RECORD)
    return smallfiles.concatenate(frames, ["file_id", "frame_no"], target_bytes=16 << 20).select("out_file", "n_parts", "n_bytes", "checksum")


def p7_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct peaks of every source."""
    return skew.salted_aggregate(table(spark, d, "chip_peaks"), "source_id", distinct=["peak_chr", "peak_start", "peak_end"], distinct_name="distinct_peaks")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows and score summary of every TF."""
    r = skew.salted_aggregate(table(spark, d, "string_pkn").withColumn("milli", F.round(F.col("string_combined_score") * 1000).cast("long")), "TF", {"score": "milli"})
    return r.select("TF", "rows", F.col("score_n").alias("n_scored"), F.col("score_sum").alias("sum_milli"), F.col("score_min").alias("min_milli"), F.col("score_max").alias("max_milli"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least a fiftieth of all rows of their table; the total comes from the count that finds heavy keys."""
    out = []
    for t, key, row_id in (("chip_peaks", "source_id", "peak_row_id"), ("string_pkn", "TF", "link_id")):
        heavy, total = skew.heavy_keys(table(spark, d, t), key)
        per = skew.salted_aggregate(table(spark, d, t), key, salt_by=[row_id], heavy=heavy)
        out.append(per.where(F.col(key).isNotNull() & (F.col("rows") * 50 >= F.lit(total))).select(F.lit(t).alias("table_name"), F.col(key).alias("key_value")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (p1_found, p1_delimiters, p3_found, p3_stretches, p5_found, p5_manifest, p5_classes, p5_declared, p5_consolidated, p7_found, p7_peaks, p7_scores)}

_ISLANDS = """
WITH p AS (SELECT DISTINCT source_id, peak_chr, peak_start AS a, peak_end AS z FROM chip_peaks
           WHERE source_id IS NOT NULL AND peak_chr IS NOT NULL AND peak_start < peak_end),
m AS (SELECT *, max(z) OVER (PARTITION BY source_id, peak_chr ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM p),
g AS (SELECT *, sum(CASE WHEN pz IS NULL OR a > pz THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, peak_chr ORDER BY a, z) AS g FROM m),
s AS (SELECT source_id, peak_chr, g, min(a) AS a, max(z) AS z, count(*) AS n FROM g GROUP BY 1, 2, 3),
t AS (SELECT *, lead(a) OVER (PARTITION BY source_id, peak_chr ORDER BY a) AS na FROM s)
"""
ORACLES = {
    "p3_found": _ISLANDS
    + "SELECT source_id, peak_chr, 'merged' AS kind, a AS range_start, z AS range_end FROM t WHERE n >= 2 UNION ALL "
    "SELECT source_id, peak_chr, 'gap', z, na FROM t WHERE na - z BETWEEN 1 AND 2000",
    "p3_stretches": _ISLANDS
    + "SELECT source_id, peak_chr, 'covered' AS kind, a AS range_start, z AS range_end, n AS n_intervals FROM t UNION ALL "
    "SELECT source_id, peak_chr, 'gap', z, na, 0 FROM t WHERE na IS NOT NULL",
    "p5_found": """
WITH r AS (SELECT DISTINCT file_id, source_id, peak_chr, peak_start, peak_end FROM chip_peaks WHERE file_id IS NOT NULL),
f AS (SELECT file_id, list(struct_pack(s := source_id, c := peak_chr, a := peak_start, z := peak_end) ORDER BY source_id, peak_chr, peak_start, peak_end)::VARCHAR AS c FROM r GROUP BY 1)
SELECT x.file_id AS file_id_a, y.file_id AS file_id_b FROM f x JOIN f y ON x.c = y.c AND x.file_id < y.file_id""",
    "p5_manifest": """
WITH l AS (SELECT DISTINCT file_id, concat_ws(chr(9), coalesce(source_id, '\\N'), coalesce(peak_chr, '\\N'), coalesce(peak_start::VARCHAR, '\\N'), coalesce(peak_end::VARCHAR, '\\N')) AS line
           FROM chip_peaks WHERE file_id IS NOT NULL),
f AS (SELECT file_id, CAST(count(*) AS INTEGER) AS n_records, string_agg(line, chr(10) ORDER BY line) || chr(10) AS content FROM l GROUP BY 1)
SELECT file_id, 0 AS frame_no, n_records, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS checksum FROM f""",
    "p5_classes": """
WITH r AS (SELECT DISTINCT file_id, source_id, peak_chr, peak_start, peak_end FROM chip_peaks WHERE file_id IS NOT NULL),
f AS (SELECT file_id, list(struct_pack(s := source_id, c := peak_chr, a := peak_start, z := peak_end) ORDER BY source_id, peak_chr, peak_start, peak_end)::VARCHAR AS c FROM r GROUP BY 1)
SELECT min(file_id) AS class_id, count(*) AS n_files, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_links FROM f GROUP BY c HAVING count(*) > 1""",
    "p5_declared": """
SELECT file_id, CAST(n_rows AS BIGINT) AS declared, coalesce(n, 0) AS found
FROM chip_files LEFT JOIN (SELECT file_id, count(*) AS n FROM chip_peaks GROUP BY 1) USING (file_id) WHERE n_rows IS NULL OR n_rows <> coalesce(n, 0)""",
    "p7_found": """
SELECT 'chip_peaks' AS table_name, source_id AS key_value FROM chip_peaks WHERE source_id IS NOT NULL GROUP BY 2 HAVING count(*) * 50 >= (SELECT count(*) FROM chip_peaks)
UNION ALL SELECT 'string_pkn', TF FROM string_pkn WHERE TF IS NOT NULL GROUP BY 2 HAVING count(*) * 50 >= (SELECT count(*) FROM string_pkn)""",
    "p7_peaks": """
SELECT source_id, count(*) AS rows, count(DISTINCT CASE WHEN peak_chr IS NOT NULL AND peak_start IS NOT NULL AND peak_end IS NOT NULL
THEN peak_chr || ':' || peak_start || '-' || peak_end END) AS distinct_peaks FROM chip_peaks GROUP BY 1""",
    "p7_scores": """
SELECT TF, count(*) AS rows, count(string_combined_score) AS n_scored, CAST(sum(CAST(round(string_combined_score * 1000) AS BIGINT)) AS BIGINT) AS sum_milli,
min(CAST(round(string_combined_score * 1000) AS BIGINT)) AS min_milli, max(CAST(round(string_combined_score * 1000) AS BIGINT)) AS max_milli FROM string_pkn GROUP BY 1""",
}
