"""Readers of the domain's file formats; every one gives a DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSS = "chrom STRING, tss_start INT, tss_end INT, gene STRING"
TRRUST = "TF STRING, TG STRING, Regulation STRING, PMIDs STRING"


def regulation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV of pairs. Three columns give null PMIDs; fewer are an error."""
    n = len(spark.read.option("sep", "\t").csv(path).columns)
    if n < 3:
        raise ValueError(f"{path}: at least 3 columns are needed, {n} found")
    return spark.read.schema(TRRUST).option("sep", "\t").option("enforceSchema", True).csv(path)


def protein_info(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``preferred_name``, ``ord`` of a (gzip) TSV whose header begins with '#'."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    if "preferred_name" not in d.columns:
        raise ValueError("no column preferred_name")
    first = d.columns[0]
    return d.select(F.col(f"`{first}`").alias("id"), "preferred_name").withColumn("ord", F.monotonically_increasing_id())


def protein_links(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Blank-separated links with header. Gzip cannot be split, so give ``partitions`` for large files."""
    d = spark.read.option("sep", " ").option("header", True).csv(path)
    d = d.select("protein1", "protein2", *[F.col(c).cast("int").alias(c) for c in d.columns if c not in ("protein1", "protein2")])
    return d.repartition(partitions) if partitions else d


def count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Features by cells with header to ``feature``, ``cell``, ``value``, zeros dropped.

    A line is split and its values exploded with their place, so the plan does not grow with the cells; cells are named by
    a join on the place. Cell and feature names hold no commas. Values that are no numbers are dropped.
    """
    lines = spark.read.text(path).where("value <> ''")
    head = lines.limit(1)
    unquoted = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    cells = head.select(F.posexplode(F.split("value", ",")).alias("n", "cell")).where("n > 0").select("n", unquoted("cell").alias("cell"))
    first = head.select(F.substring_index("value", ",", 1)).first()[0]
    long = lines.where(F.substring_index("value", ",", 1) != first).select(F.substring_index("value", ",", 1).alias("feature"), F.posexplode(F.split("value", ",")).alias("n", "x"))
    return long.where("n > 0").select(unquoted("feature").alias("feature"), "n", F.expr("try_cast(trim(x) AS double)").alias("value")).where("value <> 0").join(cells, "n").select("feature", "cell", "value")


def line_place():
    """The place of a line in the order of file names, splits and lines (Spark itself reads larger files first)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``no``: the lines of a text with their number from 1, counted in ranges and not in one task."""
    from ..operators.scans import running_sums

    lines = spark.read.text(path).withColumns({"_at": line_place(), "_one": F.lit(1)})
    return running_sums(lines, "_at", ["_one"], ["no"]).select("value", F.col("no").cast("long").alias("no"))


def mtx(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """Matrix Market triple to ``feature``, ``cell``, ``value``; rows are features, columns cells."""
    lines = spark.read.text(matrix).withColumn("n", line_place()).where("NOT startswith(value, '%')")
    head = lines.agg(F.min("n").alias("h"))
    f = F.split(F.trim("value"), r"\s+")
    e = lines.join(F.broadcast(head), F.col("n") != F.col("h")).select(f[0].cast("long").alias("r"), f[1].cast("long").alias("c"), f[2].cast("double").alias("value"))

    def names(path: str, name: str) -> DataFrame:
        return numbered_lines(spark, path).select(F.col("no").alias(f"{name}_no"), F.split("value", "\t")[0].alias(name))

    return e.join(names(features, "feature"), F.col("r") == F.col("feature_no")).join(names(barcodes, "cell"), F.col("c") == F.col("cell_no")).select("feature", "cell", "value")


def tss_bed(spark: SparkSession, path: str) -> DataFrame:
    """Headerless BED of sites with ``ord``, the order of the file."""
    d = spark.read.schema(TSS).option("sep", "\t").csv(path)
    return d.withColumn("ord", F.monotonically_increasing_id()).withColumn("tss", F.col("tss_start").cast("long"))


def tf_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.upper(F.trim("source_id")).alias("source_id")).distinct()


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id``, ``gene_name``, ``ord`` of the gene lines; comments and short lines are skipped."""
    f = F.split("value", "\t")
    d = spark.read.text(path).where("NOT startswith(value, '#')").withColumn("ord", F.monotonically_increasing_id()).where(F.size(f) >= 9)
    d = d.where(F.get(f, F.lit(2)) == "gene").withColumn("a", F.get(f, F.lit(8)))
    return d.select(F.regexp_extract("a", r'gene_id "([^"]+)"', 1).alias("gene_id"), F.nullif(F.regexp_extract("a", r'gene_name "([^"]+)"', 1), F.lit("")).alias("gene_name"), "ord").where("gene_id <> ''")


def gene_info(spark: SparkSession, path: str, taxon: str) -> DataFrame:
    """First six columns of a gene table, one taxon."""
    f = F.split("value", "\t")
    d = spark.read.text(path).where("NOT startswith(value, '#')").withColumn("ord", F.monotonically_increasing_id()).where((F.size(f) >= 6) & (f[0] == taxon))
    return d.select(*[f[i].alias(n) for i, n in enumerate(["tax_id", "gene_id", "symbol", "locus", "synonyms", "dbxrefs"])], "ord")


def flat_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``code``, ``name`` of lines that start with D: the code and the first gene name after it."""
    m = r"^D\s+(\S+)\s+([^,;]+)"
    return spark.read.text(path).where(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 1).alias("code"), F.trim(F.regexp_extract("value", m, 2)).alias("name"))


def code_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code STRING, name STRING").option("sep", "\t").csv(path)


def organism_genes(spark: SparkSession, path: str) -> DataFrame:
    """``code`` (after the colon) and ``name`` (column 4 up to the first ';', then ',')."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 4).select(F.substring_index(f[0], ":", -1).alias("code"), F.substring_index(F.substring_index(f[3], ";", 1), ",", 1).alias("name"))


def pathway_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.replace(F.split("value", "\t")[0], F.lit("path:"), F.lit("")).alias("code"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Three columns of a BED file; a track line is skipped whole."""
    f = F.split("value", "\t")
    d = spark.read.text(path).where("NOT startswith(value, 'track') AND value <> ''").where(F.size(f) >= 3)
    return d.select(f[0].alias("peak_chr"), f[1].try_cast("int").alias("peak_start"), f[2].try_cast("int").alias("peak_end"))


def settings_row(spark: SparkSession, path: str, sample: str) -> dict:
    """The row of one sample; none or several are an error."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).where(F.col("Sample") == sample).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows for sample {sample!r}")
    return rows[0].asDict()


def kgml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Pathway XML: ``entries``, ``members``, ``relations``, ``reactions``, each with ``pathway`` (file name without suffix)."""
    pathway = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1).alias("pathway")

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select("*", pathway)

    e = rows("entry", "_id STRING, _name STRING, _type STRING, _reaction STRING, component ARRAY<STRUCT<_id: STRING>>")
    r = rows("relation", "_entry1 STRING, _entry2 STRING, _type STRING, subtype ARRAY<STRUCT<_name: STRING>>")
    x = rows("reaction", "_name STRING, _type STRING, substrate ARRAY<STRUCT<_name: STRING>>, product ARRAY<STRUCT<_name: STRING>>")
    kind = F.when(F.col("_type").isin("gene", "enzyme"), "gene").otherwise(F.col("_type"))
    return {
        "entries": e.select("pathway", F.col("_id").alias("id"), F.split("_name", " ").alias("names"), kind.alias("type"), F.split("_reaction", " ").alias("reactions")),
        "members": e.where("component IS NOT NULL").select("pathway", F.col("_id").alias("parent"), F.explode("component._id").alias("child")),
        "relations": r.select("pathway", F.col("_entry1").alias("entry1"), F.col("_entry2").alias("entry2"), F.col("_type").alias("type"), F.col("subtype._name").alias("subtypes"), F.monotonically_increasing_id().alias("n")),
        "reactions": x.select("pathway", F.explode(F.split("_name", " ")).alias("reaction"), F.col("substrate._name").alias("substrates"), F.col("product._name").alias("products"), F.monotonically_increasing_id().alias("n")),
    }


def kgml_nodes(tables: dict[str, DataFrame], names: DataFrame | None = None, joined: bool = False) -> DataFrame:
    """``pathway``, ``id``, ``node``, ``type``: one row per name of every plain entry, or with ``joined`` one per entry.

    Codes of the pathway's organism and of ``ko`` go through the dictionary (``code``, ``name``), paths lose their prefix,
    all other names (compounds) stay as they are; so does a code that the dictionary lacks. Commas are dropped. A joined
    name has its genes with '-' between them, other names as they stand in the file.
    """
    plain = tables["entries"].select("pathway", "id", "type", F.posexplode("names").alias("pos", "raw"))
    own = F.substring_index("raw", ":", 1).isin("ko", "path") | (F.substring_index("raw", ":", 1) == F.regexp_extract("pathway", "^[a-z]+", 0))
    genes = plain.withColumn("own", own).withColumn("code", F.when(F.col("own"), F.substring_index("raw", ":", -1)).otherwise(F.col("raw")))
    if names is not None:
        genes = genes.join(names.groupBy("code").agg(F.max("name").alias("named")), "code", "left").withColumn("code", F.coalesce("named", "code"))
    each = genes.select("pathway", "id", "type", "pos", "own", F.replace("code", F.lit(","), F.lit("")).alias("node"))
    if not joined:
        return each.select("pathway", "id", "node", "type")
    whole = each.groupBy("pathway", "id", "type").agg(F.array_sort(F.collect_list(F.struct("pos", "own", "node"))).alias("l"))
    return whole.select("pathway", "id", F.when(F.col("l")[0]["own"], F.array_join(F.col("l.node"), "-")).otherwise(F.array_join(F.col("l.node"), " ")).alias("node"), "type")


def kgml_edges(tables: dict[str, DataFrame], names: DataFrame | None = None, ordered: bool = False, joined: bool = False) -> DataFrame:
    """Edges of pathway XML: relations over group members at any depth and gene names, reactions over substrates and products.

    ``src``, ``dst``, ``signal``, ``kind``, ``pathway``; a name that the dictionary (``code``, ``name``) lacks stays. With
    ``ordered`` also ``ord``: files by name, relations before reactions, each in the order of its file; with ``joined`` the
    genes of an entry are one node (see ``kgml_nodes``).
    """
    from ..operators.graph import expand_groups, relation_signal

    e, m = tables["entries"], tables["members"]
    key = lambda c: F.struct("pathway", F.col(c).alias("id"))
    place = lambda kind: F.struct("pathway", F.lit(kind).alias("kind"), "n").alias("ord")
    members = m.select(key("parent").alias("parent"), key("child").alias("child"))
    leaves = expand_groups(members, members.select(F.col("parent").alias("root")).distinct())
    nodes = kgml_nodes(tables, names, joined).select("pathway", "id", "node")
    inner = leaves.select("root.pathway", F.col("root.id").alias("id"), F.col("leaf.id").alias("child")).join(nodes.withColumnRenamed("id", "child"), ["pathway", "child"]).select("pathway", "id", "node")
    grouped = m.select("pathway", F.col("parent").alias("id")).distinct()
    g = nodes.join(grouped, ["pathway", "id"], "left_anti").unionByName(inner)
    r = tables["relations"]
    a, b = g.select("pathway", F.col("id").alias("entry1"), F.col("node").alias("src")), g.select("pathway", F.col("id").alias("entry2"), F.col("node").alias("dst"))
    rel = r.join(a, ["pathway", "entry1"]).join(b, ["pathway", "entry2"]).select("src", "dst", relation_signal(F.col("subtypes")).alias("signal"), F.lit("relation").alias("kind"), "pathway", place(0))
    by = e.where("type = 'gene' AND reactions IS NOT NULL").select("pathway", "id", F.explode("reactions").alias("reaction")).join(g, ["pathway", "id"]).select("pathway", "reaction", "node")
    x = tables["reactions"].join(by, ["pathway", "reaction"])
    made = x.select(F.col("node").alias("src"), F.explode("products").alias("dst"), F.lit("0").alias("signal"), F.lit("metabolic_product").alias("kind"), "pathway", place(1))
    used = x.select(F.explode("substrates").alias("src"), F.col("node").alias("dst"), F.lit("0").alias("signal"), F.lit("metabolic_substrate").alias("kind"), "pathway", place(1))
    edges = rel.unionByName(made).unionByName(used).where("src <> dst")
    return edges.groupBy("src", "dst", "signal", "kind", "pathway").agg(F.max("ord").alias("ord")) if ordered else edges.drop("ord").distinct()


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "edge").schema("_source STRING, _target STRING").load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


def graphml_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``attributes``) and edges (``src``, ``dst``, ``attributes``) of a graph that ``sinks.graphml_graph`` wrote."""
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: F.struct(x["_key"], x["_VALUE"]))).alias("attributes")
    read = lambda tag, ends: spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", False).schema(f"{ends}, {data}").load(f"{path}/{tag}s")
    return read("node", "_id STRING").select(F.col("_id").alias("id"), attributes), read("edge", "_source STRING, _target STRING").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes)


def zip_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """``file``, ``value``: the text lines of one member of every ZIP file; a file without it gives no rows. Archives fit in a task."""

    def lines(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    if member in z.namelist():
                        text = z.read(member).decode("utf-8").splitlines()
                        yield pd.DataFrame({"file": [name] * len(text), "value": text})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "file string, value string")


def attribute_table(spark: SparkSession, path: str) -> DataFrame:
    """An exported table of sites (gene name, chromosome, start; with header) as ``name``, ``chrom``, ``start``."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    if len(d.columns) < 3:
        raise ValueError(f"{path}: three columns are needed")
    return d.toDF("name", "chrom", "start", *d.columns[3:]).select("name", "chrom", F.col("start").try_cast("int").alias("start"))


def best_records(records: DataFrame) -> DataFrame:
    """Per gene the best protein record: selected, then NP, then not XP, then not low quality, then longest, then first.

    ``records`` has ``gene``, ``id``, ``description``, ``keywords``, ``seq``, ``ord``.
    """
    desc = F.lower("description")
    rank = F.struct(
        F.when(F.exists("keywords", lambda k: F.lower(k).contains("refseq select")), 0).otherwise(1).alias("select"), F.when(F.col("id").startswith("NP_"), 0).otherwise(1).alias("np"),
        F.when(F.col("id").startswith("XP_"), 1).otherwise(0).alias("xp"), F.when(desc.contains("low quality"), 1).otherwise(0).alias("low"), (-F.length("seq")).alias("short"), F.col("ord"),
    )
    best = records.groupBy("gene").agg(F.min_by(F.struct(*[c for c in records.columns if c != "gene"]), rank).alias("_r"))  # folded before the shuffle
    return best.select("gene", "_r.*").select(records.columns)


def present(spark: SparkSession, path: str) -> bool:
    """Is the whole result of an earlier run there? A folder counts only with the mark that a finished job leaves."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    return not fs.getFileStatus(p).isDirectory() or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
