"""Readers, writers, symbols and graph rules on literals."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions import scalars, symbols
from helixframe.operators import genomic, graph, identifiers, matrix, metrics, networks, sampling
from helixframe.operators.scans import running_sums
from helixframe.plans import network_queries
from helixframe.sources import files, sinks
from helixframe.streaming import peaks

from .conftest import rows


def write(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(exist_ok=True, parents=True)
    (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w")).write(text) if not name.endswith(".gz") else None
    if name.endswith(".gz"):
        with gzip.open(p, "wt") as f:
            f.write(text)
    return str(p)


def test_text_readers(spark, tmp_path):
    assert rows(files.regulation_tsv(spark, write(tmp_path, "a.tsv", "A\tB\tActivation\t1,2\nC\tD\tUnknown\t\n"))) == [("A", "B", "Activation", "1,2"), ("C", "D", "Unknown", None)]
    assert rows(files.regulation_tsv(spark, write(tmp_path, "b.tsv", "A\tB\tActivation\n"))) == [("A", "B", "Activation", None)]
    with pytest.raises(ValueError):
        files.regulation_tsv(spark, write(tmp_path, "c.tsv", "A\tB\n"))
    info = files.protein_info(spark, write(tmp_path, "i.tsv.gz", "#string_protein_id\tpreferred_name\np1\tx\np2\ty\np1\tz\n"))
    links = files.protein_links(spark, write(tmp_path, "l.txt.gz", "protein1 protein2 combined_score textmining\np1 p2 800 5\np2 p1 799 6\np1 p9 900 7\n"))
    assert rows(networks.association_edges(links, info, 800)) == [("Z", "Y", 0.8, 5)]
    assert rows(files.bed(spark, write(tmp_path, "p.bed", "track name=x\nchr1_x_alt\t1\t5\textra\n\nchr2\t7\t9\n"))) == [("chr1_x_alt", 1, 5), ("chr2", 7, 9)]
    gtf = 'x\n#!c\nchr1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "E1"; gene_name "A";\nchr1\ts\texon\t1\t2\t.\t+\t.\tgene_id "E1";\nchr1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "E2";\n'
    assert rows(files.gtf_genes(spark, write(tmp_path, "g.gtf", gtf)).select("gene_id", "gene_name")) == [("E1", "A"), ("E2", None)]
    assert rows(files.gene_info(spark, write(tmp_path, "n.tsv", "#tax\n9\t1\tA\tl\tb|c\tEnsembl:E1\n8\t2\tB\tl\t-\t-\n9\t3\n"), "9").drop("ord")) == [("9", "1", "A", "l", "b|c", "Ensembl:E1")]
    assert rows(files.flat_hierarchy(spark, write(tmp_path, "h.txt", "A\nD      K00001 adh1, adh2; x\n"))) == [("K00001", "adh1")]
    assert rows(files.organism_genes(spark, write(tmp_path, "o.tsv", "mmu:11\tCDS\t1\tFoo, Bar; foo protein\nmmu:12\tx\n"))) == [("11", "Foo")]
    assert rows(files.pathway_list(spark, write(tmp_path, "pl.tsv", "path:mmu001\tname\n"))) == [("mmu001",)]
    s = write(tmp_path, "s.tsv", "Sample\tmin\nS1\t5\nS2\t6\nS2\t7\n")
    assert files.settings_row(spark, s, "S1")["min"] == "5"
    for bad in ("S2", "S3"):
        with pytest.raises(ValueError):
            files.settings_row(spark, s, bad)
    assert rows(files.count_matrix(spark, write(tmp_path, "m.csv", "g,c1,c2\nA,1,0\nB,0,2.5\n"))) == [("A", "c1", 1.0), ("B", "c2", 2.5)]
    assert rows(files.count_matrix(spark, write(tmp_path, "q.csv", '"","c 1"\n"A",3\nB,x\n'))) == [("A", "c 1", 3.0)]
    m = files.mtx(spark, write(tmp_path, "x.mtx.gz", "%%MatrixMarket\n%\n2 2 2\n1 2 5\n2 1 7\n"), write(tmp_path, "bc.tsv", "c1\nc2\n"), write(tmp_path, "ft.tsv", "A\tx\nB\ty\n"))
    assert rows(m) == [("A", "c2", 5.0), ("B", "c1", 7.0)]
    assert rows(files.tss_bed(spark, write(tmp_path, "t.bed", "chr1\t5\t6\tA\n")).select("chrom", "tss", "gene")) == [("chr1", 5, "A")]
    assert rows(files.tf_list(spark, write(tmp_path, "tf.csv", "source_id\n abc\nABC\n"))) == [("ABC",)]


KGML = """<?xml version="1.0"?><pathway name="path:x">
<entry id="1" name="mmu:1 mmu:2" type="gene" reaction="rn:R1"/><entry id="2" name="mmu:3" type="gene"/>
<entry id="3" name="undefined" type="group"><component id="1"/><component id="2"/></entry>
<entry id="4" name="mmu:4" type="gene"/>
<relation entry1="3" entry2="4" type="PPrel"><subtype name="inhibition"/><subtype name="phosphorylation"/></relation>
<relation entry1="4" entry2="4" type="PPrel"><subtype name="activation"/></relation>
<reaction id="9" name="rn:R1" type="irreversible"><substrate name="cpd:C1"/><product name="cpd:C2"/></reaction></pathway>"""


def test_kgml(spark, tmp_path):
    write(tmp_path, "k/mmu001.xml", KGML)
    names = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "code string, name string")
    e = files.kgml_edges(files.kgml(spark, str(tmp_path / "k")), names)
    want = [(x, "4", "i", "relation", "mmu001") for x in "ABC"] + [(x, "cpd:C2", "0", "metabolic_product", "mmu001") for x in "AB"] + [("cpd:C1", x, "0", "metabolic_substrate", "mmu001") for x in "AB"]
    assert {tuple(r) for r in e.collect()} == set(want)


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", None), ("b", "c", 2)], "src string, dst string, w int")
    sinks.graph_tables(e.select(F.col("src").alias("id")), e, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g/edges"))) == [("a", "b", "0"), ("b", "c", "2")]
    sinks.graphml(e, str(tmp_path / "x"))
    assert rows(files.graphml_edges(spark, str(tmp_path / "x"))) == [("a", "b"), ("b", "c")]
    sinks.parquet_by(e, str(tmp_path / "p"), "src")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.bed(e.select("src", "w"), str(tmp_path / "b"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "b")).count() == 2
    sinks.fasta(spark.createDataFrame([("i", "d", "AC")], "id string, description string, seq string"), str(tmp_path / "f"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()] == [">i d", "AC"]


def test_symbols(spark):
    cases = {" 2-Sep ": "SEPT2", "01-Mar": "MARCH1", "3-Oct": "3-OCT", "NF-kB p65": "NFKBP65", "TNF-α": "TNF-A", "Kürt\t1": "KURT1", "θ": "TH", "υ": "Y", "中A": "A", None: "", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", symbols.normalise_symbol(F.col("s"))).collect()} == cases
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(symbols.split_synonyms, "a| b,-;c/") == ["a", "b", "c"]
    assert one(scalars.normalise_peak, "chr1-random-0005-10") == "chr1-random:5-10" and one(scalars.normalise_peak, "chr1:5:10") == "chr1:5:10"
    assert one(scalars.pathway_number, "mmu00010") == "00010" and one(scalars.pathway_number, "mmu") is None
    assert one(scalars.strip_prefix, "hg38.X") == "X" and one(scalars.strip_version, "ENS1.12") == "ENS1" and one(scalars.add_chr, "7") == "chr7"
    with pytest.raises(ValueError, match="bad"):
        scalars.parse_peaks(spark.createDataFrame([("chr1:1-2",), ("bad",)], "p string"), "p")
    with pytest.raises(ValueError):
        networks.organism("xx1")


def test_resolution(spark):
    genes = spark.createDataFrame([("1", "Aa", "al|x", "Ensembl:ENSG1", 1), ("2", "Bb", "al", "-", 2), ("3", "TP53", None, None, 3)], "gene_id string, symbol string, synonyms string, dbxrefs string, ord long")
    v = spark.createDataFrame([(x,) for x in ["aa", "AL", "ENSG1", "2", "p53", "zz", None, "q"]], "n string")
    got = {r["n"]: (r["symbol"], r["how"]) for r in identifiers.resolve(v, "n", identifiers.dictionaries(genes, "ord"), spark.createDataFrame([("Q", "Found")], "query string, symbol string")).collect()}
    assert got == {"aa": ("AA", "official"), "AL": ("AA", "alias"), "ENSG1": ("AA", "ensembl"), "2": ("BB", "entrez"), "p53": ("TP53", "official"), "zz": ("ZZ", "self"), None: ("", "empty"), "q": ("Found", "fallback")}
    e = identifiers.standardise_edges(spark.createDataFrame([("al", "2"), (None, "aa")], "TF string, TG string"), identifiers.dictionaries(genes, "ord"))
    assert rows(e.select("TF", "TG")) == [("AA", "BB")]


def test_nearest_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    p = [(f"p{i}", rnd.choice("ab"), a, a + rnd.choice([0, 3, 40])) for i, a in enumerate(rnd.choices(range(400), k=120))]
    t = [(i, rnd.choice("abc"), rnd.randint(0, 500), f"g{i}") for i in range(40)]
    peaks_, tss = spark.createDataFrame(p, "peak_id string, chrom string, start long, end long"), spark.createDataFrame(t, "ord long, chrom string, tss long, gene string")
    dist = lambda a, z, x: max(a - x, x - z, 0)
    want = set()
    for i, c, a, z in p:
        cand = [(dist(a, z, x), o, g) for o, cc, x, g in t if cc == c]
        if cand:
            want.add((i, *min(cand)))
    for width in (30, 200_000):
        assert {tuple(r) for r in genomic.nearest(peaks_, tss, width).select("peak_id", "absd", "ord", "gene").collect()} == want
        assert genomic.nearest(peaks_.union(peaks_), tss, width).count() == 2 * genomic.nearest(peaks_, tss, width).count()
    wide = genomic.annotate_peaks(peaks_, tss.limit(0), keep_intergenic=True)
    assert wide.where("peak_type = 'intergenic'").count() == 120 and genomic.annotate_peaks(peaks_.limit(0), tss).count() == 0


def test_graph_rules(spark):
    sub = spark.createDataFrame([(["phosphorylation", "dephosphorylation"],), (["binding"],), ([],), (["expression", "inhibition"],)], "s array<string>")
    assert [r[0] for r in sub.select(graph.relation_signal(F.col("s"))).collect()] == ["i", "0", "0", "a"]
    m = spark.createDataFrame([("g", "h"), ("h", "x"), ("g", "y"), ("h", "g")], "parent string, child string")  # a cycle
    assert rows(graph.expand_groups(m, spark.createDataFrame([("g",)], "root string"), 4)) == [("g", "x"), ("g", "y")]
    e = spark.createDataFrame([("A", "x", "p"), ("x", "B", "q"), ("A", "B", "d"), ("B", "A", "d")], "src string, dst string, pathway string")
    assert rows(graph.collapse_compounds(e, spark.createDataFrame([("x",)], "node string"))) == [("A", "B", "x", "p,q"), ("B", "A", None, "d")]
    star = spark.range(40).selectExpr("CAST(id AS STRING) AS src", "'x' AS dst", "'p' AS pathway").union(spark.range(40).selectExpr("'x'", "CAST(id AS STRING)", "'q'"))
    assert rows(graph.bypass(star, spark.createDataFrame([("x",)], "node string"), hub=3)) == sorted((str(a), str(b), "x", "p,q") for a in range(40) for b in range(40) if a != b)
    c = graph.communities(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)], "i string, j string, w double"))
    lab = {r[0]: r[1] for r in c.collect()}
    assert lab["a"] == lab["b"] == lab["c"] != lab["x"] == lab["y"]


def test_matrix_and_metrics_edges(spark):
    w = matrix.diffusion_weights(spark.createDataFrame([("a", "b", 1.0), ("c", "c", 0.0)], "i string, j string, w double"), 3)
    assert {round(r[0], 9) for r in w.groupBy("i").agg(F.sum("w")).select("sum(w)").collect()} == {1.0}
    with pytest.raises(ValueError):
        matrix.collapse_symbols(w, "mode")
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert metrics.auroc(one).first()[0] is None and metrics.average_precision(one).first()[0] is None
    four = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert metrics.auroc(four).first()[0] == 0.75 and round(metrics.average_precision(four).first()[0], 4) == 0.8333
    none = metrics.confusion(four.where("score > 2")).first()
    assert (none["precision"], none["f1"], none["n_pos"]) == (0.0, 0.0, 0)
    equal = spark.createDataFrame([(i, i % 2, 0.5) for i in range(10)], "id int, label int, score double")
    assert sampling.balance_classes(equal, "label", "id").count() == 10 and sampling.exact_fraction(equal, "id", 0.7).count() == 7
    r = running_sums(spark.range(1000).withColumn("v", F.lit(1)), "id", ["v"], ["s"])
    assert r.where("s <> id + 1").count() == 0 and running_sums(spark.range(0).withColumn("v", F.lit(1)), "id", ["v"], ["s"]).count() == 0


def test_stream(spark, tmp_path):
    one = spark.sql("SELECT 1L peak_row_id, 1L file_id, 's' source_id, 'c' peak_chr, 1 peak_start, 2 peak_end, TIMESTAMP_NTZ'2020-01-05 00:00:00' called_at, TIMESTAMP_NTZ'2020-01-06 00:00:00' loaded_at")
    one.union(one.withColumn("peak_row_id", F.lit(2))).write.parquet(str(tmp_path / "in/a"))
    one.write.parquet(str(tmp_path / "in/b"))
    got = peaks.run_once(peaks.counts_by_window(peaks.read_stream(spark, str(tmp_path / "in/*"))), "peak_counts", str(tmp_path / "cp"))
    assert [(r["source_id"], r["n"]) for r in got.collect()] == [("s", 2)]


def test_rank_features_ranks_every_feature(spark):
    import math

    cells = {f"c{i}": "a" if i < 4 else "b" for i in range(10)}
    table = {("c0", "f"): 3.0, ("c1", "f"): 1.0, ("c4", "f"): 2.0, **{(f"c{i}", "only_b"): float(i) for i in range(4, 10)}, **{(c, "same"): 0.1 for c in cells}}
    got = matrix.rank_features(spark.createDataFrame([(*k, v) for k, v in table.items()], "cell string, feature string, value double"), spark.createDataFrame(list(cells.items()), "cell string, cluster string"))
    found = {(r["cluster"], r["feature"]): r for r in got.collect()}
    assert set(found) == {(c, f) for c in "ab" for f in ("f", "only_b", "same")}
    for (c, f), r in found.items():
        one, rest = ([table.get((x, f), 0.0) for x, k in cells.items() if (k == c) == same] for same in (True, False))
        mean, var = lambda v: sum(v) / len(v), lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
        se = math.sqrt((var(one) + var(rest)) / len(one))
        t = (mean(one) - mean(rest)) / se if f != "same" else 0.0
        assert r["t"] == pytest.approx(t) and r["p"] == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), abs=1e-6)
    for c in "ab":
        p = sorted(r["p"] for k, r in found.items() if k[0] == c)
        want = [min(1, *[p[j] * 3 / (j + 1) for j in range(i, 3)]) for i in range(3)]
        assert sorted(r["p_adj"] for k, r in found.items() if k[0] == c) == pytest.approx(want)


def _genes_and(spark, tmp_path, name, pairs):
    genes = [("910090", "1", "KRÉK", "al|x", "Ensembl:ENSG1"), ("910090", "2", "Bb", "SYN-β", "-"), ("910090", "3", "NFKB1", "-", "-"), ("910090", "7", "Cc", "QM1x", "-"), ("1", "9", "zz", "al", "-")]
    spark.createDataFrame(genes, "tax_id string, gene_id string, symbol string, synonyms string, dbxrefs string").write.parquet(str(tmp_path / "gene_info.parquet"))
    spark.createDataFrame(pairs, "TF string, TG string").write.parquet(str(tmp_path / f"{name}.parquet"))


def test_id_resolve_all_takes_every_name(spark, tmp_path):
    import unicodedata

    names = ["KRÉK", "kre\u0301k", "VÅFDU18", "A\u200bl", "B\u00a0b", "\tbb", "syn-β", "NF-kB", "NF-kappaB1", "2-Sep", "ENSG1", "2", "zz", "К1", "θ1", "..", "\u200b"]
    _genes_and(spark, tmp_path, "kegg_pkn", list(zip(names, [*names[5:], None, "aL", "x", "q", "al"])))

    def norm(x):
        x = "".join(symbols.GREEK.get(c) or ("".join(y for y in unicodedata.normalize("NFKD", c) if ord(y) < 128)) for c in x.strip(" "))
        x = {"2-SEP": "SEPT2"}.get(x.upper(), x).replace("NF-kB", "NFKB").replace("NF-kappaB", "NFKB")
        return x.replace(" ", "").replace("\t", "").upper()

    def brute(x):
        c = identifiers.CURATED.get(norm(x), norm(x))
        ids = {"ENSG1": ("KREK", "ensembl"), "2": ("BB", "entrez"), "1": ("KREK", "entrez"), "AL": ("KREK", "alias"), "X": ("KREK", "alias"), "SYN-B": ("BB", "alias"), "QM1X": ("CC", "alias")}
        return ("", "empty") if not c else (c, "official") if c in ("KREK", "BB", "NFKB1", "CC") else ids.get(c, (c, "self"))

    got = {r["name"]: (r["symbol"], r["how"]) for r in network_queries.id_resolve_all(spark, str(tmp_path)).collect()}
    assert got == {x: brute(x) for x in {*names, "aL", "x", "q", "al"}}


def test_fallback_lookup_all_yields_to_dictionaries(spark, tmp_path):
    _genes_and(spark, tmp_path, "string_pkn", [("bb", "QM1X"), ("ENSG1", "QM12"), ("2", "al"), (None, "QM2"), ("zz", None)])
    got = {r["name"]: (r["symbol"], r["how"]) for r in network_queries.fallback_lookup_all(spark, str(tmp_path)).collect()}
    assert got == {"bb": ("BB", "official"), "QM1X": ("CC", "alias"), "ENSG1": ("KREK", "ensembl"), "QM12": ("FQM12", "fallback"), "2": ("BB", "entrez"), "al": ("KREK", "alias"), "QM2": ("QM2", "self"), "zz": ("ZZ", "self")}


def test_expand_groups_at_any_depth(spark):
    m = spark.createDataFrame([*[(f"g{i}", f"g{i + 1}") for i in range(20)], ("g20", "deep"), ("g20", "g0"), ("g1", "near")], "parent string, child string")
    roots = spark.createDataFrame([("g0",)], "root string")
    assert rows(graph.expand_groups(m, roots)) == [("g0", "deep"), ("g0", "near")]
    with pytest.raises(ValueError, match="deeper"):
        graph.expand_groups(m, roots, 16)


def test_zip_members_tables_and_finished_folders(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/protein.faa", ">x\nMA\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other", "no")
    assert [r["value"] for r in files.zip_member(spark, str(tmp_path / "*.zip"), "data/protein.faa").collect()] == [">x", "MA"]
    t = write(tmp_path, "t.tsv", "Gene name\tChromosome\tStart\nA\t1\t5\n\tMT\tx\n")
    assert rows(files.attribute_table(spark, t)) == [(None, "MT", None), ("A", "1", 5)]
    with pytest.raises(ValueError):
        files.attribute_table(spark, write(tmp_path, "u.tsv", "a\tb\n1\t2\n"))
    assert files.present(spark, t) and not files.present(spark, str(tmp_path / "none"))
    spark.range(1).write.parquet(str(tmp_path / "p"))
    assert files.present(spark, str(tmp_path / "p"))
    (tmp_path / "p" / "_SUCCESS").unlink()
    assert not files.present(spark, str(tmp_path / "p"))


def test_graph_files_keep_attributes(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "gene", None), ("c", "<x>", 2)], "id string, kind string, n int")
    edges = spark.createDataFrame([("a & b", "c", None, "p,q")], "src string, dst string, signal string, pathways string")
    sinks.graphml_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.graphml_graph(spark, str(tmp_path / "g"))
    assert {r["id"]: r["attributes"] for r in n.collect()} == {"a & b": {"kind": "gene", "n": "0"}, "c": {"kind": "<x>", "n": "2"}}
    assert [tuple(r) for r in e.collect()] == [("a & b", "c", {"signal": "0", "pathways": "p,q"})]


def test_lines_are_numbered_in_the_order_of_names(spark, tmp_path):
    write(tmp_path, "n/a.txt", "1\n2\n")
    write(tmp_path, "n/b.txt", "\n".join(str(i) for i in range(3, 500)))
    assert {(int(r["value"]), r["no"]) for r in files.numbered_lines(spark, str(tmp_path / "n")).collect()} == {(i, i) for i in range(1, 500)}


def test_unique_names_with_nulls_and_a_hot_name(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), (None, 1), (None, 2)], "name string, ord int").repartition(5)
    got = {(r["name"], r["ord"]): r["unique_name"] for r in scalars.unique_names(df, "name", "ord").collect()}
    assert got == {**{("hot", i): f"hot-{i}" if i else "hot" for i in range(50)}, ("b", 1): "b", (None, 1): None, (None, 2): None}
    assert scalars.unique_names(df.limit(0), "name", "ord").count() == 0
