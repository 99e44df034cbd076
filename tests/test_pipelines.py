"""Composite pipelines on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import factors, graph, identifiers, metrics, pipelines
from helixframe.plans import omics_queries

from .conftest import rows
from .test_files import KGML, write


def counts(spark, prefix, n):
    return spark.range(40 * n).selectExpr("concat('c', id % 40) AS cell", f"concat('{prefix}', id DIV 40) AS feature", "CAST(1 + id * 7 % (5 + id % 3) AS DOUBLE) AS value").where("value <> 2")


def test_qc_keeps_named_features(spark):
    c = counts(spark, "g", 12)
    mito = F.col("feature") == "g0"
    all_ = pipelines.rna_qc(c, mito, 5, (1, 50), (1, 1000), 50.0)
    assert all_.count() > 0 and set(all_.columns) == {"cell", "feature", "value", "norm", "log1p", "variable"}
    keep = spark.createDataFrame([("g3",)], "feature string")
    some = pipelines.rna_qc(c, mito, 5, (1, 50), (1, 1000), 50.0, keep, True)
    named = {r[0] for r in some.select("feature").distinct().collect()}
    assert "g3" in named and named == {"g3"} | {r[0] for r in all_.where("variable").select("feature").distinct().collect()}
    assert pipelines.atac_qc(c, 5, (1, 50), (1, 1000)).where("tfidf IS NULL").count() == 0


def test_integrate_metacells_and_samples(spark):
    rna, atac = counts(spark, "g", 6), counts(spark, "p", 5).where("cell <> 'c7'")
    emb, clusters, ranked = pipelines.integrate(rna, atac, 3, 5)
    assert emb.count() == 39 == clusters.count() and ranked.where("p_adj < p - 1e-12").count() == 0
    w = spark.range(39).selectExpr("concat('c', id) AS i", "concat('c', id + 1) AS j", "1.0D AS w")
    a, b = pipelines.metacells(w, rna, atac)
    assert {r[0] for r in a.select("symbol").distinct().collect()} == {f"G{i}" for i in range(6)} and b.count() > 0
    samples = pipelines.stability_samples([rna, atac], 0.7, 2)
    assert [[t.select("cell").distinct().count() for t in s] for s in samples] == [[27, 27], [27, 27]]


def test_build_networks(spark, tmp_path):
    write(tmp_path, "k/mmu001.xml", KGML)
    got = pipelines.build_networks(
        spark, "mm10", write(tmp_path, "r.tsv", "a\tb\tActivation\t2,1\nA\tB\tRepression\t3\n"), write(tmp_path, "l.txt.gz", "protein1 protein2 combined_score\np1 p2 800\n"),
        write(tmp_path, "i.tsv.gz", "#id\tpreferred_name\np1\tx\np2\ty\n"), str(tmp_path / "k"), str(tmp_path / "out"),
    )
    assert rows(got["trrust"].select("TF", "TG", "trrust_sign", "trrust_pmids", "trrust_support_n")) == [("A", "B", 1, "1,2,3", 2)]
    assert rows(got["string"].select("TF", "TG", "string_combined_score")) == [("X", "Y", 0.8)]
    assert got["kegg"].where("kegg_signal = -1").count() == 3 and got["kegg"].select("source_db").distinct().first()[0] == "kegg"


METABOLIC = """<?xml version="1.0"?><pathway name="path:x">
<entry id="1" name="mmu:1" type="gene" reaction="rn:R1"/><entry id="2" name="mmu:2" type="gene" reaction="rn:R2"/><entry id="3" name="mmu:3 ko:K00009" type="gene"/>
<entry id="4" name="undefined" type="group"><component id="5"/></entry><entry id="5" name="undefined" type="group"><component id="3"/></entry>
<entry id="6" name="path:mmu00020" type="map"/><entry id="7" name="cpd:C00002" type="compound"/>
<relation entry1="4" entry2="1" type="PPrel"><subtype name="activation"/></relation>
<relation entry1="1" entry2="2" type="PPrel"><subtype name="activation"/></relation>
<relation entry1="6" entry2="7" type="maplink"><subtype name="compound"/></relation><relation entry1="6" entry2="3" type="maplink"><subtype name="compound"/></relation>
<relation entry1="7" entry2="3" type="PCrel"><subtype name="activation"/></relation>
<reaction id="8" name="rn:R1" type="irreversible"><substrate name="cpd:C00001"/><product name="cpd:C00002"/></reaction>
<reaction id="9" name="rn:R2" type="irreversible"><substrate name="cpd:C00002"/><product name="cpd:C00003"/></reaction></pathway>"""


def test_build_networks_bypasses_compounds(spark, tmp_path):
    write(tmp_path, "k/mmu00010.xml", METABOLIC)
    write(tmp_path, "k/mmu00011.xml", METABOLIC.replace('reaction="rn:R1"', ""))
    got = pipelines.build_networks(
        spark, "mm10", write(tmp_path, "r.tsv", "a\tb\tActivation\t2,1\n"), write(tmp_path, "l.txt", "protein1 protein2 combined_score\np1 p2 800\n"), write(tmp_path, "i.tsv", "#id\tpreferred_name\np1\tx\np2\ty\n"),
        str(tmp_path / "k"), str(tmp_path / "out"), genes=write(tmp_path, "g.tsv", "mmu:1\tCDS\t1\tGa, Gz; x\nmmu:2\tCDS\t1\tGb; y\nmmu:3\tCDS\t1\tGc; z\n"), orthologs=write(tmp_path, "ko.txt", "D      K00009  KOA, KOB; w\n"),
    )
    both = "mmu00010,mmu00011"
    # Gc and KOA share an entry: they are bypassed to as that entry, within the pathway, and not over all pathways
    want = [("GA", "GB", 0, both), ("GA", "GC", 0, "mmu00010"), ("GA", "KOA", 0, "mmu00010"), ("GC", "GA", 1, both), ("KOA", "GA", 1, both)]
    assert rows(got["kegg"].select("TF", "TG", "kegg_signal", "kegg_pathways")) == want


def test_joint_clusters_takes_every_feature(spark, monkeypatch):
    views = {"counts": counts(spark, "f", 70), "counts2": counts(spark, "s", 60)}
    seen = []
    monkeypatch.setattr(omics_queries, "view", lambda s, d, name: views[name])
    monkeypatch.setattr(omics_queries.pipelines, "integrate", lambda a, b, *n: seen.extend([a, b]) or (a, a, a))
    omics_queries.joint_clusters(spark, "")
    assert [t.select("feature").distinct().count() for t in seen] == [70, 60]


def test_atac_clusters(spark):
    import numpy as np

    c = spark.range(40 * 12).selectExpr("concat('c', id % 40) AS cell", "concat('chr1:', id DIV 40 * 1000, '-', id DIV 40 * 1000 + 500) AS feature", "CAST(1 + id * 7 % (5 + id % 3) AS DOUBLE) AS value").where("value <> 2")
    # every other peak is variable; one cell has none of them
    kept = pipelines.atac_qc(c, 5, (1, 50), (1, 1000)).withColumn("variable", F.expr("int(regexp_extract(feature, ':([0-9]+)', 1)) % 2000 = 0")).where("NOT (variable AND cell = 'c3')")
    tss = spark.createDataFrame([(0, "chr1", 4100, "Near"), (1, "chr1", 900_000, "Far")], "ord long, chrom string, tss long, gene string")
    got = pipelines.atac_clusters(kept, tss, 4, 3, 5)
    cells = {r[0] for r in kept.select("cell").distinct().collect()}
    assert "c3" in cells and all({r[0] for r in got[k].select("cell").distinct().collect()} == cells for k in ("lsi", "pca", "clusters"))
    assert {len(r[0]) for r in got["lsi"].select("embedding").collect()} == {3} and {len(r[0]) for r in got["pca"].select("embedding").collect()} == {3}
    assert got["neighbours"].count() == 5 * len(cells) and got["neighbours"].where("i = j").count() == 0
    names, peaks = sorted(cells), sorted({r[0] for r in kept.where("variable").select("feature").collect()})
    x = np.zeros((len(names), len(peaks)))
    for r in kept.where("variable").collect():
        x[names.index(r["cell"]), peaks.index(r["feature"])] = r["log1p"]
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    mine = {r["cell"]: r["embedding"] for r in got["pca"].collect()}
    assert np.allclose(np.abs([mine[n] for n in names]), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    assert {(r["start"], r["gene"], r["peak_type"]) for r in got["annotation"].collect()} == {(p, "Near", "promoter" if p == 4000 else "distal") for p in range(0, 12000, 2000)}


def test_factors_against_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(factors, "BLOCK", 7)
    monkeypatch.setattr(factors, "CHUNK", 50)
    rnd = np.random.default_rng(4)
    x = (rnd.random((60, 90)) < 0.2) * rnd.random((60, 90)) @ np.diag(np.linspace(3, 0.1, 90))
    x[:, 5] = 0  # an empty feature has no number
    x[7] = 0
    x[7, 3] = 1e-3
    data = [(f"c{i:02d}", f"f{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    df = spark.createDataFrame(data, "cell string, feature string, value double").repartition(4)
    rows_, n = factors.sparse_rows(df)
    x = np.delete(x, np.flatnonzero(~x.any(0)), axis=1)
    assert n == x.shape[1]
    for scale, extra in ((False, 54), (True, 12)):
        z = x - x.mean(0)
        z = z / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1) if scale else z
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        axes, off, top = factors.decompose(rows_, "cell", n, 4, True, scale, extra=extra, tolerance=1e-10)
        assert np.allclose(top, s[:4], rtol=1e-6) and np.allclose(np.abs(x @ axes - off), np.abs(u[:, :4] * s[:4]), atol=1e-3)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = {r["cell"]: r["embedding"] for r in factors.lsi(rows_, "cell", n, 4).collect()}
    assert np.allclose(np.abs([got[f"c{i:02d}"] for i in range(60)]), np.abs(u[:, 1:4]), atol=1e-4)
    assert factors.pca(rows_.limit(0), "cell", n, 3).count() == 0
    with pytest.raises(ValueError):
        factors.decompose(rows_, "cell", n, 4, most_bytes=100)


def test_factors_of_a_flat_spectrum_take_few_passes(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 150))
    rows_ = spark.createDataFrame([(i, list(range(150)), [float(v) for v in r]) for i, r in enumerate(x)], "cell long, idx array<int>, val array<double>").repartition(2)
    passes, gathered = [], factors._gathered
    monkeypatch.setattr(factors, "_gathered", lambda *a: passes.append(1) or gathered(*a))
    top = factors.decompose(rows_, "cell", 150, 5)[2]
    assert len(passes) <= 12 and np.allclose(top, np.linalg.svd(x - x.mean(0), compute_uv=False)[:5], rtol=1e-5)


def test_communities_are_the_same_by_joins(spark):
    rnd = random.Random(3)
    data = [(i * 7, j * 7, 1.0 / r) for i in range(60) for r, j in enumerate(rnd.sample([n for n in range(i - i % 12, i - i % 12 + 12) if n != i], 4) + [rnd.randrange(60)], 1)]
    edges = spark.createDataFrame(data, "i long, j long, w double").repartition(3)
    assert rows(graph.communities(edges)) == rows(graph.communities(edges, most_nodes=0))


def test_neighbour_graph_recall(spark):
    """The index against brute force: at least 0.9 of the neighbours, every row asked, hot lists cut."""
    import numpy as np

    rnd = np.random.default_rng(6)
    x = np.concatenate([rnd.normal(size=(900, 12)), rnd.normal(size=(300, 12)) * 0.05 + 3]).round(4)
    data = [(i, [float(v) for v in x[i]]) for i in range(1200)] + [(5000, None)]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2).round(6)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :10]
    want = {(i, int(j)) for i in range(1200) for j in best[i]}
    got = {(r[0], r[1]) for r in graph.neighbour_graph(df, "id", "v", 10, slice_rows=100).collect()}
    assert len(got) == 12_000 and len(got & want) >= 0.9 * len(want)
    exact = {(r[0], r[1]) for r in graph.neighbour_graph(df, "id", "v", 10, probes=50).collect()}
    assert len(exact & want) >= 0.999 * len(want)
    few = df.where("id < 30")
    assert {tuple(r) for r in graph.nearest_neighbours(few, few, "id", "v", 5, block=7).collect()} == {tuple(r) for r in graph.nearest_neighbours(few, few, "id", "v", 5).collect()}
    assert graph.neighbour_graph(df.limit(0), "id", "v").count() == 0


def test_classifier_entry_points(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, (i * 37 % 100) / 100) for i in range(200)], "id int, y boolean, score double").select("id", F.col("y").cast("int").alias("label"), "score")
    r = metrics.classification_metrics(df, "id").first().asDict()
    assert set(r) == {"auroc", "auprc", "rand_auroc", "rand_auprc", "accuracy", "precision", "early_precision", "recall", "f1", "n_edges", "n_pos", "n_neg", "score_threshold"}
    assert r["n_edges"] == 200 and r["n_pos"] == 67 and r["early_precision"] == r["precision"] and abs(r["rand_auroc"] - 0.5) < 0.2
    drawn = metrics.permuted(df, "id")
    assert rows(drawn.select("score")) == rows(df.select("score")) and drawn.agg(F.sum("label")).first()[0] == 67
    one = metrics.classification_metrics(df.where("label = 1"), "id").first()
    assert one["auroc"] is None and one["rand_auprc"] is None and one["precision"] == 1.0
    assert {(x[0], x[1]) for x in metrics.curves(df).select("curve", "model").distinct().collect()} == {(c, m) for c in ("roc", "prc") for m in ("scores", "random")}
    assert {x[0] for x in metrics.curves(df, "roc").select("curve").distinct().collect()} == {"roc"}
    assert metrics.score_panel(df, "hist", 11).agg(F.sum("n")).first()[0] == 134 and metrics.score_panel(df, balance=False).count() == 100
    for bad in (lambda: metrics.curves(df, "pie"), lambda: metrics.score_panel(df, "pie")):
        with pytest.raises(ValueError):
            bad()


def test_species_layers_and_saved_tables(spark, tmp_path):
    peaks = spark.createDataFrame([("hg38.chr1:1-2", "hg38.g", "hg38.chr1:1-2"), ("mm10.chr1:1-2", "mm10.g", "mm10.chr1:1-2")], "feature string, gene_ids string, interval string")
    assert rows(pipelines.one_species(peaks)) == [("chr1:1-2", "g", "chr1:1-2")]
    assert pipelines.one_species(peaks.where("feature LIKE 'mm10%'")).count() == 1
    rna = spark.createDataFrame([("gata1", "c1", 3.0, 0.5)], "feature string, cell string, counts double, log1p double")
    at = pipelines.save_processed(rna, rna.drop("log1p"), str(tmp_path))
    assert rows(spark.read.parquet(at["rna"])) == [("GATA1", "c1", 0.5)] and rows(spark.read.parquet(at["atac"])) == [("gata1", "c1", 3.0)]


def test_canonicaliser(spark):
    genes = spark.createDataFrame([("1", "KRÉK", "al|x", "Ensembl:ENSG1", 0), ("2", "Bb", "-", "-", 1)], "gene_id string, symbol string, synonyms string, dbxrefs string, ord int")
    gtf = spark.createDataFrame([("ENSG1.4", "old", 0), ("ENSG7.1", "Dd", 1), ("ENSG8", None, 2)], "gene_id string, gene_name string, ord int")
    c = identifiers.Canonicaliser(gtf, genes)
    got = {r["v"]: r["symbol"] for r in c.series(spark.createDataFrame([(x,) for x in ("ensg1", "ENSG7", "al", "2", "dd", "zz", "")], "v string"), "v").collect()}
    assert got == {"ensg1": "KREK", "ENSG7": "DD", "al": "KREK", "2": "BB", "dd": "DD", "zz": "ZZ", "": ""}
    e = spark.createDataFrame([("al", "2", 1), ("..", "", 2), (None, "x", 3), ("Bb", "zz", 4)], "a string, b string, n int")
    out, dropped = c.table(e, "a", "b")
    assert out.columns == ["a", "b", "n"] and dropped == 2 and rows(out.select("a", "b")) == [("BB", "ZZ"), ("KREK", "BB")]
    assert tuple(c.coverage().first()) == (4, 2, 2, 2)
    only = identifiers.Canonicaliser(gtf)
    assert rows(only.series(spark.createDataFrame([("ENSG7",)], "v string"), "v")) == [("ENSG7", "DD", "ensembl")]
    with pytest.raises(ValueError):
        identifiers.Canonicaliser()


NESTED = """<pathway><entry id="1" name="mmu:1 mmu:2" type="gene" reaction="rn:R1"/><entry id="2" name="mmu:3" type="gene" reaction="rn:R2"/>
<entry id="3" name="mmu:4" type="gene"/><entry id="4" name="undefined" type="group"><component id="1"/></entry><entry id="5" name="undefined" type="group"><component id="4"/><component id="3"/></entry>
<entry id="6" name="path:mmu00099" type="map"/><entry id="7" name="cpd:C00005" type="compound"/>
<relation entry1="5" entry2="2" type="PPrel"><subtype name="inhibition"/></relation><relation entry1="6" entry2="2" type="maplink"/>
<relation entry1="3" entry2="2" type="PPrel"><subtype name="activation"/></relation>
<reaction name="rn:R1"><substrate name="cpd:C00004"/><product name="cpd:C00005"/></reaction><reaction name="rn:R2"><substrate name="cpd:C00005"/><product name="cpd:C00006"/></reaction></pathway>"""


def test_pathway_network_groups_hyphens_and_compounds(spark, tmp_path):
    """A group of a group, a symbol with a hyphen, a path over a compound; signals by file and relation order."""
    from helixframe.sources import files

    write(tmp_path, "k/mmu00020.xml", NESTED)
    names = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "H-X"), ("4", "D")], "code string, name string")
    got = rows(pipelines.pathway_network(files.kgml(spark, str(tmp_path / "k")), names).select("src", "dst", "signal", "pathway"))
    # A and B reach H-X as members of the nested group and over the compound, whose bypass comes over the relation
    want = [(a, b, "0", "mmu00020") for a in "AB" for b in "HX"] + [("D", b, "a", "mmu00020") for b in "HX"]
    assert got == sorted(want)
