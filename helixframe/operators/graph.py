"""Edge tables: merging, bypassing, splitting, expanding, clustering."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, written


def last_writer_wins(edges: DataFrame, keys: Sequence[str], order: str, attributes: Sequence[str]) -> DataFrame:
    """One row per key; every attribute is the last one that is not null, by ``order``."""
    return edges.groupBy(*keys).agg(*[F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes])


def undirected(edges: DataFrame, src: str, dst: str, order: str, attributes: Sequence[str]) -> DataFrame:
    """Edges keyed on (least, greatest) end, the last row winning whole."""
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    last = F.max_by(F.struct(*attributes), order)
    return e.groupBy(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).agg(last.alias("_a")).select("u", "v", "_a.*")


def symmetrised(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Every edge and its reverse with the same attributes."""
    back = edges.select(*[F.col(dst).alias(src) if c == src else F.col(src).alias(dst) if c == dst else F.col(c) for c in edges.columns])
    return edges.unionByName(back)


def without_self_loops(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.where(F.col(src) != F.col(dst))


def without_isolates(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Nodes that some edge touches."""
    touched = edges.select(F.col(src).alias(node)).union(edges.select(F.col(dst).alias(node))).distinct()
    return nodes.join(touched, node, "left_semi")


def without_pathway_nodes(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str, pattern: str = r"^(PATH:|TITLE:)") -> tuple[DataFrame, DataFrame]:
    """Nodes whose upper-case name does not match, and the edges between them."""
    kept = nodes.where(~F.upper(F.col(node)).rlike(pattern))
    ends = kept.select(F.col(node).alias("_n"))
    return kept, edges.join(ends, F.col(src) == F.col("_n"), "left_semi").join(ends, F.col(dst) == F.col("_n"), "left_semi")


def bypass(edges: DataFrame, compounds: DataFrame, hub: int = 1000) -> DataFrame:
    """``src``, ``dst``, ``via``, ``pathways``: gene to gene over one compound, provenance of both hops joined, no self loops.

    ``edges`` has ``src``, ``dst``, ``pathway``; ``compounds`` has ``node``. A hub compound joins all that lead to it with
    all that follow: its rows are cut into slices of ``hub`` genes on the one side, each of which meets the whole other side.
    """
    # provenance is folded per hop first, so the join forms one row per (gene, compound, gene)
    into = edges.join(compounds, F.col("dst") == F.col("node"), "left_semi").join(compounds, F.col("src") == F.col("node"), "left_anti").groupBy(F.col("src").alias("a"), F.col("dst").alias("via")).agg(F.collect_set("pathway").alias("s1"))
    out = edges.join(compounds, F.col("src") == F.col("node"), "left_semi").join(compounds, F.col("dst") == F.col("node"), "left_anti").groupBy(F.col("src").alias("via"), F.col("dst").alias("b")).agg(F.collect_set("pathway").alias("s2"))
    slices = into.groupBy("via").agg(F.ceil(F.count(F.lit(1)) / F.lit(hub)).cast("int").alias("n"))
    out = out.join(slices, "via").select("via", "b", "s2", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    into = into.join(slices, "via").select("a", "via", "s1", F.pmod(F.xxhash64("a"), "n").cast("int").alias("slice"))
    hop = into.join(out, ["via", "slice"]).where("a <> b").select("a", "b", "via", F.array_sort(F.array_union("s1", "s2")).alias("s"))
    r = hop.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("via").alias("via"), F.flatten(F.collect_set("s")).alias("s"))
    return r.select("src", "dst", "via", F.array_join(F.array_sort(F.array_distinct("s")), ",").alias("pathways"))


def collapse_compounds(edges: DataFrame, compounds: DataFrame) -> DataFrame:
    """The edges between genes with compounds bypassed and removed; a bypass replaces a direct edge of the same ends."""
    over = bypass(edges, compounds).withColumn("_o", F.lit(1))
    ends = compounds.select("node")
    direct = edges.join(ends, F.col("src") == F.col("node"), "left_anti").join(ends, F.col("dst") == F.col("node"), "left_anti")
    direct = direct.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("pathway")), ",").alias("pathways")).select("src", "dst", F.lit(None).cast("string").alias("via"), "pathways", F.lit(0).alias("_o"))
    return last_writer_wins(direct.unionByName(over), ["src", "dst"], "_o", ["via", "pathways"])


def split_complexes(edges: DataFrame, src: str = "src", dst: str = "dst", sep: str = "-") -> DataFrame:
    """Members of both ends against each other, without self loops; distinct."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(F.explode(F.split(src, sep)).alias(src), dst, *rest).select(src, F.explode(F.split(dst, sep)).alias(dst), *rest).where(F.col(src) != F.col(dst)).distinct()


def expand_groups(members: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root``, ``leaf``: all members of a group at any depth that are no groups themselves. Pairs met before end a cycle.

    ``members`` has ``parent``, ``child``; ``roots`` has ``root``. Groups deeper than ``max_depth``, if given, are an error.
    """
    groups = members.select(F.col("parent").alias("leaf")).distinct()
    seen = front = checkpointed(roots.select("root", F.col("root").alias("leaf")).distinct())
    depth = 0
    while True:
        step = front.join(members, F.col("leaf") == F.col("parent")).select("root", F.col("child").alias("leaf")).distinct()
        front = checkpointed(step.join(seen, ["root", "leaf"], "left_anti"))
        if front.isEmpty():
            return seen.join(groups, "leaf", "left_anti").select("root", "leaf")
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"groups nested deeper than {max_depth}")
        seen = seen.union(front)


#: Relation subtypes, by priority, and the signal they mean.
RELATIONS = [(("activation", "expression", "glycosylation"), "a"), (("inhibition", "repression"), "i"), (("dephosphorylation",), "i"), (("ubiquitination",), "i"), (("phosphorylation",), "a")]


def relation_signal(subtypes):
    """'a', 'i' or '0' of an array of subtypes."""
    c = F.when(F.lit(False), "0")
    for names, signal in RELATIONS:
        c = c.when(F.arrays_overlap(subtypes, F.array(*map(F.lit, names))), signal)
    return c.otherwise("0")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = 2000) -> DataFrame:
    """``query_id``, ``neighbour_id``, ``rank_no``: exact Euclidean neighbours of a stated query set against all rows.

    Queries go out in blocks of ``block`` vectors (512 floats each: 4 MB) and every task keeps the best ``k`` of its rows, so
    ``k`` rows per query and task are shuffled, never the pairs. Beyond one block each is joined, written and released in
    its turn. Equal distances go by id.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession

    def blocks():
        held = []
        for r in queries.where(F.col(vector).isNotNull()).select(key, vector).orderBy(key).toLocalIterator():
            held.append(r)
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    def part(rows: list):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def best(batches):
            ids, q = shared.value
            held = None
            for b in batches:
                x, n = np.stack(b["v"].to_numpy()).astype(np.float64), b["id"].to_numpy()
                d = np.round(((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]), 6)
                d[ids[:, None] == n[None, :]] = np.inf
                nn = np.broadcast_to(n, d.shape)
                if held is not None:
                    d, nn = np.concatenate([held[0], d], 1), np.concatenate([held[1], nn], 1)
                o = np.lexsort((nn, d), axis=1)[:, :k]
                held = np.take_along_axis(d, o, 1), np.take_along_axis(nn, o, 1)
            if held is not None:
                f = np.isfinite(held[0])
                yield pd.DataFrame({"query_id": np.repeat(ids, held[0].shape[1])[f.ravel()], "neighbour_id": held[1][f], "d": held[0][f]})

        return vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(best, "query_id long, neighbour_id long, d double"), shared

    todo = blocks()
    first, second = next(todo, None), next(todo, None)
    if first is None:
        return spark.createDataFrame([], "query_id long, neighbour_id long, rank_no int")
    if second is None:
        return _closest(part(first)[0], k)
    out = None
    for rows in chain((first, second), todo):
        found, shared = part(rows)
        found = written(_closest(found, k))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _closest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("d", "neighbour_id")
    return pairs.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k).select("query_id", "neighbour_id", "rank_no")


def _centres(x, lists: int, rounds: int = 8):
    """Centres of ``lists`` groups of the sampled vectors (Lloyd's algorithm from evenly taken rows)."""
    import numpy as np

    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((c * c).sum(1) - 2 * p @ c.T, axis=1) for p in np.array_split(x, max(1, len(x) * lists // 10_000_000))])
        size = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        used = size > 0
        c[used] = np.add.reduceat(x[order], starts[used], axis=0) / size[used, None]
    return c


def neighbour_graph(vectors: DataFrame, key: str, vector: str, k: int = 10, probes: int = 12, sample_rows: int = 50_000, most_lists: int = 4096, slice_rows: int = 4096) -> DataFrame:
    """``query_id``, ``neighbour_id``, ``rank_no``: Euclidean neighbours of *every* row, by an index of inverted lists.

    Centres are fitted on at most ``sample_rows`` rows (those with the least hashes of their keys; the one sample taken),
    about the square root of the rows in number, ``most_lists`` at most. Every row is put into the list of its nearest centre
    and looks for neighbours in the ``probes`` nearest lists, exactly there. A list longer than ``slice_rows`` is cut on both
    sides, so no task holds more than two slices. The k-th nearest of the own list bounds what the others may send and which
    of them are asked at all, which loses nothing. A row whose lists hold fewer than ``k`` others has fewer neighbours; with
    no more lists than probes the result is exact. Equal distances go by id; null vectors take no part.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, neighbour_id long, rank_no int")
    lists = int(min(most_lists, max(1, round(n**0.5))))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toLocalIterator()], np.float64)
    shared = spark.sparkContext.broadcast(_centres(sample, min(lists, len(sample))))

    def assign(batches):
        c = shared.value
        most = min(probes, len(c))
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(np.float64)
            d = (c * c).sum(1)[None, :] - 2 * x @ c.T
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            own = d.argmin(1)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "own": own.astype(np.int32), "near": list(near.astype(np.int32))})

    def nearest(y, me, x, ids, bound=None):
        """(row of ``y``, id, squared distance to six digits) of its ``k`` nearest others; no farther than ``bound``."""
        parts = []
        xx = (x * x).sum(1)[None, :]
        for at in range(0, len(y), 128):
            q, own = y[at : at + 128], me[at : at + 128]
            d = -2 * q @ x.T
            d += xx
            d += (q * q).sum(1)[:, None]
            # of all only those near the k-th (a row may meet itself) are rounded and put in order
            far = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k + 1 else np.full(len(q), np.inf)
            if bound is not None:
                far = np.minimum(far, bound[at : at + 128])
            i, j = np.nonzero(d <= far[:, None] + 2e-6)
            other = ids[j] != own[i]
            i, j = i[other], j[other]
            v = np.round(d[i, j], 6)
            o = np.lexsort((ids[j], v, i))
            i, j, v = i[o], j[o], v[o]
            starts = np.searchsorted(i, np.arange(len(q)))
            first = np.arange(len(i)) - starts[i] < k
            parts.append((i[first] + at, ids[j[first]], v[first]))
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        """How far the k-th nearest is at most, by a slice of the own list, and the lists that may hold nearer ones."""
        c, x, ids = shared.value, np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()
        i, _, d = nearest(x, ids, x, ids)
        last = np.searchsorted(i, np.arange(len(x)), "right") - 1
        bound = np.where(np.bincount(i, minlength=len(x)) == k, d[np.maximum(last, 0)] if len(d) else np.inf, np.inf)
        near, own = np.stack(pdf["near"].to_numpy()), pdf["own"].to_numpy()
        # a list's rows lie on the far side of the plane midway between its centre and the own one
        away = ((x[:, None, :] - c[near]) ** 2).sum(2) - ((x - c[own]) ** 2).sum(1)[:, None]
        apart = 2 * np.sqrt(((c[own][:, None, :] - c[near]) ** 2).sum(2))
        kept = (near == own[:, None]) | (away <= apart * np.sqrt(np.maximum(bound, 0) + 1e-5)[:, None] * (1 + 1e-9) + 1e-9)
        return pd.DataFrame({"id": ids, "v": pdf["v"], "own": own, "near": [n[f] for n, f in zip(near, kept, strict=True)], "bound": bound})

    placed = written(rows.mapInPandas(assign, "id long, v array<double>, own int, near array<int>"))
    slices = lambda name: F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("int").alias(name)
    own_slices = placed.groupBy("own").agg(slices("ms"))
    placed = written(placed.join(own_slices, "own").withColumn("m", F.pmod(F.xxhash64("id"), "ms")).groupBy("own", "m").applyInPandas(bounded, "id long, v array<double>, own int, near array<int>, bound double"))
    asked = placed.select("id", "v", "bound", F.explode("near").alias("list"))
    sizes = placed.groupBy(F.col("own").alias("list")).agg(slices("ms")).join(asked.groupBy("list").agg(slices("qs")), "list")
    spread = lambda own, other, a, b: (F.pmod(F.xxhash64("id"), own).cast("int").alias(a), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(b))
    members = placed.select("id", "v", F.col("own").alias("list")).join(sizes, "list").select("list", "id", "v", *spread(F.col("ms"), "qs", "m", "q"))
    queries = asked.join(sizes, "list").select("list", F.col("id").alias("qid"), F.col("v").alias("qv"), "bound", *spread(F.col("qs"), "ms", "q", "m"))
    queries, members = queries.toDF("ql", "qid", "qv", "bound", "qq", "qm"), members.toDF("ml", "id", "v", "mm", "mq")

    def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "neighbour_id": np.zeros(0, np.int64), "d": np.zeros(0)})
        y, me = np.stack(q["qv"].to_numpy()).astype(np.float64), q["qid"].to_numpy()
        i, ids, d = nearest(y, me, np.stack(m["v"].to_numpy()).astype(np.float64), m["id"].to_numpy(), q["bound"].to_numpy())
        return pd.DataFrame({"query_id": me[i], "neighbour_id": ids, "d": d})

    found = queries.groupBy("ql", "qm", "qq").cogroup(members.groupBy("ml", "mm", "mq")).applyInPandas(search, "query_id long, neighbour_id long, d double")
    return _closest(found, k)


def communities(edges: DataFrame, most_nodes: int = 4_000_000) -> DataFrame:
    """``node``, ``label``: weighted label propagation over ``i``, ``j``, ``w`` (in place of a modularity method; labels differ from it).

    Ties go to the least label, and each round is checkpointed. It ends when no label moves any more, or when a round
    gives labels that an earlier round gave (told by a fingerprint of all of them), since they would go round for ever.
    Votes are compared to nine digits, so that a tie is one in any order of adding. Up to ``most_nodes`` whole-numbered
    nodes are sent to the tasks with their labels in each round, 12 bytes each; else rounds are joins. Labels are the same.
    """
    both = written(edges.select("i", "j", "w").union(edges.select("j", "i", "w")).where("i <> j"))
    if both.schema["i"].dataType.simpleString() in ("bigint", "int"):
        nodes = both.select(F.col("i").alias("node")).distinct()
        if nodes.count() <= most_nodes:
            return _communities_by_number(both, nodes)
    labels = strength = both.groupBy(F.col("i").alias("node")).agg(F.max("w").alias("w")).withColumn("label", F.col("node"))
    labels = labels.select("node", "label")
    met = set()
    while True:
        votes = both.join(labels, F.col("j") == F.col("node")).groupBy(F.col("i").alias("node"), "label").agg(F.sum("w").alias("w"))
        # a node's own label votes like its strongest neighbour, so that pairs do not swap for ever
        own = labels.join(strength.select("node", "w"), "node").select("node", "label", "w")
        votes = votes.unionByName(own).groupBy("node", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("node").agg(F.max("w").alias("top"))
        labels = checkpointed(votes.join(best, "node").where("w = top").groupBy("node").agg(F.min("label").alias("label")))
        mark = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if mark in met:
            return labels
        met.add(mark)


def _communities_by_number(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """``communities`` where the labels of all nodes fit a task: every task keeps its nodes' edges, packed, from round to round."""
    import hashlib

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    spark = both.sparkSession
    sc = spark.sparkContext
    names = np.sort(nodes.toArrow()["node"].to_numpy())
    shared = sc.broadcast(names)

    def pack(batches):
        """Edges come sorted by ``i``: rows of nodes, number of edges of each, other ends and weights, as bytes."""

        def row(t):
            i, j = (np.searchsorted(shared.value, t[c]).astype(np.int32) for c in "ij")
            node, n = np.unique(i, return_counts=True)
            w = t["w"].astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (node, n.astype(np.int32), j, w)], ["n", "c", "j", "w"])

        held = None
        for b in batches:
            t = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "ijw"}
            held = t if held is None else {c: np.concatenate([held[c], t[c]]) for c in "ijw"}
            if len(held["i"]) >= 200_000:
                cut = np.searchsorted(held["i"], held["i"][-1])  # the last node may go on
                if cut:
                    yield row({c: x[:cut] for c, x in held.items()})
                    held = {c: x[cut:] for c, x in held.items()}
        if held is not None and len(held["i"]):
            yield row(held)

    packed = written(both.repartition(2 * sc.defaultParallelism, "i").sortWithinPartitions("i").mapInArrow(pack, "n binary, c binary, j binary, w binary"))
    labels = np.arange(len(names), dtype=np.int32)
    moved = np.ones(len(names), bool)
    met = set()
    while True:
        sent = sc.broadcast((labels, moved))

        def vote(batches, sent=sent):
            labels, moved = sent.value
            for b in batches:
                for r in range(b.num_rows):
                    node, c, j, w = (np.frombuffer(b.column(x)[r].as_buffer(), t) for x, t in enumerate((np.int32, np.int32, np.int32, np.float64)))
                    # only a node that moved, or has a neighbour that did, may move now
                    at = np.concatenate([[0], np.cumsum(c)])
                    live = np.logical_or.reduceat(moved[j], at[:-1]) | moved[node]
                    node, top = node[live], np.maximum.reduceat(w, at[:-1])[live]
                    if not len(node):
                        continue
                    edge = np.repeat(live, c)
                    of = np.concatenate([np.repeat(np.arange(len(node)), c[live]), np.arange(len(node))])
                    key = of.astype(np.int64) << 32 | np.concatenate([labels[j[edge]], labels[node]])
                    o = np.argsort(key, kind="stable")
                    key, w = key[o], np.concatenate([w[edge], top])[o]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    key, w = key[first], np.round(np.add.reduceat(w, first), 9)
                    of = key >> 32
                    best = np.maximum.reduceat(w, np.searchsorted(of, np.arange(len(node))))
                    key = key[w == best[of]]  # still in order: the first of a node has the least label
                    label = (key[np.searchsorted(key >> 32, np.arange(len(node)))] & 0xFFFFFFFF).astype(np.int32)
                    changed = label != labels[node]
                    yield pa.RecordBatch.from_arrays([pa.array([node[changed].tobytes()], pa.binary()), pa.array([label[changed].tobytes()], pa.binary())], ["n", "l"])

        labels, moved = labels.copy(), np.zeros(len(names), bool)
        for r in packed.mapInArrow(vote, "n binary, l binary").toLocalIterator():
            n = np.frombuffer(bytes(r["n"]), np.int32)
            moved[n], labels[n] = True, np.frombuffer(bytes(r["l"]), np.int32)
        sent.destroy()
        mark = hashlib.sha256(labels.tobytes()).digest()
        if mark in met or not moved.any():
            break
        met.add(mark)
    last = sc.broadcast(labels)

    def named(batches):
        for b in batches:
            label = last.value[np.searchsorted(shared.value, b["node"].to_numpy())]
            yield pd.DataFrame({"node": b["node"], "label": shared.value[label]})

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.mapInPandas(named, f"node {kind}, label {kind}")
