"""The text problems against brute force, round trips and hand-made cases."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import leaks, lookalikes, mapping, packing, splitting, topn
from helixframe.llm.tokenizer import DEFAULT_RANKS, load

from ..conftest import rows

# mapping

NAMES = [("1", "ABCD12", 0), ("1", "p12-ZURI", 2), ("2", "ABCE12", 0), ("3", "FEB4", 0), ("4", "WYSKG", 0), ("4", "7001", 1), ("5", "KÜRT7", 0), ("5", "shared", 2), ("6", "QOLMER9", 0), ("6", "shared", 2), ("6", "QOLMER9", 0)]


def mapped(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    names = spark.createDataFrame(NAMES, "target string, name string, rank int")
    return {r["value"]: r["target"] for r in mapping.map_values(df, "value", names, "target", "name", "rank").collect()}


def test_mapping_forms(spark):
    want = {
        "abcd-12": "1", "ABCD12 protein": "1", "gene ABCD12": "1", "[TF] ABCD12;": "1", "p12_zuri": "1", "4-Feb": "3", "Feb-04": "3", "WYSK-gamma": "4", "wyskγ": "4", "GeneID:7001": "4",
        "KURT7": "5", "Kürt7": "5", "АBCD12": "1", "ＡＢＣＥ１２": "2", "AB​CD12": "1",
        "QOLMR9": "6", "QOLLMER9": "6", "QOMLER9": "6", "QOLMEX9": "6",
        "ABCX12": None,  # one slip from two targets
        "QOLMER8": None, "QLOMRE9": None, "shared": None, "-": None, "": None, "x" * 100_000: None,
    }
    got = mapped(spark, [*want, None, "abcd-12"])
    assert got == want


def test_mapping_finds_every_pair_within_one_slip(spark):
    rnd = random.Random(3)
    keys = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(60)})
    values = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(120)})

    def slips(a, b):
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + x + a[i:] for i in range(len(a) + 1) for x in "abc"} | {a[:i] + x + a[i + 1 :] for i in range(len(a)) for x in "abc"}
        near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return 0 if a == b else 1 if b in near else 2

    v = spark.createDataFrame([(x,) for x in values], "v string")
    k = spark.createDataFrame([(x, x, 0) for x in keys], "key string, target string, rank int")
    got = {(r["v"], r["key"], r["distance"]) for r in mapping.pigeonhole_pairs(v, k).collect()}
    assert got == {(a, b, slips(a, b)) for a in values for b in keys if slips(a, b) < 2}


def test_mapping_empty(spark):
    assert mapped(spark, []) == {} and mapped(spark, [None]) == {}


# look-alikes

PLAIN = {
    "WYЅKUG": "WYSKUG", "Κerna19 ": "Kerna19", "﻿AB​C1": "ABC1", "\U0001d416\U0001d400G2": "WAG2", "ＫÜＧ５": "KÜG5", "KÜG5": "KÜG5",
    "Mewup‑10а": "Mewup-10a", "GOGK12": "GOGK12", "DUQϹ8": "DUQC8", "Fοx1": "Fox1", "A B C": "A B C", " ": "", "ÅNX1": "ÅNX1", "x­\n": "x",
}


def test_repair(spark):
    same = ["WYSKU-γ", "ftanβ", "KÜG5", "plain", "", " tab\t\n", "слово", None, "ñ"]
    data = [(i, t, "p") for i, t in enumerate([*PLAIN, *same, "vocab aνb", "qνq", "AVB avb"])]
    df = spark.createDataFrame(data, "id int, t string, plain string")
    got = {r["t"]: r["plain"] for r in lookalikes.repair_text(df, ["id"], "t").collect()}
    # nu inside a token: replaced where the repaired token is in the vocabulary
    assert got == {**PLAIN, "vocab aνb": "vocab avb"}
    assert lookalikes.repair_text(df.limit(0), ["id"], "t").count() == 0
    # without the vocabulary only styled and invisible characters change
    strict = {r["t"]: (r["plain"], r["n_unknown"]) for r in lookalikes.repair_text(df, ["id"], "t", df.limit(0), "t", beyond_vocabulary=False).collect()}
    assert "Fοx1" not in strict and strict["ＫÜＧ５"] == ("KÜG5", 0) and strict["﻿AB​C1"] == ("ABC1", 0)
    names = spark.createDataFrame([("fox1, kug5",), (None,), ("Dúqc8",)], "n string")
    strict = {r["t"]: (r["plain"], r["n_unknown"]) for r in lookalikes.repair_text(df.union(df), ["id"], "t", names, "n", beyond_vocabulary=False).collect()}
    assert strict["Fοx1"] == ("Fox1", 0) and "DUQϹ8" not in strict and lookalikes.repair_text(df.union(df), ["id"], "t", names, "n").where("t = 'Fοx1'").count() == 2
    again = spark.createDataFrame([(i, v) for i, v in enumerate(PLAIN.values())], "id int, t string")
    assert lookalikes.repair_text(again, ["id"], "t").count() == 0


def test_repair_long(spark):
    df = spark.createDataFrame([(1, "АB1 " * 30_000)], "id int, t string")
    assert lookalikes.repair_text(df, ["id"], "t").first()["plain"] == ("AB1 " * 30_000).strip()


# top n


@pytest.mark.parametrize("flush", [1, 1_000_000])
def test_top_n(spark, flush):
    rnd = random.Random(flush)
    data = [(rnd.choice([None, "hot", "hot", *map(str, range(9))]), rnd.choice([None, "a", "b", "é", "\U0001d400", "Ａ", *[f"i{n}" for n in range(20)]]), rnd.choice([None, 0.1, 0.5, 0.5, 0.9])) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, i string, s double").withColumn("r", F.lit(1))
    want = {}
    for g, i, s in data:
        if g is not None and s is not None:
            want.setdefault(g, {})[i] = max(s, want.get(g, {}).get(i, -1))
    want = {(g, i, s, n) for g, m in want.items() for n, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))[:10], 1)}
    assert {tuple(r) for r in topn.top_n(df.repartition(5), "g", "i", "s", 10, flush).collect()} == want
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0


@pytest.mark.parametrize("flush", [50_000, 1_000_000])
def test_top_n_of_a_task_of_many_rows(spark, flush):
    # one task folds several times: 20 items in each of 10,000 groups, then the same with better scores, then worse ones
    df = spark.range(0, 600_000, 1, 1).selectExpr("concat('g', id % 10000) AS g", "concat('i', lpad(id DIV 10000 % 20, 2, '0')) AS i", "CAST(id DIV 10000 % 20 + array(0, 100, 50)[int(id DIV 200000)] AS DOUBLE) AS s")
    got = topn.top_n(df, "g", "i", "s", 3, flush)
    assert {tuple(r) for r in got.groupBy("i", "s", "rank_no").count().collect()} == {("i19", 119.0, 1, 10_000), ("i18", 118.0, 2, 10_000), ("i17", 117.0, 3, 10_000)}


def test_top_n_ranks_nan_above_infinity(spark):
    nan, inf = float("nan"), float("inf")
    data = [("g", "a", inf), ("g", "b", nan), ("g", "c", 1.0), ("g", "b", 5.0), ("g", "d", nan), ("h", "a", -inf), ("h", None, nan), ("h", None, 2.0)]
    got = rows(topn.top_n(spark.createDataFrame(data, "g string, i string, s double").repartition(3), "g", "i", "s", 3))
    assert {(r[0], r[1], str(r[2]), r[3]) for r in got} == {("g", "a", "inf", 3), ("g", "b", "nan", 1), ("g", "d", "nan", 2), ("h", "a", "-inf", 2), ("h", None, "nan", 1)}


# packing


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(sizes):
    place, left = packing.best_fit_decreasing(sizes, 50)
    want_left, want = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in want_left if r >= sizes[k]]
        if fits:
            want_left[want_left.index(min(fits))] -= sizes[k]
        else:
            want_left.append(50 - sizes[k])
    assert sorted(left) == sorted(want_left)  # containers of equal rest are interchangeable
    for b, rest in enumerate(left):
        assert sum(s for s, p in zip(sizes, place) if p == b) + rest == 50


def test_pack_documents(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice("red green blue".split()) for _ in range(rnd.choice([1, 5, 30, 200])))) for i in range(200)] + [(500, None), (501, ""), (3, "red red"), (3, "red red")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    t = load(DEFAULT_RANKS)
    got = packing.pack_documents(df, 64, block_tokens=1500).collect()
    used = {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        assert r["n_parts"] == 1 or r["n_tokens"] == 64 or r["part_no"] == r["n_parts"]
    assert max(used.values()) <= 64 and sum(used.values()) == sum(t.count(x) for _, x in texts if x)
    assert sum(used.values()) / (64 * len(used)) > 0.93
    assert {r["doc_id"] for r in got if r["doc_id"] in (500, 501)} == set() and sum(r["doc_id"] == 3 for r in got) >= 3
    assert packing.pack_documents(df.limit(0), 64).count() == 0


# leaks

ITEM = "Long ago, the amber fox that Belvex praised counted 37 copper kettles beside the narrow quarry. Every pilgrim called Dunhul repaired another silver lantern after the flood, and 42 ravens followed Belvex to the mild harbour. How many kettles remain?"


def found(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM, 1), (8, None, 1), (9, ITEM, 1), (7, "A short fact about nothing.", 1)], "item_id long, text string, doc_id int")
    return rows(leaks.leaked(docs, items))


def test_leaks(spark):
    w = ITEM.split()
    hit = [(1, 9, "quoted")]
    assert found(spark, "noise " + " ".join(w[5:26])) == hit
    assert found(spark, "\n".join("+    // " + x.upper() for x in w[3:30])) == hit
    assert found(spark, '{"p": "' + "\\n".join(w[5:26]) + '"}') == hit
    assert found(spark, "<p>" + " ".join(f"<b>{x}</b>&nbsp;" for x in w[5:26]) + "</p>") == hit
    swapped = list(w[4:30])
    swapped[6] = swapped[15] = "teapot"
    assert found(spark, " ".join(swapped)) == hit
    assert found(spark, " ".join(w[:15]) + "\n@@ -1 +1 @@ x\n other words here\n+" + " ".join(w[15:30])) == hit  # interrupted
    assert found(spark, " ".join(w[5:22])) == []  # too short
    assert found(spark, " ".join("teapot" if i % 5 == 0 else x for i, x in enumerate(w))) == []  # one in five replaced
    assert found(spark, " ".join(w[20:35] + w[:15])) == []  # not in the item's order
    assert found(spark, None) == [] and found(spark, "") == []


def test_reparameterised(spark):
    item = "Suppose that Belvex adds 44 more and Dunhul loses a third of 477 while Belvex pays 12 on each of 90 days, how many kettles stay with Dunhul and Belvex in all after 31 more rounds?"
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    text = item
    for old, new in {"Belvex": "Sovthi", "Dunhul": "Krapel", "44": "5", "477": "61", "12": "8", "90": "15", "31": "70"}.items():
        text = text.replace(old, new)
    docs = spark.createDataFrame([(1, text), (2, text.replace("while Sovthi", "while Marbel")), (3, item)], "doc_id long, text string")
    assert rows(leaks.leaked(docs, items, typed=False)) == [(3, 9, "quoted")]
    # document 2 gives one name two values, so the slots do not agree
    assert rows(leaks.leaked(docs, items)) == [(1, 9, "re-parameterised"), (3, 9, "quoted")]


def _made_up(rnd, n):
    return ["".join(rnd.choice("bcdfglmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(n)]


def test_quoted_passages_are_found_and_others_not():
    """Passages at the edge of the definition, whole or interrupted by foreign lines anywhere, and passages beyond it."""
    rnd = random.Random(8)
    items = [(i, " ".join(_made_up(rnd, rnd.randint(24, 110)))) for i in range(40)]
    ix = leaks.build_index(items)
    coder = leaks.Coder(ix)
    missed = wrong = 0
    for turn in range(600):
        i, text = items[turn % 40]
        words = text.split()
        n = rnd.randint(20, len(words))
        at = rnd.randint(0, len(words) - n)
        part = words[at : at + n]
        swap = sorted(rnd.sample(range(1, n - 1), n // 8))
        good, bad = list(part), list(part)
        for x in swap:
            good[x] = _made_up(rnd, 1)[0]
        for x in range(3, n, 5):
            bad[x] = _made_up(rnd, 1)[0]
        whole = [x for x in range(n - 4) if not set(swap) & set(range(x, x + 5))]  # windows that stay
        cut = rnd.choice([0, *[x for x in range(whole[0] + 5, whole[-1] + 1) if not set(swap) & {x - 1, x}]])
        lines = good[:cut] + _made_up(rnd, rnd.choice([1, 5, 40]) if cut else 0) + good[cut:]
        noise = lambda: " ".join(_made_up(rnd, 30))
        missed += (i, "quoted") not in leaks.match_document(ix, " ".join([noise(), *lines, noise()]), coder=coder)
        wrong += bool(leaks.match_document(ix, " ".join([noise(), *bad, noise(), *part[:19], noise()]), coder=coder)) and n - 3 < 60
    assert missed == 0 and wrong == 0


def test_placeholders_find_reparameterised_questions():
    rnd = random.Random(9)
    people = ["Belvex", "Dunhul", "Sovthi", "Krapel", "Marbel", "Tolwin"]
    items, texts = [], []
    for i in range(50):
        filler = _made_up(rnd, 26)
        slots = {5 * k: str(rnd.randint(10, 999)) if k % 2 else people[k % 6] for k in range(1, 5)}
        fill = lambda values: "The " + " ".join(values.get(k, w) for k, w in enumerate(filler)) + "?"
        items.append((i, fill(slots)))
        texts.append(fill({k: v + "7" if v.isdigit() else "Q" + v.lower() for k, v in slots.items()}))
    # every third word is a slot's neighbour, so that plain windows of five words rarely stay whole
    hits = {}
    for typed in (True, False):
        ix = leaks.build_index(items, typed=typed)
        hits[typed] = sum((i, "re-parameterised") in leaks.match_document(ix, t) for (i, _), t in zip(items, texts))
        assert all((i, "quoted") in leaks.match_document(ix, t) for i, t in items)
    assert hits[True] >= 45 and hits[False] == 0


def test_leaks_of_repetitive_texts_cost_their_length():
    rnd = random.Random(10)
    words = _made_up(rnd, 90)
    ix = leaks.build_index([(1, " ".join(words))])
    parts = [words[x : x + 7] for x in (60, 40, 20, 3)]
    took = []
    for n in (10_000, 40_000):
        text = " ".join(" ".join(parts[k % 4 if k < n // 2 else rnd.randint(0, 3)]) + f" filler{k % 97} the" for k in range(n))
        began = time.process_time()
        leaks.match_document(ix, text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.2)


def test_leaks_blocks_and_empty(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "x " * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(3)], "item_id long, text string")
    want = [(d, i, "quoted") for d in (1, 2) for i in range(3)]
    assert rows(leaks.leaked(docs, items)) == want == rows(leaks.leaked(docs, items, max_windows=10))
    assert leaks.leaked(docs.limit(0), items).count() == 0 and leaks.leaked(docs, items.limit(0)).count() == 0


# splitting

PATCH = "".join(f"diff --git a/f{n} b/f{n}\n@@ -1,2 +1,2 @@\n" + "".join(f"+line {i} of some text here\n" for i in range(n % 9)) + "\n para é 中文 🚀\r\n" for n in range(60))


@pytest.mark.parametrize("text", [PATCH, "word " * 3000, "x" * 5000, "中文" * 900, "\n" * 3000, "🚀" * 700, "a\r" * 900])
def test_split_round_trip(text):
    t = load(DEFAULT_RANKS)
    room = 0.125 if text == PATCH else 0.0
    parts = splitting.split_text(text, t, 100, 10, room)
    data = text.encode()
    assert b"".join(data[new:z] for _, z, new, *_ in parts) == data and len(parts) > 1
    for (a, z, new, n, _, piece), before in zip(parts, [None, *parts]):
        assert n == t.count(piece) <= 100 and data[a:z].decode() == piece and a <= new
        if before:
            assert new == before[1] and before[0] < a and a < new  # overlaps the piece before
    if text == PATCH:
        assert sum(p[4] in ("file", "hunk") for p in parts[:-1]) > 0.3 * len(parts)
        assert all(p[4] not in ("character", "word") for p in parts[:-1])
    if text.startswith("word"):
        assert all(p[4] == "word" for p in parts[:-1])
    n, parts = len(t.ends(text)), splitting.split_text(text, t, 100, 10)
    least = splitting.least_pieces(n, 100, 10)
    assert least <= len(parts) <= least + max(1, least // 32) + 1 and 100 + (least - 2) * 90 < n <= 100 + (least - 1) * 90


def test_split_needs_the_least_number_of_pieces():
    t, rnd = load(DEFAULT_RANKS), random.Random(5)
    pieces = least = inside = 0
    for _ in range(60):
        text = "\n".join(" ".join(rnd.choice("red green blue yellow-ish x1 ___ 中文。".split()) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(20, 300)))
        parts, n = splitting.split_counted(text, t, 100, 10)
        pieces, least, inside = pieces + len(parts), least + (n if parts else 0), inside + sum(p[4] == "character" for p in parts)
    assert pieces <= 1.02 * least and inside <= 0.03 * pieces


def test_split_documents(spark):
    df = spark.createDataFrame([(1, PATCH), (1, PATCH), (2, None), (3, ""), (4, "short")], "doc_id long, text string").withColumn("piece", F.lit(0))
    got = splitting.split_documents(df, 100, 10)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {1} and got.where("n_tokens > 100").count() == 0
    assert splitting.split_documents(df.limit(0), 100, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(df, 100, 90)


def test_leaks_judge_a_diagonal_as_a_whole():
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    ix = leaks.build_index([(1, " ".join(item[:32])), (2, " ".join(item))], 5)

    def found(n, places, item_id):
        doc = ["xxq" if i in places else w for i, w in enumerate(item[:n])]
        return (item_id, "quoted") in leaks.match_document(ix, "pre " + " ".join(doc) + " post")

    assert found(32, (8, 13, 18, 23), 1)  # 4 of 32 replaced, hits too far apart for one stretch
    assert not found(32, (5, 8, 13, 18, 23, 27), 1)
    assert found(80, (20, 25, 30, 35, 40, 45, 50, 55, 60, 64), 2)  # 10 of 80, a gap wider than both reaches
    # one word more between the far halves: parts of the first diagonal still chain to the second
    doc = [*["xxq" if i in (8, 13, 18, 23) else w for i, w in enumerate(item[:30])], "new", *item[30:50]]
    assert (2, "quoted") in leaks.match_document(ix, " ".join(doc))
