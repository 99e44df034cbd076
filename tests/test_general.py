"""The general problems against brute force on small tables, with nulls, ties, repeats, empty and clashing inputs."""

import hashlib
import random
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.operators import intervals, packed, skew, smallfiles

from .conftest import rows

# packed fields

CASES = [
    ("1,2, 3", ["1", "2", "3"]),
    ("['1', \"2\"]", ["1", "2"]),
    ("(1;2 ;;3)", ["1", "2", "3"]),
    ('"a ""b"", c" and 4', ['a "b", c', "4"]),
    ("'x; y'|5", ["x; y", "5"]),
    ("6", ["6"]),
    (" ,7,", ["7"]),
    ("8,8", ["8", "8"]),
    ('9"', ['9"']),
    ("(a) ; (b)", ["(a)", "(b)"]),
    ("10 11\t12\n13", ["10", "11", "12", "13"]),
    ("{PMID:14，15；16}", ["PMID:14", "15", "16"]),
    ("11\n", ["11"]),
    ("12; ; \t13 ,\u00a014", ["12", "13", "14"]),
    ("'a' and b and \"c\"", ["a", "b", "c"]),
    ("and 5 band", ["5", "band"]),
    ("15\ue00016,17", ["15\ue00016,17"]),
    (" " * 50_000 + "18 " * 20_000, ["18"] * 20_000),
    ("  ", []),
    ("", []),
    ("[]", []),
    (None, []),
]
ALL = [*packed.CANDIDATES, "blank"]


def test_split_values(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "id int, v string")
    got = {}
    for r in packed.explode_packed(df, {"v": ALL}, ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["value"]))
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(want, 1)), CASES[i]


def test_split_very_long(spark):
    long = ",".join(f'"{i},""x"""' for i in range(50_000))
    df = spark.createDataFrame([(1, long)], "id int, v string")
    assert packed.explode_packed(df, {"v": ALL}, ["id"]).count() == 50_000


def test_delimiters_are_inferred_per_source(spark):
    ids = [("ids", v) for v in ["1", "2", "33", "4 5", "6 7", "1;2", "3;4", '"5;6"']]
    words = [("words", v) for v in ["up", "down", "weak up", "not said", "up;down", "down;up"]]
    df = spark.createDataFrame(ids + words + [("words", None)], "s string, v string")
    got = packed.infer_delimiters(df, "s", "v")
    assert set(got["ids"]) == {"blank", "semicolon"} and got["words"] == ["semicolon"]


def test_packed_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "a,b", "f", "p", "v")], "id int, v string, field string, pos string, value string")
    assert rows(packed.explode_packed(df, {"v": ["comma"]}, ["id"])) == [(1, "v", 1, "a"), (1, "v", 2, "b")]
    assert packed.explode_packed(df.limit(0), {"v": ["comma"]}, ["id"]).count() == 0
    assert packed.infer_delimiters(df.limit(0), "id", "v") == {}


# intervals


def sweep(spans):
    out, spans = [], sorted(set(spans))
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z), out[-1][2] + 1)
        else:
            out.append((a, z, 1))
    return out, [(x[1], y[0]) for x, y in zip(out, out[1:])]


@pytest.mark.parametrize("block", [7, 50, 4_000_000])
def test_intervals_against_brute_force(spark, block):
    rnd = random.Random(block)
    data = [(rnd.choice("ab"), rnd.choice("xy"), a, a + rnd.randint(-2, 25)) for a in (rnd.randint(0, 900) for _ in range(150))]
    data += data[:20] + [(None, "x", 1, 5), ("a", None, 1, 5), ("a", "x", None, 5), ("a", "x", 3, None)]
    df = spark.createDataFrame(data, "k string, c string, start int, end int")
    want = set()
    for k in "ab":
        for c in "xy":
            covered, gaps = sweep([(a, z) for kk, cc, a, z in data if kk == k and cc == c and a is not None and z is not None and a < z])
            want |= {(k, c, "covered", a, z, n) for a, z, n in covered} | {(k, c, "gap", a, z, 0) for a, z in gaps}
    assert {tuple(r) for r in intervals.covered_and_gaps(df, ["k", "c"], "start", "end", block).collect()} == want


def test_intervals_touch_nest_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5, "z"), ("a", 5, 9, "z"), ("a", 2, 3, "z"), ("a", 20, 30, "z")], "k string, s int, e int, pos string")
    assert rows(intervals.covered_and_gaps(df, ["k"], "s", "e")) == [("a", "covered", 1, 9, 3), ("a", "covered", 20, 30, 1), ("a", "gap", 9, 20, 0)]
    assert intervals.covered_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_intervals_limits_and_negative_positions(spark):
    spans = [(-30, -20), (-25, -12), (-12, -3), (40, 55), (41, 43), (90, 95), (90, 95), (300, 310)]
    df = spark.createDataFrame([("a", a, z) for a, z in spans], "k string, s long, e long")
    for block in (8, 1_000_000):
        assert rows(intervals.covered_and_gaps(df, ["k"], "s", "e", block, least=2, longest_gap=43)) == [("a", "covered", -30, -3, 3), ("a", "covered", 40, 55, 2), ("a", "gap", -3, 40, 0), ("a", "gap", 55, 90, 0)]
    with pytest.raises(TypeError):
        intervals.covered_and_gaps(df, ["s"], "k", "e")


def test_intervals_hot_group_and_long_intervals(spark):
    """Half of the rows are one interval, and one interval spans every block."""
    hot = spark.range(20_000).selectExpr("'hot' AS k", "5 AS s", "9 AS e")
    many = spark.range(20_000).selectExpr("'hot' AS k", "CAST(20 + id * 7 AS INT) AS s", "CAST(25 + id * 7 AS INT) AS e")
    assert intervals.covered_and_gaps(hot.union(many), ["k"], "s", "e", 500).where("kind = 'gap'").count() == 20_000
    over = spark.createDataFrame([("hot", 0, 200_000)], "k string, s int, e int")
    assert rows(intervals.covered_and_gaps(hot.union(many).union(over), ["k"], "s", "e", 500)) == [("hot", "covered", 0, 200_000, 20_002)]


# skew


def test_salted_aggregate(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 40)}", rnd.choice([None, *range(9)]), rnd.choice([None, "p", "q"])) for _ in range(3000)] + [(None, 1, "p")] * 50
    df = spark.createDataFrame(data, "rows string, m int, d string")
    got = {r[0]: tuple(r)[1:] for r in skew.salted_aggregate(df, "rows", {"m": "m"}, ["d", "m"], "nd").toDF("k", "rows", "n", "sum", "min", "max", "nd").collect()}
    for k in {x[0] for x in data}:
        own = [x for x in data if x[0] == k]
        ms = [x[1] for x in own if x[1] is not None]
        assert got[k] == (len(own), len(ms), sum(ms) if ms else None, min(ms, default=None), max(ms, default=None), len({(d, m) for _, m, d in own if m is not None and d is not None}))
    assert "hot" in skew.heavy_keys(df, "rows")[0] and None not in skew.heavy_keys(df, "rows")[0] and skew.heavy_keys(df, "rows")[1] == 3050
    nulls = spark.range(100).selectExpr("IF(id < 90, NULL, 'a') AS k", "id AS v")
    assert None in skew.heavy_keys(nulls, "k")[0] and skew.heavy_keys(nulls.limit(0), "k") == ([], 0)
    for how in ({"salt_by": ["v"]}, {"measures": {"m": "v"}}, {"distinct": ["v"]}, {"heavy": []}):
        assert {r["k"]: r["rows"] for r in skew.salted_aggregate(nulls, "k", **how).collect()} == {None: 90, "a": 10}
    assert skew.salted_aggregate(df.limit(0), "rows", {"m": "m"}).count() == 0
    assert {r["rows"] for r in skew.salted_aggregate(df.select("rows"), "rows").toDF("key", "rows").collect()} == {v[0] for v in got.values()}


# small files


def test_equal_files(spark):
    data = [(1, "a", 1), (1, "b", 2), (2, "b", 2), (2, "a", 1), (2, "a", 1), (3, "a", None), (4, "a", None), (5, "\\N", None), (6, "a\tb", 1), (7, "a", 9), (None, "a", 1), (8, "b", 2), (8, "a", 1)]
    df = spark.createDataFrame(data, "f int, s string, p int")
    for frame_rows in (1, 4096):
        frames = smallfiles.frames_of_records(df, "f", ["s", "p"], frame_rows)
        pairs = smallfiles.equal_pairs(smallfiles.file_digests(smallfiles.manifest(frames, ["file_id", "frame_no"])))
        assert rows(pairs) == [(1, 2), (1, 8), (2, 8), (3, 4)]
        digests = smallfiles.file_digests(smallfiles.consolidate(frames, ["file_id", "frame_no"], target_bytes=20))
        assert rows(smallfiles.equal_pairs(digests, 1)) == [(1, 2), (1, 8), (2, 8), (3, 4)]
        assert {tuple(r)[1:] for r in smallfiles.equal_files(digests).collect()} == {(1, 3, 3), (3, 2, 1)}
    assert smallfiles.equal_pairs(smallfiles.file_digests(smallfiles.manifest(smallfiles.frames_of_records(df.limit(0), "f", ["s", "p"]), ["file_id", "frame_no"]))).count() == 0


@given(st.lists(st.one_of(st.none(), st.binary(max_size=30).map(lambda b: b.replace(b"\r", b""))), max_size=8))
@settings(max_examples=50, deadline=None)
def test_join_bytes_keeps_lines(parts):
    whole, marks = smallfiles.join_bytes(parts)
    lines = [x for p in parts if p for x in (p if p.endswith(b"\n") else p + b"\n").split(b"\n")[:-1]]
    assert whole.split(b"\n")[:-1] == lines
    for (at, n, h), _ in zip(marks, parts):
        assert hashlib.sha256(whole[at : at + n]).hexdigest() == h


def test_headers_and_zstandard():
    whole, _ = smallfiles.join_bytes([b"h\n1", b"h\n2\n", b"", b"h\n"], header=b"h")
    assert whole == b"h\n1\n2\n"
    packed_, _ = smallfiles.join_bytes([zstandard.compress(b"one\n"), b"", zstandard.compress(b"two\n")], "zstd")
    assert zstandard.ZstdDecompressor().stream_reader(packed_, read_across_frames=True).read() == b"one\ntwo\n"
    with pytest.raises(ValueError):
        smallfiles.join_bytes([b"plain"], "zstd")


def test_truncated_frames_are_refused():
    whole = zstandard.ZstdCompressor(write_checksum=True).compress(bytes(range(256)) * 2000)
    skippable = (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert smallfiles.zstd_frames(whole + skippable + zstandard.compress(b"")) == 3 and smallfiles.zstd_frames(b"") == 0
    for n in (1, 5, 8, len(whole) // 2, len(whole) - 1):
        with pytest.raises(ValueError):
            smallfiles.join_bytes([whole[:n]], "zstd")
    for bad in (b"Plain text", whole + b"x", skippable[:-1]):
        with pytest.raises(ValueError):
            smallfiles.join_bytes([bad], "zstd")


def test_consolidate_writes_every_record_once(spark, tmp_path):
    parts = [(i, (f"{i},x\n" * (i % 5)).encode()[: -1 if i % 3 else None] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(parts, "file_id int, content binary").withColumn("offset", F.lit("x"))
    got = smallfiles.consolidate(df, ["file_id"], target_bytes=100, folder=str(tmp_path)).collect()
    assert sorted(r["file_id"] for r in got) == list(range(60)) and len({r["out_file"] for r in got}) < 20
    for r in got:
        data = (tmp_path / r["out_file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        want = dict(parts)[r["file_id"]] or b""
        assert data == (want if want.endswith(b"\n") or not want else want + b"\n") and hashlib.sha256(data).hexdigest() == r["checksum"]
    assert sum((tmp_path / n).stat().st_size for n in {r["out_file"] for r in got}) == sum(r["length"] for r in got)
    assert smallfiles.consolidate(df.limit(0), ["file_id"]).count() == 0


def test_large_files_are_cut_by_distinct_lines(spark, monkeypatch):
    data = [(f, f"line {i % 50}") for f in (1, 2) for i in range(300 * f)] + [(3, f"line {i}") for i in range(51)] + [(4, "one")] * 200
    df = spark.createDataFrame(data, "f int, s string")
    for bound in (500_000, 0):  # sent to all tasks, or joined with salts
        monkeypatch.setattr(smallfiles, "BROADCAST_ROWS", bound)
        frames = smallfiles.frames_of_records(df, "f", ["s"], 10)
        assert {(r["file_id"], r["n_frames"]) for r in frames.collect()} == {(1, 5), (2, 5), (3, 6), (4, 1)}
        assert frames.agg(F.sum("n_records")).first()[0] == 152
        assert rows(smallfiles.equal_pairs(smallfiles.file_digests(smallfiles.consolidate(frames, ["file_id", "frame_no"])))) == [(1, 2)]


def test_concatenate_writes_every_record_once(spark, tmp_path):
    parts = [(i, (f"{i},x\n" * (i % 5)).encode() if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(parts, "file_id int, content binary")
    out = smallfiles.concatenate(df, ["file_id"], target_bytes=100)
    written = smallfiles.write_concatenated(out, str(tmp_path / "o")).collect()
    text = b"".join(open(r["name"], "rb").read() for r in written).decode()
    want = [line for _, c in parts if c for line in c.decode().splitlines()]
    assert sorted(text.splitlines()) == sorted(want) and sum(r["n_parts"] for r in written) == 60 and len(written) < 20
    assert all(re.search(r"part-\d+\.txt$", r["name"]) for r in written)
