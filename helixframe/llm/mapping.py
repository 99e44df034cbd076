"""Mapping free-entered values to a canonical list: a partition-based pigeonhole join, in SQL expressions only.

Both sides are brought to a comparison key by one chain of column expressions (look-alike and styled letters, accents,
case, Greek letters, spreadsheet dates, qualifiers, versions, punctuation). Reference keys are cut into ``k + 1``
segments; a value within ``k`` edits of a key must contain one of the key's segments, unchanged and at most ``k`` places
from where the key has it. So the values' substrings at those places are joined with the segments by equality, and only
such pairs are verified with the built-in levenshtein. Distance 0 goes the same way. Values left over come out of an
anti-join with a null target.

An edit is an inserted, dropped or replaced character, or two neighbours swapped (one slip of the hand, levenshtein 2).
Digits are never guessed: a pair must agree in all its digits, since names of one family differ in nothing else. The
closest key wins, among equal distances the name of the better kind; a value whose best keys belong to different targets
is reported as unmatched.

The join runs over the distinct values (checkpointed: they are asked for three times), so a name typed a million times is
one row of it. A caller that joins the result back to its rows meets hot names there; adaptive execution splits them.

Defined cases: null values take no part; an empty key (punctuation only) is unmatched; repeated reference rows count
once; a reference key shared by two targets matches neither unless a better kind decides.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .lookalikes import MARKS, TWINS, is_invisible

#: Words that curators add to a name, and months as spreadsheets write them.
QUALIFIERS = ["protein", "mrna", "gene", "entrez", "geneid", "ncbi"]
GREEK_NAMES = {"alpha": "a", "beta": "b", "gamma": "g", "delta": "d", "epsilon": "e", "zeta": "z", "eta": "h", "theta": "th", "iota": "i", "kappa": "k", "lambda": "l", "mu": "m", "nu": "n", "xi": "x", "omicron": "o", "pi": "p", "rho": "r", "sigma": "s", "tau": "t", "upsilon": "u", "phi": "ph", "chi": "ch", "psi": "ps", "omega": "o"}
GREEK_LETTERS = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "abgdezh?iklmnxoprsstu???o"))
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _tables() -> tuple[str, str]:
    """Arguments of ``translate``: every character that has a one-letter form, from the Unicode mappings and the twins."""
    src, dst, gone = [], [], []
    ranges = [(0xA0, 0x250), (0x300, 0x370), (0x370, 0x400), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2070, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0xFE00, 0xFE10), (0xFE50, 0xFE70), (0xFEFF, 0xFF00), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
    special = {**TWINS, **MARKS}
    for ch in sorted({chr(n) for a, z in ranges for n in range(a, z)} | set(special)):
        if ch in special:
            to = special[ch]
        elif is_invisible(ch) or unicodedata.combining(ch):
            gone.append(ch)
            continue
        elif unicodedata.category(ch) == "Zs":
            to = " "
        else:
            to = unicodedata.normalize("NFKC", ch)
        bare = "".join(c for c in unicodedata.normalize("NFD", to) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != ch:
            src.append(ch)
            dst.append(bare)
    return "".join(src + gone), "".join(dst)


def comparison_key(value: Column) -> Column:
    """The key by which values and reference names are compared: small Latin letters and digits only."""
    src, dst = _tables()
    c = F.lower(F.trim(F.regexp_replace(F.translate(value, src, dst), r"\s+", " ")))
    months = "|".join(m[:3] for m in MONTHS)
    rest = "(?:" + "|".join(m[3:] for m in MONTHS if m[3:]) + "|t)?"
    c = F.regexp_replace(c, rf"^0*(\d{{1,2}})[- /]({months}){rest}$", "$2$1")
    c = F.regexp_replace(c, rf"^({months}){rest}[- /]0*(\d{{1,2}})$", "$1$2")
    c = F.regexp_replace(c, r"\[[^\[\]]*\]|\([^()]*\)", " ")
    c = F.regexp_replace(c, rf"(?<![a-z0-9])(?:{'|'.join(QUALIFIERS)})(?![a-z0-9])", " ")
    c = F.regexp_replace(c, r"^\W*(ens[a-z]*\d+)\.\d+\W*$", "$1")
    # theta, phi, chi and psi read as two letters, the others as one; a spelt-out letter only at the end of a name
    for ch, two in (("θ", "th"), ("φ", "ph"), ("χ", "ch"), ("ψ", "ps")):
        c = F.replace(c, F.lit(ch), F.lit(two))
    singles = {k: v for k, v in GREEK_LETTERS.items() if v != "?"}
    c = F.translate(c, "".join(singles), "".join(singles.values()))
    words = sorted(GREEK_NAMES, key=len, reverse=True)
    tail = rf"(?<=[a-z0-9])[\s_.-]*({'|'.join(words)})\W*$"
    letter = F.create_map(*[F.lit(x) for w in words for x in (w, GREEK_NAMES[w])])
    c = F.transform(F.array(c), lambda x: F.concat(F.regexp_replace(x, tail, ""), F.coalesce(letter[F.regexp_extract(x, tail, 1)], F.lit(""))))[0]
    return F.regexp_replace(c, r"[^0-9a-z]+", "")


def reference_keys(names: DataFrame, target: str, name: str, rank: str) -> DataFrame:
    """``key``, ``target``, ``rank`` of every reference name; the best rank of each (key, target)."""
    return names.select(comparison_key(F.col(name)).alias("key"), F.col(target).alias("target"), F.col(rank).alias("rank")).where("key <> '' AND target IS NOT NULL").groupBy("key", "target").agg(F.min("rank").alias("rank"))


def pigeonhole_pairs(values: DataFrame, keys: DataFrame, edits: int = 1) -> DataFrame:
    """``v`` (distinct keys of values), ``key``, ``target``, ``rank`` and ``distance`` of every pair within ``edits`` slips.

    A swap touches two neighbours, so ``edits`` slips leave one of ``2 * edits + 1`` segments whole.
    """
    n, e = 2 * edits + 1, edits
    segments = keys.selectExpr("key", "target", "rank", "length(key) AS len", f"explode(sequence(0, {n - 1})) AS no").selectExpr(
        "key", "target", "rank", "len", "no", f"substring(key, len * no DIV {n} + 1, len * (no + 1) DIV {n} - len * no DIV {n}) AS seg"
    )
    asked = (
        values.selectExpr("v", f"explode(sequence(length(v) - {e}, length(v) + {e})) AS len")
        .where("len > 0")
        .selectExpr("v", "len", f"explode(sequence(0, {n - 1})) AS no")
        .selectExpr("v", "len", "no", f"explode(sequence(greatest(len * no DIV {n} + 1 - {e}, 1), len * no DIV {n} + 1 + {e})) AS at")
        .selectExpr("v", "len", "no", f"substring(v, CAST(at AS INT), CAST(len * (no + 1) DIV {n} - len * no DIV {n} AS INT)) AS seg")
        .distinct()
    )
    pairs = asked.join(segments, ["len", "no", "seg"]).select("v", "key", "target", "rank").distinct()
    pairs = pairs.selectExpr("*", f"levenshtein(v, key, {2 * e}) AS d").where(r"d >= 0 AND regexp_replace(v, '\\D', '') = regexp_replace(key, '\\D', '')")
    # a swap is the one case of distance 2 that is a single slip: equal lengths, two neighbouring places differ crosswise
    pairs = pairs.selectExpr("*", "CASE WHEN d = 2 AND length(v) = length(key) THEN filter(sequence(1, length(v)), i -> substr(v, i, 1) <> substr(key, i, 1)) END AS at")
    swapped = "d = 2 AND size(at) = 2 AND get(at, 1) - get(at, 0) = 1 AND substr(v, get(at, 0), 1) = substr(key, get(at, 1), 1) AND substr(v, get(at, 1), 1) = substr(key, get(at, 0), 1)"
    return pairs.selectExpr("v", "key", "target", "rank", f"CASE WHEN {swapped} THEN 1 ELSE d END AS distance").where(f"distance <= {e}")


def map_values(values: DataFrame, value: str, names: DataFrame, target: str, name: str, rank: str, edits: int = 1) -> DataFrame:
    """``value`` (distinct, not null), ``target`` (null where unmatched) and ``distance``."""
    distinct = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()
    keyed = checkpointed(distinct.withColumn("v", comparison_key(F.col("value"))))
    pairs = pigeonhole_pairs(keyed.where("v <> ''").select("v").distinct(), reference_keys(names, target, name, rank), edits)
    chosen = (
        pairs.groupBy("v", "distance", "rank")
        .agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
        .groupBy("v")
        .agg(F.min(F.struct("distance", "rank", "lo", "hi")).alias("b"))
        .where("b.lo = b.hi")
        .select("v", F.col("b.lo").alias("target"), F.col("b.distance").alias("distance"))
    )
    matched = keyed.join(chosen, "v").select("value", "target", "distance")
    missing = keyed.join(chosen, "v", "left_anti").select("value", F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("distance"))
    return matched.unionByName(missing)
