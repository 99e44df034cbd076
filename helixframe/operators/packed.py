"""Several values packed in one field: infer the delimiters of each source, then split and explode with position.

A *source* is one column of one table. A first pass scores every candidate delimiter of a source on two things:

* piece type regularity: the share of the atoms in rows with the delimiter whose type (text with digit runs folded to
  one digit) is also found in rows of that source without it;
* piece-count consistency: the share of the rows with the delimiter which it cuts into two non-blank pieces or more.

A delimiter is taken where the product reaches ``threshold``. So a blank separates identifiers but not the words of
``weak Activation``. The second pass splits each row at the delimiters taken; text in quotation marks is never cut.

Both passes are JVM expressions. Nothing in the scores depends on the digits, so the first pass folds rows to *shapes*
(quoted values masked, digit runs folded) with their counts before the shuffle, and all candidates meet the distinct
shapes, not the rows. It brings one row of scores per source to the driver. The second is a narrow transformation: every
delimiter becomes one reserved character, at which a plain split cuts.

Defined cases: null and blank fields give no row; blank pieces take no position; repeated values keep theirs; a
quotation mark without its partner is ordinary text; brackets are dropped only where one pair encloses the whole list; a
field that holds one of the two reserved private-use characters is one value; clashing column names do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Candidate delimiters: name and Java pattern. The blank comes last: it is judged inside the pieces the others leave.
CANDIDATES: dict[str, str] = {
    "comma": ",", "semicolon": ";", "pipe": r"\|", "slash": "/", "ampersand": "&", "plus": r"\+", "tab": r"\t", "newline": r"[\r\n]",
    "wide_comma": "，", "wide_semicolon": "；", "list_comma": "、", "and": r"(?<![^\s\ue000])and(?![^\s\ue000])",
}
BLANK = r"[ \u00a0\u2000-\u200a\u202f\u3000]"
PLAIN = r"^[A-Za-z0-9:._-]+\z"
MARK, CUT = "\ue000", "\ue001"  # reserved: a quoted value, and any delimiter
EDGES = " \t\n\x0b\f\r\u00a0\u3000"  # dropped at both ends of a value
_EDGE = r"\s,;|/&+，；、"
_DOUBLE, _SINGLE = r'"[^"]*+(?:""[^"]*+)*+"', r"'[^']*+(?:''[^']*+)*+'"
QUOTED = rf"(?<![^{_EDGE}])(?:{_DOUBLE}|{_SINGLE})(?![^{_EDGE}])"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGES))


def _body(text: Column) -> Column:
    """The list, already without blanks around it, without one pair of brackets that encloses all of it."""
    out = F.when(~text.rlike(r"^[\[({]"), text)
    inner = text.substr(F.lit(2), F.length(text) - 2)
    for a, b in (("[", "]"), ("(", ")"), ("{", "}")):
        # not enclosing: the first bracket inside, outside quotation marks, already closes
        out = out.when(text.startswith(a) & text.endswith(b) & (F.length(text) > 1) & ~F.regexp_replace(inner, QUOTED, "").rlike(rf"(?s)^[^\{a}\{b}]*\{b}"), _strip(inner))
    return out.otherwise(text)


def _masked(df: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value`` is not blank with ``_plain`` (one simple value), ``_body`` and ``_m`` (the body, quoted values as MARK)."""
    v = F.col(value)
    df = df.where(v.isNotNull()).withColumn("_plain", v.rlike(PLAIN))
    df = df.withColumn("_t", F.when(F.col("_plain"), v).otherwise(_strip(v))).where("_t <> ''")
    df = df.withColumn("_body", F.when(F.col("_plain"), F.col("_t")).otherwise(_body(F.col("_t"))))
    quoted = F.col("_body").contains('"') | F.col("_body").contains("'")
    return df.withColumn("_m", F.when(F.col("_plain") | ~quoted, F.col("_body")).otherwise(F.regexp_replace("_body", QUOTED, MARK))).drop("_t")


def score_delimiters(df: DataFrame, source: str, value: str) -> DataFrame:
    """One row per ``source``: an array ``scores`` of (delimiter, rows, regularity, consistency, score)."""
    any_of, none = "|".join(f"(?:{p})" for p in CANDIDATES.values()), F.array().cast("array<string>")

    def pieces(pattern: str) -> Column:
        return F.filter(F.transform(F.split("_m", pattern), _strip), lambda x: x != "")

    shapes = _masked(df.select(F.col(source).alias("source"), F.col(value).alias("value")), "value").groupBy("source", F.regexp_replace("_m", r"[0-9]+", "9").alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    base = checkpointed(shapes).where("_m <> ''").withColumn("has", F.when(F.col("_m").rlike(PLAIN), none).otherwise(F.array_compact(F.array(*[F.when(F.col("_m").rlike(p), F.lit(k)) for k, p in CANDIDATES.items()]))))
    # piece-count consistency
    cuts = F.array_compact(F.array(*[F.when(F.col("_m").rlike(p), F.struct(F.lit(k).alias("delimiter"), F.when(F.size(pieces(p)) > 1, F.col("n")).otherwise(0).alias("cut"))) for k, p in CANDIDATES.items()]))
    rows = base.where(F.size("has") > 0).select("source", "n", F.explode(cuts).alias("c")).groupBy("source", "c.delimiter").agg(F.sum("n").alias("rows"), (F.sum("c.cut") / F.sum("n")).alias("consistency"))
    # piece types by the set of delimiters that their row has: a handful of sets and types per source, used four times
    inner = F.when(F.col("a").rlike(rf"\S{BLANK}+\S"), F.split("a", f"{BLANK}+")).otherwise(none)
    parts = F.concat(F.array(F.struct(F.lit(False).alias("sub"), F.col("a").alias("t"))), F.transform(inner, lambda x: F.struct(F.lit(True).alias("sub"), x.alias("t"))))
    types = checkpointed(
        base.select("source", "n", "has", F.explode(F.when(F.col("_m").rlike(PLAIN), F.array("_m")).otherwise(pieces(any_of))).alias("a"))
        .select("source", "n", "has", F.explode(parts).alias("p"))
        .groupBy("source", "has", F.col("p.sub").alias("sub"), F.col("p.t").alias("t"))
        .agg(F.sum("n").alias("n"))
    )
    per_type = types.where("NOT sub").groupBy("source", "t").agg(F.sum("n").alias("n_all"))
    with_d = types.where("NOT sub").select("source", "t", "n", F.explode("has").alias("delimiter")).groupBy("source", "delimiter", "t").agg(F.sum("n").alias("n_with"))
    totals = per_type.groupBy("source").agg(F.sum("n_all").alias("n_source"))
    # a type seen without the delimiter is regular; where no row is without the delimiter, a type seen twice is
    regular = (
        with_d.join(per_type, ["source", "t"])
        .groupBy("source", "delimiter")
        .agg(F.sum("n_with").alias("w"), F.sum(F.when(F.col("n_all") > F.col("n_with"), F.col("n_with")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("n_with") > 1, F.col("n_with")).otherwise(0)).alias("twice"))
        .join(totals, "source")
        .select("source", "delimiter", (F.when(F.col("n_source") > F.col("w"), F.col("ok")).otherwise(F.col("twice")) / F.col("w")).alias("regularity"))
    )
    blank = (
        types.where("sub").groupBy("source", "t").agg(F.sum("n").alias("n_sub")).join(per_type, ["source", "t"], "left")
        .groupBy("source").agg(F.sum("n_sub").alias("rows"), (F.sum(F.when(F.col("n_all") > 0, F.col("n_sub")).otherwise(0)) / F.sum("n_sub")).alias("regularity"))
        .select("source", F.lit("blank").alias("delimiter"), "rows", F.lit(1.0).alias("consistency"), "regularity")
    )
    scored = rows.join(regular, ["source", "delimiter"], "left").select("source", "delimiter", "rows", "consistency", F.coalesce("regularity", F.lit(0.0)).alias("regularity")).unionByName(blank)
    one = F.struct("delimiter", "rows", "regularity", "consistency", (F.col("regularity") * F.col("consistency")).alias("score"))
    return scored.groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("scores"))


def infer_delimiters(df: DataFrame, source: str, value: str, threshold: float = 0.5) -> dict[str, list[str]]:
    """Delimiters taken for each source. Brings one row per source to the driver (sources are columns, not data)."""
    return {r["source"]: [x["delimiter"] for x in r["scores"] if x["rows"] and x["score"] >= threshold] for r in score_delimiters(df, source, value).collect()}


def _cut(delimiters: Sequence[str]) -> Column:
    """``_m`` with one CUT in place of the delimiters that follow one another, and of the blanks around them."""
    patterns = [CANDIDATES[d] for d in delimiters if d != "blank"] + ([rf"{BLANK}+"] if "blank" in delimiters else [])
    if not patterns:
        return F.col("_m")
    blanks = r"[\s\u00a0\u3000]"  # the lookbehind lets a run of blanks be tried once, from its start
    return F.regexp_replace(F.regexp_replace("_m", "|".join(f"(?:{p})" for p in patterns), CUT), f"(?<!{blanks}){blanks}*+(?:{CUT}{blanks}*+)++", CUT)


def _values() -> Column:
    """The values of ``_c``, with what stood in quotation marks in ``_body`` put back."""
    none = F.array().cast("array<string>")
    pieces = lambda c: F.array_remove(F.transform(F.split(c, CUT), _strip), "")

    def unquoted(q: Column) -> Column:
        inner = q.substr(F.lit(2), F.length(q) - 2)
        return _strip(F.when(q.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(inner, F.lit("''"), F.lit("'"))))

    pairs = F.arrays_zip(F.split("_c", MARK).alias("p"), F.regexp_extract_all("_body", F.lit(QUOTED), F.lit(0)).alias("q"))
    whole = F.flatten(F.transform(pairs, lambda x: F.concat(F.coalesce(pieces(x["p"]), none), F.when(x["q"].isNotNull(), F.array(unquoted(x["q"]))).otherwise(none))))
    return (
        F.when(F.col("_plain") | F.col("_reserved"), F.array("_body"))
        .when(~F.col("_c").contains(MARK), F.array_remove(F.split("_c", CUT), ""))
        .otherwise(F.array_remove(whole, ""))
    )


def explode_packed(df: DataFrame, columns: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``field``, ``pos`` (from 1) and ``value``: one row per single value of the named columns.

    The columns of one table are split in one scan. Clashing names in ``df`` do no harm: only ``keep`` is carried on.
    """
    ks = [f"_k{i}" for i in range(len(keep))]
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns]))
    long = df.select(*[F.col(k).alias(a) for k, a in zip(keep, ks)], fields.alias("_x")).select(*ks, F.col("_x.f").alias("_f"), F.col("_x.v").alias("_v"))
    long = _masked(long, "_v").withColumn("_reserved", F.col("_v").contains(MARK) | F.col("_v").contains(CUT))
    cut = F.when(F.col("_plain") | F.col("_reserved"), F.col("_m"))
    for c, delimiters in columns.items():
        cut = cut.when(F.col("_f") == c, _cut(delimiters))
    cut_up = long.withColumn("_c", cut)
    return (
        cut_up.select(*ks, "_f", F.posexplode(_values()).alias("_p", "_v"))
        .select(*[F.col(a).alias(k) for a, k in zip(ks, keep)], F.col("_f").alias("field"), (F.col("_p") + 1).cast("int").alias("pos"), F.col("_v").alias("value"))
    )
