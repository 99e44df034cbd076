"""Visually identical text with different characters: script-aware repair.

Three kinds of characters are brought to one form. *Styled* characters (full-width, mathematical and enclosed letters,
ligatures, combining accents) follow the Unicode compatibility mappings. *Invisible* characters (format characters,
variation selectors, fillers) are removed and unusual blanks and dashes become the usual ones. *Look-alike* letters of
other scripts are judged token by token: the dominant script of a token is the one with most of its letters, and only in
tokens that mix scripts, or whose letters all have Latin twins, are twins substituted, if the result is in the vocabulary
of the corpus (tokens of names without any unusual character; case and accents do not matter there).

A name may occur nowhere else, and what a reader sees must still come out. So a token whose result the vocabulary lacks
gets its twins, too, where no reading as Greek or Cyrillic is left (``beyond_vocabulary``, on unless switched off):
capital Cyrillic and Greek letters and small Cyrillic ones with a twin are never the usual character of a Latin name.
Small Greek letters often are; only the vocabulary replaces them, but for the omicron, which nobody can tell from an o.

Rows of plain ASCII never leave the JVM, every distinct other text is repaired once, and the vocabulary is a table joined
by token, not a set held in memory.

Defined cases: null gives no row; an empty text or one of unusual blanks only comes out empty; a token with a letter that
has no twin (a Cyrillic word) stays as it is; repairing twice changes nothing; repeated rows each give a row; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Letters of other scripts and the Latin letters that they look like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ԁ": "D", "Ѵ": "V", "Ӏ": "I", "Ғ": "F", "Ԍ": "G", "З": "3", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "к": "k",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j", "Ϝ": "F"}
SMALL_GREEK = {"ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "τ": "t", "α": "a", "γ": "y", "η": "n", "ω": "w"}
OTHER = {"Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "ı": "i", "ɑ": "a", "ɡ": "g", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T"}
TWINS = {**CYRILLIC, **GREEK, **OTHER}
#: Marks that look like usual ones.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "﹘": "-", "﹣": "-", "－": "-", "˗": "-", "‘": "'", "’": "'", "‛": "'", "ʼ": "'", "′": "'", "“": '"', "”": '"', "″": '"', "⁄": "/", "∕": "/", "․": ".", "‚": ",", "∗": "*", "∶": ":", "ː": ":", "ˍ": "_"}
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0}


def is_invisible(ch: str) -> bool:
    n = ord(ch)
    return unicodedata.category(ch) == "Cf" or n in _FILLERS or 0xFE00 <= n <= 0xFE0F or 0x180B <= n <= 0x180F or 0xE0100 <= n <= 0xE01EF or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r")


def script(ch: str) -> str:
    """Latin, Greek, Cyrillic or another script of a letter; '' for what is no letter."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ")
    return name[0].title() if name[0] in ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "LISU") else "Other"


def _unstyled(text: str) -> str:
    out = []
    for ch in text:
        if ch < "\x7f" and (ch >= " " or ch in "\t\n\r"):
            out.append(ch)
        elif is_invisible(ch):
            continue
        elif ch in MARKS:
            out.append(MARKS[ch])
        elif unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
            out.append(" ")
        elif ch in TWINS:  # before its compatibility form: the lunate sigma would become a sigma
            out.append(ch)
        else:
            styled = unicodedata.normalize("NFKC", ch)
            out.append(ch if styled.isspace() else "".join(MARKS.get(c, c) for c in styled))
    return unicodedata.normalize("NFC", "".join(out))


def _token(token: str) -> tuple[str, str]:
    """(repaired without the vocabulary, repaired if the vocabulary has it)."""
    if token.isascii():
        return token, token
    scripts = [s for s in map(script, token) if s]
    if not any(s not in ("Latin",) for s in scripts):
        return token, token
    foreign = [c for c in token if script(c) not in ("", "Latin")]
    mixed = len(set(scripts)) > 1
    dominant = max(set(scripts), key=lambda s: (scripts.count(s), s == "Latin"))
    if not mixed and dominant != "Latin" and not all(c in TWINS or c in SMALL_GREEK for c in foreign):
        return token, token  # a word of another script
    if mixed and dominant not in ("Latin",) and any(c not in TWINS and c not in SMALL_GREEK for c in foreign):
        return token, token
    sure = "".join(TWINS.get(c, c) for c in token)
    latin = any(script(c) == "Latin" for c in sure)
    if latin or any(c.isdigit() for c in sure):
        sure = sure.replace("ο", "o")
    if any(c in SMALL_GREEK for c in sure):
        # nu, rho and the like inside a token of Latin letters; a Greek letter at an edge is read as Greek
        core = [i for i, c in enumerate(sure) if c in SMALL_GREEK and c not in "αγηω" and 0 < i < len(sure) - 1 and sure[i - 1].isalpha() and sure[i + 1].isalpha()]
        maybe = "".join(SMALL_GREEK[c] if i in core else c for i, c in enumerate(sure))
    else:
        maybe = sure
    return sure, maybe


_SPLIT = re.compile(r"([^\W_]+)")


def repair(text: str) -> tuple[list[str], list[str], list[str]]:
    """Pieces of the text (tokens and what is between them): as they are, repaired for sure, and repaired with the vocabulary."""
    pieces = _SPLIT.split(_unstyled(text))
    both = [_token(p) if p else (p, p) for p in pieces]
    return pieces, [a for a, _ in both], [b for _, b in both]


def vocabulary_key(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


NON_ASCII = r"[^\x{20}-\x{7e}\t\n\r]"


def vocabulary(names: DataFrame, name: str) -> DataFrame:
    """``w``: the tokens, in small letters, of all names without unusual characters."""
    plain = names.where(~F.col(name).rlike(NON_ASCII)).select(F.lower(name).alias("n")).distinct()
    return plain.select(F.explode(F.split("n", r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")


def repair_text(df: DataFrame, key: Sequence[str], text: str, names: DataFrame | None = None, name: str | None = None, beyond_vocabulary: bool = True) -> DataFrame:
    """``key`` columns, ``text``, ``plain`` and ``n_unknown`` for every row whose text has an invisible or look-alike character.

    The vocabulary comes from column ``name`` of ``names`` (the texts themselves unless given); ``n_unknown`` is the
    number of repaired tokens that it lacks.
    """
    import pandas as pd

    ks = [f"k{i}" for i in range(len(key))]
    # a text is named by its SHA-256, so that a long one is not carried along with each of its tokens
    odd = df.where(F.col(text).rlike(NON_ASCII)).select(*[F.col(k).alias(a) for k, a in zip(key, ks)], F.col(text).alias("t"), F.unhex(F.sha2(text, 256)).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [repair(t) for t in b.t]
            b["piece"], b["sure"], b["maybe"] = ([g[n] for g in got] for n in range(3))
            b["w"] = [[vocabulary_key(m) if m != p else "" for p, m in zip(g[0], g[2])] for g in got]
            yield b[["h", "piece", "sure", "maybe", "w"]]

    texts = "piece array<string>, sure array<string>, maybe array<string>, w array<string>"
    fixed = written(odd.select("h", "t").distinct().mapInPandas(run, f"h binary, {texts}"))
    asked = fixed.select(F.explode(F.array_distinct("w")).alias("w")).where("w <> ''").distinct()
    known = vocabulary(df if names is None else names, text if names is None else name).join(asked, "w", "left_semi").distinct().withColumn("has", F.lit(True))
    judged = (
        fixed.select("h", F.posexplode(F.arrays_zip("piece", "sure", "maybe", "w")).alias("p", "x"))
        .select("h", "p", "x.*")
        .join(known, "w", "left")
        .select("h", "p", (F.col("has").isNull() & (F.col("w") != "")).alias("unknown"), F.when(F.col("has"), F.col("maybe")).otherwise(F.col("sure") if beyond_vocabulary else F.col("piece")).alias("v"))
        .groupBy("h")
        .agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l"), F.count_if("unknown").alias("n"))
        .select("h", F.array_join(F.col("l.v"), "").alias("r"), "n")
    )
    return odd.join(judged, "h").where("r <> t").select(*[F.col(a).alias(k) for a, k in zip(ks, key)], F.col("t").alias(text), F.regexp_replace("r", r"^\s+|\s+$", "").alias("plain"), F.col("n").alias("n_unknown"))
