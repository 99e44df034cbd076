"""Gene symbols to one spelling. The steps and their order are part of the result."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek letters and what they are written as.
GREEK = {
    "α": "A", "β": "B", "γ": "G", "δ": "D", "ε": "E", "ζ": "Z", "η": "H", "θ": "TH", "ι": "I", "κ": "K", "λ": "L", "μ": "M", "ν": "N", "ξ": "X",
    "ο": "O", "π": "P", "ρ": "R", "σ": "S", "τ": "T", "υ": "Y", "φ": "PH", "χ": "CH", "ψ": "PS", "ω": "O", "Κ": "K", "Ω": "O", "Λ": "L",
}


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks with one ASCII letter under their marks, from the Unicode decompositions."""
    src, dst = [], []
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(n)) if ord(c) < 128)
        if len(bare) == 1:
            src.append(chr(n))
            dst.append(bare)
    return "".join(src), "".join(dst)


def asciify(c: Column) -> Column:
    """Greek letters spelt in Latin ones, accents dropped, all else outside ASCII dropped."""
    for k, v in GREEK.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    one = {k: v for k, v in GREEK.items() if len(v) == 1}
    src, dst = _accents()
    return F.regexp_replace(F.translate(c, "".join(one) + src, "".join(one.values()) + dst), r"[^\x00-\x7F]", "")


def undo_dates(c: Column) -> Column:
    """Spreadsheet dates of two gene families: 2-Sep is SEPT2 and 01-Mar is MARCH1. Other months stay."""
    text = F.upper(F.trim(c))
    day, month = F.regexp_extract(text, r"^(\d{1,2})-(SEP|MAR)$", 1), F.regexp_extract(text, r"^(\d{1,2})-(SEP|MAR)$", 2)
    return F.when(month != "", F.concat(F.when(month == "SEP", "SEPT").otherwise("MARCH"), day.try_cast("int").cast("string"))).otherwise(c)


def normalise_symbol(c: Column) -> Column:
    """Null gives ''. Trim, ASCII, dates, NF-kB forms, blanks out, upper case."""
    c = undo_dates(asciify(F.trim(F.coalesce(c, F.lit("")))))
    for a, b in (("NF-kB", "NFKB"), ("NF-kappaB", "NFKB")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.upper(F.regexp_replace(c, r"[ \t]", ""))


def split_synonyms(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,;/]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "-"))
