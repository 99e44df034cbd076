"""Splitting oversized items at natural boundaries: balanced targets, each snapped to the strongest boundary nearby.

For a document of more than ``limit`` tokens the smallest number of pieces follows from the limit and the overlap. Equal
targets are set, and every target moves to the strongest boundary within ``limit / 4`` tokens (file, hunk, paragraph,
line, word; among equals the nearest) that keeps this piece and the rest within the limit and leaves the cuts to come
their share of the free tokens, so that an early file boundary does not force the later cuts into words. Where no
boundary is that near, the whole range that the limits leave is searched. The next piece begins ``overlap`` tokens before
the cut. Every piece is tokenised by itself; if one exceeds the limit by a few tokens, the cuts are set again for a limit
less these. A piece is added only if that fails, too, or if cuts inside words remain and another piece leaves fewer of
them (one piece, or one for 32 in long documents).
Documents are independent: one narrow pass, no shuffle.

Defined cases: null texts and those within the limit give no row; a text without any boundary is cut between characters;
the new parts of the pieces, joined, are the text again; ``overlap`` is at least the amount asked for (the whole
characters that hold it); repeated rows each give their pieces; an empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import DEFAULT_RANKS, Tokenizer

CHARACTER, WORD, LINE, PARAGRAPH, HUNK, FILE = range(6)
NAMES = ["character", "word", "line", "paragraph", "hunk", "file"]
_FILE = re.compile(rb"(?m)^(?:diff --|Index: |From [0-9a-f]{7,40} |commit [0-9a-f]{7,40}$)")
_HUNK = re.compile(rb"(?m)^@@@* ")
_STOP = re.compile(rb"\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f]")  # marks after which scripts without blanks may be cut
_BLANK_LINE = re.compile(rb"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)")


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets before which the text may be cut, in order, and their strength."""
    arr = np.frombuffer(data, np.uint8)
    space = (arr == 32) | ((arr >= 9) & (arr <= 13))
    strength = np.zeros(len(arr) + 1, np.int8)
    strength[1:-1][space[:-1] & ~space[1:]] = WORD
    for m in _STOP.finditer(data):
        strength[m.end()] = WORD
    line = (arr == 10) | ((arr == 13) & np.concatenate([arr[1:] != 10, [True]]))
    strength[1:][line] = LINE
    for m in _BLANK_LINE.finditer(data):
        strength[m.end()] = PARAGRAPH
    for pattern, s in ((_HUNK, HUNK), (_FILE, FILE)):
        for m in pattern.finditer(data):
            strength[m.start()] = s
    strength[0] = strength[-1] = 0
    at = np.flatnonzero(strength)
    return at, strength[at]


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


SHARE = 12  # tokens that every cut to come keeps, if there are as many, to reach a boundary


def least_pieces(n: int, limit: int, overlap: int) -> int:
    """The smallest number of pieces of ``n`` tokens, each but the first beginning ``overlap`` tokens before the last end."""
    return 1 if n <= limit else -(-(n - overlap) // (limit - overlap))


def cut(data: bytes, ends: np.ndarray, limit: int, overlap: int, pieces: int, at: np.ndarray, strength: np.ndarray, tok_at: np.ndarray) -> list[tuple[int, int, int, int]] | None:
    """(start, end, first new byte, strength of the end) of ``pieces`` pieces; None if the estimate does not fit."""
    n, out, begin, begin_tok, new = len(ends), [], 0, 0, 0
    step = (n + (pieces - 1) * overlap) / pieces
    reach = max(1, limit // 4)
    for i in range(pieces):
        left = pieces - i - 1
        if not left:
            end, s, end_tok = len(data), FILE, n
        else:
            full, hi = n - left * (limit - overlap), min(begin_tok + limit, n - left)  # ``full``: all later pieces are full
            lo = max(begin_tok + overlap + 1, full)
            if lo > hi:
                return None
            fair = max(lo, full + min(SHARE * (left - 1), (hi - full) * (left - 1) // left))
            target = min(max(int(round((i + 1) * step - i * overlap)), fair), hi)
            end = None
            for first, last in ((max(fair, target - reach), min(hi, target + reach)), (fair, hi), (lo, hi)):
                a, z = np.searchsorted(tok_at, first, "left"), np.searchsorted(tok_at, last, "right")
                a = max(a, np.searchsorted(at, new, "right"))
                if z > a:
                    if first == lo and lo < fair:  # at the expense of the cuts to come: the boundary that takes least
                        k = a + np.flatnonzero(tok_at[a:z] < fair)
                        k = k if len(k) else np.array([a])
                        end, s, end_tok = int(at[k[-1]]), int(strength[k[-1]]), int(tok_at[k[-1]])
                        break
                    k = a + np.flatnonzero(strength[a:z] == strength[a:z].max())
                    k = k[np.argmin(np.abs(tok_at[k] - target))]
                    end, s, end_tok = int(at[k]), int(strength[k]), int(tok_at[k])
                    break
            if end is None:
                end, s, end_tok = _char_start(data, int(ends[target - 1])), CHARACTER, target
            if end <= new:
                return None
        if end_tok - begin_tok > limit:
            return None
        out.append((begin, end, new, s))
        new = end
        begin_tok = max(0, end_tok - overlap)
        begin = _char_start(data, int(ends[begin_tok - 1]) if begin_tok else 0)
    return out


def split_text(text: str, tokenizer: Tokenizer, limit: int, overlap: int, room: float = 0.0) -> list[tuple[int, int, int, int, str, str]]:
    """(start, end, first new byte, tokens, kind of the end, text) of every piece; empty if the text is within the limit."""
    return split_counted(text, tokenizer, limit, overlap, room)[0]


def split_counted(text: str, tokenizer: Tokenizer, limit: int, overlap: int, room: float = 0.0) -> tuple[list[tuple[int, int, int, int, str, str]], int]:
    """The pieces as of ``split_text`` and the smallest number of pieces that the limits allow.

    ``room`` is a share of the limit that is left free when the number of pieces is set: more pieces, stronger boundaries.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:  # a token has a byte at least
        return [], 1
    ends = tokenizer.ends(text)
    n = len(ends)
    if n <= limit:
        return [], 1
    at, strength = boundaries(data)
    tok_at = np.searchsorted(ends, at, "left") + 1  # tokens needed to reach each boundary
    counted: dict[tuple[int, int], tuple[int, str]] = {}

    def attempt(pieces: int) -> list[tuple[int, int, int, int, str, str]] | None:
        less = 0
        for _ in range(4):
            if least_pieces(n, limit - less, overlap) > pieces:
                return None
            plan = cut(data, ends, limit - less, overlap, pieces, at, strength, tok_at)
            if plan is None:
                return None
            out, over = [], 0
            for a, z, new, s in plan:
                if (a, z) not in counted:
                    piece = data[a:z].decode("utf-8", "surrogatepass")
                    counted[a, z] = tokenizer.count(piece), piece
                k, piece = counted[a, z]
                over = max(over, k - limit)
                if over > 0:
                    break
                out.append((a, z, new, k, NAMES[s], piece))
            if over <= 0:
                return out
            less += over
        return None

    inside = lambda parts: sum(p[4] == NAMES[CHARACTER] for p in parts)
    least = least_pieces(n, limit, overlap)
    pieces = least_pieces(n, max(overlap + 1, int(limit * (1 - room))), overlap)
    out = attempt(pieces)
    while out is None:
        pieces += 1
        if pieces > n:
            raise ValueError("the limit is too small for one character")
        out = attempt(pieces)
    for pieces in range(pieces + 1, least + 1 + max(1, least // 32)):
        if not inside(out):
            break
        more = attempt(pieces)
        if more is not None and inside(more) < inside(out):
            out = more
    return out, least


def split_documents(docs: DataFrame, limit: int, overlap: int, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, room: float = 0.0) -> DataFrame:
    """``doc_id``, ``piece_no``, ``n_pieces``, ``n_least``, ``byte_start``, ``byte_new``, ``byte_end``, ``n_tokens``, ``ends_at``, ``piece``.

    ``n_least`` is the smallest number of pieces that limit and overlap allow.
    """
    import pandas as pd

    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of the limit")
    cols = ["doc_id", "piece_no", "n_pieces", "n_least", "byte_start", "byte_new", "byte_end", "n_tokens", "ends_at", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokenizer import load

        t = load(ranks)
        for b in batches:
            rows, held = [], 0
            for d, x in zip(b.doc_id, b.text):
                if not x:
                    continue
                parts, least = split_counted(x, t, limit, overlap, room)
                rows += [(d, i, len(parts), least, a, new, z, n, kind, piece) for i, (a, z, new, n, kind, piece) in enumerate(parts, 1)]
                held += len(x) if parts else 0
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=cols)

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return picked.mapInPandas(run, f"doc_id {kind}, piece_no int, n_pieces int, n_least int, byte_start long, byte_new long, byte_end long, n_tokens long, ends_at string, piece string")
