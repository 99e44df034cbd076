"""Evaluation texts leaking into training text: typed templates, a hash join of their windows, and a check of the slots.

Texts are canonicalised (escapes, entities, markup, case and layout removed) and cut into words. In the *template* of a
text, on both sides, numbers become one placeholder, names another and units of measure a third. Every window of
``window`` template words of every item is a key of an index; a window with fewer than two words besides placeholders
says too little and is keyed by its own words instead. All documents are probed against the index, whole, in one narrow
pass without a shuffle (a broadcast hash join of windows; a window of the corpus is never written anywhere).

A hit gives a diagonal (place in the document minus place in the item). On each diagonal the words that agree are kept as
far as a passage with the hit could reach, and the passages that lie on one diagonal or go on from one to a later one are
found by dynamic programming over the item: for every end and every number of replaced words the earliest beginning. It is
exact for these moves and works through diagonals in blocks, so a text that repeats a phrase a hundred thousand times costs
no more than its length. The slots then decide:

* *quoted*: ``min_words`` consecutive words of the item or more, at most one in ``one_in`` replaced by another, where
  a slot counts as replaced unless it holds the item's own value;
* *re-parameterised*: the template agrees over such a passage, but slots hold other values, each item value always the
  same other value.

The reference list is read in blocks of at most ``max_windows`` words, which bounds what is sent to the tasks. With more
than one block the documents are canonicalised once, and each block is built, joined, written and released in its turn.

Defined cases: null or empty texts match nothing; repeated documents each give their rows, repeated items one; a passage
interrupted by foreign lines counts as one if the item's words go on where they stopped and a window of the item stands
on both sides (shorter ends do not count as part of it); items shorter than ``min_words``
have no passages; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Units that a template folds into one placeholder.
UNITS = frozenset("mm cm m km mg g kg ml l s sec min h hours minutes seconds days weeks months years percent dollars euros".split())
NUM, NAME, UNIT = -1, -2, -3
LITERALS = 2  # words besides placeholders that a template window needs


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        return chr(int(code, 16))
    return " " if m.group(3) in "nrtfbv\n" else m.group(3)


def canonical(text: str) -> str:
    """The text without escapes, entities and markup; letter case is kept (it tells names)."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


@dataclass
class Index:
    """Windows of the items' templates. ``ids`` numbers the items' words (small letters) from 1; 0 is any other word."""

    ids: dict[str, int] = field(default_factory=dict)
    slot: np.ndarray | None = None  # word id -> NUM, NAME, UNIT or the id itself
    keys: np.ndarray | None = None  # sorted window hashes
    item_at: np.ndarray | None = None
    pos_at: np.ndarray | None = None
    items: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # item id, word ids, first word of each blank-separated word
    window: int = 5
    typed: bool = True  # placeholders on both sides; without them a template is the text


def name_words(texts: Sequence[str]) -> set[str]:
    """Words that are capitalised inside sentences and never written small: the names of the reference list."""
    upper, small = set(), set()
    for t in texts:
        for m in re.finditer(r"(^|[.!?;:\"]\s*|\s|\W)([^\W\d_]+)", t):
            w = m.group(2)
            if w[0].islower():
                small.add(w)
            elif w[1:].islower() and m.group(1) == " ":
                upper.add(w.lower())
    return upper - small


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Keys of the windows that begin at the places ``at``."""
    t = (words.astype(np.int64) + 7).astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            x = (t[at + k] + np.uint64(k + 1)) * _MIX[k % len(_MIX)]
            x ^= x >> np.uint64(29)
            h = h * np.uint64(0x100000001B3) + x
    return h


def _windows(ids: np.ndarray, template: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every window that has a key: its template's, or that of its words if these are mostly placeholders."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(ids) - window + 1
    if n < 1:
        return none
    known = np.flatnonzero(template)
    # windows without an unknown word: places whose word begins a run of known ones that is long enough
    ends = known[window - 1 :]
    whole = known[: len(ends)][ends - known[: len(ends)] == window - 1] if len(ends) else known[:0]
    if not len(whole):
        return none
    literal, own = np.zeros(len(whole), np.int8), np.ones(len(whole), bool)
    for k in range(window):
        literal += template[whole + k] > 0
        own &= ids[whole + k] != 0
    told = literal >= LITERALS
    at = whole[told | own]
    told = told[told | own]
    key = np.empty(len(at), np.uint64)
    key[told] = _hashes(template, at[told], window)
    key[~told] = _hashes(ids, at[~told], window) ^ np.uint64(0x5851F42D4C957F2D)
    return at, key


def build_index(items: Sequence[tuple[int, str]], window: int = 5, typed: bool = True) -> Index:
    ix = Index(window=window, typed=typed)
    texts = [canonical(t) for _, t in items]
    names = name_words(texts) if typed else set()
    kinds = [0]
    for (item_id, _), text in zip(items, texts):
        ws, starts = [], []
        for part in text.split():
            sub = _WORD.findall(part)
            if sub:
                starts.append(len(ws))
                ws += sub
        arr = np.empty(len(ws), np.int32)
        for i, w in enumerate(map(str.lower, ws)):
            if w not in ix.ids:
                ix.ids[w] = len(kinds)
                kinds.append(NUM if typed and w.isdigit() else UNIT if typed and w in UNITS else NAME if w in names else len(kinds))
            arr[i] = ix.ids[w]
        ix.items.append((item_id, arr, np.array(starts, np.int32)))
    ix.slot = np.array(kinds, np.int64)
    keys, at, pos = [], [], []
    for k, (_, arr, _) in enumerate(ix.items):
        p, h = _windows(arr, ix.slot[arr], window)
        keys.append(h)
        at.append(np.full(len(h), k, np.int32))
        pos.append(p.astype(np.int32))
    keys, at, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, at, pos))
    order = np.argsort(keys, kind="stable")
    ix.keys, ix.item_at, ix.pos_at = keys[order], at[order], pos[order]
    return ix


class Coder(dict):
    """Word as written -> (word id << 2) + placeholder of a word that no item has; remembers the words it has met."""

    def __init__(self, ix: Index) -> None:
        super().__init__()
        self.ix = ix

    def __missing__(self, w: str) -> int:
        low = w.lower()
        n = self.ix.ids.get(low, 0)
        code = n << 2
        if not n and self.ix.typed:
            code = 1 if low.isdigit() else 2 if w[0].isupper() and w[1:].islower() else 3 if low in UNITS else 0
        if len(self) > 1_000_000:
            self.clear()
        self[w] = code
        return code

    def code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (0: no item has the word) and template (0: no placeholder either)."""
        c = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ids = c >> 2
        return ids, np.where(ids > 0, self.ix.slot[ids], -(c & 3))


def _probe(ix: Index, ids: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the document, place in the index) of every window hit."""
    at, h = _windows(ids, template, ix.window)
    lo, hi = np.searchsorted(ix.keys, h, "left"), np.searchsorted(ix.keys, h, "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    where = np.repeat(at, n)
    k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    return where, k


ROWS = 4096  # diagonals that are looked at together


def _kept(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, diags: np.ndarray, hit_row: np.ndarray, hit_pos: np.ndarray, window: int, most: int) -> np.ndarray:
    """For every diagonal the item's blank-separated words that agree, as far as ``most`` others from a hit."""
    j = np.arange(len(item))
    at = diags[:, None] + j
    inside = (at >= 0) & (at < len(doc))
    same = inside & (doc[np.where(inside, at, 0)] == item) & (item != 0)
    hits = np.zeros_like(same)
    for k in range(window):
        hits[hit_row, hit_pos + k] = True
    same, hits = np.logical_and.reduceat(same, starts, axis=1), np.logical_or.reduceat(hits, starts, axis=1)
    bad = np.cumsum(~same, axis=1, dtype=np.int32)
    before = np.maximum.accumulate(np.where(hits, bad, -(1 << 20)), axis=1)
    after = np.minimum.accumulate(np.where(hits, bad, 1 << 20)[:, ::-1], axis=1)[:, ::-1]
    return same & ((bad - before <= most) | (after - bad <= most))


NEVER = 1 << 20


class Runs:
    """Earliest beginning of a passage for every end and number of replaced words, over the diagonals seen so far."""

    def __init__(self, words: int, min_words: int, one_in: int) -> None:
        self.n, self.min_words, self.one_in = words, min_words, one_in
        self.best = np.full((words + 1, words // one_in + 1), NEVER, np.int32)

    def _step(self, kept: np.ndarray) -> tuple[bool, np.ndarray]:
        """Is there a passage on one of the rows, each going on from what is known; and what the rows would add."""
        rows, b = len(kept), self.best.shape[1]
        cur, new = np.full((rows, b), NEVER, np.int32), np.empty((rows, self.n + 1, b), np.int32)
        new[:, 0] = NEVER
        allowed = self.one_in * np.arange(b)
        for x in range(self.n):
            cur = np.minimum(cur, self.best[x])
            k = kept[:, x]
            nxt = np.empty_like(cur)
            nxt[:, 0], nxt[:, 1:] = NEVER, cur[:, :-1]
            if k.any():
                nxt[k] = cur[k]
                nxt[k, 0] = np.minimum(nxt[k, 0], x)
                size = x + 1 - nxt[k]
                if ((size >= self.min_words) & (size < NEVER // 2) & (size >= allowed)).any():
                    return True, new
            new[:, x + 1] = cur = nxt
        return False, new

    def add(self, kept: np.ndarray) -> bool:
        """Rows in the order of their diagonals; True as soon as there is a passage."""
        at, many = 0, 1
        while at < len(kept):
            rows = kept[at : at + many]
            found, new = self._step(rows)
            if found and len(rows) == 1:
                return True
            better = (new < self.best).any(axis=(1, 2)) if not found else np.ones(len(rows), bool)
            if not better.any():
                at, many = at + len(rows), min(2 * many, 512)
            elif len(rows) == 1:
                self.best = np.minimum(self.best, new[0])
                at += 1
            else:  # rows before the first that adds something change nothing; that one is taken by itself
                at, many = at + (0 if found else int(np.argmax(better))), 1
        return False


def _path(kept: np.ndarray) -> np.ndarray:
    """For every word the row (they never go back) on the way along which most words are kept."""
    v = np.zeros(kept.shape, np.int32)
    v[:, 0] = kept[:, 0]
    for x in range(1, kept.shape[1]):
        v[:, x] = np.maximum.accumulate(v[:, x - 1]) + kept[:, x]
    row = int(np.argmax(v[:, -1]))
    way = np.empty(kept.shape[1], np.int64)
    for x in range(kept.shape[1] - 1, -1, -1):
        row = int(np.argmax(v[: row + 1, x]))
        way[x] = row
    return way


def _slots_agree(way: np.ndarray, kept: np.ndarray, diags: np.ndarray, ids: np.ndarray, words: Sequence[str], item: np.ndarray, starts: np.ndarray, slot: np.ndarray) -> bool:
    """Do slots hold other values than the item's, each item value always the same other one?"""
    ends = np.append(starts[1:], len(item))
    bound: dict[int, set[str]] = {}
    changed = False
    for x in np.flatnonzero(kept[way, np.arange(len(way))]):
        d = int(diags[way[x]])
        for j in range(starts[x], ends[x]):
            if slot[item[j]] < 0:
                bound.setdefault(int(item[j]), set()).add(words[j + d].lower())
                changed |= ids[j + d] != item[j]
    return changed and all(len(v) == 1 for v in bound.values())


def match_document(ix: Index, text: str | None, min_words: int = 20, one_in: int = 8, coder: Coder | None = None, words: list[str] | None = None) -> list[tuple[int, str]]:
    """(item id, 'quoted' or 're-parameterised') for one document, given as text or as its canonical words."""
    if words is None:
        words = _WORD.findall(canonical(text)) if text else []
    if len(words) < ix.window:
        return []
    ids, template = (coder or Coder(ix)).code(words)
    where, k = _probe(ix, ids, template)
    if not len(where):
        return []
    items, pos = ix.item_at[k], ix.pos_at[k]
    found = []
    for it in np.unique(items):
        item_id, arr, starts = ix.items[it]
        n = len(starts)
        if n < min_words:
            continue
        sel = items == it
        diags, row = np.unique(where[sel] - pos[sel], return_inverse=True)
        p = pos[sel]
        if len(diags) == 1 and p.max() + ix.window - p.min() + 2 * (n // one_in) * ix.window < min_words:
            continue
        slots = ix.slot[arr]
        order = np.argsort(row, kind="stable")
        row, p = row[order], p[order]

        def rows(doc: np.ndarray, item: np.ndarray) -> Iterator[np.ndarray]:
            for at in range(0, len(diags), ROWS):
                a, z = np.searchsorted(row, [at, at + ROWS])
                yield _kept(doc, item, starts, diags[at : at + ROWS], row[a:z] - at, p[a:z], ix.window, n // one_in)

        def passage(doc: np.ndarray, item: np.ndarray) -> bool:
            least = min_words - min_words // one_in
            blocks = list(rows(doc, item))
            if np.logical_or.reduce([b.any(axis=0) for b in blocks]).sum() < least:
                return False
            runs = Runs(n, min_words, one_in)
            return any(runs.add(b) for b in blocks)

        if not passage(template, slots):
            continue
        if passage(ids, arr):
            found.append((item_id, "quoted"))
        else:
            kept = np.concatenate(list(rows(template, slots)))
            if _slots_agree(_path(kept), kept, diags, ids, words, arr, starts, ix.slot):
                found.append((item_id, "re-parameterised"))
    return found


def _blocks(items: DataFrame, item_id: str, item_text: str, max_windows: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        n = r["t"].count(" ") + 1
        if block and size + n > max_windows:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 5, min_words: int = 20, one_in: int = 8, typed: bool = True, max_windows: int = 1_000_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``kind``: every document that holds a passage of an item.

    The items are the bounded side: they come to the driver and go to the tasks in blocks of at most ``max_windows`` words
    each (1 million: about 30 MB). ``typed`` puts placeholders on both sides; without it only quotations are found.
    """
    import pandas as pd

    spark = docs.sparkSession
    ddl = "doc_id long, item_id long, kind string"

    def join(rows: DataFrame, block: list[tuple[int, str]], as_words: bool) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(build_index(block, window, typed))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = shared.value
            coder = Coder(ix)
            for b in batches:
                got = [(d, i, k) for d, t in zip(b.doc_id, b.text) if t for i, k in match_document(ix, t, min_words, one_in, coder, t.split(" ") if as_words else None)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "kind"]).astype({"doc_id": "int64", "item_id": "int64"})

        return rows.mapInPandas(match, ddl), shared

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(items, item_id, item_text, max_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return join(picked, first, False)[0]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "text": [" ".join(_WORD.findall(canonical(t))) if t else "" for t in b.text]})

    once = written(picked.where("text <> ''").mapInPandas(words, "doc_id long, text string"))
    out = None
    for block in (first, second, *blocks):
        hit, shared = join(once, block, True)
        hit = written(hit)
        shared.destroy()
        out = hit if out is None else out.unionByName(hit)
    return out
