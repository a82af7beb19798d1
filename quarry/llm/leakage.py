"""Evaluation texts leaking into a corpus, by q-gram lemma filtering.

Texts are compared as padded word strings (`` w1 w2 ... ``). If a window of an item of n characters
occurs in a document with at most e edits, the two share at least n + 1 - q(e + 1) q-grams whose
diagonals (position in the document less position in the item) differ by at most e. So the q-grams
of each document are looked up in an index of the items' q-grams and counted by item and diagonal
band, bands of width e + 1 being taken two by two so that they overlap; bands reaching the bound
are retained and verified by alignment within the band. With e = 0 the band is one diagonal.

Items are indexed in blocks of at most BLOCK_CHARS characters, so what is sent to the executors is
bounded however many items there are; each block meets every document, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import word_string

BLOCK_CHARS = 2_000_000
MAX_Q = 24
#: Windows aligned side by side.
ALIGNED = 4_000
_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _qgram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on, by doubling; the last q - 1 positions are left out."""
    if len(c) < q:
        return np.empty(0, dtype=np.uint64)
    have, span, out, done = c, 1, None, 0
    power = int(_BASE)
    while True:
        if q >> (span.bit_length() - 1) & 1:
            part = have[done:]
            out = part if out is None else out[: len(part)] * np.uint64(power) + part
            done += span
        if done == q:
            break
        have = have[: len(have) - span] * np.uint64(power) + have[span:]
        power = power * power % (1 << 64)
        span *= 2
    h = out[: len(c) - q + 1] * _M
    return h ^ (h >> np.uint64(31))


@dataclass
class Index:
    """Items of one block: their padded word strings and the sorted q-gram hashes with (item, position)."""

    q: int
    need: int
    edits: int
    words: int
    ids: np.ndarray
    texts: list[str]
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    window_end: list[np.ndarray]
    starts: list[list[int]]
    codes: list[np.ndarray]
    lookup: np.ndarray

    @staticmethod
    def build(ids: list[int], strings: list[str], words: int, edits: int) -> Index | None:
        """None if no item has as many words, or if the budget leaves no q-gram to count."""
        kept, ends, starts, shortest = [], [], [], math.inf
        for i, s in zip(ids, strings, strict=True):
            padded = f" {s} "
            blank = np.array([k for k, ch in enumerate(padded) if ch == " "])
            if len(blank) > words:
                stop = blank[words:]
                shortest = min(shortest, int((stop - blank[: len(stop)]).min()) + 1)
                # for each position the end of the first window that starts there or later
                end = np.full(len(padded) + 1, 1 << 30)
                nxt = np.searchsorted(blank[: len(stop)], np.arange(len(padded) + 1))
                ok = nxt < len(stop)
                end[ok] = stop[nxt[ok]] + 1
                kept.append((i, padded))
                ends.append(end)
                starts.append(blank[: len(stop)].tolist())
        if not kept:
            return None
        q = max(2, min(MAX_Q, int(shortest) // (edits + 2)))
        need = int(shortest) + 1 - q * (edits + 1)
        hs = [_qgram_hashes(_codes(t), q) for _, t in kept]
        h = np.concatenate(hs)
        item = np.repeat(np.arange(len(kept)), [len(x) for x in hs])
        pos = np.concatenate([np.arange(len(x)) for x in hs])
        order = np.argsort(h, kind="stable")
        h, item, pos = h[order], item[order], pos[order]
        distinct, first = np.unique(h, return_index=True)
        size = 1 << max(12, int(len(distinct) * 32).bit_length())
        lookup = np.zeros(size, dtype=bool)
        lookup[(distinct & np.uint64(size - 1)).astype(np.int64)] = True
        return Index(q, need, edits, words, np.array([i for i, _ in kept]), [t for _, t in kept], distinct, np.append(first, len(h)), item, pos, ends, starts, [_codes(t) for _, t in kept], lookup)


def _hits(index: Index, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, diagonal, item position) of every shared q-gram."""
    padded = [f" {s} " for s in strings]
    starts = np.cumsum([0, *(len(p) + 1 for p in padded)])
    h = _qgram_hashes(_codes("\x00".join(padded) + "\x00"), index.q)
    at = np.flatnonzero(index.lookup[(h & np.uint64(len(index.lookup) - 1)).astype(np.int64)])
    k = np.searchsorted(index.hashes, h[at])
    k[k == len(index.hashes)] = 0
    same = index.hashes[k] == h[at]
    at, k = at[same], k[same]
    n = index.first[k + 1] - index.first[k]
    flat = np.repeat(index.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = np.repeat(at, n)
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, index.item[flat], at - starts[doc] - index.pos[flat], index.pos[flat]


def banded_distances(items: list[np.ndarray], texts: list[np.ndarray], shifts: list[int], band: int, limit: int) -> np.ndarray:
    """Least edits turning each item into a part of its text that starts within ``band`` of its shift; limit + 1 if more.

    All pairs are aligned side by side, a character of every item at a time; pairs over the limit drop out.
    """
    width, far = 2 * band + 1, limit + 1
    out = np.full(len(items), far)
    if not items:
        return out
    size = np.array([len(x) for x in items])
    longest = int(size.max())
    item = np.zeros((len(items), longest), dtype=np.uint32)
    around = np.zeros((len(items), longest + width), dtype=np.uint32)  # NUL, which no word string holds, outside the text
    length, low = np.array([len(t) for t in texts]), np.asarray(shifts) - band
    for n, (x, t) in enumerate(zip(items, texts, strict=True)):
        item[n, : len(x)] = x
        lo, hi = max(0, low[n]), min(len(t), low[n] + longest + width)
        if lo < hi:
            around[n, lo - low[n] : hi - low[n]] = t[lo:hi]
    k = np.arange(width)
    at = np.arange(len(items))
    place = low[:, None] + k
    row = np.where((place >= 0) & (place <= length[:, None]), 0, far)
    for i in range(longest):
        new = row + (around[at, i : i + width] != item[at, i][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        place = low[at][:, None] + i + 1 + k
        inside = (place >= 0) & (place <= length[at][:, None])
        new = np.where(inside, np.minimum.accumulate(np.where(inside, new, far) - k, axis=1) + k, far)
        row = np.minimum(new, far)
        least = row.min(axis=1)
        done = size[at] == i + 1
        out[at[done]] = least[done]
        go = ~done & (least <= limit)
        at, row = at[go], row[go]
        if not len(at):
            break
    return out


def _exact(index: Index, strings: list[str], doc, item, diag, pos) -> set[tuple[int, int, int]]:
    """(document, item, 0) where a whole window lies on one diagonal."""
    order = np.lexsort((pos, diag, item, doc))
    doc, item, diag, pos = doc[order], item[order], diag[order], pos[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    retained = last - first + 1 >= index.need
    found = set()
    for a, b in zip(first[retained], last[retained], strict=True):
        i, end = item[a], pos[b] + index.q
        if index.window_end[i][pos[a]] <= end:
            piece = index.texts[i][pos[a] : end]
            start = pos[a] + diag[a]
            if f" {strings[doc[a]]} "[start : start + len(piece)] == piece:
                found.add((int(doc[a]), int(i), 0))
    return found


def _edited(index: Index, strings: list[str], doc, item, diag, pos) -> set[tuple[int, int, int]]:
    """(document, item, edits) of bands retained by the bound in which a window aligns within the budget.

    Of a window that matches, every part as long as the shortest window matches too, so the bound has
    to be reached within that length; only windows that meet such a stretch are aligned.
    """
    e, q = index.edits, index.q
    span = index.need - 1 + q * (e + 1) - q
    cell = np.floor_divide(diag, e + 1)
    # every hit lies in two overlapping bands; (document, item, band, position) is sorted and told apart as one number
    base = int(cell.min(initial=0)) - 1
    cells, places = int(cell.max(initial=0)) - base + 1, int(pos.max(initial=0)) + 1
    group = (doc * len(index.texts) + item) * cells - base
    rows = np.sort(np.concatenate([(group + c) * places + pos for c in (cell, cell - 1)]))
    rows = rows[np.append(True, rows[1:] != rows[:-1])[: len(rows)]]
    if len(rows) < index.need:
        return set()
    band, place = rows // places, rows % places
    first, last = np.arange(len(rows) - index.need + 1), np.arange(index.need - 1, len(rows))
    dense = np.flatnonzero((band[first] == band[last]) & (place[last] - place[first] <= span))
    if not len(dense):
        return set()
    begins = np.flatnonzero(np.append(True, band[dense[1:]] != band[dense[:-1]]))
    # a window that matches holds a whole dense stretch: it begins by the last one's begin and ends behind the first one's end
    latest, earliest = np.maximum.reduceat(place[dense], begins), np.minimum.reduceat(place[dense + index.need - 1], begins) + q
    of, number = np.divmod(band[dense[begins]], cells)
    stretches = list(zip((of // len(index.texts)).tolist(), (of % len(index.texts)).tolist(), (number + base).tolist(), latest.tolist(), earliest.tolist(), strict=True))
    pairs, items, texts, shifts = [], [], [], []
    best: dict[tuple[int, int], int] = {}
    coded: dict[int, np.ndarray] = {}

    def align() -> None:
        for pair, n in zip(pairs, banded_distances(items, texts, shifts, 2 * e + 1, e), strict=True):
            if n <= e:
                best[pair] = min(int(n), best.get(pair, e))
        for x in (pairs, items, texts, shifts):
            x.clear()

    for d, i, b, latest, earliest in stretches:
        if d not in coded:
            coded[d] = _codes(f" {strings[d]} ")
        it, ends = index.codes[i], index.window_end[i]
        for s in index.starts[i]:
            if s <= latest and ends[s] >= earliest:
                pairs.append((d, i))
                items.append(it[s : ends[s]])
                texts.append(coded[d])
                shifts.append(b * (e + 1) + e + s)
        if len(pairs) > ALIGNED:
            align()
    align()
    return {(d, i, n) for (d, i), n in best.items()}


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                strings = [word_string(t, plus=False) for t in part.column("text").to_pylist()]
                doc, item, diag, pos = _hits(index, strings)
                found = _exact(index, strings, doc, item, diag, pos)
                if index.edits:
                    sure = np.array([d * len(index.texts) + i for d, i, _ in found], dtype=np.int64)
                    rest = ~np.isin(doc * len(index.texts) + item, sure)
                    found |= _edited(index, strings, doc[rest], item[rest], diag[rest], pos[rest])
                if found:
                    d, i, n = map(list, zip(*sorted(found), strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(d)), pa.array(index.ids[i]), pa.array(n, pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 12, edits: int = 0) -> DataFrame:
    """(doc_id, item_id, edits) of each document holding ``words`` consecutive words of an item within ``edits`` character edits.

    ``docs`` has id and text, ``items`` item_id and text. Null, empty and wordless texts, and items
    of fewer words, match nothing; repeated rows give one result; empty tables give none. Documents
    are streamed through once per block of items and never shuffled; only the matches are.
    """
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    docs = docs.where("text is not null").select(F.col("id").cast("long").alias("id"), "text")
    found = []
    for b in range(blocks):
        mine = items.where("text is not null").where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = mine.select(F.col("item_id").cast("long"), "text").collect()  # a block of the stated query set
        index = Index.build([r[0] for r in rows], [word_string(r[1], plus=False) for r in rows], words, edits)
        if index is not None:
            found.append(docs.mapInArrow(_search(index), "doc_id long, item_id long, edits int"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int")
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
