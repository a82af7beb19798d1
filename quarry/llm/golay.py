"""Near-duplicates by Golay-code fuzzy hashing.

A text's distinct character trigrams are spread by hash over SEGMENTS segments of 23 bits; each
trigram flips one bit of one segment, so two texts differing in d trigrams differ in at most d
bits, and by the pigeonhole principle some segments have few errors. A segment is decoded to the
codewords of the perfect (23,12) Golay code within distance 4: one or six of them. Two segments at
distance 2 or less always share a codeword index, and many at 3 or 4 do. As 12 bits tell too
little in a large collection, each index is joined with the minima of BAND word permutations of
its own segment; the key is a hash of (segment, band, index). Rows sharing a key are candidates.
Texts that only share a phrase rarely share a key, as all three minima would have to fall into the
phrase and an index agree besides; so a common phrase makes no hot key, and what remains of skew
(large families of near-duplicates, whose pairs are results) is split by adaptive execution.
They are sifted by a 64-bit sketch of the words and 128 bits of the fingerprint in the join itself,
then by the whole fingerprints: these differ in at most as many bits as the trigram sets differ in
trigrams, so this bound loses nothing. What is left is verified exactly. As candidates that are
alike by chance grow with the square of the rows, the join must leave next to none of them.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import word_string
from quarry.operators.skew import balanced
from quarry.storage import materialize

SEGMENTS = 20
BAND = 3
#: The segments' keys are joined in so many passes, so that disk holds a part of the keys at a time.
PASSES = 5
LIST = 6
#: Sketches of two texts may differ in so many of 64 + 128 bits: a pair at the threshold differs in about 30 on average, unrelated texts in 71.
SKETCH_BITS = 48

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= _GENERATOR << (i - 11)
    return x


def _error_table() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and by syndrome the error patterns up to weight 4, -1 where there are fewer than six."""
    single = np.array([_remainder(1 << i) for i in range(23)], dtype=np.int64)
    table = np.full((2048, LIST), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=int)
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight < 4 or filled[s] < LIST:
                table[s, filled[s]] = sum(1 << b for b in bits)
                filled[s] += 1
    return single, table


_SINGLE, _ERRORS = _error_table()
_LOW = np.array([int(np.bitwise_xor.reduce(_SINGLE[[i for i in range(12) if v >> i & 1]])) if v else 0 for v in range(4096)])
_HIGH = np.array([int(np.bitwise_xor.reduce(_SINGLE[[i + 12 for i in range(11) if v >> i & 1]])) if v else 0 for v in range(2048)])


def codewords(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word, -1 as filling; one more axis."""
    errors = _ERRORS[_LOW[segments & 4095] ^ _HIGH[segments >> 12]]
    return np.where(errors >= 0, (segments[..., None] ^ errors) >> 11, -1)


_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _M
    return x ^ (x >> np.uint64(29))


_MULT = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _trigram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, mixed hash) of each distinct trigram of each row, sorted by row."""
    joined = "\x00".join(texts) + "\x00"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    if len(c) < 3:
        return row[:0], c[:0]
    g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    inside = (c[:-2] != 0) & (c[1:-1] != 0) & (c[2:] != 0)
    h, row = _mix(g[inside] * _M), row[:-2][inside]
    # a stable order by row is kept by sorting on (row, 40 bits of the hash) in one word
    packed = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return (packed >> np.uint64(40)).astype(np.int64), packed & np.uint64((1 << 40) - 1)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SEGMENTS) words of 23 bits, and the number of distinct trigrams by row."""
    row, h = _trigram_rows(texts)
    slot = ((h & np.uint64(0xFFFFFF)) * np.uint64(SEGMENTS * 23)) >> np.uint64(24)
    flips = np.bincount(row * (SEGMENTS * 23) + slot.astype(np.int64), minlength=len(texts) * SEGMENTS * 23) & 1
    return (flips.reshape(len(texts), SEGMENTS, 23) << np.arange(23)).sum(axis=2), np.bincount(row, minlength=len(texts))


def _pack(segments: np.ndarray) -> np.ndarray:
    """Two segments to a word of 64 bits."""
    return segments[:, 0::2] | (segments[:, 1::2] << 32)


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), dtype=np.int64)
    out[:, 0::2], out[:, 1::2] = packed & 0xFFFFFFFF, packed >> 32
    return out


_hashes: dict[str, int] = {}


def _word_hashes(words: list[str]) -> list[int]:
    """Hashes of words; the memo is emptied when it has a million entries, which changes no result."""
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    out = []
    for w in words:
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def minima(texts: list[str]) -> np.ndarray:
    """(rows, 64) minima of 64 permutations of each row's word hashes; every text must have a word."""
    split = [t.split(" ") for t in texts]
    starts = np.cumsum([0, *map(len, split)])[:-1]
    h = np.array(_word_hashes(list(itertools.chain.from_iterable(split))), dtype=np.uint64)
    out = np.empty((len(texts), 64), dtype=np.uint64)
    for k in range(64):
        x = h * _MULT[k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts)
    return out


def _sketch(low: np.ndarray) -> np.ndarray:
    """A 64-bit sketch of the words by row of minima."""
    return np.packbits((_mix(low) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0]


def _bands(low: np.ndarray) -> np.ndarray:
    """(rows, SEGMENTS) hashes of 32 bits of the BAND minima that belong to each segment."""
    band = np.zeros((len(low), SEGMENTS), dtype=np.uint64)
    for s in range(SEGMENTS):
        for b in range(BAND):
            band[:, s] = _mix(band[:, s] + low[:, s * BAND + b])
    return (band >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _keys(segments: np.ndarray, bands: np.ndarray, some: range) -> tuple[np.ndarray, np.ndarray]:
    """(rows, segments, LIST) keys of these segments, and where there is one."""
    index = codewords(segments)
    band = bands.view(np.uint32).astype(np.uint64) + (np.array(some, dtype=np.uint64) << np.uint64(32))
    return _mix(_mix(band[..., None] * _M) ^ index.astype(np.uint64)).view(np.int64) & ((1 << 40) - 1), index >= 0


def keys_and_sketch(texts: list[str], segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of all keys, and the sketch of the words by row."""
    low = minima(texts)
    keys, there = _keys(segments, _bands(low), range(SEGMENTS))
    return np.nonzero(there)[0], keys[there], _sketch(low)


_FP = [f"f{k}" for k in range(SEGMENTS // 2)]
_BANDS = [f"b{k}" for k in range(SEGMENTS)]


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ws = pa.array([word_string(t) or None for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("grp"), ws], names=["uid", "grp", "ws"]).filter(ws.is_valid())


def _emit_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = part.column("ws").to_pylist()
            segments, n = fingerprints(texts)
            low = minima(texts)
            made = [n.astype(np.int32), _sketch(low), *_pack(segments).T, *_bands(low).T]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("grp"), *map(pa.array, made)], names=["uid", "grp", "n", "s", *_FP, *_BANDS])


def _emit_keys(some: range):
    """All keys of the segments by text, beside its sketches ``s``, ``t`` and ``u``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                packed, bands = (np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in cs], axis=1) for cs in _columns(some))
                keys, there = _keys(_unpack(packed), bands, some)
                grp = part.column("grp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                keys ^= (_mix(grp * _M) & np.uint64((1 << 40) - 1)).view(np.int64)[:, None, None]
                ends = np.cumsum([0, *there.sum(axis=(1, 2))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("uid"), *map(part.column, "stu"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[there]))], names=["uid", *"stu", "keys"])

    return run


def _columns(some: range) -> tuple[list[str], list[str]]:
    """Names of the packed segments and of the bands of a range of segments that begins and ends between two words."""
    return _FP[some.start // 2 : some.stop // 2], _BANDS[some.start : some.stop]


#: 128 bits of the fingerprint: four segments, and in what they leave free of their words 36 bits of two more.
_PRINT_SKETCH = {
    "t": "f0 | shiftleft(f2 & 511, 23) | shiftleft(shiftright(f2, 32) & 511, 55)",
    "u": "f1 | shiftleft(shiftright(f2, 9) & 511, 23) | shiftleft(shiftright(f2, 41) & 511, 55)",
}


def _candidates(prints: DataFrame, some: range) -> DataFrame:
    """Pairs (a, b), a < b, that share a key of these segments and have near sketches."""
    fp, bands = _columns(some)
    rows = prints.select("uid", "grp", "s", *[F.expr(e).alias(c) for c, e in _PRINT_SKETCH.items()], *fp, *bands)
    keys = rows.mapInArrow(_emit_keys(some), "uid long, s long, t long, u long, keys array<long>").select(F.explode("keys").alias("key"), "uid", *"stu")
    left, right = (keys.select("key", F.col("uid").alias(x), *[F.col(c).alias(f"{c}{x}") for c in "stu"]) for x in "ab")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in "stu"])
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (differ <= SKETCH_BITS)).select("a", "b").distinct()


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[str, frozenset[str]] = OrderedDict()

        def grams(t: str) -> frozenset[str]:
            g = seen.get(t)
            if g is None:
                if len(seen) > 2000:
                    seen.popitem(last=False)
                g = seen[t] = frozenset(t[i : i + 3] for i in range(len(t) - 2))
            return g

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ws_a").to_pylist(), batch.column("ws_b").to_pylist(), strict=True):
                x, y = grams(a), grams(b)
                small, large = sorted((len(x), len(y)))
                if small < threshold * large or not small:
                    keep.append(None)
                    continue
                k = len(x & y)
                j = k / (small + large - k)
                keep.append(j if j >= threshold else None)
            sim = pa.array(keep, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), sim], names=["a", "b", "similarity"]).filter(sim.is_valid())

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the membership of rows in texts.

    ``rows`` has uid (bigint, unique), grp (bigint; only rows of one group are compared) and text. Returns
    links(a, b, similarity), a < b, between representatives, and members(uid, rep): the
    representative is the smallest uid of a group's rows with one word string. Null texts and
    texts without words belong to nothing; texts of under three characters have no trigram and no
    link. Groups of exact copies take part once, so copies cost neither keys nor candidates.
    """
    worded = rows.where("text is not null").select("uid", "grp", "text").mapInArrow(_emit_words, "uid long, grp long, ws string")
    texts = materialize(worded.withColumns({"h1": F.xxhash64("ws"), "h2": F.xxhash64(F.lit("h2"), "ws")}), "texts")
    ident = ["grp", "h1", "h2"]
    reps = texts.groupBy(*ident).agg(F.min("uid").alias("rep"), F.count("*").alias("copies"))
    copied = materialize(reps.where("copies > 1").select(*ident, "rep"), "copied")
    members = texts.select("uid", *ident).join(copied, ident, "left").select("uid", F.coalesce("rep", "uid").alias("rep"))
    later = materialize(members.where("uid != rep").select("uid", "rep"), "members")
    first = balanced(texts.select("uid", "grp", "ws").join(later.select("uid"), "uid", "left_anti"), "uid")
    kinds = ", ".join(["uid long, grp long, n int, s long", *[f"{c} long" for c in _FP], *[f"{c} int" for c in _BANDS]])
    prints = materialize(first.mapInArrow(_emit_fingerprints, kinds), "prints")
    per = SEGMENTS // PASSES
    passes = [materialize(_candidates(prints, range(k, k + per)), "candidates") for k in range(0, SEGMENTS, per)]
    pairs = reduce(DataFrame.unionByName, passes).distinct()
    side = lambda of, x, cols: of.select(F.col("uid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    both = pairs.join(side(prints, "a", ["grp", "n", *_FP]), "a").join(side(prints, "b", ["grp", "n", *_FP]), "b")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _FP])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    likely = (differ <= (1 - threshold) / (1 + threshold) * (n_a + n_b) + 1e-9) & (F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b) - 1e-9)
    sifted = materialize(both.where("grp_a = grp_b").where(likely).select("a", "b"), "pairs")
    full = sifted.join(side(texts, "a", ["ws"]), "a").join(side(texts, "b", ["ws"]), "b").select("a", "b", "ws_a", "ws_b")
    return full.mapInArrow(_verify(threshold), "a long, b long, similarity double"), texts.select("uid").join(later, "uid", "left").select("uid", F.coalesce("rep", "uid").alias("rep"))


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of rows behind the links between representatives: (id_a, id_b), the smaller first."""
    a = members.select(F.col("rep").alias("a"), F.col("uid").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("uid").alias("y"))
    return links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
