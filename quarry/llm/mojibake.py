"""Text garbled by a wrong character set, found and restored by minimum description length.

A chain is one or two steps "encode in the set the text was misread in, decode in the true one".
Every chain that can be applied to a value's tokens gives a candidate; each candidate is compressed
with a zstandard dictionary of every language, and its description length is the smallest size in
bytes plus a cost per step of the chain. The shortest description wins; a value whose own is
shortest stays unchanged. Tokens are the pieces between ASCII blanks, which every set shares, so a
value can be partly garbled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.storage import materialize

MISREAD = ["cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "mac-cyrillic", "iso8859-5", "cp437"]
TRUE = ["utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5"]
#: Bytes charged for each step of a chain.
STEP_COST = 1
#: A saving below so many bytes counts only if a changed token became a known word.
SURE_BYTES = 7
#: Share of a token's characters that may be lost.
MAX_LOST = 0.5
LOST = "�"
LABELS = ["ru", "en", "uk", "de", "es"]
#: A word is known if it is at least so large a share of all words of its label's documents, or of the values; so no more than 1 / COMMON words are known from each.
COMMON = 1 / 60_000
#: UTF-8 sequences read in a Western set look like nothing that is written on purpose.
_CERTAIN = {("cp1252", "utf-8"), ("latin-1", "utf-8")}
_MEMO = 500_000


def _byte_table(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte set; bytes it leaves undefined stand for the C1 controls, as usual in practice."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    table.setdefault("\xa0", 0xA0)
    table.setdefault("\xad", 0xAD)
    return table


class _Bytes(dict):
    """Code point to the character of the same number as its byte; ASCII and what the set lacks to a blank."""

    def __missing__(self, point: int) -> str:
        return " "


_TABLES = {c: _byte_table(c) for c in MISREAD}
_RAW = {c: _Bytes({ord(ch): chr(b) for ch, b in table.items() if ord(ch) > 127}) for c, table in _TABLES.items()}
#: Characters that text misread in a set can hold, and what they stand for in each single-byte set.
_HELD = {c: frozenset(table) | {"�"} for c, table in _TABLES.items()}
_READ = {(m, t): {ord(ch): bytes([b]).decode(t, "replace") for ch, b in _TABLES[m].items()} for m in MISREAD for t in TRUE if t != "utf-8"}
_ASCII_EDGES = "\"'().,;:!?-/#*[]"
_EDGES = "«»“”„\"'().,;:!?…—–-/#*[]\xa0 "
_CYRILLIC = re.compile("[\\u0400-\\u04ff]")
_LATIN = re.compile("[A-Za-z\\u00c0-\\u024f]")
_PLAIN = re.compile("[А-ЯЁІЇЄҐа-яёіїєґ][а-яёіїєґ]+|[A-Za-zÄÖÜäöüßñáéíóúÁÉÍÓÚ][a-zäöüßñáéíóú]+")


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


#: Latin, Greek, Cyrillic, punctuation, symbols, and what other single-byte sets hold; other scripts are no result here.
_USUAL = re.compile("[\x80-\u017f\u0192\u02c6\u02dc\u0386-\u03ce\u0400-\u045f\u0490\u0491\u2000-\u266f\ufb01\ufb02\ufeff]")


def _utf8_parts(token: str, table: dict[int, str]) -> str | None:
    """Every run of characters that is a valid UTF-8 sequence of the set's bytes, decoded; the rest as it is."""
    raw = token.translate(table).encode("latin-1")
    out, at = [], 0
    for m in _SEQUENCE.finditer(raw):
        try:
            ch = m[0].decode()
        except UnicodeDecodeError:
            continue
        if not _USUAL.fullmatch(ch):
            continue
        out += [token[at : m.start()], ch]
        at = m.end()
    return "".join(out) + token[at:] if at else None


def step(token: str, misread: str, true: str) -> str | None:
    """The token with one misreading undone as far as possible; None if no part of it can have been misread so.

    Towards UTF-8 every valid multi-byte sequence is decoded. Towards a single-byte set each
    character is mapped; LOST stays LOST, and a token with more than MAX_LOST of it, or with a
    character outside the set it was misread in, is left alone.
    """
    if true == "utf-8":
        out = _utf8_parts(token, _RAW[misread])
        return None if out == token else out
    if not _HELD[misread].issuperset(token):
        return None
    out = token.translate(_READ[misread, true])
    return None if out == token or out.count(LOST) > MAX_LOST * len(out) else out


_STEPS = [(m, t) for m in MISREAD for t in TRUE if m != t]


def _fits(text: str, codec: str) -> bool:
    try:
        return bool(text.encode(codec))
    except UnicodeEncodeError:
        return False


@cache
def _between() -> list[tuple[str, str, bytes]]:
    """(t, m, table) of a true set and the set its text was misread in before: bytes of the one to bytes of the other, NUL where there are none."""
    out = []
    for t in TRUE:
        for m in MISREAD:
            if "utf-8" not in (t, m) and t != m:
                out.append((t, m, bytes(_TABLES[m].get(bytes([b]).decode(t, "replace"), 0) if b > 127 else b for b in range(256))))
    return out


@dataclass
class Models:
    """One compressor per language dictionary, and the words they know."""

    dictionaries: dict[str, bytes]
    known: frozenset[str]
    _compressors: list | None = field(default=None, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)
    _sizes: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "known": self.known, "_compressors": None, "_memo": {}, "_sizes": {}}

    def size(self, text: str) -> int:
        """Description length in bytes without a chain: the best of its scripts' languages, over four bytes a character so that even short words are worth a match."""
        got = self._sizes.get(text)
        if got is None:
            if self._compressors is None:
                window = max(18, (max(map(len, self.dictionaries.values())) + 65_536).bit_length())  # reaches the whole dictionary
                params = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=window)
                self._compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in self.dictionaries.values()]
                self._cyrillic = [k for k, lang in enumerate(self.dictionaries) if lang in ("ru", "uk")] or [0]
                self._latin = [k for k, lang in enumerate(self.dictionaries) if lang not in ("ru", "uk")] or [0]
            if len(self._sizes) > _MEMO:
                self._sizes.clear()
            raw = f" {text} ".encode("utf-32-le", "surrogatepass")  # the first character never matches
            use = (self._cyrillic if _CYRILLIC.search(text) else []) + (self._latin if _LATIN.search(text) else []) or self._cyrillic
            got = self._sizes[text] = min(len(self._compressors[k].compress(raw)) for k in use)
        return got

    def candidates(self, token: str) -> dict[str, tuple]:
        """Text to chain of each way to undo one or two misreadings of a token.

        Behind a valid UTF-8 sequence every second step is tried, as such a sequence is evidence by
        itself. Two single-byte steps can turn any word into any other letters, so they count only
        towards a known word, and only where no shorter way leads to one.
        """
        found: dict[str, tuple] = {}
        for m, t in _STEPS:
            one = step(token, m, t)
            if one is None:
                continue
            found.setdefault(one, ((m, t),))
            if t == "utf-8" and not one.isascii():
                for m2, t2 in _STEPS:
                    two = step(one, m2, t2)
                    if two is not None and (t2 == "utf-8" or self.is_known(two)):
                        found.setdefault(two, ((m, t), (m2, t2)))
        if not any(map(self.is_known, found)):
            core = token.strip(_ASCII_EDGES)
            before, _, after = token.partition(core)
            for m, table in _TABLES.items():
                if not core or any(ch not in table for ch in core):
                    continue
                raw = bytes(map(table.__getitem__, core))
                for t, m2, between in _between():
                    t2, two = self.as_bytes.get(raw.translate(between), ("", ""))
                    if t2 and m not in (t, t2) and t2 != m2:
                        found.setdefault(before + two + after, ((m, t), (m2, t2)))
        return found

    @cached_property
    def as_bytes(self) -> dict[bytes, tuple[str, str]]:
        """Known words, in small letters, capitals and capitalized, by their bytes in each single-byte set."""
        forms = sorted({f for w in self.known if not w.isascii() for f in (w, w.upper(), w.capitalize())})
        return {f.encode(t): (t, f) for t in TRUE[:0:-1] for f in forms if _fits(f, t)}

    def is_known(self, token: str) -> bool:
        return token.strip(_EDGES).lower() in self.known

    def token_gains(self, token: str) -> dict[tuple, tuple[int, str]]:
        """Chain to (bytes saved, text) for all chains that apply to a token; none for known words."""
        got = self._memo.get(token)
        if got is None:
            if len(self._memo) > _MEMO:
                self._memo.clear()
            got = {}
            if not self.is_known(token):
                found = self.candidates(token)
                if _plain(token.strip(_EDGES)):  # looks intended: only known words count against it
                    found = {text: chain for text, chain in found.items() if self.is_known(text)}
                if found:
                    own = self.size(token)
                    got = {chain: (own - self.size(text), text) for text, chain in found.items()}
            self._memo[token] = got
        return got

    def repair(self, value: str) -> tuple[str, str | None]:
        """(restored text, chain) of a value; the chain is None if the value is best left unchanged.

        A value with characters lost beyond any chain (LOST) is affected too; its chain is then ``lost``.
        """
        if value.isascii():
            return value, None
        tokens = [(t, {} if t.isascii() else self.token_gains(t)) for t in value.split(" ")]
        totals: dict[tuple, int] = {}
        for _, gains in tokens:
            for chain, (gain, _) in gains.items():
                if gain > 0:
                    totals[chain] = totals.get(chain, 0) + gain
        best, text, least = None, value, None
        for chain in sorted(totals, key=lambda c: (-totals[c], len(c), c)):
            least = least or self.size(value)
            made, word = [], False
            for t, gains in tokens:
                gain, new = gains.get(chain, (-1, t))
                made.append(new if gain >= 0 else t)
                word |= gain >= 0 and len(new) > 3 and self.is_known(new)
            candidate = " ".join(made)
            cost = self.size(candidate) + STEP_COST * len(chain)
            if cost < least and (word or least - cost >= SURE_BYTES or chain[0] in _CERTAIN):
                best, text, least = chain, candidate, cost
        if best is not None:
            return text, ">".join(f"{m}:{t}" for m, t in best)
        return value, "lost" if LOST in value else None


def _plain(word: str) -> bool:
    """A word of one alphabet in usual case: such words are taken to be intended."""
    return bool(_PLAIN.fullmatch(word))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in usual case of one alphabet by label, counted within a task, and the number of all words.

    Of single signs beyond ASCII all but capitals count, such as dashes and the shortest words.
    """
    pieces: dict[str, Counter] = {}

    def counted() -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, c in pieces.items():
            counts[lang, ""] = c.total()
            for piece, n in c.items():
                word = piece.strip(_EDGES)
                if _plain(word):
                    counts[lang, word] += n
                elif len(piece) == 1 and not piece.isascii() and piece == piece.lower() != LOST:
                    counts[lang, piece] += n
        pieces.clear()
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            pieces.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, pieces.values())) > _MEMO:
            yield counted()
    yield counted()


def _common(texts: DataFrame, apart: bool) -> list:
    """(lang, word, n) of the words of all texts (lang, text) seen more than twice and holding the share COMMON of all their words, or with ``apart`` of their label's; counted in the executors."""
    counts = texts.where("text is not null").select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    totals = dict(counts.where("word = ''").select("lang", "n").collect())
    least = F.lit(3.0)
    for lang, n in totals.items():
        least = F.when(F.col("lang") == lang, F.lit(max(3.0, COMMON * (n if apart else sum(totals.values()))))).otherwise(least)
    return counts.where((F.col("word") != "") & (F.col("n") >= least)).collect()


def train(docs: DataFrame, values: DataFrame | None = None) -> Models:
    """Dictionaries by label of ``docs`` (id, text, lang), from all documents with one of LABELS.

    ``values`` (text) adds the words of all values themselves, in English if a value is ASCII, else
    in Russian. Only words of one alphabet and usual case, and signs that stand alone, that occur
    more than twice are used, and only those that are common (COMMON), which bounds their number. A dictionary holds its
    language's words by rising frequency, so that frequent ones are cheapest. Without any text every
    value is unchanged.
    """
    rows = _common(docs.where(F.col("lang").isin(LABELS)), True)
    if values is not None:
        rows += _common(values.where("text is not null").distinct().select(F.when(F.col("text").rlike("^[\\x00-\\x7f]*$"), "en").otherwise("ru").alias("lang"), "text"), False)
    counts: dict[str, Counter] = {lang: Counter() for lang in LABELS}
    for lang, word, n in rows:
        counts[lang][word] += n
    dictionaries, known = {}, set()
    for lang, c in counts.items():
        common = [w for w, _ in sorted(c.items(), key=lambda x: (x[1], x[0]))]
        known.update(w.lower() for w in common if len(w) > 1)
        both = [w for low in dict.fromkeys(w.lower() for w in common) for w in ((low.capitalize(), low) if len(low) > 1 else (low,))]
        if both:
            dictionaries[lang] = (" " + " ".join(both) + " ").encode("utf-32-le")
    return Models(dictionaries or {"none": "none".encode("utf-32-le")}, frozenset(known))


def repair_column(models: Models):
    """A function from a text column to struct(text, chain); chain is null where the text is unchanged. Null stays null."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("chain", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, str | None]] = {}
        for s in batches:
            out = []
            for v in s:
                if not isinstance(v, str):
                    out.append((None, None))
                    continue
                got = memo.get(v)
                if got is None:
                    if len(memo) > _MEMO:
                        memo.clear()
                    got = memo[v] = models.repair(v)
                out.append(got)
            yield pd.DataFrame(out, columns=["text", "chain"], dtype=object)

    return run.asNondeterministic()  # else a filter on the result is evaluated apart, and below a distinct
