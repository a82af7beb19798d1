"""Mapping freely typed values to a canonical list by token-level repair and soft TF-IDF.

A value is read as words in up to three ways: as it is, with garbled text restored, and as if typed
on the other keyboard layout. Each distinct word is joined to the vocabulary of the reference list
by edit distance, also across look-alike letters, transliteration and abbreviation; the repaired
words are then combined with soft TF-IDF to rank the entries that share the value's rarest word.
An entry is accepted only if every word that carries meaning is met on both sides: another action,
object or kind is another entry.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.language import transliterate
from quarry.llm.text import fold
from quarry.operators.skew import balanced
from quarry.storage import materialize

#: Vocabulary words indexed at once; a larger vocabulary is worked through in blocks.
VOCABULARY_BLOCK = 5_000
#: Words in a larger share of the entries than this, and in so many entries, carry no meaning of their own.
LIGHT_SHARE, LIGHT_ENTRIES = 0.05, 20
ACCEPT = 0.8
MAX_EDITS = 2
#: Values, and entries, that a ranking task holds at most as read.
_MEMO = 20_000
LOST = "�"
_TOKEN = re.compile(r"(?:[^\W_]|�)+(?:\.(?=\W|_|$))?")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_SEPARATORS = re.compile(r"[:;,|/•░—–]|\s-\s")
_FOREIGN = re.compile(r"\S*[ªµºß-öø-ɏ]\S*")
_CODE = re.compile(r"(?<![^\W_])([^\W\d_]{1,5})[\W_]{0,2}(\d{2,})(?![^\W_])")
#: Stems of words that tell the form or level of a skill, not its action, object or kind.
FILLERS = (
    "базов", "начальн", "продвинут", "углубл", "уверенн", "минимальн", "современн", "основ", "введени", "владе", "умени", "умею", "умеет", "уметь", "знани", "знаю", "знать",
    "навык", "опыт", "способност", "практик", "практическ", "уровен", "уровн", "раздел", "уточн", "чернови",
    "basic", "advanced", "intermediate", "beginner", "junior", "middle", "senior", "level", "skill", "ability", "knowledge", "experience", "practic",
)
#: Short words that only connect others or belong to fillers.
_LINKS = frozenset("и в во на с со к по о об от до за для из у а или не при без под над the of and in on for to a an with any by at from or т п д др пр год года лет мес ред no nono hard soft etc lead new".split())

#: Keys of the two keyboard layouts, and Latin letters that look like Cyrillic ones.
_LAYOUT = str.maketrans("`qwertyuiop[]asdfghjkl;'zxcvbnm,.", "ёйцукенгшщзхъфывапролджэячсмитьбю")
_LOOKALIKE = str.maketrans("aceopxykmthbni", "асеорхукмтнвпи")
_LOOK_LATIN = str.maketrans("асеорхукмтнв", "aceopxykmthb")
_CYRILLIC = re.compile("[а-яёіїєґ]")
_LATIN = re.compile("[a-z]")


def tokens(text: str) -> list[tuple[str, int]]:
    """(folded word, number of its piece) of a value without bracketed parts and words of foreign letters.

    Pieces lie between colons, commas, slashes and dashes. An abbreviated word keeps its dot, and
    characters that are lost stay as LOST. If nothing else is left, the brackets are read after all.
    """
    folded = fold(text)
    for t in (_FOREIGN.sub(" ", _BRACKETS.sub(" ", folded)), _BRACKETS.sub(" ", folded), folded):
        found = []
        for k, piece in enumerate(_SEPARATORS.split(t)):
            for m in _TOKEN.finditer(piece):
                w = m[0]
                found.append((w if len(w) > 2 and not w[:-1].isdigit() else w.rstrip("."), k))
        if found:
            return found
    return []


def codes(text: str) -> list[str]:
    """Codes a value may hold: letters and digits close together, written without what parts them."""
    return sorted({m[1].translate(_LOOK_LATIN) + m[2] for m in _CODE.finditer(fold(text))})


def is_filler(token: str) -> bool:
    """Numbers, single letters, connecting words and words of form or level."""
    w = token.rstrip(".")
    return len(w.strip(LOST)) < 2 or w.isdigit() or w in _LINKS or w.startswith(FILLERS)


def readings(value: str, restored: str | None) -> list[list[tuple[str, int]]]:
    """The ways to read a value as words; only what has words is a reading."""
    texts = [value]
    if restored and restored != value:
        texts.append(restored)
    if not _CYRILLIC.search(value.lower()) and _LATIN.search(value.lower()):
        texts.append(value.lower().translate(_LAYOUT))
    out = []
    for t in texts:
        found = tokens(t)
        if found and found not in out:
            out.append(found)
    return out


def distance(a: str, b: str, limit: int) -> int:
    """Edits between two words, an exchange of neighbours counting once; limit + 1 if more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def allowed(word: str) -> int:
    """Edits allowed in a word, by its length; none in numbers and codes."""
    n = len(word)
    return 0 if n < 4 or any(ch.isdigit() for ch in word) else 1 if n < 5 else MAX_EDITS


def _deletions(word: str, k: int) -> set[str]:
    found = {word}
    layer = {word}
    for _ in range(k):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        found |= layer
    return found


class Repairer:
    """Vocabulary words near a token, by deletion neighbourhoods: complete up to the edits allowed."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = frozenset(vocabulary)
        self.ordered = sorted(self.vocabulary)
        self.by_deletion: dict[str, list[str]] = defaultdict(list)
        self.by_prefix: dict[str, list[str]] = defaultdict(list)
        self.forms: dict[str, list[str]] = defaultdict(list)
        for v in vocabulary:
            self.forms[v].append(v)
            if _CYRILLIC.search(v):
                self.forms[transliterate(v, "ru")].append(v)
        for f in self.forms:
            for d in _deletions(f, allowed(f)):
                self.by_deletion[d].append(f)
            for k in range(3, len(f)):
                self.by_prefix[f[:k]].append(f)

    def near(self, token: str) -> dict[str, float]:
        """Vocabulary word to similarity (1 = the same); exact words have no other repair."""
        abbreviated = token.endswith(".")
        word = token.rstrip(".")
        if word in self.vocabulary:
            return {word: 1.0}
        if LOST in word:
            if len(word.replace(LOST, "")) < 2:
                return {}
            whole = re.compile(re.escape(word).replace(LOST, "."))
            found = {v: 0.9 for v in self.ordered if whole.fullmatch(v)}
            if not found and word.endswith(LOST):  # cut off: one sign may stand for the whole rest
                stem = re.compile(re.escape(word.rstrip(LOST)).replace(LOST, ".") + ".+")
                found = {v: 0.85 for v in self.ordered if stem.fullmatch(v)}
            return found
        variants = {word: 1.0}
        if _LATIN.search(word) and _CYRILLIC.search(word):
            variants[word.translate(_LOOKALIKE)] = 0.99
            variants[word.translate(_LOOK_LATIN)] = 0.98
        elif _LATIN.search(word):
            variants.setdefault(word.translate(_LOOKALIKE), 0.97)
        found: dict[str, float] = {}
        for v, weight in variants.items():
            if v in self.forms:
                for w in self.forms[v]:
                    found[w] = max(found.get(w, 0), weight * 0.99)
        if found:
            return found
        for v, weight in variants.items():
            if abbreviated and len(v) >= 3:
                for f in self.by_prefix.get(v, ()):
                    for w in self.forms[f]:
                        found[w] = max(found.get(w, 0), weight * 0.95)
            k = allowed(v)
            if not k:
                continue
            for f in {f for d in _deletions(v, k) for f in self.by_deletion.get(d, ())}:
                e = distance(v, f, min(k, allowed(f)))
                if e <= min(k, allowed(f)):
                    for w in self.forms[f]:
                        found[w] = max(found.get(w, 0), weight * (1 - e / (len(f) + 4)))
        return found


def meaning(read: list[tuple[str, int, dict[str, float]]]) -> list[tuple[dict[str, float], bool]]:
    """(repairs, optional) of the words of (token, piece, repairs) that count.

    A piece of which no word is in the vocabulary is an ornament if another piece has one.
    """
    filler = [is_filler(token) and 1.0 not in near.values() for token, _, near in read]
    known = {piece for (_, piece, near), f in zip(read, filler, strict=True) if near and not f}
    return [(near, f) for (_, piece, near), f in zip(read, filler, strict=True) if not known or piece in known]


def score(value: list[tuple[dict[str, float], bool]], entry: dict[str, float], light: float, cut: bool = False) -> float:
    """Soft TF-IDF cosine of a value's repaired words with an entry's idf weights, 0 unless all meaning is met.

    Each entry word takes the most similar word of the value still free, the heaviest first. Words
    lighter than ``light`` may be missing on either side. Of a ``cut`` value, one whose end is lost,
    entry words may be missing; that scores ACCEPT for every such entry, so only a single one counts.
    """
    free = list(range(len(value)))
    dot = own = 0.0
    missing = 0
    for w, idf in sorted(entry.items(), key=lambda x: (-x[1], x[0])):
        best = max(free, key=lambda i: (value[i][0].get(w, 0.0), -i), default=None)
        sim = value[best][0].get(w, 0.0) if best is not None else 0.0
        if sim == 0.0:
            if idf > light:
                missing += 1
                if not cut:
                    return 0.0
            continue
        free.remove(best)
        dot += idf * idf * sim
        own += idf * idf
    rest = 0.0
    for i in free:
        near, optional = value[i]
        if not optional and min((entry.get(w, math.inf) for w in near), default=math.inf) > light:
            return 0.0
        rest += 0.0 if optional else light * light
    if missing:
        return ACCEPT if own else 0.0
    norm = math.sqrt(own + rest) * math.sqrt(sum(x * x for x in entry.values()))
    return dot / norm if norm else 0.0


def _read(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for value in batch.column("value").to_pylist():
                restored, chain = models.repair(value) if models is not None else (value, None)
                for k, read in enumerate(readings(value, restored)):
                    for pos, (token, piece) in enumerate(read):
                        for c, x in zip(cols, (value, k, pos, piece, token, is_filler(token)), strict=True):
                            c.append(x)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["value", "reading", "pos", "piece", "token", "filler"])

    return run


def _near(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = None
        for batch in batches:
            repairer = repairer or Repairer(sorted(words))
            found = [(t, w, s, words[w]) for t in batch.column("token").to_pylist() for w, s in sorted(repairer.near(t).items())]
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["token", "word", "sim", "df"])

    return run


_NAME_WORDS = F.pandas_udf(lambda s: s.map(lambda t: sorted({w.rstrip(".") for w, _ in tokens(t)}) if isinstance(t, str) else []), T.ArrayType(T.StringType()))
_CODES = F.pandas_udf(lambda s: s.map(lambda t: codes(t) if isinstance(t, str) else []), T.ArrayType(T.StringType()))


def _first(batch: pa.RecordBatch, on: list[str], memo: dict, *cells: str) -> tuple[list[tuple], list[tuple[tuple, dict]]]:
    """The keys of a batch's rows, and (key, cells) of the keys that the memo lacks: nested cells cost far more to read than keys."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in on), strict=True))
    at: dict[tuple, int] = {}
    for k, key in enumerate(keys):
        if key not in memo:
            at.setdefault(key, k)
    return keys, list(zip(at, batch.select(cells).take(pa.array(at.values(), pa.int64())).to_pylist(), strict=True))


def _ranked(light: float, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[tuple, tuple] = {}
        listed: dict[tuple, dict[str, float]] = {}
        for batch in batches:
            for memo in (values, listed):
                if len(memo) > _MEMO:
                    memo.clear()
            keys, new = _first(batch, ["value", "reading"], values, "read")
            for key, cell in new:
                read = sorted(cell["read"], key=lambda r: r["pos"])
                values[key] = meaning([(r["token"], r["piece"], {n["word"]: n["sim"] for n in r["near"]}) for r in read]), read[-1]["token"].endswith(LOST)
            numbers, new = _first(batch, ["entry_no"], listed, "words", "dfs")
            for key, cell in new:
                listed[key] = {w: math.log(1 + entries / n) for w, n in zip(cell["words"], cell["dfs"], strict=True)}
            out = [score(values[key][0], listed[no], light, values[key][1]) for key, no in zip(keys, numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("entry_id"), pa.array(out, pa.float64())], names=["value", "entry_id", "score"])

    return run


def map_values(values: DataFrame, names: DataFrame, entry_codes: DataFrame | None = None, models=None) -> DataFrame:
    """(value, entry_id, score) of each distinct value that stands for exactly one entry.

    ``values`` has value, ``names`` entry_id and name (several names an entry are possible),
    ``entry_codes`` entry_id and code; ``models`` restores garbled values. A value holding an entry's
    code stands for it, with score 1. A value equally near to two entries, a null, empty or wordless
    value, and any value when the list is empty, stand for none and are left out.
    """
    distinct = balanced(values.where("value is not null").select("value").distinct(), "value")
    entry = names.where("name is not null").select("entry_id", _NAME_WORDS("name").alias("words")).where(F.size("words") > 0).distinct()
    entry = materialize(entry, "entry")
    entries = entry.count()
    counts = materialize(entry.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    blocks = max(1, math.ceil(counts.count() / VOCABULARY_BLOCK))
    read = materialize(distinct.mapInArrow(_read(models), "value string, reading int, pos int, piece int, token string, filler boolean"), "read")
    toks = balanced(read.select("token").distinct(), "token")
    near = None
    for b in range(blocks):
        block = {r["word"]: r["df"] for r in counts.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect()}
        part = toks.mapInArrow(_near(block), "token string, word string, sim double, df long")
        near = part if near is None else near.unionAll(part)
    exact = F.max(F.when(F.col("sim") == 1, 1).otherwise(0)).over(Window.partitionBy("token"))
    near = near.withColumn("exact", exact).where("exact = 0 or sim = 1") if blocks > 1 else near
    by_token = near.groupBy("token").agg(F.collect_list(F.struct("word", "sim", "df")).alias("near"), F.sum("df").alias("reach"), F.max("sim").alias("most"))
    full = read.join(by_token, "token", "left").groupBy("value", "reading").agg(
        F.collect_list(F.struct("pos", "piece", "token", F.coalesce("near", F.array().cast("array<struct<word:string,sim:double,df:bigint>>")).alias("near"))).alias("read"),
        F.min(F.when(F.col("reach").isNotNull() & (~F.col("filler") | (F.col("most") == 1)), F.struct("reach", "pos", "near"))).alias("rarest"),
    )
    entry_dfs = entry.withColumn("entry_no", F.xxhash64("entry_id", "words")).select("entry_id", "words", "entry_no", F.explode("words").alias("word")).join(counts, "word")
    listed = entry_dfs.groupBy("entry_id", "entry_no").agg(F.collect_list("word").alias("words"), F.collect_list("df").alias("dfs"))
    postings = listed.withColumn("word", F.explode("words"))
    cand = full.where("rarest is not null").select("value", "reading", "read", F.explode("rarest.near.word").alias("word")).join(postings, "word").select("value", "reading", "entry_id", "entry_no", "read", "words", "dfs")
    light = math.log(1 + entries / max(LIGHT_ENTRIES, LIGHT_SHARE * entries))
    scored = balanced(cand, "value").mapInArrow(_ranked(light, entries), schema=T.StructType([T.StructField("value", T.StringType()), T.StructField("entry_id", names.schema["entry_id"].dataType), T.StructField("score", T.DoubleType())])).where(F.col("score") >= ACCEPT)
    if entry_codes is not None:
        known = entry_codes.where("code is not null").select("entry_id", F.explode(_CODES("code")).alias("code")).distinct()
        held = distinct.select("value", F.explode(_CODES("value")).alias("code"))
        scored = scored.unionByName(held.join(known, "code").select("value", "entry_id", F.lit(2.0).alias("score")))
    best = scored.groupBy("value", "entry_id").agg(F.max("score").alias("score"))
    top = best.groupBy("value").agg(F.max(F.round("score", 9)).alias("top"), F.max_by("entry_id", "score").alias("entry_id"), F.collect_list(F.round("score", 9)).alias("all"))
    return top.where(F.size(F.filter("all", lambda x: x == F.col("top"))) == 1).select("value", "entry_id", F.least("top", F.lit(1.0)).alias("score"))
