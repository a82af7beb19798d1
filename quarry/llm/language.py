"""Languages of documents and their paragraphs by cross-parsing entropy.

For each language a suffix automaton is built over running labelled text. A paragraph is parsed
against it from left to right into longest matches, across words; the language that needs the
fewest phrases for the same characters wins. The step of an automaton over one word is kept, by the
state it starts from, so that common phrases are parsed once. Russian and Ukrainian text also
enters its automaton in Latin transliteration, the others in Cyrillic one. Words that no language
knows any better, such as invented names, are left out where other words tell something.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import sampled
from quarry.storage import materialize

LANGUAGES = ["ru", "en", "uk", "de", "es"]
#: About so many documents of each label, whole, are the sample the automata's text is chosen from.
SAMPLE_DOCS = 600
#: Running text is taken in pieces of so many words.
PIECE = 12
#: A word belongs to a language's text if it is at least so common there as where it is most common, for labels are untrue in some rows.
SHARE = 0.3
#: Words seen less often in the sample teach nothing.
LEAST_COUNT = 3
_MEMO = 1_000_000
#: Bits for the phrases of one language in a text.
_BITS = 40
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*")
_BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")

#: Letters of the two alphabets in Latin letters.
_LATIN = {
    "ru": dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".split(), strict=True)),
    "uk": dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "a b v h g d e ye zh z y i yi y k l m n o p r s t u f kh ts ch sh shch _ yu ya".split(), strict=True)),
}
_CYRILLIC = str.maketrans(dict(zip("abcdefghijklmnopqrstuvwxyz", "а б ц д е ф г х и ж к л м н о п к р с т у в в кс й з".split(), strict=True)))


def transliterate(word: str, lang: str) -> str:
    """A word in the other alphabet; ё and ъ, ь are written in the usual simple way."""
    table = _LATIN.get(lang)
    if table is None:
        return word.translate(_CYRILLIC)
    return "".join(table.get(ch, ch) for ch in word).replace("_", "")


class Automaton:
    """Suffix automaton of a text: recognises exactly its substrings."""

    def __init__(self, text: str):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def parse(self, text: str, state: int = 0) -> tuple[int, int]:
        """(phrases begun, state after) of the parse into longest matches, going on from a state; state 0 is between phrases.

        A character that never occurs is a phrase of its own.
        """
        nxt, n = self.next, 0
        for ch in text:
            to = nxt[state].get(ch)
            if to is None:
                to, n = nxt[0].get(ch, 0), n + 1
            elif state == 0:
                n += 1
            state = to
        return n, state

    def phrases(self, text: str) -> int:
        """Number of longest matches a text is parsed into."""
        return self.parse(text)[0]


class Identifier:
    """Languages of texts by automata over running text; ``texts`` has lists of pieces by language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.texts = texts
        self._automata: list[Automaton] | None = None

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "_automata": None}

    def _build(self) -> None:
        self._automata, self._words = [], {}
        for lang, pieces in self.texts.items():
            other = [" ".join(transliterate(w, lang) for w in p.split(" ")) for p in pieces]
            self._automata.append(Automaton(f" {' '.join(pieces)} {' '.join(other)} "))
        self._forget()

    def _forget(self) -> None:
        """Start the memo of steps anew: (number of a tuple of states, word) to (phrases of all languages in one integer, number of the next tuple)."""
        self._steps: dict[tuple[int, str], tuple[int, int]] = {}
        self._states, self._numbers = [], {}
        self._start = self._step((0,) * len(self._automata), " ")

    def _step(self, states: tuple[int, ...], text: str) -> tuple[int, int]:
        made = [a.parse(text, state) for a, state in zip(self._automata, states, strict=True)]
        after = tuple(state for _, state in made)
        if after not in self._numbers:
            self._numbers[after] = len(self._states)
            self._states.append(after)
        return sum(n << _BITS * k for k, (n, _) in enumerate(made)), self._numbers[after]

    def word(self, word: str) -> bool:
        """Whether a word tells something: some language needs fewer phrases than another, and one for three letters at most."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) > _MEMO:
                self._words.clear()
            counts = [a.phrases(f" {word} ") for a in self._automata]
            got = self._words[word] = min(counts) < max(counts) and min(counts) <= max(1, len(word) // 3)
        return got

    def phrases(self, words: list[str]) -> list[int]:
        """Phrases of running words by language. A word after another starts from the states the other left."""
        if len(self._steps) > _MEMO:
            self._forget()
        steps, (total, at) = self._steps, self._start
        for w in words:
            step = steps.get((at, w))
            if step is None:
                step = steps[at, w] = self._step(self._states[at], w + " ")
            total += step[0]
            at = step[1]
        return [total >> _BITS * k & (1 << _BITS) - 1 for k in range(len(self._automata))]

    def language(self, text: str, label: str | None = None) -> tuple[str | None, float]:
        """(language, confidence) of a text: fewest phrases for the same characters; (None, 0) for a text without letters.

        The confidence is the runner-up's surplus of phrases as a share of its own. In a tie the label
        wins if it is among the best, else the earlier in LANGUAGES; the confidence is 0. Where no
        word tells anything, the label stands if it is one of the languages, else all words are parsed
        as they are, and the confidence is 0 too.
        """
        found = _WORD.findall(text)
        if not found:
            return None, 0.0
        if self._automata is None:
            self._build()
        low = [w.lower() for w in found]
        telling = [w for w in low if self.word(w)]
        names = list(self.texts)
        if not telling and label in names:
            return label, 0.0
        sums = self.phrases(telling or low)
        order = sorted(range(len(sums)), key=lambda k: (sums[k], names[k] != label, k))
        best, second = sums[order[0]], sums[order[1]] if len(order) > 1 else sums[order[0]]
        return names[order[0]], round((second - best) / second, 4) if second and telling else 0.0


def paragraphs(text: str) -> list[str]:
    """The pieces between runs of empty or blank lines, without empty pieces."""
    return [p for p in (p.strip() for p in _BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n"))) if p]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of running words of each text by label, those at the end shorter."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for p in paragraphs(text):
                w = [x.lower() for x in _WORD.findall(p)]
                out += [" ".join(w[k : k + PIECE]) for k in range(0, len(w), PIECE)]
            langs += [lang] * (len(out) - len(langs))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "piece"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """An identifier from labelled documents (id, text, lang), about ``sample_docs`` of a label.

    A word belongs to a language where it is about as common as anywhere (SHARE), which cleans out
    documents with untrue labels; words all languages share are kept in all. The automaton's text is
    made of running words of the label's documents that all belong to the language, as many runs as
    it takes to hold each such word. Words and runs are counted and chosen in the executors. Without labelled text the identifier knows no word and gives the label or else
    the first language, with confidence 0.
    """
    pieces = sampled(docs.select("id", "lang", "text"), LANGUAGES, sample_docs).where("text is not null").select("lang", "text").mapInArrow(_pieces, "lang string, piece string")
    counts = materialize(pieces.groupBy("lang", "piece").agg(F.count("*").alias("n")), "pieces")
    words = counts.select("lang", "piece", "n", F.posexplode(F.split("piece", " ")).alias("pos", "word"))
    by_word = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = by_word.groupBy("lang").agg(F.sum("n").alias("total"))
    share = by_word.join(F.broadcast(total), "lang").select("lang", "word", "n", (F.col("n") / F.col("total")).alias("share"))  # a row a language
    most = share.groupBy("word").agg(F.max("share").alias("most"))
    own = share.join(most, "word").where((F.col("n") >= LEAST_COUNT) & (F.col("share") >= SHARE * F.col("most"))).select("lang", "word")
    marked = words.join(own.withColumn("own", F.lit(True)), ["lang", "word"], "left")
    listed = marked.groupBy("lang", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("own"), F.col("word")).otherwise("\n").alias("word")))).alias("w"))  # PIECE words at most
    runs = listed.select("lang", F.explode(F.split(F.array_join(F.transform("w", lambda x: x["word"]), " "), "\n")).alias("run")).select("lang", F.trim("run").alias("piece")).where("piece != ''").distinct()
    picked = runs.select("lang", "piece", F.explode(F.split("piece", " ")).alias("word")).groupBy("lang", "word").agg(F.max(F.struct(F.length("piece"), "piece")).alias("p")).select("lang", "p.piece").distinct()
    texts: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    covered: set[tuple[str, str]] = set()
    for lang, piece in sorted(map(tuple, picked.collect()), key=lambda x: (x[0], -len(x[1]), x[1])):  # a run a word of the sample at most
        fresh = {(lang, w) for w in piece.split(" ")} - covered
        if fresh:
            covered |= fresh
            texts[lang].append(piece)
    return Identifier(texts)


def _segments(identifier: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, lang, conf, size = [], [], [], [], []
            for row, (text, label) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                for k, p in enumerate(paragraphs(text), 1):
                    found, c = identifier.language(p, label)
                    if found:
                        at.append(row)
                        no.append(k)
                        lang.append(found)
                        conf.append(c)
                        size.append(len(p))
            ids, labels = batch.column("id").take(pa.array(at, pa.int64())), batch.column("lang").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(size, pa.int32())], names=["id", "label", "seg_no", "lang", "confidence", "chars"])

    return run


def segments(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """(id, label, seg_no, lang, confidence, chars) of every paragraph with letters.

    Texts are read whole and in place, without a shuffle. Only null texts and paragraphs without
    letters give no row; a repeated document gives its paragraphs again.
    """
    rows = docs.where("text is not null").select(F.col("id").cast("long").alias("id"), "text", "lang")
    return rows.mapInArrow(_segments(identifier), "id long, label string, seg_no int, lang string, confidence double, chars int")


def documents(segs: DataFrame) -> DataFrame:
    """(id, label, lang, confidence, languages) of every document: the language of most characters.

    The confidence is the mean of its paragraphs' by characters, times its share of the document.
    """
    by = segs.groupBy("id", "label", "lang").agg(F.sum("chars").alias("chars"), F.sum(F.col("confidence") * F.col("chars")).alias("weight"))
    best = F.max_by(F.struct("lang", "chars", "weight"), F.struct("chars", "lang"))
    out = by.groupBy("id", "label").agg(best.alias("b"), F.sum("chars").alias("all"), F.count("*").cast("int").alias("languages"))
    return out.select("id", "label", F.col("b.lang").alias("lang"), F.round(F.col("b.weight") / F.col("all"), 4).alias("confidence"), "languages")
