"""Word strings: the normal form in which texts are compared."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where Unicode has characters of category Cf: the basic plane and a few blocks above it.
_CF_BLOCKS = [(0xAD, 0x10000), (0x110B0, 0x110D0), (0x13430, 0x13460), (0x1BCA0, 0x1BCB0), (0x1D170, 0x1D180), (0xE0000, 0xE0080)]
_FORMAT = re.compile("[" + "".join(chr(c) for lo, hi in _CF_BLOCKS for c in range(lo, hi) if unicodedata.category(chr(c)) == "Cf") + "]")
_WORD_PLUS = re.compile(r"[\w+#]+")
_WORD = re.compile(r"\w+")
_PARTS = re.compile("[;|]")


def fold(text: str) -> str:
    """NFKC, lower case, ё as е, without format characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not text.isprintable():  # a printable text has no format character
            text = _FORMAT.sub("", text)
    return text.lower().replace("ё", "е")


def words(text: str, plus: bool = True) -> list[str]:
    """Maximal runs of letters and digits, with ``plus`` also of ``+`` and ``#``."""
    return (_WORD_PLUS if plus else _WORD).findall(fold(text).replace("_", " "))


def word_string(text: str, plus: bool = True) -> str:
    """All words of a text joined by one space; empty for a text without words."""
    return " ".join(words(text, plus))


def canonical_parts(text: str) -> str:
    """The sorted word strings of the parts between ``;`` and ``|``, joined by ``;``."""
    return ";".join(sorted(s for s in map(word_string, _PARTS.split(text)) if s))


def sampled(docs: DataFrame, labels: list[str], size: int) -> DataFrame:
    """About ``size`` documents (id, lang, ...) of each label, all where there are no more; the same ones however the table is split.

    A document is taken if the hash of its id lies below its label's threshold, which comes from
    the label's number of documents; so nothing is sorted and nothing but the numbers is collected.
    """
    share = {r[0]: size / r[1] for r in docs.where(F.col("lang").isin(labels)).groupBy("lang").count().collect()}
    limit = F.lit(0.0)
    for lang, x in share.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(x, 1.0))).otherwise(limit)
    return docs.where(F.col("lang").isin(labels) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < limit * float(1 << 40)))


def _column(function: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(function, na_action="ignore").astype(object).where(s.notna(), None)

    return run


def canonical_key(text: Column) -> Column:
    """``canonical_parts`` as a column by Arrow batches, several times as fast as regular expressions of the JVM.

    Null stays null; texts without words give an empty string.
    """
    return _column(canonical_parts)(text)


def word_string_column(text: Column) -> Column:
    """``word_string`` (with + and #) as a column by Arrow batches; null stays null."""
    return _column(word_string)(text)
