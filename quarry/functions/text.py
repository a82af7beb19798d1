"""Text normalizers, slugs, classifiers and extractors as column expressions.

The normalizers are not interchangeable: each is the key of certain tables, and a key made by one
does not join with a key made by another. Only compatibility folding (NFKC), which the JVM's
expressions lack, is an Arrow function, and it is given only texts outside plain Latin and Cyrillic.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"
#: Texts of these characters only are their own NFKC form.
_STABLE = "^[\\t\\n\\r\\x20-\\x7E\\u00AB\\u00BB\\u0400-\\u045F\\u2013\\u2014]*$"


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore").astype(object).where(s.notna(), None)


def nfkc(x: Column) -> Column:
    stable = x.rlike(_STABLE)
    return F.when(stable, x).otherwise(_nfkc(F.when(~stable, x)))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def _casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def _fold_yo(x: Column) -> Column:
    return F.replace(x, F.lit("ё"), F.lit("е"))


def clean(x: Column) -> Column:
    """Collapsed text, null where nothing is left."""
    return F.nullif(collapse(x), F.lit(""))


def key_plain(x: Column) -> Column:
    """Natural key of imported rows: collapsed, lower case, punctuation kept; null becomes empty."""
    return F.lower(F.coalesce(clean(x), F.lit("")))


# The sets of characters that the following keys keep are fixed values: each must equal that of the tables it joins.


def key_catalog(x: Column) -> Column:
    """Key of the catalog's lookups: ё stays, other signs become blanks after trimming, so a trailing blank may remain."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(nfkc(x))), "[^0-9a-zа-яё+ ]", " "), r"\s+", " ")


def key_title(x: Column) -> Column:
    """Key of titles and flat indicators."""
    return F.trim(F.regexp_replace(_fold_yo(_casefold(nfkc(x))), "[^0-9a-zа-я+]+", " "))


#: Fixed values, applied in this order: dashes and split abbreviations as they are unified for duplicate search.
DEDUP_REPLACED = [("‑", "-"), ("–", "-"), ("—", "-"), ("ci cd", "ci/cd"), ("ci / cd", "ci/cd"), ("m v p", "mvp"), ("ok r", "okr")]


def key_dedup(x: Column) -> Column:
    """Key of duplicate search: dashes unified, split abbreviations joined, brackets dropped, + - / kept."""
    t = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), DEDUP_REPLACED, _fold_yo(_casefold(nfkc(x))))
    return collapse(F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), "[^0-9a-zа-я+/ -]+", " "))


def search_norm(x: Column) -> Column:
    """Key of substring search: folded and collapsed, punctuation kept; null becomes empty."""
    return collapse(_fold_yo(_casefold(F.coalesce(x, F.lit("")))))


def key_admin(x: Column) -> Column:
    """Key of hand-made entries and aliases: all but letters, digits and + become blanks."""
    return collapse(F.regexp_replace(_fold_yo(_casefold(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}+ ]", " "))


def key_lookup(x: Column) -> Column:
    """Key of hierarchy matching: blanks and light punctuation removed altogether."""
    return F.regexp_replace(_fold_yo(_casefold(x)), "(?U)[\\s\\-_\"'`().,/]+", "")


def key_scope(x: Column) -> Column:
    """Key of template scopes."""
    return collapse(F.regexp_replace(_fold_yo(_casefold(x)), "[^0-9a-zа-я+ ]", " "))


def key_dictionary(x: Column) -> Column:
    """Key of translation dictionaries: & is ``and``; blanks, _ and / part words; + - . stay."""
    t = F.replace(_fold_yo(_casefold(x)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_/]+", " "), "[^0-9a-zа-я+. -]", ""))


def key_query(x: Column) -> Column:
    """Key of renames and of the query cache."""
    return collapse(_fold_yo(_casefold(x)))


def slug(x: Column, fallback: str = "item") -> Column:
    """Letters and digits joined by ``-``."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def clean_profile_name(x: Column) -> Column:
    """A profile's name from a file name: without extension, version and warning marks; unchanged if nothing is left."""
    t = F.regexp_replace(x, r"(?i)\.(xlsx|xls|csv|docx)$", "")
    t = F.regexp_replace(t, "_+", " ")
    t = F.regexp_replace(t, r"(?i)\s*(warning|v\d+(\.\d+)*|\(\d+\))\s*$", "")
    return F.coalesce(F.nullif(collapse(t), F.lit("")), x)


#: Words that may not end a shortened label.
DANGLING = ["и", "или", "в", "во", "на", "для", "по", "с", "со", "к", "ко", "о", "об", "от", "до", "из"]


def strip_dangling(x: Column) -> Column:
    """Without an open bracket, and without connecting words and signs at the end."""
    closed = F.regexp_replace(x, r"\([^)]*$", "")
    signs = r"[.,:;()-]*"
    words = rf"(?iU)(?:(?:^|\s+){signs}(?:{'|'.join(DANGLING)}){signs})+\s*$"
    trimmed = F.regexp_replace(closed, r"[\s.,:;(-]+$", "")
    return collapse(F.regexp_replace(F.regexp_replace(trimmed, words, ""), r"^[\s.,:;(-]+|[\s.,:;-]+$", ""))


def drop_latin_notes(x: Column) -> Column:
    """(Fixed pattern.) Without brackets that hold Latin letters."""
    return collapse(F.regexp_replace(x, r"\s*\([^)]*[A-Za-z][^)]*\)", ""))


def limit_words(x: Column, max_chars: int) -> Column:
    """Cut at the last blank within ``max_chars`` characters, with an ellipsis; a single long word is cut inside."""
    head = F.substring(x, 1, max_chars)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    whole_word = F.substring(x, max_chars + 1, 1) == " "
    short = F.when(whole_word, head).otherwise(cut)
    return F.when(F.length(x) <= max_chars, x).otherwise(F.concat(F.regexp_replace(short, r"[\s,;:]+$", ""), F.lit("…")))


def compact(x: Column, max_words: int, max_chars: int) -> Column:
    """The first words of a text, limited and without a dangling tail."""
    words = F.split(collapse(x), " ")
    return strip_dangling(limit_words(F.array_join(F.slice(words, 1, max_words), " "), max_chars))


def join_limited(values: Column, limit: int) -> Column:
    """The first values joined by commas, and how many more there are."""
    more = F.size(values) - limit
    return F.concat(F.array_join(F.slice(values, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" и ещё "), more.cast("string"))).otherwise(F.lit("")))


def weights_percent(names: Column) -> Column:
    """``name: p%`` per name, equal integer percentages whose rest falls on the last."""
    n = F.size(names)
    each = F.floor(F.lit(100) / n).cast("int")
    return F.array_join(F.transform(names, lambda x, i: F.concat(x, F.lit(": "), F.when(i == n - 1, F.lit(100) - each * (n - 1)).otherwise(each).cast("string"), F.lit("%"))), ", ")


#: Labels before a sentence, which are no part of it, and words of contact data.
SECTION_LABELS = ["наименование", "идея", "целевая аудитория", "участники", "результат", "цель", "задача", "описание", "требования", "контекст"]
CONTACT_WORDS = ["телефон", "email", "http", "www"]


def sentences(x: Column, low: int = 12, high: int = 180, first: int = 12) -> Column:
    """Distinct sentences of fitting length in order, without section labels and contact data; case and ё make no difference."""
    label = rf"(?iU)^({'|'.join(SECTION_LABELS)})\s*[:-]\s*"
    contact = rf"(?U)\b({'|'.join(CONTACT_WORDS)})\b"
    parts = F.transform(F.split(x, r"[\n.;•]+"), lambda s: collapse(F.regexp_replace(F.regexp_replace(s, label, ""), r"^[ \t:-]+|[ \t:-]+$", "")))
    kept = F.filter(parts, lambda s: F.length(s).between(low, high) & ~F.lower(s).rlike(contact))
    keys = F.transform(kept, lambda s: _fold_yo(_casefold(s)))
    return F.slice(F.filter(kept, lambda s, i: F.array_position(keys, _fold_yo(_casefold(s))) == i + 1), 1, first)


def reason_codes(x: Column) -> Column:
    """Distinct trimmed tokens of a list separated by commas or semicolons; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[,;]"), lambda s: F.trim(s)), lambda s: s != ""))


def pair_list(x: Column) -> Column:
    """``a>b;c>d`` as an array of structs; malformed chunks are skipped."""
    chunks = F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda s: F.size(F.split(s, ">")) == 2)
    pairs = F.transform(chunks, lambda s: F.struct(F.trim(F.split(s, ">")[0]).alias("left"), F.trim(F.split(s, ">")[1]).alias("right")))
    return F.filter(pairs, lambda p: (p["left"] != "") & (p["right"] != ""))


def parse_source_ref(x: Column) -> Column:
    """struct(workbook, sheet, row_no) of ``workbook::sheet::row-N``; null parts where absent."""
    parts = F.split(x, "::")
    return F.struct(
        F.when(F.size(parts) >= 2, parts[0]).alias("workbook"),
        F.when(F.size(parts) >= 2, parts[1]).alias("sheet"),
        F.regexp_extract(x, r"::row-(\d+)$", 1).try_cast("int").alias("row_no"),
    )


def timestamp_any(x: Column) -> Column:
    """Either encoding of a time (blank-separated, or ISO with offset) as a timestamp; null if neither."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(x))


def value_kind(x: Column) -> Column:
    """Kind of a level cell: plus, minus, number or text."""
    return F.when(x == "+", "plus").when(x == "-", "minus").when(x.rlike(r"^-?\d+(?:[.,]\d+)?$"), "number").otherwise("text")


def number(x: Column) -> Column:
    """A decimal written with point or comma; null if it is none."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def looks_corrupted(x: Column) -> Column:
    """More than a third of the non-blank characters are question marks or lost ones."""
    solid = F.regexp_replace(x, r"\s", "")
    return (F.length(solid) - F.length(F.regexp_replace(solid, "[?�]", ""))) * 3 > F.length(solid)


def snap(x: Column, bands: list[int]) -> Column:
    """The nearest band; the smaller of two equally near."""
    return F.array_min(F.transform(F.array(*map(F.lit, bands)), lambda b: F.struct(F.abs(b - x).alias("d"), b.alias("b"))))["b"]


def classify(x: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Label of the first rule of which a hint occurs in the text."""
    out = None
    for label, hints in rules:
        hit = F.lit(False)
        for h in hints:
            hit = hit | x.contains(h)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def tags(x: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """All labels of which a hint occurs in the text, in order."""
    found = F.array(*[F.when(classify(x, [r]).isNotNull(), F.lit(r[0])) for r in rules])
    return F.filter(found, lambda t: t.isNotNull())


def token_set(x: Column, stop: list[str] | None = None, shortest: int = 3) -> Column:
    """Sorted distinct words of the title key, without short and stop words."""
    words = F.filter(F.split(key_title(x), " "), lambda w: F.length(w) >= shortest)
    return F.array_sort(F.array_distinct(words if not stop else F.array_except(words, F.array(*map(F.lit, stop)))))


def workload(x: Column) -> Column:
    """struct(months, hours_per_week, total_hours) named in a text; a range counts with its upper end."""
    t = F.lower(x)
    span = r"(?:\d+(?:[.,]\d+)?\s*[-–—]\s*)?(\d+(?:[.,]\d+)?)\s*"
    months = number(F.regexp_extract(t, span + "(?:мес|month)", 1))
    hours = number(F.regexp_extract(t, span + r"(?:час|ч|hour|h)\S*\s*(?:в|/|per|a)\s*(?:нед|week)", 1))
    return F.struct(months.alias("months"), hours.alias("hours_per_week"), F.bround(months * 4.345 * hours, 0).alias("total_hours"))
