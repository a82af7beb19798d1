"""Similarity of short texts, resolution cascades and greedy deduplication, without pairwise comparison of tables."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.storage import materialize


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two token sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens as a share of the smaller set; 0 where one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def sorted_ratio(a: str, b: str) -> float:
    """Indel ratio in percent of two texts whose words are sorted first."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``sorted_ratio`` of two columns; null where one is null."""
    for a, b in pairs:
        yield pd.Series([sorted_ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio of two columns in 0..1; null where one is null."""
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def word_sorted(texts: pd.Series) -> pd.Series:
    """The text's words, split at any blank, in order; null for null."""
    return texts.map(lambda t: " ".join(sorted(t.split())) if isinstance(t, str) else None)


def _ratio_candidates(keys: DataFrame, names: DataFrame, ratio_min: float) -> DataFrame:
    """(k, n) of all word-sorted keys (k) and names (n) that can reach the Indel ratio, and some others; both distinct.

    A ratio of at least ``ratio_min`` percent allows ``(1 - ratio_min / 100)`` edits a character of both,
    each of which touches one piece of the name at most. A name is cut into one piece more than the
    edits that its longest partner allows, so a partner holds a piece unchanged, moved by no more than
    the edits. A name of fewer characters than pieces has an empty piece, which every key holds.
    """
    share = 1 - ratio_min / 100
    ln, lk = F.length("n"), F.length("k")
    longest = F.floor(ln * (200 - ratio_min) / ratio_min + 1e-9)
    sized = names.withColumn("ln", ln).withColumn("m", (F.floor((ln + longest) * share + 1e-9) + 1).cast("int"))
    cut = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    start = F.floor(F.col("i") * F.col("ln") / F.col("m"))
    end = F.floor((F.col("i") + 1) * F.col("ln") / F.col("m"))
    pieces = cut.select("n", "ln", start.cast("int").alias("at_n"), (end - start).cast("int").alias("size"))
    pieces = materialize(pieces.withColumn("piece", F.expr("substring(n, at_n + 1, size)")), "pieces")
    # an empty piece is joined once, whatever the position
    sizes = [r[0] for r in pieces.select("size").distinct().collect()]
    at = F.explode(F.sequence(F.lit(0), F.col("lk") - F.col("size")))
    held = keys.withColumn("lk", lk).withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"))).where("size <= lk and size > 0")
    held = held.select("k", "lk", "size", at.alias("at_k")).select("k", "lk", "at_k", F.expr("substring(k, at_k + 1, size)").alias("piece"))
    held = held.unionByName(keys.select("k", lk.alias("lk"), F.lit(0).alias("at_k"), F.lit("").alias("piece")))
    near = F.least("ln", "lk") * (200 - ratio_min) + 1e-6 >= F.greatest("ln", "lk") * ratio_min
    moved = (F.col("size") == 0) | (F.abs(F.col("at_n") - F.col("at_k")) <= (F.col("ln") + F.col("lk")) * share + 1e-9)
    return held.join(pieces, "piece").where(near & moved).select("k", "n").distinct()


def jaccard_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of all items (id, tokens) whose sets reach the threshold, exactly.

    Tokens are ordered by rising frequency; two sets that reach the threshold share one of each
    other's first ``n - ceil(threshold * n) + 1`` tokens, so only those are joined, with a length
    bound in the join. Empty sets pair with nothing.
    """
    flat = items.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    freq = flat.groupBy("token").agg(F.count("*").alias("df"))
    ordered = flat.join(freq, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    sized = materialize(ordered.select("id", F.transform("o", lambda x: x["token"]).alias("tokens"), F.size("o").alias("n")), "tokens")
    prefix = sized.select("id", "n", F.explode(F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("token"))
    x, y = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "token"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "token")
    close = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    cand = x.join(y, "token").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    side = lambda c: sized.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    scored = cand.join(side("a"), "a").join(side("b"), "b").select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold - 1e-12)


def resolve_cascade(values: DataFrame, entries: DataFrame, aliases: DataFrame, fuzzy_min: float = 90.0) -> DataFrame:
    """(key, resolution, entry_id, score) of values (key): exact name, else alias, else fuzzy, else new.

    ``entries`` and ``aliases`` have entry_id and key; of equal keys the smallest entry counts for
    names and the largest for aliases. Fuzzy meets every pair of a value left over and an entry
    whose ratio reaches ``fuzzy_min`` (above 0); ties go to the smaller entry. A null or empty key is new.
    """
    v = values.select("key").distinct()
    exact = entries.groupBy("key").agg(F.min("entry_id").alias("exact"))
    alias = aliases.groupBy("key").agg(F.max("entry_id").alias("alias"))
    known = materialize(v.join(exact, "key", "left").join(alias, "key", "left"), "cascade")
    rest = materialize(known.where("exact is null and alias is null and key != ''").select("key", word_sorted("key").alias("k")), "rest")
    names = materialize(entries.where("key is not null").groupBy(word_sorted("key").alias("n")).agg(F.min("entry_id").alias("entry_id")), "names")
    cand = _ratio_candidates(rest.select("k").distinct(), names.select("n"), fuzzy_min)
    scored = cand.withColumn("score", token_sort_ratio("k", "n")).where(F.col("score") >= fuzzy_min).join(names, "n")
    best = scored.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry_id")).alias("f")).join(rest, "k").select("key", "f")
    out = known.join(best, "key", "left")
    kind = F.when(F.col("exact").isNotNull(), "matched").when(F.col("alias").isNotNull(), "alias").when(F.col("f").isNotNull(), "fuzzy").otherwise("new")
    score = F.when(F.col("exact").isNotNull() | F.col("alias").isNotNull(), F.lit(100.0)).otherwise(-F.col("f.s"))
    return out.select("key", kind.alias("resolution"), F.coalesce("exact", "alias", "f.entry_id").alias("entry_id"), score.alias("score"))


def greedy_absorb(pairs: DataFrame) -> DataFrame:
    """(id, anchor): each item that an earlier kept item absorbs, given similar pairs (a, b) with a before b.

    The result is that of walking the items in order and absorbing each into its first kept
    neighbour, but in rounds over all items: an item is kept once none of its earlier neighbours is
    undecided or kept, and absorbed once one is kept and all before that one are decided.
    """
    spark = pairs.sparkSession
    open_edges = materialize(pairs.select("a", "b").distinct(), "greedy")
    absorbed: list[DataFrame] = []
    while not open_edges.isEmpty():  # every round decides the first undecided item at least
        waiting = open_edges.select(F.col("b").alias("id")).distinct()
        kept = open_edges.select(F.col("a").alias("id")).distinct().join(waiting, "id", "left_anti")
        firsts = open_edges.groupBy("b").agg(F.min("a").alias("a"))
        taken = materialize(firsts.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"), F.col("a").alias("anchor")), "taken")
        absorbed.append(taken)
        gone = taken.select("id")
        left = open_edges.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        open_edges = materialize(left.select("a", "b"), "greedy")
    if not absorbed:
        kind = pairs.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, anchor {kind}")
    out = absorbed[0]
    for x in absorbed[1:]:
        out = out.unionByName(x)
    return out


#: Actions taken for each other, words left out, endings cut.
_ACTIONS = {"формализация": "формулирование", "интеграция": "настройка", "setup": "настройка"}
_DROPPED = {"для", "задач", "user", "story", "workflow", "process", "простого", "базового"}
#: The first suffix that fits is cut, so their order counts.
_SUFFIXES = "иями ями ами ого его ому ему ыми ими ий ый ой ая ое ые ов ев ам ям ах ях ия ие иям ию ии ть ти ция ции цией".split()


def _candidate_name(name: str) -> str:
    t = unicodedata.normalize("NFKC", name).casefold().replace("ё", "е")
    for old, new in (("‑", "-"), ("–", "-"), ("—", "-"), ("ci cd", "ci/cd"), ("ci / cd", "ci/cd"), ("m v p", "mvp"), ("ok r", "okr")):
        t = t.replace(old, new)
    return " ".join(re.sub(r"[^0-9a-zа-я+\-/ ]+", " ", re.sub(r"\([^)]*\)", " ", t)).split())


def _stem(word: str) -> str:
    word = _ACTIONS.get(word, word)
    if word in _DROPPED:
        return ""
    return next((word[: -len(x)] for x in _SUFFIXES if len(word) > len(x) + 3 and word.endswith(x)), word)


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """One run of the reference's walk: a candidate goes to the first kept one like it, which takes over its area if it has none."""
    bits: dict[tuple[str, int], int] = {}
    kept: list[list] = []
    out = []
    for r in rows.sort_values("id").itertuples(index=False):
        name, area, group = _candidate_name(r.name), r.area if isinstance(r.area, str) else "", (r.grp if isinstance(r.grp, str) else "").strip().casefold()
        words = [w for w in map(_stem, name.split()) if w]
        text, own = " ".join(words), set(words)
        # a bit for each occurrence of each character: common bits are the most characters that can match
        bag, seen = 0, {}
        for ch in text:
            seen[ch] = seen.get(ch, 0) + 1
            bag |= 1 << bits.setdefault((ch, seen[ch]), len(bits))
        matcher, mine = difflib.SequenceMatcher(None, "", text), area.strip()
        for anchor in kept:
            id_, name_, area_, group_, text_, own_, bag_ = anchor
            there = area_.strip()
            if there != mine if there and mine else not there and not mine and group_ and group and group_ != group:
                continue
            if name_ != name:
                if not own_ or not own:
                    continue
                both = len(own & own_)
                share = both / (len(own) + len(own_) - both)
                inside = both >= 2 and both == min(len(own), len(own_))
                if share < (0.72 if inside else 0.86):
                    least = 0.72 if inside else 0.93
                    if 2.0 * (bag & bag_).bit_count() / (len(text) + len(text_)) < least:
                        continue
                    matcher.set_seq1(text_)
                    if matcher.ratio() < least:
                        continue
            if not area_ and area:
                anchor[2] = area
            out.append((r.id, id_))
            break
        else:
            kept.append([r.id, name, area, group, text, own, bag])
    return pd.DataFrame(out, columns=["id", "anchor"]).astype("int64")


def absorb_candidates(rows: DataFrame) -> DataFrame:
    """(id, anchor): each candidate that an earlier kept one of its run absorbs; rows have id, run, name, area and grp.

    Two candidates of one area (of one group where neither has an area) are alike if their names are
    equal, or the Jaccard share of their stems is 0.86 or the sequence ratio 0.93, or one holds the
    other's two or more stems and either is 0.72. An anchor takes over an area, which changes
    whom it absorbs later, so a run is walked in order, in one task; runs are walked side by side.
    Rows of a null run are one run. Null names belong to nothing.
    """
    return rows.where("name is not null").select("id", "run", "name", "area", "grp").groupBy("run").applyInPandas(_walk, "id long, anchor long")
