"""Mixing sources to target weights by iterative proportional fitting.

Documents are sized in tokens of a public tokenizer. Their totals by (source, language, topic) cell
are raked: the cells' weights are scaled to the marginals of the sources, languages and topics in
turn, no weight exceeding the source's cap of repeats, until they stand still; the sources come
last, so their shares are met exactly wherever the caps allow. A document's weight is its expected
number of uses. Uses are drawn by systematic sampling along the running sum of fractional uses, in
order of size, so a source misses its share by little, and equal input gives equal output.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A source's running sum is taken over size classes, so many an octave, each in so many hashed parts.
CLASSES, PARTS = 4, 128
_MEMO = 500_000


def token_counter(vocabulary: str = VOCABULARY):
    """A function from a text column to its number of tokens, null for null.

    The tokenizer splits a text by its pattern and encodes each piece by itself, so the counts of
    pieces are kept between texts; the sum is exactly the length of the whole text's encoding.
    """

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = regex.compile(public_tokenizers.PATTERN).findall
        memo: dict[str, int] = {}

        def count(text: str) -> int:
            n = 0
            for p in pieces(text):
                k = memo.get(p)
                if k is None:
                    if len(memo) > _MEMO:
                        memo.clear()
                    k = len(encoding.encode_ordinary(p))
                    if len(p) < 64:
                        memo[p] = k
                n += k
            return n

        for s in batches:
            yield pd.Series([count(t) if isinstance(t, str) else None for t in s], dtype="Int64")

    return run


def rake(cells: pd.DataFrame, targets: dict[str, tuple[float, int]], rounds: int = 200, tolerance: float = 1e-9) -> pd.DataFrame:
    """Weights by cell; ``cells`` has source, lang, topic, tokens, ``targets`` source to (share, max_repeat).

    The size of the mixture is the largest at which every source with documents can reach its share
    within its cap. Languages and topics aim at their shares of the documents themselves. Sources
    without a target get weight 0; shares of targets without documents are spread over the others.
    """
    c = cells.copy()
    c["weight"] = 0.0
    share = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0}
    used = c["source"].isin(share.keys()) & (c["tokens"] > 0)
    if not used.any():
        return c
    u = c[used].copy()
    supply = u.groupby("source")["tokens"].sum()
    total = sum(share[s][0] for s in supply.index)
    size = min(supply[s] * share[s][1] / (share[s][0] / total) for s in supply.index)
    code = {by: pd.factorize(u[by])[0] for by in ("source", "lang", "topic")}
    goal = {"source": pd.Series({s: size * share[s][0] / total for s in supply.index})}
    for by in ("lang", "topic"):
        t = u.groupby(by)["tokens"].sum()
        goal[by] = t / t.sum() * size
    want = {by: u[by].map(goal[by]).to_numpy(float) for by in code}
    cap = u["source"].map(lambda s: float(share[s][1])).to_numpy(float)
    w = u["source"].map(goal["source"] / supply).to_numpy(float)
    tok = u["tokens"].to_numpy(float)

    def fit(w: np.ndarray, by: str) -> np.ndarray:
        # scaling under a cap: what capped cells can't take goes to the others of the margin
        at = code[by]
        for _ in range(20):
            free = w < cap - 1e-12
            fixed = np.bincount(at, np.where(free, 0.0, w * tok))[at]
            loose = np.bincount(at, w * tok)[at] - fixed
            factor = np.divide(want[by] - fixed, loose, out=np.ones_like(w), where=free & (loose > 0)).clip(min=0.0)
            new = np.minimum(w * factor, cap)
            if np.abs(new - w).max() <= tolerance * max(1.0, w.max()):
                return new
            w = new
        return w

    for _ in range(rounds):
        before = w
        for by in ("lang", "topic", "source"):
            w = fit(w, by)
        if np.abs(w - before).max() <= tolerance * max(1.0, w.max()):
            break
    c.loc[used, "weight"] = w
    return c


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, repeats) of the documents used at least once.

    ``docs`` has id (unique), source, lang, topic and tokens, and is read three times: pass a written
    table. Documents of no tokens, of a null source or of a source without target are not used. A
    null language or topic is a value of its own, ``und`` or ``none``. Every language and
    topic is raked as itself; the driver holds the cells that occur, at most sources x languages x
    topics.
    """
    d = docs.where("tokens > 0 and source is not null").select(F.col("id").alias("doc_id"), "source", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("topic", F.lit("none")).alias("topic"), "tokens")
    named = targets.where("source is not null and target_share is not null and max_repeat is not null")
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeat"])) for r in named.collect()}
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(named.select("source").distinct()), "source")
    weights = rake(cells.toPandas(), goal)
    table = [(r.source, r.lang, r.topic, float(r.weight)) for r in weights.itertuples() if r.weight > 0]
    w = d.join(F.broadcast(docs.sparkSession.createDataFrame(table, "source string, lang string, topic string, weight double")), ["source", "lang", "topic"])
    whole = F.floor("weight")
    w = w.withColumn("whole", whole.cast("int")).withColumn("part", F.col("weight") - whole).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    w = w.withColumn("stratum", (F.floor(F.log2("tokens") * CLASSES) * PARTS + F.pmod("h", F.lit(PARTS))).cast("int"))
    sums = w.groupBy("source", "stratum").agg(F.sum("part").alias("mass"))
    ahead = sums.select("source", "stratum", (F.sum("mass").over(Window.partitionBy("source").orderBy("stratum")) - F.col("mass")).alias("ahead"))
    run = F.sum("part").over(Window.partitionBy("source", "stratum").orderBy("tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    s = w.withColumn("run", run).join(F.broadcast(ahead), ["source", "stratum"])  # some 30 octaves x CLASSES x PARTS rows a source at most
    upto = F.col("ahead") + F.col("run") + 0.5
    extra = F.when(F.col("part") > 0, F.floor(upto) - F.floor(upto - F.col("part"))).otherwise(0)
    return s.withColumn("repeats", (F.col("whole") + extra).cast("int")).where("repeats > 0").select("doc_id", "source", "lang", "topic", "tokens", "repeats")


def shares(docs: DataFrame, mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target or documents: target and actual share, tokens there and used, documents, largest repeat."""
    there = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = targets.select("source", "target_share", "max_repeat")
    out = goal.join(there, "source", "full_outer").join(used, "source", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    out = out.select("source", zero("target_share", "double"), zero("max_repeat", "int"), zero("tokens", "long"), zero("used_tokens", "long"), zero("documents", "long"), zero("most_repeats", "int"))
    total = F.sum("used_tokens").over(Window.partitionBy())  # one row a source
    return out.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0))
