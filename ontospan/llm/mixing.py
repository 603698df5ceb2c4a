"""Problem 8: mixing sources to target weights.

Method: iterative proportional fitting. Tokens are summed per cell of source, language and topic; weights of the cells are
raked to the three marginals, bounded by how often a source may be repeated, with the source marginal met exactly; then
documents are drawn with the calibrated weights: a weight of 2.3 is two copies and a third with probability 0.3. The
draw is a threshold on a hash of the document id, set from a histogram of the tokens below it, so that the realised
shares follow the calibrated ones closely at any size. Only cells reach the driver; more than MOST_CELLS are an error, which
names the parameter that merges rare languages and topics.
"""

from __future__ import annotations

import os
from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospan.functions.visual import consistent_form
from ontospan.session import cut, is_small

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MOST_CELLS = 100_000  # of source, language and topic; each has BINS numbers in the driver
BINS = 512


@cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text; null and empty texts have none."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def source_key(source: Column) -> Column:
    """A source's name without differences in case, surrounding blanks and kind of separator."""
    return F.regexp_replace(F.lower(F.trim(consistent_form(source))), r"[\s\-_]+", "_")


def fit(cells: list[tuple[str, str, str, float]], shares: dict[str, float], caps: dict[str, int], total: float | None = None, tolerance: float = 1e-6, rounds: int = 200) -> dict[tuple[str, str, str], float]:
    """Weight per cell (source, language, topic, tokens): tokens times weight has the shares of the sources, no weight exceeds its
    source's cap, and languages and topics keep their shares of all tokens as far as both allow.

    total is the number of tokens to reach; by default, and at most, the largest at which every source can have its share.
    Sources without tokens can't have a share: the others keep their proportions. Rounds end when no weight changes by more than
    tolerance of itself. Where caps and source shares leave the other marginals out of reach, the weights settle nearest to them.
    """
    cells = [c for c in cells if shares.get(c[0], 0) > 0 and c[3] > 0]
    have: dict[str, float] = defaultdict(float)
    for s, _, _, n in cells:
        have[s] += n
    if not have:
        return {}
    whole = sum(shares[s] for s in have)
    wanted = {s: shares[s] / whole for s in have}
    most = min(caps[s] * have[s] / wanted[s] for s in have)
    total = most if total is None else min(total, most)
    tokens, cap = np.array([c[3] for c in cells]), np.array([float(caps[c[0]]) for c in cells])
    of = [np.array([c[j] for c in cells]) for j in range(3)]
    natural = [{v: tokens[of[j] == v].sum() / tokens.sum() for v in set(of[j])} for j in (1, 2)]
    w = np.ones(len(cells))
    for _ in range(rounds):
        before = w.copy()
        for j in (1, 2):
            for v, share in natural[j - 1].items():
                m = of[j] == v
                if (now := (w[m] * tokens[m]).sum()) > 0:
                    w[m] *= share * total / now
        for s in have:  # bounded: the factor at which the capped weights give the source its share
            m = of[0] == s
            low, high = 0.0, 1.0
            reach = lambda f: (np.minimum(cap[m], f * w[m]) * tokens[m]).sum()  # noqa: B023, E731
            while reach(high) < wanted[s] * total * (1 - 1e-12) and high < 1e30:
                high *= 2
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if reach(mid) < wanted[s] * total else (low, mid)
            w[m] = np.minimum(cap[m], high * w[m])
        if (np.abs(w - before) <= tolerance * np.maximum(w, 1e-300)).all():
            break
    return {c[:3]: float(x) for c, x in zip(cells, w)}


def _unit(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 48)) / F.lit(float(1 << 48))


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER, least_value: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents chosen: doc_id, source, lang, topic, tokens, repeats; sources: mix_source, target_share, documents, tokens, actual_share;
    marginals: dimension, value, share of all tokens, actual_share).

    Copies of one text under several ids are one document (its smallest id), so no text exceeds max_repeats. Documents with
    no text, or a source that has no target, aren't chosen; the latter come out in the sources with a null target and zero
    tokens. Null languages and topics are values of their own; those with less than least_value of the tokens are fitted as one.
    """
    goals = targets.select(source_key(F.col("mix_source")).alias("source"), "mix_source", "target_share", "max_repeats")
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("note_kind", F.lit("?")).alias("topic"), "text")
    copies = F.min(F.struct("doc_id", "source", "lang", "topic")).alias("x")
    counted = rows.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "source", "lang", "topic", n_tokens(F.col("text"), tokenizer).alias("tokens"), F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    known = cut(counted.groupBy("h", "g", "tokens").agg(copies).select("x.*", "tokens"))  # narrow rows: each text is tokenised once
    goal = {r.source: r for r in goals.collect()}
    everything = known.agg(F.sum("tokens")).first()[0] or 0
    rare = {d: known.groupBy(d).agg(F.sum("tokens").alias("n")).where(F.col("n") < least_value * everything).select(d, F.lit("other").alias(f"cell_{d}")) for d in ("lang", "topic")}
    wanted = known.where(F.col("source").isin(list(goal))).withColumn("u", _unit(F.col("doc_id"), seed))
    for d in ("lang", "topic"):
        wanted = wanted.join(rare[d], d, "left").withColumn(f"cell_{d}", F.coalesce(f"cell_{d}", d)) if least_value > 0 else wanted.withColumn(f"cell_{d}", F.col(d))
    if not is_small(wanted.select("source", "cell_lang", "cell_topic").distinct(), MOST_CELLS):
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic: give least_value")
    bins = wanted.groupBy("source", "cell_lang", "cell_topic", (F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("n")).collect()
    below: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(BINS))
    for r in bins:
        below[r.source, r.cell_lang, r.cell_topic][r.bin] += r.n
    weights = fit([(*k, v.sum()) for k, v in below.items()], {s: g.target_share for s, g in goal.items()}, {s: g.max_repeats for s, g in goal.items()}, total)
    plan = []
    for k, w in weights.items():
        sure = min(int(w + 1e-9), goal[k[0]].max_repeats)
        need = max(0.0, w - sure) * below[k].sum()
        sums = np.concatenate([[0.0], np.cumsum(below[k])])
        plan.append((*k, sure, float(np.interp(need, sums, np.arange(BINS + 1) / BINS)) if need > 0 else 0.0))
    cells = documents.sparkSession.createDataFrame(plan, "source string, cell_lang string, cell_topic string, sure int, upto double")
    drawn = wanted.join(F.broadcast(cells), ["source", "cell_lang", "cell_topic"])  # at most MOST_CELLS rows
    chosen = drawn.select("doc_id", "source", "lang", "topic", "tokens", (F.col("sure") + (F.col("u") < F.col("upto")).cast("int")).alias("repeats")).where(F.col("repeats") > 0)
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"))
    all_sources = known.select("source").distinct().join(goals, "source", "full")
    shares = all_sources.join(used, "source", "left").fillna(0, ["n_documents", "most_repeats", "n_tokens"])
    sum_used = used.agg(F.sum("n_tokens")).scalar()
    shares = shares.select(F.coalesce("mix_source", "source").alias("source"), "target_share", "max_repeats", "n_documents", "most_repeats", "n_tokens", (F.col("n_tokens") / sum_used).alias("actual_share"))
    of_all = known.where(F.col("source").isin(list(goal)))
    marginals = [
        of_all.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("n_available"))
        .join(chosen.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens")), "value", "left").fillna(0, ["n_tokens"])
        for d in ("lang", "topic")
    ]
    sum_all = of_all.agg(F.sum("tokens")).scalar()
    marginals = marginals[0].unionByName(marginals[1]).select("dimension", "value", "n_available", "n_tokens", (F.col("n_available") / sum_all).alias("share"), (F.col("n_tokens") / sum_used).alias("actual_share"))
    return chosen, shares, marginals


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(*_tables(spark, sf))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(*_tables(spark, sf))[1]


def p8_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """Per language and topic its share of the tokens at hand and of those chosen."""
    return mixed(*_tables(spark, sf))[2]
