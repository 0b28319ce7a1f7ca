"""Looking into the counts. Everything has a total order; a random sample is one by the hash of a seed and the keys, so that it can be drawn again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(counts: DataFrame, n: int, *keys: str, by: str = "cnt") -> DataFrame:
    return counts.orderBy(F.desc(by), *keys).limit(n)


def bottom(counts: DataFrame, n: int, *keys: str, by: str = "cnt") -> DataFrame:
    return counts.orderBy(by, *keys).limit(n)


def pairs_with(pairs: DataFrame, word: str, n: int = 50) -> DataFrame:
    """(other, cnt) of the n most frequent pairs with the word."""
    other = F.when(F.col("w1") == word, F.col("w2")).otherwise(F.col("w1")).alias("other")
    return pairs.where((F.col("w1") == word) | (F.col("w2") == word)).select(other, "cnt").orderBy(F.desc("cnt"), "other").limit(n)


def trigrams_with(trigrams: DataFrame, word: str) -> DataFrame:
    return trigrams.where((F.col("w1") == word) | (F.col("w2") == word) | (F.col("w3") == word))


def relations_with(deps: DataFrame, word: str) -> DataFrame:
    return deps.where((F.col("head") == word) | (F.col("child") == word))


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def sample(df: DataFrame, n: int, *keys: str, seed: int = 1) -> DataFrame:
    """n rows at random, each at most once."""
    return df.orderBy(_draw(F.lit(seed), *keys), *keys).limit(n)


def sample_by_word(by_word: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(draw, word, dep, head, child): n draws with replacement of a word, each as likely, and of a relation of that word. Every draw is a minimum, which is combined before the shuffle."""
    draws = by_word.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("draw"))
    words = draws.groupBy("draw").agg(F.min_by("word", F.struct(_draw(F.lit(seed), "draw", "word"), "word")).alias("word"))
    relations = by_word.join(words, "word").groupBy("draw", "word").agg(F.min(F.struct(_draw(F.lit(seed), "draw", "dep", "head", "child").alias("h"), "dep", "head", "child")).alias("x"))
    return relations.select("draw", "word", "x.dep", "x.head", "x.child")
