"""What needs a model, behind small interfaces. Built-in stand-ins are deterministic; a missing provider gives empty results, never an exception."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import tokens as T


class Tokenizer(Protocol):
    """One that is pure SQL also has toks(text: Column) -> Column, which spares texts beside a table a shuffle."""

    def tag(self, sentences: DataFrame) -> DataFrame:
        """Adds toks array<struct(sf, p, l, d)> to a table with sent."""


class DependencyParser(Protocol):
    def edges(self, sentences: DataFrame) -> DataFrame:
        """(key columns, dep, head, child, head_pos, child_pos) of a table with toks."""


class MaskedLM(Protocol):
    def distribution(self, contexts: DataFrame) -> DataFrame:
        """(item_id, token, logit) for contexts (item_id, prev_word, next_word)."""

    def log_probs(self, slots: DataFrame) -> DataFrame:
        """Adds logp to slots with prev, word, next."""


_MAKERS: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, make) -> None:
    """Makes a provider known: kind is tokenizer, parser or lm; make(**settings) loads it."""
    _MAKERS[kind, name] = make


def load(kind: str, name: str, **settings):
    """The provider, or None where it isn't known or can't be loaded, with which generators and filters go on."""
    try:
        return _MAKERS[kind, name](**settings)
    except (KeyError, ImportError, OSError):
        return None


def analyzed(rows: DataFrame, key: str, tokenizer: Tokenizer, **texts: Column) -> DataFrame:
    """rows with the tokens of each text as a column; a null text has null. key must tell rows apart."""
    if hasattr(tokenizer, "toks"):
        return rows.withColumns({name: tokenizer.toks(text) for name, text in texts.items()})
    each = F.array(*[F.struct(F.lit(name).alias("name"), text.alias("sent")) for name, text in texts.items()])
    toks = tokenizer.tag(rows.select(key, F.inline(each)).where("sent IS NOT NULL"))
    wide = toks.groupBy(key).agg(*[F.any_value(F.when(F.col("name") == name, F.col("toks")), F.lit(True)).alias(name) for name in texts])
    return rows.join(wide, key, "left")


def token_info(words: DataFrame, tokenizer: Tokenizer, profile) -> DataFrame:
    """words(word) to (word, lemma, pos): of the first vocabulary token of each word by itself; words without one are left out."""
    toks = analyzed(words.select("word").distinct(), "word", tokenizer, toks=F.col("word"))
    return toks.select("word", F.get(T.vocabulary_tokens(F.col("toks"), profile), 0).alias("t")).select("word", "t.lemma", "t.pos").where("lemma <> ''")


class WordTokenizer:
    """Words between spaces with a class by length and ending; pure SQL."""

    def toks(self, text: Column) -> Column:
        return T.tag(T.words(text))

    def tag(self, sentences: DataFrame) -> DataFrame:
        return sentences.withColumn("toks", self.toks(F.col("sent")))


class InflectingTokenizer(WordTokenizer):
    """The same words with a lemma (verbs without -ed or -er, adjectives without -ly), a detailed class by the last letter, and a dictionary that lacks words with other letters than a-z; pure SQL. A stand-in for an analyzer."""

    def toks(self, text: Column) -> Column:
        def one(w: Column) -> Column:
            kind, end, stem = T.word_class(w), F.right(w, F.lit(2)), F.left(w, F.length(w) - 2)
            strip = (F.length(w) > 5) & (((kind == "VERB") & end.isin("ed", "er")) | ((kind == "ADJ") & (end == "ly")))
            return T.token(w, kind, F.when(F.rlike(w, F.lit("[^a-z]")), "*").when(strip, stem).otherwise(w), F.concat_ws("-", kind, F.right(w, F.lit(1))))

        return F.transform(T.words(text), one)


class AdjacentWords:
    """Each content word depends on the content word before it: a stand-in, not a parse."""

    def __init__(self, content: tuple[str, ...]) -> None:
        self.content = content

    def edges(self, sentences: DataFrame, *keys: str) -> DataFrame:
        rows = sentences.select(*keys, F.explode(T.adjacent(F.col("toks"), self.content)).alias("e"))
        return rows.select(*keys, F.lit("next").alias("dep"), "e.*")


class NGramLM:
    """Counts of three words in a row in place of a language model: a stand-in, not an equivalent.

    A masked word's logit is ln(count + 1) between its neighbours; its log probability is smoothed by one over `vocabulary` words."""

    def __init__(self, trigrams: DataFrame, vocabulary: int = 10_000) -> None:
        self.trigrams, self.vocabulary = trigrams, vocabulary

    def distribution(self, contexts: DataFrame) -> DataFrame:
        seen = self.trigrams.select(F.col("w1").alias("prev_word"), F.col("w2").alias("token"), F.col("w3").alias("next_word"), "cnt")
        return contexts.join(seen, ["prev_word", "next_word"]).select("item_id", "token", F.log(F.col("cnt") + 1).alias("logit"))

    def log_probs(self, slots: DataFrame) -> DataFrame:
        triple = self.trigrams.select(F.col("w1").alias("prev"), F.col("w2").alias("word"), F.col("w3").alias("next"), "cnt")
        sides = self.trigrams.groupBy(F.col("w1").alias("prev"), F.col("w3").alias("next")).agg(F.sum("cnt").alias("all"))
        joined = slots.join(triple, ["prev", "word", "next"], "left").join(sides, ["prev", "next"], "left")
        p = (F.coalesce("cnt", F.lit(0)) + 1) / (F.coalesce("all", F.lit(0)) + self.vocabulary)
        return joined.withColumn("logp", F.log(p)).drop("cnt", "all")


register("tokenizer", "words", WordTokenizer)
register("tokenizer", "inflecting", InflectingTokenizer)
register("parser", "adjacent", AdjacentWords)
register("lm", "trigrams", NGramLM)
