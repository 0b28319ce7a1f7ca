"""Counts of words, pairs, runs of three and dependencies, and the tables that lookups are made on.

Every count is a plain aggregation, which Spark combines before its shuffle; frequent keys therefore travel once per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..profiles import Profile
from ..sources.workspace import materialize


def folded(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Adds what the look-ahead folds make of toks, for tables that several counts are made from: tokens (for the corpus) and vocab (for the vocabulary)."""
    return tagged.withColumn("tokens", T.corpus_tokens(F.col("toks"), profile)).withColumn("vocab", T.vocabulary_tokens(F.col("toks"), profile))


def vocabulary_rows(tagged: DataFrame, profile: Profile, *keys: str) -> DataFrame:
    """(keys, k, lemma, pos, surface, detail, unknown) of toks, or of folded()."""
    vocab = F.col("vocab") if "vocab" in tagged.columns else T.vocabulary_tokens(F.col("toks"), profile)
    rows = tagged.select(*keys, F.posexplode(vocab).alias("k", "t"))
    return rows.select(*keys, F.col("k").cast("long").alias("k"), "t.*").where("lemma <> ''")


def corpus_rows(tagged: DataFrame, profile: Profile, *keys: str) -> DataFrame:
    """(keys, tokens) of sentences with a token, of toks or of folded()."""
    if "tokens" in tagged.columns:
        return tagged.select(*keys, "tokens").where(F.size("tokens") > 0)
    # Exploded as the one element of an array, as a condition on the fold itself would be pushed down to the sentences, where all is computed once more.
    return tagged.select(*keys, F.explode(F.array(T.corpus_tokens(F.col("toks"), profile))).alias("tokens")).where(F.size("tokens") > 0)


def word_frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lemma", "pos").agg(F.count("*").alias("frequency"))


def word_details(rows: DataFrame) -> DataFrame:
    """With the surfaces and detailed classes of each word, sorted, and how often the dictionary lacked it."""
    return rows.groupBy("lemma", "pos").agg(
        F.sort_array(F.collect_set("surface")).alias("surface_forms"), F.sort_array(F.collect_set("detail")).alias("detailed_pos_tags"),
        F.count("*").alias("frequency"), F.sum(F.col("unknown").cast("long")).alias("unknown_by_dict_count"),
    )


def unknown_sample(rows: DataFrame, sents: DataFrame, *keys: str, n: int = 1000, context: int = 50) -> DataFrame:
    """(keys, k, surface, detail, context): the first n words in order of keys that the dictionary lacked, each with the beginning of its sentence (sents: keys, sent)."""
    few = rows.where("unknown").select(*keys, "k", "surface", "detail").orderBy(*keys, "k").limit(n)
    start = F.concat(F.substring("sent", F.lit(1), F.lit(context)), F.lit("..."))
    return few.join(sents.select(*keys, "sent"), list(keys)).select(*keys, "k", "surface", "detail", start.alias("context"))


def words_of_texts(texts: DataFrame, key: str) -> DataFrame:
    """(key, word, cnt) of toks: how often each surface is found in each text."""
    return texts.select(key, F.explode("toks").alias("t")).select(key, F.col("t.sf").alias("word")).groupBy(key, "word").agg(F.count("*").alias("cnt"))


def vocabulary_sizes(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: different (lemma, class), lemmas and surfaces of vocabulary rows, and different tokens of the corpus."""
    forms = materialize(rows.select("lemma", "pos", "surface").distinct(), "forms")  # else the optimizer takes the step out, and every row is expanded
    own = forms.agg(F.count_distinct("lemma", "pos").alias("n_words"), F.count_distinct("lemma").alias("n_lemmas"), F.count_distinct("surface").alias("n_surfaces"))
    return own.join(F.broadcast(corpus.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n_tokens"))))  # one row each


def merge_counts(*tables: DataFrame, keys: tuple[str, ...] = ("lemma", "pos"), count: str = "frequency") -> DataFrame:
    """The sum of several count tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.sum(count).alias(count))


def pos_distribution(words: DataFrame, n: int | None = None) -> DataFrame:
    out = words.groupBy("pos").agg(F.sum("frequency").alias("frequency"))
    return out if n is None else out.orderBy(F.desc("frequency"), "pos").limit(n)


def unknown_rate(words: DataFrame) -> DataFrame:
    """One row: percentage of tokens that the dictionary lacked; null without tokens."""
    return words.agg(F.round(100 * F.sum("unknown_by_dict_count") / F.nullif(F.sum("frequency"), F.lit(0)), 6).alias("unknown_percent"))


def pairs(corpus: DataFrame) -> DataFrame:
    """(w1, w2, cnt), w1 < w2: in how many sentences both occur, of all pairs; cooccurrence.py counts frequent ones of large corpora. Explodes in two steps, which keeps rows narrow."""
    first = corpus.select(F.sort_array(F.array_distinct("tokens")).alias("u")).select("u", F.posexplode("u").alias("i", "w1"))
    both = first.select("w1", F.explode(F.slice("u", F.col("i") + 2, F.size("u"))).alias("w2"))
    return both.groupBy("w1", "w2").agg(F.count("*").alias("cnt"))


def trigrams(corpus: DataFrame) -> DataFrame:
    runs = corpus.select(F.explode(T.trigrams(F.col("tokens"))).alias("t")).select("t.w1", "t.w2", "t.w3")
    return runs.groupBy("w1", "w2", "w3").agg(F.count("*").alias("cnt"))


def dependencies(edges: DataFrame, profile: Profile) -> DataFrame:
    """(dep, head, child, cnt) between content words, without roots and function labels."""
    content = F.col("head_pos").isin(*profile.content) & F.col("child_pos").isin(*profile.content)
    return edges.where(content & ~F.col("dep").isin(*profile.dropped_dependencies)).groupBy("dep", "head", "child").agg(F.count("*").alias("cnt"))


def frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("cnt") >= least)


def totals(counts: DataFrame, least: int) -> DataFrame:
    """One row: different keys, instances, and keys counted `least` times or more."""
    return counts.agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_instances"), F.count_if(F.col("cnt") >= least).alias("n_frequent"))


def both_ways(counts: DataFrame) -> DataFrame:
    """(word, other, cnt): each pair from either side."""
    side = lambda word, other: F.struct(F.col(word).alias("word"), F.col(other).alias("other"), "cnt")
    return counts.select(F.inline(F.array(side("w1", "w2"), side("w2", "w1"))))


def relations_by_word(deps: DataFrame) -> DataFrame:
    """(word, dep, head, child, cnt): each relation by head and by child, twice if they are the same."""
    side = lambda word: F.struct(F.col(word).alias("word"), *deps.columns)
    return deps.select(F.inline(F.array(side("head"), side("child"))))


def characters(words: DataFrame) -> DataFrame:
    """(ch, lemma, pos): each different character of each word."""
    return words.select(F.explode(F.array_distinct(F.split("lemma", ""))).alias("ch"), "lemma", "pos").where("ch <> ''")
