"""From articles to sentences, and statistics of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..profiles import Profile


def sentences(articles: DataFrame, profile: Profile, key: str = "doc_id") -> DataFrame:
    """articles(key, text) to (key, sent_no, sent, len); one narrow pass, no shuffle."""
    split = articles.select(key, F.posexplode(X.pieces(X.normalize(F.col("text")), profile)).alias("sent_no", "sent"))
    return split.where(X.is_sentence(F.col("sent"), profile)).select(key, F.col("sent_no").cast("long").alias("sent_no"), "sent", F.length("sent").cast("long").alias("len"))


def length_statistics(sents: DataFrame) -> DataFrame:
    """One row; the deviation is that of a population. No sentences give nulls."""
    c = F.col("len")
    return sents.agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.percentile(c, 0.5).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.stddev_pop(c), 6).alias("std"))


def length_histogram(sents: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n): equal widths between the smallest and largest length, the largest in the last bin; bins without sentences are left out."""
    ends = sents.agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    at = F.coalesce(F.least(F.floor((F.col("len") - F.col("lo")) * bins / width) + 1, F.lit(bins)), F.lit(1))
    counts = sents.groupBy("len").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.sum("n").alias("n"))


def long_sentences(sents: DataFrame, profile: Profile, n: int = 10, key: str = "doc_id") -> DataFrame:
    return sents.where(F.col("len") > profile.long_chars).orderBy(key, "sent_no").limit(n)


def reader_counters(articles: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: articles, articles with a sentence, sentences."""
    with_any = sents.agg(F.count_distinct(key).alias("n_with_sentences"), F.count("*").alias("n_sentences"))
    return articles.agg(F.count("*").alias("n_articles")).join(F.broadcast(with_any))


def file_counters(lines: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for the lines of readers.articles(): files, broken lines, articles, articles with a sentence, sentences."""
    read = lines.agg(F.count_distinct("file").alias("n_files"), F.count_if("broken").alias("n_broken"), F.count_if(~F.col("broken")).alias("n_articles"))
    with_any = sents.agg(F.count_distinct(key).alias("n_with_sentences"), F.count("*").alias("n_sentences"))
    return read.join(F.broadcast(with_any))  # one row each


def statistics(articles: DataFrame, profile: Profile, key: str = "doc_id") -> DataFrame:
    return articles.select(key, *[c.alias(n) for n, c in X.character_statistics(F.coalesce("text", F.lit("")), profile).items()])
