"""From articles to the tables that candidates are made from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence, corpus, counts, vectors
from ..profiles import Profile
from ..providers import AdjacentWords, WordTokenizer
from ..sources import readers, sinks


@dataclass(frozen=True)
class Artefacts:
    vocabulary: DataFrame
    pairs: DataFrame
    trigrams: DataFrame
    dependencies: DataFrame
    n_sentences: int
    vectors: DataFrame | None = None


def tagged(articles: DataFrame, profile: Profile, tokenizer=None, key: str = "doc_id") -> DataFrame:
    return (tokenizer or WordTokenizer()).tag(corpus.sentences(articles, profile, key))


def build(articles: DataFrame, folder: str, profile: Profile, tokenizer=None, parser=None, rebuild: bool = False) -> None:
    """Writes the tokens once, then every table of counts from them; tables that are there stay unless rebuild is set."""
    spark = articles.sparkSession
    parser = parser or AdjacentWords(profile.content)
    sinks.artefact(counts.folded(tagged(articles, profile, tokenizer), profile), folder, "tagged", rebuild)
    toks = spark.read.parquet(f"{folder}/tagged")
    words = counts.corpus_rows(toks, profile)
    rows = counts.vocabulary_rows(toks, profile, "doc_id", "sent_no")
    sinks.artefact(counts.word_details(rows), folder, "vocabulary", rebuild)
    sinks.artefact(counts.unknown_sample(rows, toks, "doc_id", "sent_no"), folder, "unknown_words", rebuild)
    sinks.artefact(cooccurrence.frequent_pairs(words, profile.min_pair), folder, "cooccurrence", rebuild)
    sinks.artefact(counts.frequent(counts.trigrams(words), profile.min_trigram), folder, "trigrams", rebuild)
    sinks.artefact(counts.frequent(counts.dependencies(parser.edges(toks), profile), profile.min_dependency), folder, "dependencies", rebuild)
    if rebuild or not readers.present(spark, folder, "vectors"):
        sinks.artefact(_vectors(words), folder, "vectors", rebuild)


def _vectors(words: DataFrame) -> DataFrame:
    """Vectors of the corpus; an empty table where no word is frequent enough for a model."""
    often = words.select(F.explode("tokens").alias("word")).groupBy("word").count().where(F.col("count") >= vectors.LEAST)
    if often.isEmpty():
        return words.sparkSession.createDataFrame([], readers.ARTEFACTS["vectors"])
    return vectors.vectors(vectors.train(words)).select("word", F.col("vec").cast("array<float>").alias("vec"))



def load(spark: SparkSession, folder: str, profile: Profile) -> Artefacts:
    n = counts.corpus_rows(spark.read.parquet(f"{folder}/tagged"), profile).count()
    return Artefacts(*(readers.artefact(spark, folder, t) for t in ("vocabulary", "cooccurrence", "trigrams", "dependencies")), n, readers.artefact(spark, folder, "vectors"))
