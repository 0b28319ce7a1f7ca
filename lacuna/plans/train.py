"""Word vectors from articles: tokens, model, files, and what each step took."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, vectors
from ..profiles import Profile
from ..sources import readers, sinks
from .build import tagged


def run(articles: DataFrame, folder: str, profile: Profile, tokenizer=None, key: str = "doc_id", **settings) -> DataFrame:
    """Writes `sentences` (a sentence a line), `model` and `vectors` below folder, and returns (step, n, seconds): sentences written, different tokens, words with a vector."""
    spark = articles.sparkSession
    began, steps = time.perf_counter(), []

    def done(step: str, n: int) -> None:
        nonlocal began
        steps.append((step, n, time.perf_counter() - began))
        began = time.perf_counter()

    sinks.token_lines(counts.corpus_rows(tagged(articles, profile, tokenizer, key), profile), f"{folder}/sentences")
    corpus = readers.token_lines(spark, f"{folder}/sentences")
    done("sentences", corpus.count())
    done("tokens", corpus.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t")).first()[0])
    model = vectors.train(corpus, **settings)
    vectors.save(model, f"{folder}/model")
    sinks.artefact(vectors.vectors(model), folder, "vectors")
    done("vectors", vectors.vectors(model).count())
    return spark.createDataFrame(steps, "step string, n long, seconds double")
