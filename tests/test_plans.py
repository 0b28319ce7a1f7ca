"""What is needed by several steps of a query is computed once."""

import os

import pytest
from pyspark.sql import functions as F

from lacuna.operators import counts
from lacuna.queries import QUERIES

SF = os.environ.get("LACUNA_SF", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_counted_once_for_both_sides(spark):
    pairs = spark.range(3).select(F.lit("a").alias("w1"), F.col("id").cast("string").alias("w2"), F.lit(5).alias("cnt"))
    assert plan(counts.both_ways(pairs)).count("Range (") == 1


def test_relations_are_counted_once_for_both_sides(spark):
    deps = spark.range(3).select(F.lit("next").alias("dep"), F.lit("a").alias("head"), F.col("id").cast("string").alias("child"), F.lit(5).alias("cnt"))
    both = counts.relations_by_word(deps)
    assert plan(both).count("Range (") == 1
    assert sorted(tuple(r) for r in both.select("word", "head", "child").collect()) == sorted([(w, "a", c) for c in "012" for w in ("a", c)])


@pytest.mark.parametrize("name", ["sample_relations", "pll_scores"])
def test_documents_are_counted_once(spark, name):
    assert "documents.parquet" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_is_made_distinct_before_it_is_counted_in_several_ways(spark):
    rows = spark.createDataFrame([("a", "N", "as"), ("a", "N", "a"), ("b", "N", "a"), ("a", "V", "a")] * 2, "lemma string, pos string, surface string")
    sizes = counts.vocabulary_sizes(rows, spark.createDataFrame([(["x", "y"],), (["x"],)], "tokens array<string>"))
    assert tuple(sizes.first()) == (3, 2, 2, 2)
    assert plan(sizes).split("Expand", 1)[1].lstrip().split("Relation [", 1)[0].count("LogicalRDD") == 0


def test_tokens_are_stored_once(spark):
    """Folds of them are made where they are counted: as three columns, the same words were written three times."""
    from lacuna.queries import Counts

    assert Counts(spark, SF).tokens.columns == ["toks"]


def test_adjacent_words_without_lambdas(spark):
    from lacuna.providers import AdjacentWords

    toks = [("ab", "NOUN", None, None), ("x", "PART", None, None), ("cd", "VERB", "c", None), ("ef", "NOUN", "*", None)]
    df = spark.createDataFrame([(1, toks), (2, toks[:2]), (3, []), (4, None)], "k int, toks array<struct<sf:string,p:string,l:string,d:string>>")
    edges = AdjacentWords(("NOUN", "VERB")).edges(df, "k")
    assert sorted(tuple(r) for r in edges.collect()) == [(1, "next", "ab", "c", "NOUN", "VERB"), (1, "next", "c", "ef", "VERB", "NOUN")]
    assert "lambdafunction" not in plan(edges)


def test_pairs_are_read_once_for_candidates(spark, monkeypatch):
    from lacuna.operators import candidates
    from lacuna.profiles import LATIN

    seen = {}
    real = candidates.materialize
    monkeypatch.setattr(candidates, "materialize", lambda df, name: seen.setdefault(name, real(df, name)))
    items = spark.createDataFrame([(1, "oak", "oak", "NOUN", None), (2, "elms", "elm", "NOUN", None)], "item_id long, target string, lemma string, pos string, context string")
    words = spark.createDataFrame([(w, "NOUN", 4) for w in ("oak", "elm", "beech", "willow")], "lemma string, pos string, frequency long")
    pairs = spark.createDataFrame([("beech", "oak", 2), ("elm", "willow", 3), ("beech", "willow", 9)], "w1 string, w2 string, cnt long")
    got = candidates.cooccurring(items, pairs, words, LATIN, 10, False)
    assert sorted((r.item_id, r.word) for r in got.collect()) == [(1, "beech"), (2, "willow")]
    assert sorted((r.word, r.other) for r in seen["index"].collect()) == [("elm", "willow"), ("oak", "beech")]
