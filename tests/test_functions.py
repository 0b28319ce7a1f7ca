"""Rules and folds on small literals, with the bounds of each rule."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import scoring as S
from lacuna.functions import text as X
from lacuna.functions import tokens as T
from lacuna.operators import candidates as C
from lacuna.operators import corpus, counts
from lacuna.operators import screening as R
from lacuna.profiles import JA, LATIN
from lacuna.providers import NGramLM


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences_of_japanese_text(spark):
    text = "車 car 赤い red。猫だ！" + "あ" * 7 + "。" + "い" * 8 + "？" + "う" * 300 + "。" + "え" * 301 + "。" + "あいう" + "x" * 7 + "。" + "あい" + "x" * 8
    df = spark.createDataFrame([(1, text), (2, None), (3, "あ")], "doc_id long, text string")
    got = [(r.sent_no, r.len) for r in corpus.sentences(df, JA).orderBy("sent_no").collect()]
    assert got == [(3, 8), (4, 300), (6, 10)]


@pytest.mark.parametrize(("lemma", "want"), [("タイム-time", "タイム"), ("ペン-pen!", "ペン-pen!"), ("x-12ab", "x-12ab"), ("a-b-c", "a-b-c"), ("-", "-"), ("w-abcd1", "w"), ("plain", "plain"), ("x-", "x-")])
def test_clean_lemma(spark, lemma, want):
    # four letters of five are 80 %; in "ペン-pen!" three of four are not
    assert one(spark, X.clean_lemma(F.lit(lemma))) == want


def plain_fold(tokens, keep):
    out, open_ = [], False
    for sf, p in tokens:
        if not sf.strip():
            open_ = False
        elif p == "AUX" and open_:
            out[-1] += sf
        elif p != "PART" and (keep or p != "AUX"):
            out.append(sf)
            open_ = p in ("VERB", "ADJ")
        else:
            open_ = False
    return out


def test_look_ahead_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, [(rng.choice("abcd "), rng.choice(["VERB", "ADJ", "AUX", "AUX", "NOUN", "PART"])) for _ in range(rng.randrange(9))]) for i in range(300)]
    rows.append((300, [("v", "VERB"), ("a", "AUX"), ("b", "AUX"), ("n", "NOUN"), ("c", "AUX")]))
    df = spark.createDataFrame([(i, [(*t, None, None) for t in x]) for i, x in rows], "id long, toks array<struct<sf:string,p:string,l:string,d:string>>")
    got = df.select("id", T.corpus_tokens(F.col("toks"), LATIN).alias("c"), F.transform(T.vocabulary_tokens(F.col("toks"), LATIN), lambda t: t["surface"]).alias("v")).collect()
    for r in got:
        tokens = dict(rows)[r.id]
        assert r.c == plain_fold(tokens, True) and r.v == plain_fold(tokens, False)
    assert {r.id: (r.c, r.v) for r in got}[300] == (["vab", "n", "c"], ["vab", "n"])


def test_pairs_and_trigrams(spark):
    df = spark.createDataFrame([(["b", "a", "a", "c"],), (["a", "b"],), (["x"],), ([],)], "tokens array<string>")
    assert sorted(map(tuple, counts.pairs(df).collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert sorted(map(tuple, counts.trigrams(df).collect())) == [("a", "a", "c", 1), ("b", "a", "a", 1)]


def test_scores(spark):
    args = [F.lit(x) for x in (89, 123, 4567, 25408585)]
    assert round(one(spark, S.pmi(*args)), 6) == 11.975001
    assert one(spark, S.pmi(F.lit(0), *args[1:])) is None
    inside = lambda c, v: one(spark, S.in_band(F.lit(c), F.lit(v), JA.similarity_bands))
    assert inside("OPEN", 0.4) and inside("OPEN", 0.6) and inside("CLOSED", 0.7) and inside(None, 0.75)
    assert not inside("OPEN", 0.61) and not inside("CLOSED", 0.49)
    assert [one(spark, S.context_class(F.lit(h), JA.open_entropy)) for h in (4.5, 4.5001)] == ["CLOSED", "OPEN"]


def test_blank_at_the_edges(spark):
    rows = [(1, "___", "noun"), (2, "kept ___ walls", "stone"), (3, "no blank here", "noun")]
    got = {r.item_id: (r.prev_word, r.next_word) for r in C.locate(spark.createDataFrame(rows, "item_id long, sentence string, target string"), LATIN).collect()}
    assert got == {1: ("BOS", "EOS"), 2: ("kept", "walls"), 3: (None, None)}


def test_ranking_keeps_the_best_of_each_cleaned_word(spark):
    rows = [(1, "cat", "dog-dog", 2.0), (1, "cat", "dog", 1.0), (1, "cat", "cat-cat", 0.0), (1, "cat", "bee", 1.0), (1, "cat", "ant", 9.0)]
    df = spark.createDataFrame(rows, "item_id long, lemma string, word string, score double")
    assert [(r.rank, r.word) for r in C.ranked(df, 2).orderBy("rank").collect()] == [(1, "bee"), (2, "dog")]


def test_filters_keep_all_rows_and_reject_if_any_does(spark):
    items = C.locate(spark.createDataFrame([(1, "green ___ walls", "stone")], "item_id long, sentence string, target string"), LATIN).withColumn("context", F.lit("CLOSED"))
    cands = spark.createDataFrame([(1, "brick"), (1, "house"), (1, "cloud")], "item_id long, word string")
    tri = spark.createDataFrame([("green", "brick", "walls", 3), ("green", "stone", "walls", 900)], "w1 string, w2 string, w3 string, cnt long")
    rows = R.by_likelihood(R.by_trigram(cands, items, tri), items, NGramLM(tri, 10), LATIN)
    assert {r.word: (r.bad_trigram, r.bad_pll) for r in rows.collect()} == {"brick": (True, False), "house": (False, False), "cloud": (False, False)}
    assert {r.word for r in R.final(rows).collect()} == {"house", "cloud"}
    empty = R.by_trigram(cands, items, tri.limit(0))
    assert not any(r.bad_trigram for r in empty.collect())
    assert not any(r.bad_pll for r in R.by_likelihood(cands, items, None, LATIN).collect())
