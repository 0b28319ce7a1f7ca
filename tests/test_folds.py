"""Words and look-ahead folds against plain Python, token by token; and that sentences are tokenized once."""

import random
import re

from pyspark.sql import functions as F

from lacuna.functions import tokens as T
from lacuna.operators import counts
from lacuna.plans import build
from lacuna.profiles import JA, LATIN


def folded(toks, profile, loose):
    out, open_ = [], False
    for t in toks:
        if t["sf"].strip(" ") == "":
            open_ = False
        elif t["p"] == profile.auxiliary and open_:
            out[-1][1] += t["sf"]
        elif t["p"] not in (profile.corpus_excluded if loose else profile.vocabulary_excluded):
            out.append([t, t["sf"]])
            open_ = t["p"] in profile.heads
        else:
            open_ = False
    return out


def entry(t, surface):
    lemma = "" if t["sf"].strip(" ") in ("", "*") else t["sf"] if (t["l"] or "").strip(" ") in ("", "*") else t["l"]
    return lemma, t["p"], surface, t["d"] or t["p"], (t["l"] or "").strip(" ") == "*"


def test_folds(spark):
    draw = random.Random(1)
    for profile in (JA, LATIN):
        kinds = [*profile.heads, profile.auxiliary, profile.auxiliary, *profile.corpus_excluded[:2], "NOUN"]
        one = lambda: {"sf": draw.choice(["ab", "猫", "*", " ", "x y", "", "ñ"]), "p": draw.choice(kinds), "l": draw.choice([None, "*", "", "lem"]), "d": draw.choice([None, "det"])}  # noqa: B023, E731
        rows = [[one() for _ in range(draw.randrange(12))] for _ in range(400)]
        df = spark.createDataFrame([(i, r) for i, r in enumerate([*rows, None])], "i int, toks array<struct<sf:string,p:string,l:string,d:string>>")
        got = df.select("i", T.corpus_tokens(F.col("toks"), profile).alias("c"), T.vocabulary_tokens(F.col("toks"), profile).alias("v")).orderBy("i").collect()
        assert [r.c for r in got] == [*([s for _, s in folded(r, profile, True)] for r in rows), None]
        assert [r.v if r.v is None else [tuple(x) for x in r.v] for r in got] == [*([entry(*x) for x in folded(r, profile, False)] for r in rows), None]


def test_words(spark):
    texts = ["The-re, 'tis  a9b (x) ... Über-Maß ñ1 1 A. İx ΑΣ ç\tq", "", "  ", "1 2", "aé9é!", None, "—a— b\nc", "ß x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t")).orderBy("i")
    edge = re.compile("^[^a-zà-ɏ]+|[^a-zà-ɏ]+\\Z")
    for r in df.select("low", T.words(F.col("t")).alias("w")).collect():
        assert r.w == (None if r.low is None else [w for w in (edge.sub("", x) for x in r.low.split(" ")) if w])


def test_sentences_are_tokenized_once(spark):
    docs = spark.createDataFrame([(1, "One sentence of words. And another one.")], "doc_id long, text string")
    rows = counts.corpus_rows(build.tagged(docs, LATIN), LATIN, "doc_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("aggregate(") == 0
    assert [r.tokens for r in rows.collect()] == [["sentence", "of", "words"], ["another"]]
