"""Analyzers behind the interface, from items to screened candidates."""

import math

from pyspark.sql import functions as F

from lacuna import providers
from lacuna.functions import tokens as T
from lacuna.operators import candidates as C
from lacuna.operators import counts
from lacuna.operators import screening as R
from lacuna.plans import build, generate, train
from lacuna.profiles import JA, LATIN
from lacuna.sources import sinks


class OnlyTables:
    """A tokenizer that can do tables only, as one in Python would."""

    def tag(self, sentences):
        return sentences.withColumn("toks", providers.InflectingTokenizer().toks(F.col("sent")))


def test_a_tokenizer_of_tables_gives_the_same(spark):
    items = spark.createDataFrame([(1, "They walked ___ over the bridge", "slowly"), (2, "No blank here", "x"), (3, "___ looked up", "Nobody"), (4, None, "y")], "item_id long, sentence string, target string")
    a, b = (C.locate(items, LATIN, t).orderBy("item_id").collect() for t in (providers.InflectingTokenizer(), OnlyTables()))
    assert a == b
    assert a[0].lemma == "slow" and a[0].pos == "ADJ" and a[0].prev_word == "walked" and a[1].left is None and a[2].prev_word == "BOS"


def test_token_info_is_that_of_the_first_vocabulary_token(spark):
    words = spark.createDataFrame([("walked",), ("the",), ("naïve",), ("",), ("quickly",)], "word string")
    for tokenizer in (providers.InflectingTokenizer(), OnlyTables()):
        got = {r.word: (r.lemma, r.pos) for r in providers.token_info(words, tokenizer, LATIN).collect()}
        assert got == {"walked": ("walk", "VERB"), "naïve": ("naïve", "NOUN"), "quickly": ("quick", "ADJ")}


def test_unknown_words_and_details(spark):
    sents = spark.createDataFrame([(1, 0, "They walked naïve walker naïve"), (2, 0, "walked")], "doc_id long, sent_no long, sent string")
    rows = counts.vocabulary_rows(providers.InflectingTokenizer().tag(sents), LATIN, "doc_id", "sent_no")
    d = {(r.lemma, r.pos): r for r in counts.word_details(rows).collect()}
    assert d["walk", "VERB"].surface_forms == ["walked", "walker"] and d["walk", "VERB"].detailed_pos_tags == ["VERB-d", "VERB-r"] and d["walk", "VERB"].frequency == 3
    assert d["naïve", "NOUN"].unknown_by_dict_count == 2 and d["they", "NOUN"].unknown_by_dict_count == 0
    got = counts.unknown_sample(rows, sents, "doc_id", "sent_no", n=1, context=4).collect()
    assert [(r.surface, r.context) for r in got] == [("naïve", "They...")]


class JapaneseWords:
    """Words of a tiny dictionary, split at spaces: surface/class/lemma."""

    def toks(self, text):
        part = lambda w, i: F.get(F.split(w, "/"), i)
        return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: T.token(part(w, 0), part(w, 1), part(w, 2)))

    def tag(self, sentences):
        return sentences.withColumn("toks", self.toks(F.col("sent")))


def test_the_japanese_profile_with_an_analyzer(spark):
    sent = "猫/名詞/猫 が/助詞/が 走っ/動詞/走る た/助動詞/た 犬/名詞/* は/助詞/は 走ら/動詞/走る ない/助動詞/ない"
    tagged = JapaneseWords().tag(spark.createDataFrame([(1, 0, sent)], "doc_id long, sent_no long, sent string"))
    vocabulary = {(r.lemma, r.pos): (r.surface_forms, r.frequency, r.unknown_by_dict_count) for r in counts.word_details(counts.vocabulary_rows(tagged, JA, "doc_id", "sent_no")).collect()}
    assert vocabulary == {("猫", "名詞"): (["猫"], 1, 0), ("走る", "動詞"): (["走った", "走らない"], 2, 0), ("犬", "名詞"): (["犬"], 1, 1)}
    assert counts.corpus_rows(tagged, JA).first().tokens == ["猫", "走った", "犬", "走らない"]


def test_generation_with_lemmas_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Many people walked over the {w} bridge. They quickly painted the {w} house.") for i, w in enumerate(["green", "great", "small", "narrow"] * 4)], "doc_id long, text string")
    tokenizer = providers.load("tokenizer", "inflecting")
    build.build(docs, str(tmp_path), LATIN, tokenizer)
    a = build.load(spark, str(tmp_path), LATIN)
    items = spark.createDataFrame([(1, "Some people ___ over the hill", "walked")], "item_id long, sentence string, target string")
    rows = generate.generate(items, a, LATIN, tokenizer=tokenizer).collect()
    assert {r.word for r in rows if r.generator == "baseline"} == {"paint", "over", "green"}  # verbs by their endings, and walk itself is the target
    assert {r.system for r in rows} == {"plain", "contextual"} and all((r.bad_pll is None) == (r.system == "plain") for r in rows)


def test_what_cannot_be_loaded_is_none():
    assert providers.load("lm", "no such model") is None
    providers.register("parser", "broken", lambda: (_ for _ in ()).throw(OSError("no file")))
    assert providers.load("parser", "broken") is None


def test_pieces_of_a_word_are_masked_together(spark):
    seen = []

    class Model:
        def log_probs(self, slots):
            seen.extend((r.prev, r.word, r.next) for r in slots.collect())
            return slots.withColumn("logp", F.lit(-1.0))

    df = spark.createDataFrame([(1, ["a", "be", "##au", "##ty", "is"])], "item_id long, words array<string>")
    assert R.pseudo_log_likelihood(df, Model(), "item_id").first().pll == -5.0
    assert sorted(seen) == sorted([("BOS", "a", "be"), ("a", "be", "is"), ("be", "##au", "is"), ("##au", "##ty", "is"), ("##ty", "is", "EOS")])


def test_nearest_equals_brute_force_in_any_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(60, 5)), 1)
    v[7] = v[3]
    v[9] = 0
    rows = [(f"w{i}", [float(x) for x in v[i]]) for i in range(60)] + [("short", [1.0]), ("none", None)]
    vectors = spark.createDataFrame(rows, "word string, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, f"w{i}") for i in range(0, 60, 3)] + [(99, "absent")], "item_id long, word string")
    want = set()
    for i in range(0, 60, 3):
        if not v[i].any():
            continue
        near = [(-round(float(v[i] @ v[j]) / math.sqrt(v[i] @ v[i]) / math.sqrt(v[j] @ v[j]), 6), f"w{j}") for j in range(60) if j != i and v[j].any()]
        want |= {(i, k, w, -s) for k, (s, w) in enumerate(sorted(near)[:4], 1)}
    for block in (1024, 6):
        monkeypatch.setattr(C, "QUERY_BLOCK", block)
        got = {(r.item_id, r["rank"], r.word, r.score) for r in C.nearest(queries, vectors, 4).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in want} and all(abs(a - b) < 2e-6 for a, b in zip(sorted(x[3] for x in got), sorted(x[3] for x in want), strict=True))


def test_training_writes_and_tells_its_steps(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Some other thing went over there with many people. Many other people went with some thing over there.") for i in range(6)], "doc_id long, text string")
    got = {r.step: (r.n, r.seconds) for r in train.run(docs, str(tmp_path), LATIN, size=8, rounds=1).collect()}
    assert got["sentences"][0] == 12 and got["vectors"][0] == spark.read.parquet(f"{tmp_path}/vectors").count() > 5 and all(s >= 0 for _, s in got.values())
    from pyspark.ml.feature import Word2VecModel

    assert Word2VecModel.load(f"{tmp_path}/model").getVectors().count() == got["vectors"][0]


def test_bucketed_tables_join_without_a_shuffle(spark):
    pairs = spark.createDataFrame([("a", "b", 3), ("b", "a", 3)], "word string, other string, cnt long")
    for name in ("bucketed_one", "bucketed_two"):
        sinks.bucketed(pairs, name, "word", 4)
    try:
        plan = spark.table("bucketed_one").hint("merge").join(spark.table("bucketed_two"), "word")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        for name in ("bucketed_one", "bucketed_two"):
            spark.sql(f"DROP TABLE {name}")
