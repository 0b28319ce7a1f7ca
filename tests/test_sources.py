"""Readers, writers, the build and the stream."""

import json

from pyspark.sql import functions as F

from lacuna.operators import counts
from lacuna.plans import build, evaluate, generate
from lacuna.profiles import LATIN
from lacuna.sources import readers, sinks
from lacuna.streaming import word_counts


def test_articles_skip_small_hidden_and_broken(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"text": "one"}\n\n{broken\n{"text": "two", "id": 3}\n')
    (tmp_path / "a" / ".h.json").write_text('{"text": "hidden one"}\n')
    (tmp_path / "small.json").write_text("{}\n")
    (tmp_path / "x.txt").write_text('{"text": "other name"}\n')
    got = readers.articles(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got if not r.broken) == ["one", "two"] and sum(r.broken for r in got) == 1


def test_csv_items_packed_keys_and_missing_artefacts(spark, tmp_path):
    (tmp_path / "i.csv").write_text('sentence,target,english_sentence\n"a, ___ ""b""",t,e\n')
    assert [tuple(r) for r in readers.cloze_items(spark, str(tmp_path / "i.csv")).collect()] == [('a, ___ "b"', "t", "e")]
    (tmp_path / "m.json").write_text(json.dumps({"a|b|c": 3, "x|y": 4}))
    assert sorted(map(tuple, readers.packed_map(spark, str(tmp_path / "m.json"), ["w1", "w2"]).collect())) == [("a", "b|c", "3"), ("x", "y", "4")]
    assert readers.artefact(spark, str(tmp_path / "nowhere"), "trigrams").collect() == []


def test_token_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"],), ([],), (["c"],)], "tokens array<string>")
    sinks.token_lines(df, str(tmp_path / "t"))
    assert sorted(r.tokens for r in readers.token_lines(spark, str(tmp_path / "t")).collect()) == [["a", "b"], ["c"]]


def test_build_generate_and_nest(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    folder = str(tmp_path / "artefacts")
    build.build(docs, folder, LATIN)
    build.build(docs.limit(0), folder, LATIN)  # what is there stays
    a = build.load(spark, folder, LATIN)
    assert a.n_sentences > 1000 and a.vocabulary.count() > 1000
    items = spark.createDataFrame([(1, "thing of ___ and the thereto", "thereat"), (2, "no blank", "x")], "item_id long, sentence string, target string")
    rows = generate.generate(items, a, LATIN)
    context = items.withColumn("context", F.lit(None).cast("string"))
    got = {r.item_id: r for r in evaluate.nest(context, rows).collect()}
    assert set(got) == {1, 2} and got[2].plain_results is None
    for name in ("plain_results", "contextual_results"):
        for record in (got[1][name] or {}).values():
            assert (record.rejected_by.pll is None) == (name == "plain_results")
            rejected = set().union(*(x or [] for x in record.rejected_by))
            assert record.final == [w for w in record.candidates if w not in rejected]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    word_counts.run_available(word_counts.stream(spark, str(tmp_path / "in"), "doc_id long, text string", LATIN), "words", str(tmp_path / "checkpoint"))
    want = counts.word_frequencies(counts.vocabulary_rows(build.tagged(spark.read.parquet(str(tmp_path / "in")), LATIN), LATIN))
    assert sorted(map(tuple, spark.table("words").collect())) == sorted(map(tuple, want.collect()))


def test_vectors_are_built_and_used(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Some other thing went over there with many people. Many other people went with some thing over there.") for i in range(6)], "doc_id long, text string")
    folder = str(tmp_path / "artefacts")
    build.build(docs, folder, LATIN)
    a = build.load(spark, folder, LATIN)
    assert a.vectors.count() > 8 and len(a.vectors.first().vec) == 400
    items = spark.createDataFrame([(1, "Many other ___ went over there", "people"), (2, "no blank", "people")], "item_id long, sentence string, target string")
    got = generate.generate(items, a, LATIN).where("generator LIKE 'similarity%'").collect()
    assert {r.item_id for r in got} == {1} and {r.generator for r in got} >= {"similarity"}
    build.build(docs.limit(0), str(tmp_path / "none"), LATIN)
    assert build.load(spark, str(tmp_path / "none"), LATIN).vectors.count() == 0
