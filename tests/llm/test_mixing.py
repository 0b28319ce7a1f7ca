from collections import defaultdict

from oracle import assert_equal
from pyspark.sql import functions as F

from lacuna.llm import mixing
from lacuna.llm.queries import QUERIES, oracle_sql


def targets(sizes):
    """The contract's rule, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while True:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over


def check(rows, near):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == size[r.source] for r in rows)
    for s, t in targets(size).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= near(t), (s, taken[s], t)


def test_query_equals_sql(spark, sf):
    assert_equal(spark, sf, QUERIES["op7_source_mixing"], oracle_sql()["op7_source_mixing"])


def test_targets_are_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(mixing.mix(docs).collect(), lambda t: 0.01 * t)
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, None).when(F.col("doc_id") % 97 == 2, "").otherwise(F.col("source")))
    check(mixing.mix(hot, shard_docs=11).collect(), lambda t: 0.03 * t)


def test_edges(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", "t"), (4, "x " * 3000, None), (5, "y", None), (None, "z z", "u"), (6, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("shard", F.lit("k"))
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 3000), (5, 1), (6, 0)]
    check(got, lambda t: 3 + 0.01 * t)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(df.limit(0)).collect() == []
    kept = mixing.apply_mix(df, mixing.mix(df)).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in kept} >= {2, 3, 6}


def test_whole_copies_sum_to_the_targets(spark):
    long = lambda i: 700 + 37 * i % 900 if i % 5 == 0 else 20 + 13 * i % 300
    rows = [(i, "w " * long(i), "a" if i % 3 == 0 else "b" if i % 30 == 1 else "c" if i % 30 == 2 else None if i % 30 == 4 else "d") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(df, weights=(1, 20, 3, 12)).cache()
    target = {r.source: (r.target, r.source_size) for r in mixed.collect()}
    assert min(t / n for t, n in target.values()) < 0.3 and max(t / n for t, n in target.values()) == 3
    got, copies, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixing.apply_mix(df, mixed).collect():
        n = len(r.text.split())
        got[r.source] += n
        copies[r.doc_id] += 1
        longest[r.source] = max(longest[r.source], n)
    assert max(copies.values()) <= 3
    for s, (t, _) in target.items():
        assert abs(got[s] - t) <= 0.01 * t, (s, got[s], t)
    assert longest["a"] > 640
