"""Pairs counted as numbers, against counting them one by one."""

from itertools import combinations

import pyarrow as pa
import pytest
from duck import rows_of

from lacuna.operators import cooccurrence, counts

SENTENCES = [["a", "b", "c"], ["b", "a", "b"], ["c", "ä", "a"], ["d"], [], None, ["a", None, "b"], ["e", "f"], ["ä", "a", "zz"]]


def corpus(spark, rows=SENTENCES):
    return spark.createDataFrame([(r,) for r in rows], "tokens array<string>")


def plain(rows, least):
    n = {}
    for r in rows:
        for p in combinations(sorted({w for w in r or [] if w is not None}, key=str.encode), 2):
            n[p] = n.get(p, 0) + 1
    return n, sorted((*p, k) for p, k in n.items() if k >= least)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_and_totals(spark, least):
    every, few = plain(SENTENCES, least)
    assert sorted(tuple(r) for r in cooccurrence.frequent_pairs(corpus(spark), least).collect()) == few
    assert tuple(cooccurrence.totals(corpus(spark), least).first()) == (len(every), sum(every.values()), len(few))


def test_several_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PAIRS", 50)
    rows = [[f"w{(i * j) % 23}" for j in range(1, 12)] for i in range(60)]
    for least in (1, 4):
        every, few = plain(rows, least)
        assert sorted(tuple(r) for r in cooccurrence.frequent_pairs(corpus(spark, rows), least).collect()) == few
        assert tuple(cooccurrence.totals(corpus(spark, rows), least).first()) == (len(every), sum(every.values()), len(few))


def test_no_pairs(spark):
    rows = [["a"], []]
    assert cooccurrence.frequent_pairs(corpus(spark, rows), 1).collect() == []
    assert tuple(cooccurrence.totals(corpus(spark, rows), 2).first()) == (0, None, 0)


def test_what_travels_is_small():
    """Pairs of a task go as a few bytes each, once where it has seen them several times."""
    import numpy as np

    rng = np.random.default_rng(1)
    names = pa.array([f"w{k}" for k in range(5000)])
    import xxhash

    known = type("Sent", (), {"value": cooccurrence.Words(names, np.array([xxhash.xxh64_intdigest(w, 42) for w in names.to_pylist()], np.uint64).view(np.int64))})
    rows = [[f"w{k}" for k in set((5000 * rng.random(12) ** 3).astype(int))] for _ in range(5000)]
    batches = [pa.record_batch({"u": pa.array(rows, pa.list_(pa.string()))})]
    out = list(cooccurrence._counted(iter(batches), known, 3))
    n = sum(len(r) * (len(r) - 1) // 2 for r in rows)
    assert sum(len(d) for b in out for d in b.column("data").to_pylist()) < 5 * n
    a, b, c = zip(*[cooccurrence._sums(iter([x.filter(pa.compute.equal(x.column("part"), k)) for x in out]), 5000, 3) for k in range(3)], strict=True)
    got = {tuple(sorted((f"w{x}", f"w{y}"))): k for p in zip(a, b, c, strict=True) for x, y, k in zip(*p, strict=True)}
    assert got == plain(rows, 1)[0]


def test_words_that_share_a_hash():
    import numpy as np
    import xxhash

    names = ["x", "y", "z"]
    h = np.array([xxhash.xxh64_intdigest("x", 42)] * 2 + [7], np.uint64).view(np.int64)
    words = cooccurrence.Words(pa.array(names), h)
    assert words.numbers(pa.array(["x", "q"])).tolist() == [0, -1]


def test_both_ways(spark):
    pairs = spark.createDataFrame([("a", "b", 2)], "w1 string, w2 string, cnt long")
    assert rows_of(["word", "other", "cnt"], [tuple(r) for r in counts.both_ways(pairs).collect()]) == rows_of(["word", "other", "cnt"], [("a", "b", 2), ("b", "a", 2)])
