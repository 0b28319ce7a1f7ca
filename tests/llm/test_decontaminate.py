import re

import pyarrow as pa
from oracle import assert_equal

from lacuna.llm import decontaminate as D
from lacuna.llm.queries import QUERIES, oracle_sql


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def brute(docs, items, width):
    out = []
    for d, x in docs:
        w, hit, ids = words(x), set(), set()
        for i, y in items:
            v = words(y)
            k = min(width, len(v))
            for a in range(len(v) - k + 1) if v else ():
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit |= set(range(s, s + k))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def test_query_equals_sql(spark, sf):
    assert_equal(spark, sf, QUERIES["op3_benchmark_decontamination"], oracle_sql()["op3_benchmark_decontamination"])


DOCS = [(1, "The cat sat on the mat. THE CAT sat"), (2, None), (3, ""), (4, "!?"), (5, "on the mat the cat"), (5, "on the mat the cat"), (None, "cat sat on"), (7, "cat"), (8, "a b a b a b c"), (9, "Ä b é")]
ITEMS = [(10, "cat sat on the"), (9, "the cat"), (2, None), (3, " "), (4, "mat the cat sat"), (5, "a b a b c"), (6, "ä B É"), (7, "zzz yyy"), (8, "Ä b é"), (8, "b c")]


def test_edges_equal_brute_force_in_any_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS chunk", "1 AS at")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block, width in ((1 << 20, 3), (4, 3), (4, 2)):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in D.contamination(docs, items, width).collect()]
        assert sorted(got, key=repr) == brute(DOCS, ITEMS, width)
    assert D.contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in D.contamination(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "beta alpha gamma"), (3, "alpha beta"), (4, "alpha x x x beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in D.contamination(docs, items, 3, slop).collect() if r.n_hit}
    assert hit(0) == set()
    assert hit(1) == {1, 2} or hit(1) == {1}


def thue_morse(k):
    return "".join("ab"[i.bit_count() % 2] for i in range(1 << k)), "".join("ba"[i.bit_count() % 2] for i in range(1 << k))


def test_words_that_collide_under_polynomial_hashes_differ(spark):
    a, b = thue_morse(11)
    docs = spark.createDataFrame([(1, f"x {a} y")], "doc_id long, text string")
    got = D.contamination(docs, spark.createDataFrame([(7, b), (None, a)], "item_id long, text string")).first()
    assert (got.n_hit, got.item_ids) == (1, [])


def test_long_texts_are_indexed_in_parts(spark, monkeypatch):
    import lacuna.llm.common as C

    text = " ".join(f"w{i % 37}" for i in range(500)) + " " + "z" * 300 + " tail of it"
    rows = [(1, "short one"), (2, text), (3, "w1 w2 w3")]
    items = [(1, " ".join(f"w{i}" for i in range(30, 37)) + " w0 w1"), (2, "z" * 300 + " tail of"), (3, "w35 w36 w0"), (4, "w499")]
    monkeypatch.setattr(C, "SLICE_BYTES", 100)
    monkeypatch.setattr(D, "parts_of", lambda batch, table: ((p, r[a:b], np.array([0, b - a]), a == 0, b == len(r)) for p in C.slices(batch, most=1) for r in [C.text_bytes(p.column("text"))[0]] for a, b in (list(C.blocks(r, table, 100)) or [(0, 0)])))
    import numpy as np

    for width in (4, 10):
        index = list(D._index(iter([pa.record_batch({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})]), width - 1))
        assert len({c for b in index for c in b.column("chunk").to_pylist()}) == 3 < len(index)
        df = spark.createDataFrame([r for b in index for r in b.to_pylist()], D.INDEX)
        monkeypatch.setattr(D, "build_index", lambda docs, overlap, df=df: df)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), width).collect()]
        assert sorted(got, key=repr) == brute(rows, items, width)
