import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import repeats as R
from lacuna.llm.queries import op2_suffix_array_dedup


def brute(rows, length):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def result(df, length):
    return sorted(map(tuple, R.remove_repeats(df, length).withColumn("kept", F.sha2("kept", 256)).collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_suffix_array_dedup(spark, sf).collect()), key=repr) == brute(rows, 100)


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("abé "), k))
    shared = [word(150), word(60), "ab" * 60, "x" * 300]
    rows = []
    for i in range(n):
        t = word(rng.integers(0, 200))
        for _ in range(rng.integers(0, 4)):
            s = shared[rng.integers(len(shared))]
            a = rng.integers(0, len(s) // 2)
            t += s[a : a + rng.integers(20, len(s))] + word(rng.integers(0, 40))
        rows.append((i * 7 % 101, t))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None), (301, ""), (None, rows[3][1]), (302, rows[5][1][:90])]
    return rows


@pytest.mark.parametrize("crowd", [32, 3])
def test_random_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)
    rows = random_rows(crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("q")).withColumn("at", F.lit(1)).repartition(5)
    assert result(df, 50) == brute(rows, 50)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "abc " * 50), (1, "abc " * 50), (2, "abc " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(df, 100)
    assert got[0] == got[1] and got[0][:1] + got[2][:3] == (1, 2, 200, 200)
    assert got[0] == brute(rows[:1], 100)[0]
    assert result(df.limit(0), 100) == []
    with pytest.raises(ValueError):
        R.remove_repeats(df, 20)


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(40):
        strings = [rng.integers(0, rng.integers(2, 4), rng.integers(1, 40), dtype=np.uint8) for _ in range(rng.integers(1, 12))]
        patterns = [rng.integers(0, 4, rng.integers(1, 30), dtype=np.uint8) for _ in range(8)] + strings[:2]
        data = np.concatenate(patterns)
        sizes = np.array([len(p) for p in patterns])
        got = R.RunIndex(strings).matching_statistics(data, np.cumsum(sizes) - sizes, sizes)
        held = [s.tobytes() for s in strings]
        for p, row in zip(patterns, got, strict=True):
            raw = p.tobytes()
            want = [max(k for k in range(len(raw) - i + 1) if any(raw[i : i + k] in s for s in held)) for i in range(len(raw))]
            assert row[: len(raw)][::-1].tolist() == want


def test_stream_of_pieces_in_any_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted((int(d), int(c), int(k), int(rng.integers(0, 9)) << 8 | 5) for d, c, k in rng.integers(0, 4, (200, 3)))
    want_gone, want_rival = [], []
    for d in range(4):
        mine = [r for r in rows if r[0] == d]
        leads = {}
        for r in mine:
            if leads.setdefault(r[1], r) != r:
                want_gone.append(r[2:])
        if len(leads) > 1:
            want_rival += [(d, *r[2:]) for r in leads.values()]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("deal", "content", "d1", "at"))})
    for size in (1, 2, 3, 7, 500):
        out = [x for b in R._resolve(table.to_batches(max_chunksize=size), 50) for x in b.to_pylist()]
        assert sorted((x["d1"], x["at"]) for x in out if x["n"] is not None) == sorted(want_gone)
        assert sorted((x["deal"], x["d1"], x["at"]) for x in out if x["n"] is None) == sorted(want_rival)


def test_many_texts_without_doc_id_and_repeated_ids(spark):
    """Each is a document of its own, in some order: what is removed adds up to what the distinct strings leave, whatever the order."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgh"))
    rows = [(None, "".join(rng.choice(letters, 120))) for _ in range(20000)]
    rows += [(5, "".join(rng.choice(letters, 120))) for _ in range(300)]
    shared = "".join(rng.choice(letters, 110))
    rows += [(None, "x" + shared), (5, "y" + shared), (6, shared)]
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_removed) for r in got if r.n_removed) == [(5, 110), (6, 110)]


@pytest.mark.parametrize("most", [60, 250])
def test_long_texts_are_read_in_parts(spark, most):
    rng = np.random.default_rng(7)
    long = "".join(rng.choice(list("abé "), 3000))
    rows = [(1, long[:700]), (2, long + long[500:900]), (3, "q" + long[1000:1400]), (4, long), (5, "x" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.remove_repeats(df, 50, most=most).withColumn("kept", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)


def test_a_task_remembers_classes_of_its_slices():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    shared = "".join(rng.choice(list("abcdefgh"), 300))
    batch = pa.record_batch({"d1": pa.array(range(200)), "text": pa.array([f"{i:03d}" + shared for i in range(200)])})
    n = [sum(1 for b in R._pieces(iter([batch]), 100, most) for a in b.column("at").to_pylist() if a & 0xFF) for most in (2 << 20, 3000)]
    assert n[1] <= n[0] + 20 * 10


def test_all_joins_read_one_shuffle_of_the_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("FileScan" in line and "text#" in line for line in plan.splitlines()) == 1, plan
