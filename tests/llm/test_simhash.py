import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lacuna.llm import simhash
from lacuna.llm.queries import op10_simhash_near_dedup


def brute_fp(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def brute_components(rows, bits):
    fps = sorted({fp for _, fp in rows})
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            parent[find(fps[i + 1 + j])] = find(x)
    least = {}
    for d, fp in rows:
        r = find(fp)
        least[r] = min(least.get(r, d), d)
    return {(d, f"{fp:016x}", least[find(fp)]) for d, fp in rows}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, brute_fp(r.text, 3)) for r in docs.collect()]
    got = {tuple(r) for r in op10_simhash_near_dedup(spark, sf).collect()}
    assert got == brute_components(rows, 2)


def test_planted_bits_edge_texts_and_ties(spark):
    rng = random.Random(5)
    texts = ["", None, "  \n", "a b", "A  B", "é Ü ß x", "a b"] + [" ".join(rng.choice("abcdefg") for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "a b", "y")], "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.near_duplicate_groups(df, 3, 2).withColumn("fp", simhash.fingerprint_hex(F.col("fp"))).collect())
    assert got == sorted([*brute_components([(i, brute_fp(t, 3)) for i, t in enumerate(texts)], 2), next(r for r in got if r[0] == 3)])
    assert simhash.near_duplicate_groups(df.limit(0), 3, 2).collect() == []


def close_words(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = base[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n // 2, dtype=np.uint64))
    return np.unique(np.concatenate((base, near)))


def test_every_close_pair_meets_at_a_home():
    fp = close_words(400, 1)
    i, anchor, home = simhash.anchors(fp, 2)
    at = {}
    for k, a in zip(i.tolist(), anchor.tolist(), strict=True):
        at.setdefault(a, set()).add(k)
    homes = dict(zip(i[home].tolist(), anchor[home].tolist(), strict=True))
    assert sorted(homes) == list(range(len(fp)))
    for x in range(len(fp)):
        for y in np.flatnonzero(np.bitwise_count(fp ^ fp[x]) <= 2).tolist():
            assert y in at[homes[x]]


def test_crowded_anchors_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_PAIRS", 3)
    fp = close_words(300, 2)
    rng = np.random.default_rng(3)
    crowd = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    fp = np.unique(np.concatenate((fp, crowd)))
    out = []
    import pyarrow as pa

    spread = list(simhash._replicate([pa.record_batch({"fp": pa.array(fp.view(np.int64))})], 2))
    table = pa.Table.from_batches(spread).sort_by("place")
    for b in simhash._compare(table.to_batches(max_chunksize=7), 2):
        out += zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)
    hot = spark.createDataFrame([(u, v) for u, v in out if v is None] or [(0, None)], "u long, v long")
    edges = [(u, v) for u, v in out if v is not None] + [tuple(r) for r in simhash.hot_edges(hot, 2).collect()]
    assert any(v is None for _, v in out)
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    label = simhash.local_components(len(fp), np.array([at[u] for u, _ in edges]), np.array([at[v] for _, v in edges]))
    want = brute_components([(int(k), int(x)) for k, x in enumerate(fp)], 2)
    assert {(k, f"{int(x):016x}", int(label[k])) for k, x in enumerate(fp)} == want


def test_long_texts_are_read_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join("x" * rng.randint(1, 9) + rng.choice("abcdÉ") for _ in range(900)), "a" * 5000, "a " * 3000, " " * 3000 + "one two", "ab " * 20 + "c" * 4000 + " d" * 30]
    want = [brute_fp(t, 3) for t in texts]
    for size in (64, 1000, 1 << 21):
        for module in (simhash, __import__("lacuna.llm.common", fromlist=["x"])):
            monkeypatch.setattr(module, "SLICE_BYTES", size)
        monkeypatch.setattr(simhash, "SHINGLES", 50)
        monkeypatch.setattr(simhash, "blocks", lambda raw, table, size=size: __import__("lacuna.llm.common", fromlist=["x"]).blocks(raw, table, size))
        got = [int(simhash.majority(pa.record_batch({"text": pa.array([t])}), 3)[0]) for t in texts]
        assert got == want
    assert simhash.majority(pa.record_batch({"text": pa.array(texts)}), 3).tolist() == want


def test_a_20_mb_text_needs_little_memory():
    import resource
    import subprocess
    import sys

    code = (
        "import resource, pyarrow as pa; from lacuna.llm import simhash; part = pa.record_batch({'text': pa.array(['a b c d ' * (5 << 19)])}); "
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; simhash.majority(part, 3); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    assert resource
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 300


def test_odd_distances_of_crowded_anchors(spark):
    fp = np.unique(np.uint64(12345) ^ (np.uint64(1) << np.random.default_rng(4).integers(0, 64, 40, dtype=np.uint64)) ^ np.repeat(np.array([0, 1 << 40], np.uint64), 20))
    edges = [tuple(r) for r in simhash.hot_edges(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "u long"), 1).collect()]
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    label = simhash.local_components(len(fp), np.array([at[u] for u, _ in edges], np.int64), np.array([at[v] for _, v in edges], np.int64))
    want = brute_components([(int(k), int(x)) for k, x in enumerate(fp)], 1)
    assert {(k, f"{int(x):016x}", int(label[k])) for k, x in enumerate(fp)} == want
