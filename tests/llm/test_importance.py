import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm import importance as I
from lacuna.llm.common import blocks, NOT_SPACE, text_bytes
from lacuna.llm.queries import op8_quality_classifier


def brute_ngrams(text):
    raw = (text or "").encode()
    out = [(int.from_bytes(raw[i : i + 4], "little") * 2654435769 % 2**32) >> 16 for i in range(len(raw) - 3)]
    words, last, kinds = re.findall(rb"[^\x20\x09-\x0D]+", raw), {}, []
    for i, w in enumerate(words):
        ago = i - last[w] if w in last else 0
        kinds.append(0 if not ago else 1 + sum(ago > x for x in (1, 4, 16, 64)))
        last[w] = i
    return out + [I.BUCKETS + a * 36 + b * 6 + c for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False)]


def test_ngrams_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["", None, "abc", "a a b a a", "é" * 9]
    grams, of = I.ngrams(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(grams[of == i].tolist()) == sorted(brute_ngrams(t))
        for most in (7, 300):  # in blocks
            raw, memory = text_bytes(pa.array([t], pa.string()))[0], I._Memory()
            parts = [I.ngrams(raw[a:b], np.array([0, b - a]), memory)[0] for a, b in blocks(raw, NOT_SPACE, most)]
            assert sorted(np.concatenate([*parts, np.zeros(0, np.int32)]).tolist()) == sorted(brute_ngrams(t))


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs}
    grams = {d: Counter(brute_ngrams(t)) for d, t in docs.items()}
    raw, good = np.zeros(I.WIDTH), np.zeros(I.WIDTH)
    for d, c in grams.items():
        for k, n in c.items():
            raw[k] += n
            good[k] += n * labels.get(d, False)
    ratio = np.zeros(I.WIDTH)
    for part in (slice(0, I.BUCKETS), slice(I.BUCKETS, I.WIDTH)):
        ratio[part] = np.log((good[part] + I.PRIOR) / (raw[part] * good[part].sum() / raw[part].sum() + I.PRIOR))
    weight = {d: sum(n * ratio[k] for k, n in c.items()) / (sum(c.values()) + I.SHORT) for d, c in grams.items()}
    got = {r.doc_id: r for r in op8_quality_classifier(spark, sf).collect()}
    assert got.keys() == docs.keys()
    assert all(math.isclose(got[d].log_weight, w, abs_tol=1e-9) for d, w in weight.items())
    held = []
    for d in sorted(labels):  # each weighed without its own n-grams in the target model
        rest = good - np.bincount(list(grams[d].elements()), minlength=I.WIDTH) * labels[d]
        own = np.zeros(I.WIDTH)
        for part in (slice(0, I.BUCKETS), slice(I.BUCKETS, I.WIDTH)):
            own[part] = np.log((rest[part] + I.PRIOR) / (raw[part] * rest[part].sum() / raw[part].sum() + I.PRIOR))
        held.append(sum(n * own[k] for k, n in grams[d].items()) / (sum(grams[d].values()) + I.SHORT))
    cut = I.best_cut(np.array(held), np.array([labels[d] for d in sorted(labels)]))
    k = sum(w >= cut for w in weight.values())
    assert sorted(r.doc_id for r in got.values() if r.kept) == sorted(sorted(got, key=lambda d: -got[d].gumbel_key)[:k])
    seen = [(labels[d], got[d].kept) for d in labels]
    assert sum(a == b for a, b in seen) >= 0.97 * len(seen)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=9000), np.full(5000, 0.5), rng.normal(size=500) * 1e-9))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 2, 700, 4000, 8000, 14499):
        assert I.kth_largest(df, "x", k) == np.sort(x)[::-1][k - 1]
    assert I.kth_largest(df, "x", 14500) == -np.inf and I.kth_largest(df, "x", 0) == np.inf


def test_edges(spark):
    rows = [(1, "good words here are fine"), (2, None), (3, ""), (4, "### $$$ ### $$$ ###"), (None, "no id at all"), (1, "good words here are fine"), (5, "### $$$ ### $$$")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("x")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = I.resample(df, labels, temperature=0.01).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 1, 2, 3, 4, 5]
    assert {r.log_weight for r in got if r.doc_id in (2, 3)} == {0.0}
    assert not any(r.kept for r in got if r.doc_id in (4, 5)) and all(r.kept for r in got if r.doc_id == 1)
    assert all(r.kept for r in I.resample(df, labels.limit(0)).collect())
    assert I.resample(df.limit(0), labels).collect() == []


def test_keys_sample_by_weight(spark):
    rows = [(i, 0.1 * (i % 2)) for i in range(40000)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double")
    keys = [{r.doc_id: r.gumbel_key for r in I.gumbel_keys(df, 0.15, seed).collect()} for seed in (1, 2)]
    for key in keys:  # the heavier of two comes first with probability 1 / (1 + exp(-0.1 / 0.15))
        share = np.mean([key[i + 1] > key[i] for i in range(0, 40000, 2)])
        assert abs(share - 1 / (1 + math.exp(-0.1 / 0.15))) < 0.012
    first = [set(sorted(key, key=key.get)[-4000:]) for key in keys]
    assert len(first[0] & first[1]) < 1000


def test_other_seeds_draw_other_samples_and_keep_the_good(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = []
    for seed in (1, 2, 3, 4):
        kept.append({r.doc_id for r in I.resample(docs, labels, seed=seed).where("kept").collect()})
    assert len({frozenset(k) for k in kept}) > 1 and len({len(k) for k in kept}) == 1
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert np.mean([len(k & good) / len(good) for k in kept]) > 0.99
