import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm import toxicity as T
from lacuna.llm.queries import op4_toxicity


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op4_toxicity(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    label = np.array([t for t, _ in held])
    assert auc(np.array([r.score for _, r in held]), label) > 0.85
    assert np.mean([t == r.predicted for t, r in held]) > 0.93


def examples(texts):
    batch = pa.record_batch({"label": pa.array([1] * len(texts), pa.int32()), "text": pa.array(texts)})
    out = pa.Table.from_batches(list(T._examples([batch], T.IDENTITY_TERMS)))
    return [[np.asarray(x) for x in out.column(c).combine_chunks().to_numpy(zero_copy_only=False)] for c in ("slots", "twin")]


def chosen(own, label):
    slot, both = np.unique(np.concatenate(own), return_counts=True)
    bad = np.zeros(len(slot))
    for x, y in zip(own, label, strict=True):
        bad[np.searchsorted(slot, x)] += y
    return T.choose_slots(slot, both, bad, len(label), int(label.sum()))


def test_penalty_takes_weight_from_identity_terms():
    rng = np.random.default_rng(4)
    filler = [f"word{i}" for i in range(40)]
    texts, label = [], []
    for i in range(600):
        bad = i % 2
        words = list(rng.choice(filler, 12))
        words += ["muslims"] * (rng.random() < (0.9 if bad else 0.1)) + ["nasty"] * int(bad and rng.random() < 0.9)
        texts.append(" ".join(words))
        label.append(float(bad))
    own, twins = examples(texts)
    (slots,), _ = examples(["muslims"])
    number = chosen(own, np.array(label))
    free, held = (T.fit_weights(own, twins, np.array(label), number, pull)[0][slots].sum() for pull in (0.0, 5.0))
    assert abs(held) < 0.3 * abs(free)
    (nasty,), _ = examples(["nasty"])
    assert T.fit_weights(own, twins, np.array(label), number, 5.0)[0][nasty].sum() > 1


def test_twins_swap_within_a_list():
    own, twins = examples(["Muslims and women met", "nobody here", ""])
    assert len(twins[1]) == len(twins[2]) == 0 and len(own[2]) == 0
    assert len(twins[0]) and set(own[0]) & set(twins[0]) and set(own[0]) != set(twins[0])


def test_edges(spark):
    rows = [(1, "you idiot fool"), (2, None), (3, ""), (None, "idiot"), (1, "you idiot fool"), (5, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("q")).withColumn("score", F.lit(1))
    for labels in ([], [(1, 1)], [(1, 0), (9, 1)], [(1, 1), (2, 0), (None, 1), (3, None)]):
        model = T.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = T.score(df, model).collect()
        assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 1, 2, 3, 5]
        assert all(0 <= r.score <= 1 for r in got)
    assert T.score(df.limit(0), model).collect() == []


def test_model_and_scores_equal_a_plain_version(spark):
    """Slots by Python strings, loss and gradient by dense matrices, scores by a sum over the words of a text."""
    import re

    import xxhash

    def slots_of(words):
        out = set()
        for w in words:
            out |= {xxhash.xxh3_64_intdigest(w[:k] if k and len(w) > k else w, salt if k and len(w) > k or not k else T._FAMILIES[0][1]) >> 44 for k, salt in T._FAMILIES}
        return out

    low = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
    lists = [t.encode().split() for t in T.IDENTITY_TERMS]

    def twin_of(words):
        turn = len(set(words))
        swap = {w: g[(i + 1 + turn % (len(g) - 1)) % len(g)] for g in lists for i, w in enumerate(g)}
        return slots_of(swap.get(w, w) for w in words) if any(w in swap for w in words) else None

    rng = np.random.default_rng(8)
    vocabulary = [f"wörd{i}" for i in range(60)] + ["women", "Muslims", "gay", "idiots", "kindness"]
    rows = []
    for i in range(300):
        t = list(rng.choice(vocabulary, int(rng.integers(1, 30)))) + ["idiots"] * int(i % 3 == 0) + ["kindness"] * int(i % 3 == 1) + ["women"] * int(rng.random() < 0.4)
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, offset = T.fit(df, df)
    own, label = [slots_of(low(t)) for _, t, _ in rows], np.array([y for *_, y in rows], float)
    every = sorted(set().union(*own))
    both = {s: sum(s in o for o in own) for s in every}
    bad = {s: sum(y for o, y in zip(own, label, strict=True) if s in o) for s in every}

    def clear(s):
        n, n1, b, a = len(rows), label.sum(), both[s], bad[s]
        cells = ((a, b * n1 / n), (b - a, b - b * n1 / n), (n1 - a, n1 - b * n1 / n), (n - n1 - b + a, n - n1 - b + b * n1 / n))
        return 2 * sum(x * np.log(x / e) for x, e in cells if x > 0)

    used = [s for s in every if both[s] >= 4 and clear(s) > 12]
    dense = lambda sets: np.array([[s in o for s in used] for o in sets], float)
    twins = [(k, z) for k, (_, t, _) in enumerate(rows) if (z := twin_of(low(t)))]
    x, a, b = dense(own), dense([own[k] for k, _ in twins]), dense([z for _, z in twins])
    w, w0, m, v, m0, v0 = np.zeros(len(used)), float(np.log(label.mean() / (1 - label.mean()))), 0.0, 0.0, 0.0, 0.0
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-(x @ w + w0)))
        g = x.T @ (p - label) / len(rows) + 2e-3 * w + 2 * (a - b).T @ ((a - b) @ w) / len(twins)
        m, v, m0, v0 = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * m0 + 0.1 * (p - label).mean(), 0.99 * v0 + 0.01 * (p - label).mean() ** 2
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, w0 = w - step * m / (np.sqrt(v) + 1e-9), w0 - step * m0 / (np.sqrt(v0) + 1e-9)
    assert np.allclose(weights[used], w, atol=1e-6) and np.count_nonzero(weights) <= len(used)
    got = {r.doc_id: r.score for r in T.score(df, (weights, offset)).collect()}
    for i, o in enumerate(own):
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(weights[s] for s in o) + offset)))) < 1e-5
    assert np.mean([(got[i] >= T.THRESHOLD) == y for i, _, y in rows]) > 0.85


def test_long_texts_are_scored_in_blocks(monkeypatch):
    import lacuna.llm.common as C

    rng = np.random.default_rng(3)
    weights = rng.normal(size=T.SLOTS)
    text = " ".join(f"word{i}" for i in rng.integers(0, 500, 2000)) + " women and Muslims met"
    batch = pa.record_batch({"doc_id": pa.array([1]), "label": pa.array([1], pa.int32()), "text": pa.array([text])})
    whole = next(T._score(iter([batch]), weights, 0.1)), next(T._examples(iter([batch]), T.IDENTITY_TERMS))
    monkeypatch.setattr(C, "SLICE_BYTES", 500)
    monkeypatch.setattr(C, "blocks", lambda raw, table, f=C.blocks: f(raw, table, 500))
    parts = next(T._score(iter([batch]), weights, 0.1)), next(T._examples(iter([batch]), T.IDENTITY_TERMS))
    assert whole[0] == parts[0] and whole[1].column("slots") == parts[1].column("slots") and len(parts[1].column("twin")[0])
