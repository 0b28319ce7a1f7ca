import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lacuna.llm import token_counts as C
from lacuna.llm.queries import op5_token_counts

VOCABULARY = C.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary)
        n += 1
    return n


def brute(text, vocabulary, longest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words), sum(greedy(b" " + w.encode(), vocabulary, longest) for w in words)


def test_query_equals_greedy_matching(spark, sf):
    vocabulary, longest = set(VOCABULARY), max(map(len, VOCABULARY))
    want = sorted((r.doc_id, *brute(r.text, vocabulary, longest)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op5_token_counts(spark, sf).collect())) == want


def test_failure_links_on_random_vocabularies():
    rng = np.random.default_rng(2)
    for _ in range(30):
        extra = [bytes(rng.integers(97, 100, rng.integers(2, 9), dtype=np.uint8)) for _ in range(25)]
        vocabulary = [bytes([c]) for c in range(256)] + extra
        words = [bytes(rng.integers(97, 100, rng.integers(0, 30), dtype=np.uint8)) for _ in range(60)]
        ends = np.cumsum([0] + [len(w) for w in words])
        got = C.Automaton(vocabulary).count(np.frombuffer(b"".join(words), np.uint8), ends)
        assert got.tolist() == [greedy(w, set(vocabulary), 9) for w in words]
    with pytest.raises(ValueError):
        C.Automaton([b"a"])


def test_edges(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (4, " \n\t "), (None, "x"), (1, "one two"), (5, "日本語 é " * 3000), (6, "a" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("q"))
    automaton = C.Automaton(VOCABULARY)
    vocabulary, longest = set(VOCABULARY), max(map(len, VOCABULARY))
    got = sorted(map(tuple, C.count_tokens(df, automaton).collect()), key=repr)
    assert got == sorted([(d, *brute(t, vocabulary, longest)) for d, t in rows], key=repr)
    assert C.count_tokens(df.limit(0), automaton).collect() == []
