import re
from collections import Counter

from oracle import assert_equal
from pyspark.sql import functions as F

from lacuna.llm import quality_rules as Q
from lacuna.llm.queries import QUERIES, oracle_sql


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(g)
    hit = {p for i, x in enumerate(g) if c[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in Q.SYMBOLS for x in text), len(lines) - len(set(lines)), len(hit)


def test_query_equals_sql(spark, sf):
    assert_equal(spark, sf, QUERIES["op1_quality_rules"], oracle_sql()["op1_quality_rules"])


def test_counters_on_edges(spark):
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "a b\n\na b\n \n\n \nq", "#x *y $$ é<>", "é ü\x0bß\x0c日本", "a b c d e f g h i a b c d e f g h", "long " + "w%d " * 3, " ".join(f"w{i % 700}" for i in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "x y")], "doc_id long, text string").withColumn("n_words", F.lit(-1)).withColumn("w", F.lit("c"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.judge(df).collect())
    assert got == sorted([(i, *brute(t)) for i, t in enumerate(texts)] + [(0, *brute(None)), (-1, *brute("x y"))])
    assert Q.judge(df.limit(0)).collect() == []


def test_order_never_changes_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = Q.counters(docs)
    a, b = (sorted(map(tuple, Q.apply_rules(counted, "n_words < 20", rules).select("doc_id", "kept").collect())) for rules in (list(Q.RULES), list(Q.RULES)[::-1]))
    assert a == b
    assert sorted(r.name for r in Q.order_rules(docs, Q.RULES, "n_words < 20", 50)) == sorted(r.name for r in Q.RULES)


def test_rules_go_by_what_they_still_reject_per_cost(spark, monkeypatch):
    rows = [(i, "word " * 30 + ("# " * 40 if i % 10 < 6 else "") + ("7777 " * 90 if i % 10 >= 8 else "")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dear = "length(regexp_replace(repeat(text, 40), '[a-q]+', '')) < 0"
    rules = (Q.Rule("dear", f"{dear} OR 10 * n_symbols > n_words"), Q.Rule("symbols", "10 * n_symbols > n_words"), Q.Rule("digits", "text LIKE '%7777%'"), Q.Rule("none", "n_words < 0"))
    names = [r.name for r in Q.order_rules(df, rules, "n_words < 20", 100)]
    assert names[:2] == ["symbols", "digits"]  # after them the dear rule has nothing left to reject
    assert set(names[2:]) == {"dear", "none"}
    seen = {"a": 4.0, "b": 1.0, "c": 1.0, "": 0.5}
    monkeypatch.setattr(Q, "_seconds", lambda rows, condition: next((t for k, t in seen.items() if k and f"'{k}'" in condition), 0.5))
    rules = (Q.Rule("a", "'a' = 'a' AND 10 * n_symbols > n_words"), Q.Rule("b", "'b' = 'b' AND text LIKE '%7777%'"), Q.Rule("c", "'c' = 'c' AND (10 * n_symbols > n_words AND doc_id % 10 < 3)"))
    # per second: a 60 / 3.5, b 20 / 0.5, c 30 / 0.5; then a still has 30
    assert [r.name for r in Q.order_rules(df, rules, "n_words < 20", 1000)] == ["c", "b", "a"]
