"""Quality rules as a short-circuit cascade of built-in functions.

The counters that are returned come from one projection without a shuffle. The rules are then joined in one CASE, whose branches are evaluated in order until one holds; what a rule needs besides the counters is computed in its
branch. A sample tells each rule's cost, as time per document beyond that of a job that only reads the texts, and which rules reject each document. The order takes, again and again, the rule that rejects most of the documents
still left per cost. It changes what is computed, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Documents that costs and selectivities are estimated on, about, and how often a rule is evaluated on each to tell its cost; the least of so many runs counts.
SAMPLE, TIMES, RUNS = 2000, 4, 2
#: Seconds for the sample below which costs can't be told apart.
LEAST_COST = 0.01


@dataclass(frozen=True)
class Rule:
    """A document is rejected where the SQL condition holds; it may use `text` and the counters. It is evaluated only for documents that no earlier rule rejects."""

    name: str
    rejects: str


def _without(characters: str, text: str = "text") -> str:
    return f"length(translate({text}, '{characters}', ''))"


def _words(body: str) -> str:
    """A SQL expression of `w`, the words of text."""
    return f"get(transform(array(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '')), w -> {body}), 0)"


RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("stutter", "10 * " + _words("size(filter(w, (x, i) -> x = get(w, i - 1)))") + " > 3 * n_words"),
    Rule("capitals", "2 * (length(text) - " + _without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + ") > word_chars"),
    Rule("digits", "2 * (length(text) - " + _without("0123456789") + ") > word_chars"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` that are found twice or more, the first included.

    Windows are compared by 64-bit hashes. Where all differ, which one hash set tells, nothing is sorted."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            kept = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
        return F.aggregate(let(pairs, positions), start, step, lambda a: a["n"])

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - width + 1), lambda i: F.xxhash64(F.slice(x, i, width))))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(counted)


def counters(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words as longs; only these columns stay."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    # inline() evaluates both structs once, before their fields are read
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.inline(F.array(F.struct(by_word.alias("w"), by_line.alias("l")))))
    long = lambda c: c.cast("long")
    length = F.length("text")
    return rows.select(
        "doc_id", "text", long(F.col("w.n")).alias("n_words"), long(F.length(F.translate("text", SPACE, ""))).alias("word_chars"),
        long(length - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"), long(F.col("l.n")).alias("n_lines"), long(F.col("l.d")).alias("n_dup_lines"), long(F.col("w.r")).alias("n_repeat_words"),
    )


def _seconds(rows: DataFrame, condition: str) -> float:
    """The least time of some runs that evaluate the condition on rows."""
    best = float("inf")
    for _ in range(RUNS):
        began = time.perf_counter()
        rows.agg(F.count_if(F.expr(condition))).first()
        best = min(best, time.perf_counter() - began)
    return best


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], base: str, sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order that rejects most per cost, by a sample of about `sample` rows of docs, all rows if there are fewer. Only the sample is counted on."""
    n = docs.select(F.lit(1)).count()
    if not n or not rules:
        return list(rules)
    part = materialize(counters(docs.select("doc_id", "text").sample(min(1.0, sample / n), seed=11)), "sample")
    many = part.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
    empty = _seconds(many, "length(text) < 0")
    cost = [max(_seconds(many, r.rejects) - empty, LEAST_COST) for r in rules]
    verdicts = F.concat(*[F.when(F.expr(r.rejects), "1").otherwise("0") for r in rules])
    seen = [(r.v, r.n) for r in part.where(f"NOT coalesce({base}, false)").groupBy(verdicts.alias("v")).agg(F.count("*").alias("n")).collect()]  # at most a row per set of rules
    out, rest = [], list(range(len(rules)))
    while rest:
        gain = {k: sum(c for v, c in seen if v[k] == "1") / cost[k] for k in rest}
        k = min(rest, key=lambda k: (-gain[k], cost[k], rules[k].name))
        out.append(rules[k])
        rest.remove(k)
        seen = [(v, c) for v, c in seen if v[k] != "1"]
    return out


def apply_rules(counted: DataFrame, base: str, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, first_failed (name of the first rule in this order that rejects, null if none or base_failed) and kept."""
    cascade = F.when(F.expr(base), F.lit(None).cast("string"))
    for rule in rules:
        cascade = cascade.when(F.expr(rule.rejects), F.lit(rule.name))
    marked = counted.withColumn("base_failed", F.expr(base)).withColumn("first_failed", cascade)
    return marked.withColumn("kept", ~F.col("base_failed") & F.col("first_failed").isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: str = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words") -> DataFrame:
    """docs(doc_id, text) to the counters, base_failed, first_failed and kept, a row per document.

    A null or empty text has no words, so base_failed holds. Repeated rows are judged alike and each kept as a row; a null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    counted = counters(docs)
    return apply_rules(counted, base, order_rules(docs, rules, base)).drop("text")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
st AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d) WHERE w[i] = w[i - 1] GROUP BY doc_id),
c AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(st.n, 0) AS n_stutter FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN st USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutter > 3 * n_words
    OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) AS kept
FROM b
"""
