"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, all in SQL.

A source's documents are dealt by a seeded hash to shards; the documents of a shard of a source, in hash order, form a line of words, cut into blocks of equal size.
Targets become seats (blocks to take): first each source gets seats by highest quotients weight / (2 seats + 1), then each of its shards. A shard's seats go
round all its blocks as often as they can, and the rest to blocks that a seeded permutation selects. A document takes the words of its that lie in blocks taken, repeats counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words in a block, about.
BLOCK_WORDS = 16
WORD = r"[^\x20\x09-\x0D]+"

#: What differs between Spark SQL and DuckDB.
SPARK = {
    "int_of_hash": "CAST(conv(substr(md5({}), 1, 8), 16, 10) AS BIGINT)", "text": "STRING", "each": "explode(sequence({}, {}))",
    "picked": "aggregate(sequence(j0, j1), 0L, (s, j) -> s + {})", "div": "({}) div ({})",
}
DUCKDB = {
    "int_of_hash": "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)", "text": "VARCHAR", "each": "unnest(range({}, ({}) + 1))",
    "picked": "CAST(list_sum(list_transform(range(j0, j1 + 1), lambda j: {})) AS BIGINT)", "div": "({}) // ({})",
}


def seats_sql(name: str, cells: str, group: str, order: str) -> str:
    """CTEs that end in `name`: cells with `seats`, for each group in all floor(sum of weight + 0.5), by the highest quotients weight / (2 k + 1).

    Rounding each weight takes all quotients above one bound; the few seats too few or too many are then added or taken away by quotient, ties by `order`."""
    by = f"PARTITION BY {group}" if group else ""
    return f"""
{name}_r AS (SELECT *, CAST(floor(weight + 0.5) AS BIGINT) AS r, CAST(floor(sum(weight) OVER ({by}) + 0.5) AS BIGINT) AS goal FROM {cells}),
{name}_d AS (SELECT *, goal - CAST(sum(r) OVER ({by}) AS BIGINT) AS diff FROM {name}_r),
{name}_q AS (SELECT *, CASE WHEN diff > 0 THEN -weight / (2 * (r + step - 1) + 1) ELSE weight / (2 * (r - step) + 1) END AS q FROM
  (SELECT *, <each:1;abs(diff)> AS step FROM {name}_d WHERE diff <> 0) t WHERE diff > 0 OR step <= r),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {group + ',' if group else ''} diff ORDER BY q, {order}, step) AS nth FROM {name}_q),
{name}_m AS (SELECT cell, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE -1 END) AS BIGINT) AS moved FROM {name}_n WHERE nth <= abs(diff) GROUP BY cell),
{name} AS (SELECT d.*, d.r + coalesce(m.moved, 0) AS seats FROM {name}_d d LEFT JOIN {name}_m m ON d.cell = m.cell)"""


def dealt_sql(sizes: str, dialect: dict[str, str], docs: str, seed: int, shard_docs: int) -> str:
    """sizes(doc_id, source, size) with the source as (is null, text), so that null is a source of its own, after all others, and with each document's hash and shard; docs is the number of rows."""
    text = f"""SELECT *, <div:h * (<div:{docs} + {shard_docs - 1};{shard_docs}>);4294967296> AS shard FROM
  (SELECT doc_id, size, source IS NULL AS nil, coalesce(source, '') AS src, <int_of_hash:concat('{seed}:', coalesce(CAST(doc_id AS <text>), ''))> AS h FROM {sizes}) x"""
    return _spelled(text, dialect)


#: Words of each shard of each source.
CELLS_SQL = "SELECT nil, src, shard, CAST(sum(size) AS BIGINT) AS line_words FROM {} GROUP BY nil, src, shard"


def mix_sql(dealt: str, cells: str, dialect: dict[str, str], weights: tuple[int, ...], most: int, seed: int, block_words: int) -> str:
    """The query over the tables of dealt_sql and CELLS_SQL. All but the last steps work on cells, which are few."""
    cycle = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    text = f"""
WITH s0 AS (SELECT nil, src, CAST(sum(line_words) AS BIGINT) AS n FROM {cells} GROUP BY nil, src),
s1 AS (SELECT nil, src, n, k, CASE (k - 1) % {len(weights)} {cycle} END AS w FROM (SELECT *, row_number() OVER (ORDER BY nil, src) AS k FROM s0) t),
s2 AS (SELECT *, {most} * n AS cap, CAST(sum(w) OVER () AS BIGINT) AS w_all, CAST(sum(n) OVER () AS BIGINT) AS n_all,
  CAST(coalesce(sum({most} * n) OVER before, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(w) OVER before, 0) AS BIGINT) AS w_before
  FROM s1 WINDOW before AS (ORDER BY CAST(n AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CAST(w AS DOUBLE) * (n_all - cap_before) >= CAST(cap AS DOUBLE) * (w_all - w_before) AS capped FROM s2),
s4 AS (SELECT *, n_all - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS n_open, w_all - CAST(sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS BIGINT) AS w_open FROM s3),
s5 AS (SELECT nil, src, k, n, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * n_open / w_open END AS target FROM s4),
line AS (SELECT *, CAST(sum(size) OVER (PARTITION BY nil, src, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi FROM {dealt}),
c1 AS (SELECT nil, src, shard, line_words, CASE WHEN line_words = 0 THEN 0 ELSE greatest(1, <div:2 * line_words + {block_words};{2 * block_words}>) END AS b FROM {cells}),
a0 AS (SELECT s5.nil, s5.src, s5.k, s5.target, s5.k AS cell, sum(b) AS b_all, CASE WHEN max(n) = 0 THEN 0.0e0 ELSE s5.target * CAST(sum(b) AS DOUBLE) / max(n) END AS weight
  FROM s5 JOIN c1 ON s5.nil = c1.nil AND s5.src = c1.src GROUP BY s5.nil, s5.src, s5.k, s5.target),
{seats_sql("a", "a0", "", "cell")},
e0 AS (SELECT c1.*, a.k, concat(CAST(a.k AS <text>), ':', CAST(c1.shard AS <text>)) AS cell, CASE WHEN b_all = 0 THEN 0.0e0 ELSE CAST(a.seats AS DOUBLE) * b / b_all END AS weight FROM c1 JOIN a ON a.nil = c1.nil AND a.src = c1.src),
{seats_sql("e", "e0", "k", "shard")},
f AS (SELECT nil, src, shard, line_words, b, least(seats, {most} * b) AS seats, CASE WHEN b > 0 THEN <int_of_hash:concat('{seed}/', cell)> % b ELSE 0 END AS shift FROM e),
g AS (SELECT l.*, f.line_words, f.b, f.shift, <div:f.seats;f.b> AS rounds, f.seats % f.b AS rest, l.hi - l.size AS lo,
  <div:(l.hi - l.size + 1) * f.b - 1;f.line_words> AS j0, <div:l.hi * f.b - 1;f.line_words> AS j1
  FROM line l JOIN f ON l.nil = f.nil AND l.src = f.src AND l.shard = f.shard WHERE l.size > 0),
took AS (SELECT doc_id, nil, src, size, rounds * size + <picked:CASE WHEN (j * 1610612741 + shift) % b < rest THEN least(hi, <div:(j + 1) * line_words;b>) - greatest(lo, <div:j * line_words;b>) ELSE 0 END> AS taken FROM g
  UNION ALL SELECT doc_id, nil, src, size, CAST(0 AS BIGINT) FROM {dealt} WHERE size = 0)
SELECT took.doc_id, CASE WHEN took.nil THEN NULL ELSE took.src END AS source, took.size, s5.n AS source_size, s5.target, took.taken FROM took JOIN s5 ON took.nil = s5.nil AND took.src = s5.src
"""
    return _spelled(text, dialect)


def _spelled(text: str, dialect: dict[str, str]) -> str:
    """Replaces <name:argument;argument>, innermost first, and <text>, by the dialect's words."""
    text = text.replace("<text>", dialect["text"])
    while True:
        starts = [i for k in dialect for i in _found(text, f"<{k}:")]
        if not starts:
            return text
        at = max(starts)
        end = _close(text, at)
        name, _, inner = text[at + 1 : end].partition(":")
        text = text[:at] + dialect[name].format(*inner.split(";")) + text[end + 1 :]


def _found(text: str, what: str) -> list[int]:
    out, at = [], text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1)
    return out


def _close(text: str, at: int) -> int:
    """The > that ends a placeholder: not one of -> or >=, nor a comparison, which all stand next to a space."""
    i = at
    while True:
        i = text.index(">", i + 1)
        if text[i - 1] not in "- " and text[i + 1 : i + 2] != "=":
            return i


def sized(docs: DataFrame, size: str | None = None) -> DataFrame:
    """docs to (doc_id, source, size); size is the number of words unless an expression is given."""
    words = F.expr(size) if size else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, shard_docs: int = 16384, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text, source) to (doc_id, source, size, source_size, target, taken), a row each.

    Sources by code point, null last, weigh `weights`, repeating; targets share the sum of all sizes and stop at `most` times the source's size, the excess going to the others by weight. A null
    or empty text has size 0 and takes nothing; a source of such only has target 0. Rows that repeat a doc_id are rows of their own. An empty table gives no rows. Blocks have about block_words words. Shards have about shard_docs documents of all sources, so that a source of a third of all rows is still cut into many lines.
    """
    spark = docs.sparkSession
    n = docs.select(F.lit(1)).count()
    dealt = materialize(spark.sql(dealt_sql("{sizes}", SPARK, f"{n}L", seed, shard_docs), sizes=sized(docs)), "dealt")
    cells = materialize(spark.sql(CELLS_SQL.format("{dealt}"), dealt=dealt).coalesce(1), "cells")
    return spark.sql(mix_sql("{dealt}", "{cells}", SPARK, weights, most, seed, block_words), dealt=dealt, cells=cells)


#: Documents of one source and size that are ranked together.
CELL_DOCS = 16384
#: Documents of a source, at most, that make up for what its copies are off the target.
FIXES = 3


def copies(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """The result of mix() to (doc_id, copies): how often each document goes into the mix as a whole, so that the words of each source's copies sum to its target; one of size 0 once.

    All documents of a source get floor(target / source_size) copies. Its documents from the largest size down, by a seeded hash among those of one size, are a line along which the rest of the target is dealt evenly: at
    each size as many get one copy more as keep their number on the share. What the sum of words is then off by, less than the largest document, is made up by some documents of about that size.
    """
    keys = ["source", "target", "source_size"]
    hashed = mixed.where("size > 0").select("doc_id", *keys, "size", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)).alias("h"))
    sizes = hashed.groupBy(*keys, "size").agg(F.count("*").alias("n"))
    rounds = F.floor(F.col("target") / F.col("source_size"))
    line = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("target") / F.col("source_size") - F.col("rounds")
    to = F.floor(F.sum("n").over(line) * share + 0.5)
    before = F.floor((F.sum("n").over(line) - F.col("n")) * share + 0.5)
    dealt = sizes.withColumn("rounds", rounds).withColumn("extra", to - before).withColumn("parts", F.ceil(F.col("n") / F.lit(CELL_DOCS)))
    dealt = materialize(dealt.select("source", "size", "n", "rounds", "extra", "parts"), "sizes")

    def joined(a, b, on: tuple[str, ...], how: str = "inner"):
        """a with the other columns of b, where those of `on` are the same, null or not."""
        b = b.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns])
        return a.join(b, [a[c].eqNullSafe(b[f"_{c}"]) for c in on], how).drop(*[f"_{c}" for c in on])

    full = joined(hashed, dealt, ("source", "size")).select("doc_id", "source", "target", "size", "h", "rounds", "extra", "n", F.floor(F.col("h") * F.col("parts") / F.lit(1 << 32)).alias("part"))
    full = materialize(full, "dealt")
    # the parts of a size share its extra copies by their numbers of documents
    cells = full.groupBy("source", "size", "part", "n", "extra").agg(F.count("*").alias("m"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.sum("m").over(along)
    cells = cells.withColumn("most", F.floor(reached * F.col("extra") / F.col("n")) - F.floor((reached - F.col("m")) * F.col("extra") / F.col("n"))).select("source", "size", "part", "most")
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", F.col("doc_id").asc_nulls_first()))
    chosen = joined(full.withColumn("nth", nth), cells, ("source", "size", "part")).select("doc_id", "source", "target", "size", "h", "rounds", (F.col("nth") <= F.col("most")).cast("int").alias("more"))
    chosen = materialize(chosen, "chosen")
    for _ in range(FIXES):  # one document of each source makes up for most of what is left: a copy more or less
        off = chosen.groupBy("source", "target").agg(F.sum((F.col("rounds") + F.col("more")) * F.col("size")).alias("words")).select("source", (F.col("target") - F.col("words")).alias("off"))
        fits = F.abs(F.col("size") - F.abs("off")) < F.abs("off")
        free = F.when(F.col("off") > 0, (F.col("more") < 1) & (F.col("rounds") < 3)).otherwise((F.col("more") > -1) & (F.col("rounds") + F.col("more") > 0))
        able = joined(chosen, off, ("source",)).where(fits & free)
        last = able.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("off")).alias("d"), "h", "size", "doc_id", F.signum("off").cast("int").alias("by"))).alias("x")).select("source", "x.h", "x.size", "x.doc_id", "x.by")
        last = materialize(last, "last")  # a row per source at most
        moved = joined(chosen, last, ("source", "size", "h", "doc_id"), "left")
        chosen = materialize(moved.withColumn("more", F.col("more") + F.coalesce("by", F.lit(0))).drop("by"), "chosen")
    fixed = chosen.select("doc_id", (F.col("rounds") + F.col("more")).cast("int").alias("copies"))
    return fixed.unionByName(mixed.where("size = 0").select("doc_id", F.lit(1).alias("copies")))


def apply_mix(docs: DataFrame, mixed: DataFrame, seed: int = 7) -> DataFrame:
    """docs with whole documents copied as copies() says."""
    return take(docs, copies(mixed, seed))


def take(docs: DataFrame, times: DataFrame) -> DataFrame:
    """docs with each document as often as times(doc_id, copies) says. doc_id must tell documents apart: rows that repeat one are each taken as often as the most of them, and rows without doc_id once."""
    often = times.where("copies > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_mixed_doc")).agg(F.max("copies").alias("_mixed_copies"))
    found = docs.join(often, docs.doc_id == F.col("_mixed_doc")).withColumn("_mixed_copy", F.explode(F.sequence(F.lit(1), "_mixed_copies")))
    return found.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def oracle() -> str:
    sizes = rf"(SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents) sizes"
    dealt = f"({dealt_sql(sizes, DUCKDB, '(SELECT count(*) FROM documents)', 7, 16384)}) dealt"
    return mix_sql(dealt, f"({CELLS_SQL.format(dealt)}) cells", DUCKDB, (1, 2, 3), 3, 7, BLOCK_WORDS)
