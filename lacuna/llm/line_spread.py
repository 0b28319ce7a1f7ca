"""Line dedup by the number of distinct sites a line is found on, with built-in functions only.

Lines are compared by 128 bits of hash. Lines of a single site, nearly all, are set aside by the minimum and maximum of a hash of the site, which combine before the shuffle. For the
rest HyperLogLog sketches of the sites are merged per line; a line whose estimate lies near the threshold gets an exact count of distinct sites. Lines on enough sites are boilerplate
and leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MARGIN = " \t\r\x0b\f"
LOG_BUCKETS = 12
#: Estimates off the threshold by up to this share of it are replaced by exact counts: over six standard errors of a sketch of 4096 buckets. Estimates further off decide by themselves; that one is on the wrong side has a chance of about
#: one in a billion for each line (and none while a sketch still lists its sites, as it does for some hundred).
BAND = 0.1
#: Parts that the rows of each line are dealt to where they meet the few lines found, so that no task has all rows of a frequent line.
SALTS = 16


def _line_key(line: Column) -> list[Column]:
    trimmed = F.btrim(line, F.lit(MARGIN))
    return [F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit("line"), trimmed).alias("h2"), F.length(trimmed).alias("size")]


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """A row (d1, d2, pos, site, h1, h2) for each line that isn't blank. d1 and d2 tell documents apart by id and text, so rows that repeat both are one."""
    text = F.coalesce("text", F.lit(""))
    at = docs.select(*_doc_key(), F.xxhash64(F.col(site).isNull(), site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return at.select("d1", "d2", "pos", "site", *_line_key(F.col("line"))).where("size > 0").drop("size")


def _doc_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("d2")]


def _salted(lines: DataFrame) -> DataFrame:
    """Keys (h1, h2), once for each salt."""
    return lines.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def spread_lines(candidates: DataFrame, min_sites: int) -> DataFrame:
    """candidates(h1, h2, salt, site) to the keys (h1, h2) of lines on min_sites sites or more."""
    sketched = candidates.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS))).alias("sites"))
    sketched = materialize(sketched.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = F.col("sites") <= min_sites * (1 + BAND)
    exact = candidates.join(_salted(sketched.where(near)), ["h1", "h2", "salt"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count()
    return sketched.where(~near).select("h1", "h2").unionByName(exact.where(F.col("count") >= min_sites).select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, site: str = "source") -> DataFrame:
    """docs(doc_id, text, source) to (doc_id, n_lines, n_removed, text): text without the lines that are found on min_sites (2 or more) distinct sites.

    Lines are split at \\n and compared without white space around them; blank lines are kept and never counted in n_lines. A null site is a site of its own. A null text is empty and stays so.
    Repeated rows are each kept and cleaned alike; an empty table gives no rows. Other columns are ignored.
    """
    if min_sites < 2:
        raise ValueError("min_sites must be 2 or more")
    lines = lines_of(docs, site)
    shared = lines.groupBy("h1", "h2").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("h1", "h2")
    candidates = materialize(lines.join(shared, ["h1", "h2"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("d1", "d2", "pos"), F.lit(SALTS)).cast("int")), "candidates", free=True)
    found = candidates.join(_salted(spread_lines(candidates, min_sites)), ["h1", "h2", "salt"], "left_semi")
    drop = found.groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_doc_key())
    split = F.split("text", "\n")
    full = lambda line: F.length(F.btrim(line, F.lit(MARGIN))) > 0
    n_lines = F.size(F.filter(split, full)).cast("long")
    joined = text.join(drop, ["d1", "d2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "drop")  # by a hash set
    rest = F.get(F.transform(F.array(F.struct(split.alias("s"), stay.alias("i"))), lambda x: F.array_join(F.transform(x["i"], lambda i: F.get(x["s"], i)), "\n")), F.lit(0))
    return joined.select(
        "doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(rest).alias("text"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, source, i, l[i] AS line, trim(l[i], concat(' ', chr(9), chr(11), chr(12), chr(13))) AS k FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
wide AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'none')) >= 5),
y AS (SELECT x.*, wide.k IS NOT NULL AS gone FROM x LEFT JOIN wide ON x.k = wide.k)
SELECT doc_id, CAST(count(*) FILTER (k <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5 FROM y GROUP BY doc_id
"""
