from oracle import assert_equal
from pyspark.sql import functions as F

from lacuna.llm import line_spread as L
from lacuna.llm.queries import QUERIES, oracle_sql


def test_query_equals_sql(spark, sf):
    assert_equal(spark, sf, QUERIES["op9_line_dedup"], oracle_sql()["op9_line_dedup"])


def brute(rows, most):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x.strip(L.MARGIN), set()).add(s)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [x.strip(L.MARGIN) != "" and len(sites[x.strip(L.MARGIN)]) >= most for x in lines]
        out.append((d, sum(x.strip(L.MARGIN) != "" for x in lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


ROWS = [(1, "a\nb\n\na", "s"), (2, " a\nc", "t"), (3, "a\t", None), (4, None, "s"), (5, "", "s"), (6, "c\n  \nd", None), (2, " a\nc", "t"), (None, "b\nx", "u"), (8, "a", ""), (9, "long " * 4000 + "\na", "v")]


def test_edges_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("site", F.lit(1)).withColumn("pos", F.lit("z"))
    for most in (2, 3, 4, 6):
        assert sorted(map(tuple, L.remove_boilerplate(df, most).collect()), key=repr) == brute(ROWS, most)
    assert L.remove_boilerplate(df.limit(0)).collect() == []


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"x{m}", f"site{k}") for i, (m, k) in enumerate((m, k) for m in range(40, 61) for k in range(m))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, L.remove_boilerplate(df, 50).collect()), key=repr) == brute(rows, 50)
