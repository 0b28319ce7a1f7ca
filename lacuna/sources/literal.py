"""A few items with a blank, written down here: for a first try of the generators without any file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (sentence, target)
ITEMS = (
    ("The ferry left the ___ before the storm came in.", "harbour"),
    ("She counted the ___ twice and wrote the sum below.", "coins"),
    ("Nobody had ___ the upper window since autumn.", "opened"),
    ("A ___ road led them past the mill.", "narrow"),
    ("They spoke ___ so that the child would sleep on.", "quietly"),
    ("Bread, salt and ___ stood on the table.", "cheese"),
)


def items(spark: SparkSession) -> DataFrame:
    """(item_id, sentence, target)."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(ITEMS, 1)], "item_id long, sentence string, target string")
