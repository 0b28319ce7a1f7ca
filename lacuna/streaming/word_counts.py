"""Word counts of a growing folder of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import counts
from ..plans.build import tagged
from ..profiles import Profile


def stream(spark: SparkSession, folder: str, schema: str, profile: Profile) -> DataFrame:
    """(lemma, pos, frequency) of Parquet articles as they arrive."""
    return counts.word_frequencies(counts.vocabulary_rows(tagged(spark.readStream.schema(schema).parquet(folder), profile), profile))


def run_available(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts all that is there into an in-memory table and stops."""
    query = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
