"""Readers. Missing artefacts are empty tables of the same schema, as are missing models elsewhere, so that a run never stops for one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "sentence string, target string, english_sentence string"
#: Schemas of the artefacts of plans/build.py.
ARTEFACTS = {
    "vocabulary": "lemma string, pos string, surface_forms array<string>, detailed_pos_tags array<string>, frequency long, unknown_by_dict_count long",
    "cooccurrence": "w1 string, w2 string, cnt long",
    "trigrams": "w1 string, w2 string, w3 string, cnt long",
    "dependencies": "dep string, head string, child string, cnt long",
    "vectors": "word string, vec array<float>",
}


def articles(spark: SparkSession, root: str, glob: str = "*.json", least_bytes: int = 11) -> DataFrame:
    """(text, file, broken) of JSON-lines files below root; small files and names that start with a dot are left out, blank lines skipped, and lines that aren't an object are marked broken, not dropped."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema("text string, _corrupt_record string").json(root)
    named = raw.select("text", F.col("_corrupt_record").isNotNull().alias("broken"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"))
    return named.where((F.col("_size") >= least_bytes) & ~F.startswith(F.element_at(F.split("file", "/"), -1), F.lit("."))).drop("_size")


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tokens) of a text file of one sentence a line, tokens between blanks."""
    return spark.read.text(path).select(F.filter(F.split("value", r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "").alias("tokens"))


def cloze_items(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and quoted fields."""
    return spark.read.schema(ITEMS).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def packed_map(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """A one-object JSON file whose keys join words with | to a row per key: split at the first |, the rest of the last part kept whole."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "value"))
    return rows.select(*[F.get(F.split("k", r"\|", len(parts)), i).alias(p) for i, p in enumerate(parts)], "value")


DETAILS = "surface_forms array<string>, detailed_pos_tags array<string>, frequency long, unknown_by_dict_count long"


def word_details(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary from a one-object JSON file of lemma|class to its details; an empty table where there is no such file."""
    try:
        rows = packed_map(spark, path, ["lemma", "pos"])
    except AnalysisException:
        return spark.createDataFrame([], ARTEFACTS["vocabulary"])
    return rows.select("lemma", "pos", F.from_json("value", DETAILS).alias("d")).select("lemma", "pos", "d.*")


def present(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a build wrote that table."""
    try:
        spark.read.schema(ARTEFACTS[name]).parquet(f"{folder}/{name}").limit(0).collect()
        return True
    except AnalysisException:
        return False


def artefact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that a build wrote, or an empty one."""
    try:
        return spark.read.schema(ARTEFACTS[name]).parquet(f"{folder}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], ARTEFACTS[name])


def sampled(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a total order, for trial runs."""
    return df.orderBy(*order).limit(n)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files give fewer partitions than there are cores, as one small file does; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
