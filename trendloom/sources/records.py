"""Input records: metadata snapshots, category taxonomies and merge trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.operators.ranking import dedup_by_key
from trendloom.schemas import SNAPSHOT, TAXONOMY_ENTRY


def read_snapshot(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines metadata. The schema is given: one pass, only the fields in use, ids as text."""
    return spark.read.schema(SNAPSHOT).json(path)


def parse_versions(versions: Column) -> Column:
    """Version entries that arrive as text, in JSON or in single quotes."""
    kind = T.ArrayType(SNAPSHOT["versions"].dataType.elementType)
    return F.from_json(versions, kind, {"allowSingleQuotes": "true"})


def read_taxonomy(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(code, name) from JSON objects code → entry; the first file that has a code names it."""
    entries = None
    for order, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        one = text.select(
            F.explode(F.from_json("value", T.MapType(T.StringType(), TAXONOMY_ENTRY)))
        ).select(F.lit(order).alias("_file"), F.col("key").alias("code"), F.col("value.name").alias("name"))
        entries = one if entries is None else entries.unionByName(one)
    return dedup_by_key(entries, ["code"], [F.asc("_file"), F.asc("name")]).select("code", "name")


def write_topic_tree(tree: DataFrame, path: str, form: str = "parquet") -> None:
    """Merge tree (parent_id, topics, left_id, right_id, distance); ``tsv`` writes topics as JSON."""
    if form == "parquet":
        tree.write.mode("overwrite").parquet(path)
    elif form == "tsv":
        tree.withColumn("topics", F.to_json("topics")).write.mode("overwrite").csv(
            path, sep="\t", header=True
        )
    else:
        raise ValueError(f"unknown form: {form}")


TREE = T.StructType(
    [
        T.StructField("parent_id", T.LongType()),
        T.StructField("topics", T.ArrayType(T.LongType())),
        T.StructField("left_id", T.LongType()),
        T.StructField("right_id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ]
)


def read_topic_tree(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    if form == "parquet":
        return spark.read.schema(TREE).parquet(path)
    if form != "tsv":
        raise ValueError(f"unknown form: {form}")
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "topics" else f.dataType) for f in TREE]
    )
    table = spark.read.schema(raw).csv(path, sep="\t", header=True)
    return table.withColumn("topics", F.from_json("topics", TREE["topics"].dataType)).select(
        *TREE.names
    )
