"""Schemas of the input records and of the persistent tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

VERSION = _struct(version=_S, created=_S)

SNAPSHOT = _struct(
    id=_S, title=_S, abstract=_S, categories=_S, versions=T.ArrayType(VERSION), update_date=_S
)

TAXONOMY_ENTRY = _struct(
    name=_S, in_group=_S, start_date=T.ArrayType(_I), end_date=T.ArrayType(_I)
)

PAPER = _struct(
    id=_L, source_id=_S, creation_year=_I, creation_month=_I, title=_S, abstract=_S,
    abstract_length=_I, embedding=T.ArrayType(T.FloatType()), update_date=T.DateType(),
)
CATEGORY = _struct(id=_L, archive=_S, name=_S, paper_count=_L)
PAPER_CATEGORIES = _struct(paper_id=_L, category_id=_L, is_primary=_I)
TOPIC = _struct(
    id=_L, parent_id=_L, hierarchy=_I, model=_S, orig_id=_I, name=_S, llm_label=_S, paper_count=_L
)
PAPER_TOPICS = _struct(paper_id=_L, topic_id=_L, probability=_D, transformed=_I)
CATEGORY_STATS = _struct(
    category_id=_L, year=_I, month=_I, paper_count=_L, total_percent=_D, parent_percent=_D
)
TOPIC_STATS = _struct(
    topic_id=_L, year=_I, month=_I, transformed=_I, paper_count=_L, total_percent=_D,
    parent_percent=_D,
)

TABLES = {
    "paper": PAPER,
    "category": CATEGORY,
    "paper_categories": PAPER_CATEGORIES,
    "topic": TOPIC,
    "paper_topics": PAPER_TOPICS,
    "category_stats": CATEGORY_STATS,
    "topic_stats": TOPIC_STATS,
}

# Columns that identify a row of each table.
KEYS = {
    "paper": ["source_id"],
    "category": ["name"],
    "paper_categories": ["paper_id", "category_id"],
    "topic": ["model", "orig_id"],
    "paper_topics": ["paper_id", "topic_id"],
    "category_stats": ["category_id", "year", "month"],
    "topic_stats": ["topic_id", "year", "month", "transformed"],
}

OUTLIER = -1  # orig_id of the topic that holds what no topic holds

# paper_topics.transformed
TRAINED, PREDICTED, DISTRIBUTED = 0, 1, 2
