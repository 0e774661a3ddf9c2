"""Queries over raw records: dates, cleaning, trimming, filters and the import report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars, text
from trendloom.operators import ingest
from trendloom.plans import views
from trendloom.plans.registry import query, view


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _accents_sql(column: str) -> str:
    for escape, letter in text.ACCENTS:
        column = f"replace({column}, {_quoted(escape)}, {_quoted(letter)})"
    return column


def _cleaning_sql(column: str) -> str:
    for pattern, replacement in text.CLEANING[:-1]:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(replacement.replace('$', chr(92)))}, 'g')"
    # the regex engine of the SQL side knows no look-ahead; this form is equal for it
    formula = r"\$\$[^$]*(?:\$[^$]+)*\$\$|\$[^$]*\$"
    return f"regexp_replace({column}, '{formula}', '(formula)', 'g')"


# the words of the text with an accent escape put after each of some letters
_ESCAPED = {"é": "\\'e", "è": "\\`e", "ü": '\\"u', "ö": '\\"o', "ß": "{\\ss}", "ñ": "\\~n", "ê": "\\^e"}


def _escaped_sql(column: str) -> str:
    for letter, escape in _ESCAPED.items():
        column = f"replace({column}, {_quoted(letter)}, {_quoted(escape)})"
    return column


view("cleaned", f"""
SELECT id, creation_date, update_date, {_cleaning_sql(_accents_sql('title'))} AS title,
       {_cleaning_sql(_accents_sql('abstract'))} AS abstract, categories
FROM snapshot""", "snapshot")

_WITHDRAWN_SQL = " OR ".join(f"starts_with(abstract, {_quoted(p)})" for p in text.WITHDRAWN)

view("sentences", r"""
SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (
  SELECT id, string_split(regexp_replace(trim(abstract), '([.!?])\s+([\p{Lu}\p{N}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s
  FROM cleaned)""", "cleaned")

view("trimmed", """
SELECT id, string_agg(sentence, ' ' ORDER BY i) AS abstract FROM (
  SELECT id, i, sentence, sum(length(sentence) + 1) OVER (PARTITION BY id ORDER BY i) - 1 AS size,
         length(sentence) AS own FROM sentences)
WHERE i = 1 OR size - 1 < 1024 GROUP BY id""", "sentences")

view("stages", f"""
SELECT c.id, CASE WHEN {_WITHDRAWN_SQL.replace('abstract', 'c.abstract')} THEN 'withdrawn' WHEN length(c.abstract) < 64 THEN 'short'
                  WHEN length(t.abstract) > 1024 THEN 'untrimmable' ELSE 'imported' END AS stage,
       c.title, t.abstract, CAST(length(t.abstract) AS INT) AS abstract_length, c.creation_date, c.update_date, c.categories
FROM cleaned c JOIN trimmed t ON t.id = c.id
WHERE year(c.creation_date) >= 2000 AND c.update_date > CAST('2012-03-01' AS DATE)""", "cleaned", "trimmed")

MARK = "2012-03-01"


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.filter_since(ingest.with_creation(views.snapshot(spark, sf)), 2000, MARK)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Every record, cleaned."""
    return ingest.clean(ingest.with_creation(views.snapshot(spark, sf)))


def _stages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.clean_snapshot(views.snapshot(spark, sf), 2000, MARK)


@query("SELECT id, creation_date FROM snapshot", "snapshot")
def creation_date(spark, sf):
    return ingest.with_creation(views.snapshot(spark, sf)).select("id", "creation_date")


@query("SELECT id, year(creation_date)::INT AS creation_year, month(creation_date)::INT AS creation_month FROM snapshot", "snapshot")
def creation_year_month(spark, sf):
    return ingest.with_creation(views.snapshot(spark, sf)).select("id", "creation_year", "creation_month")


@query("SELECT id FROM snapshot WHERE year(creation_date) >= 2000 AND update_date > CAST('2012-03-01' AS DATE)", "snapshot")
def filter_since(spark, sf):
    return _filtered(spark, sf).select("id")


@query("SELECT max(update_date) AS update_date FROM snapshot", "snapshot")
def high_water_mark(spark, sf):
    return ingest.high_water_mark(views.snapshot(spark, sf))


@query(f"SELECT doc_id, {_accents_sql(_escaped_sql('text'))} AS text FROM documents")
def clean_accents(spark, sf):
    escaped = F.col("text")
    for letter, escape in _ESCAPED.items():
        escaped = F.replace(escaped, F.lit(letter), F.lit(escape))
    return views.spread(views.load(spark, sf, "documents")).select("doc_id", text.clean_accents(escaped).alias("text"))


@query(f"SELECT doc_id, {_cleaning_sql('text')} AS text FROM documents")
def clean_text(spark, sf):
    return views.spread(views.load(spark, sf, "documents")).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT id, CAST(count(*) AS INT) AS sentences, string_agg(sentence, '|' ORDER BY i) AS text FROM sentences GROUP BY id", "sentences")
def split_sentences(spark, sf):
    split = text.split_sentences(F.col("abstract"))
    return _cleaned(spark, sf).select(
        "id", F.size(split).alias("sentences"), F.array_join(split, "|").alias("text")
    )


@query("SELECT id, abstract FROM trimmed", "trimmed")
def trim_sentences(spark, sf):
    return ingest.trim(_cleaned(spark, sf)).select("id", "abstract")


@query("SELECT id, CAST(length(abstract) AS INT) AS abstract_length FROM trimmed", "trimmed")
def abstract_length(spark, sf):
    return ingest.trim(_cleaned(spark, sf)).select("id", "abstract_length")


@query(f"""SELECT doc_id, abstract FROM (SELECT doc_id, CASE WHEN quality = 0 THEN ' This paper has been withdrawn. '
                 WHEN toxic = 1 THEN ' Withdrawn: ' ELSE ' withdrawn ' END || text AS abstract
           FROM documents LEFT JOIN labels USING (doc_id)) WHERE NOT ({_WITHDRAWN_SQL})""")
def filter_withdrawn(spark, sf):
    start = (
        F.when(F.col("quality") == 0, " This paper has been withdrawn. ")
        .when(F.col("toxic") == 1, " Withdrawn: ")
        .otherwise(" withdrawn ")
    )
    labelled = views.load(spark, sf, "documents").join(views.load(spark, sf, "labels"), "doc_id", "left")
    return ingest.filter_withdrawn(
        labelled.select("doc_id", F.concat(start, F.col("text")).alias("abstract"))
    )


@query("SELECT id FROM cleaned WHERE length(abstract) > 63", "cleaned")
def filter_short(spark, sf):
    return ingest.filter_short(_cleaned(spark, sf)).select("id")


@query("SELECT id FROM trimmed WHERE length(abstract) <= 1024", "trimmed")
def filter_untrimmable(spark, sf):
    return ingest.filter_untrimmable(ingest.trim(_cleaned(spark, sf))).select("id")


@query("""SELECT count(*) AS total, count(*) FILTER (stage = 'imported') AS imported, count(*) FILTER (stage = 'withdrawn') AS withdrawn,
                 count(*) FILTER (stage = 'short') AS short, count(*) FILTER (stage = 'untrimmable') AS untrimmable FROM stages""", "stages")
def import_report(spark, sf):
    return ingest.import_report(_stages(spark, sf))


@query("""SELECT id AS source_id, year(creation_date)::INT AS creation_year, month(creation_date)::INT AS creation_month, title, abstract,
                 abstract_length, update_date, str_split(categories, ' ')[1] AS primary_category
          FROM stages WHERE stage = 'imported'""", "stages")
def imported_papers(spark, sf):
    papers = ingest.imported_papers(_stages(spark, sf))
    return papers.withColumn("primary_category", F.get("categories", F.lit(0))).drop("categories")


@query(f"SELECT o_orderkey AS id, trim(replace(' `*' || o_orderpriority || '.&quot;*? ', '&quot;', ''), ' ''`\"*.?') AS label FROM orders")
def clean_label(spark, sf):
    raw = F.concat(F.lit(" `*"), "o_orderpriority", F.lit(".&quot;*? "))
    return views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.clean_label(raw).alias("label"))


@query("""SELECT vec_id, i, round(x, 9) AS x FROM (
            SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE
                   / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS x FROM embeddings)""")
def normalize_vector(spark, sf):
    unit = scalars.normalize_vector(F.col("embedding"))
    return views.load(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).alias("i"), F.round("x", 9).alias("x")
    )


@query("""SELECT vec_id, (i - 1) // 32 AS word, CAST(sum(CASE WHEN x > 0 THEN 1 << (31 - (i - 1) % 32) ELSE 0 END) AS BIGINT) AS bits
          FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL""")
def quantize_bits(spark, sf):
    packed = scalars.quantize_bits(F.col("embedding"))
    return views.load(spark, sf, "embeddings").select("vec_id", F.posexplode(packed).alias("word", "bits"))
