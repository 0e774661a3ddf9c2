"""Queries over monthly counts, shares, trends and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import stats, trends
from trendloom.plans import views
from trendloom.plans.registry import query, view
from trendloom.session import settle

view("month_totals", """
SELECT creation_year AS year, creation_month AS month, count(*) AS total FROM paper GROUP BY 1, 2""", "paper")

view("category_stats", """
SELECT category_id, creation_year AS year, creation_month AS month, count(*) AS paper_count,
       count(*) * 100 / CAST(min(total) AS DOUBLE) AS total_percent
FROM paper_categories JOIN paper p ON p.id = paper_id
JOIN month_totals m ON m.year = creation_year AND m.month = creation_month GROUP BY 1, 2, 3""",
     "paper", "paper_categories", "month_totals")

view("topic_stats", """
SELECT topic_id, p.creation_year AS year, p.creation_month AS month, v.transformed, count(*) AS paper_count,
       count(*) * 100 / CAST(min(total) AS DOUBLE) AS total_percent
FROM paper_topics pt JOIN paper p ON p.id = paper_id
JOIN month_totals m ON m.year = p.creation_year AND m.month = p.creation_month
JOIN (VALUES (1), (2)) v(transformed) ON v.transformed = 2 OR pt.transformed < 2 GROUP BY 1, 2, 3, 4""",
     "paper", "paper_topics", "month_totals")

view("topic_peaks", """
SELECT topic_id, max(total_percent) AS peak FROM topic_stats s JOIN topic t ON t.id = topic_id AND t.hierarchy = 0
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""", "topic_stats", "topic")

view("series", """
SELECT t.id, t.llm_label AS label, make_date(s.year, s.month, 1) AS publication, s.paper_count,
       s.total_percent / 100 AS total_percent
FROM topic_stats s JOIN topic t ON t.id = s.topic_id
WHERE t.orig_id <> -1 AND s.transformed = 1 AND s.topic_id IN (SELECT topic_id FROM topic_peaks)""",
     "topic_stats", "topic", "topic_peaks")

view("filled", """
SELECT g.id, g.m AS month_no, coalesce(s.paper_count, 0) AS paper_count, coalesce(s.total_percent, 0.0) AS total_percent,
       s.id IS NOT NULL AS real
FROM (SELECT id, unnest(range(min(year(publication) * 12 + month(publication) - 1),
                              max(year(publication) * 12 + month(publication) - 1) + 1)) AS m FROM series GROUP BY id) g
LEFT JOIN series s ON s.id = g.id AND year(s.publication) * 12 + month(s.publication) - 1 = g.m""", "series")

view("averaged", """
SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY id) AS n,
       (sum(paper_count) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
        + sum(paper_count) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24.0::DOUBLE AS ma_c,
       (sum(total_percent) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
        + sum(total_percent) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24.0::DOUBLE AS ma_p
FROM filled WINDOW w AS (PARTITION BY id ORDER BY month_no)""", "filled")

view("fits", """
SELECT id, regr_slope(ma_c, i) FILTER (front) AS fcs, regr_intercept(ma_c, i) FILTER (front) AS fci,
       regr_slope(ma_c, i) FILTER (back) AS bcs, regr_intercept(ma_c, i) FILTER (back) AS bci,
       regr_slope(ma_p, i) FILTER (front) AS fps, regr_intercept(ma_p, i) FILTER (front) AS fpi,
       regr_slope(ma_p, i) FILTER (back) AS bps, regr_intercept(ma_p, i) FILTER (back) AS bpi
FROM (SELECT *, i >= 6 AND i < least(18, n - 7) AS front, i >= greatest(6, n - 19) AND i < n - 7 AS back FROM averaged)
GROUP BY id""", "averaged")

view("trended", """
SELECT a.id, month_no, real,
       CASE WHEN n >= 24 THEN round_even(round(greatest(CASE WHEN i < 6 THEN fcs * i + fci WHEN i > n - 7 THEN bcs * i + bci ELSE ma_c END, 0), 9), 0) END AS trend_count,
       CASE WHEN n >= 24 THEN greatest(CASE WHEN i < 6 THEN fps * i + fpi WHEN i > n - 7 THEN bps * i + bpi ELSE ma_p END, 0) END AS trend_percent
FROM averaged a JOIN fits f ON f.id = a.id""", "averaged", "fits")

view("sloped", """
SELECT *, trend_count - lag(trend_count, 5) OVER w AS slope_count,
       trend_percent - lag(trend_percent, 5) OVER w AS slope_percent
FROM trended WINDOW w AS (PARTITION BY id ORDER BY month_no)""", "trended")

view("last_three", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY month_no DESC) AS rn FROM sloped
               WHERE real AND month_no BETWEEN 1996 * 12 + 4 AND 2001 * 12 + 5) WHERE rn <= 3""", "sloped")

# the months the driver's papers span
START, END = "1996-05-01", "2001-06-01"


def _category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_stats(views.paper(spark, sf), views.paper_categories(spark, sf))


def _topic_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.topic_stats(views.paper(spark, sf), views.paper_topics(spark, sf))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    # a stored table in use: read for the peaks and for the series
    monthly = settle(_topic_stats(spark, sf))
    return stats.topic_stats_by_month(monthly, views.bare_topic(spark, sf))


def _trends(spark: SparkSession, sf: str) -> DataFrame:
    return trends.calculate_trends(_series(spark, sf))


@query("SELECT id, creation_year, creation_month, CAST(strftime(make_date(creation_year, creation_month, 1), '%Y-%m-%d') AS DATE) AS publication FROM paper", "paper")
def publication(spark, sf):
    day = scalars.publication(F.col("creation_year"), F.col("creation_month"))
    return views.paper(spark, sf).select("id", "creation_year", "creation_month", day.alias("publication"))


@query("SELECT year, month, total FROM month_totals", "month_totals")
def month_totals(spark, sf):
    return stats.month_totals(views.paper(spark, sf))


@query("""SELECT category_id, year, month, paper_count, round(total_percent, 9) AS total_percent, 0.0::DOUBLE AS parent_percent
          FROM category_stats""", "category_stats")
def category_stats(spark, sf):
    return _category_stats(spark, sf).withColumn("total_percent", F.round("total_percent", 9))


@query("""SELECT topic_id, year, month, transformed, paper_count, round(total_percent, 9) AS total_percent,
                 CAST(NULL AS DOUBLE) AS parent_percent FROM topic_stats""", "topic_stats")
def topic_stats(spark, sf):
    return _topic_stats(spark, sf).withColumn("total_percent", F.round("total_percent", 9))


@query("""SELECT label, year, month, paper_count, round(paper_count * 100 / CAST(total AS DOUBLE), 9) AS total_percent
          FROM (SELECT o_orderpriority AS label, year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS paper_count
                FROM orders GROUP BY ALL) JOIN month_totals USING (year, month)""", "month_totals")
def month_share(spark, sf):
    papers = views.paper(spark, sf)
    orders = views.load(spark, sf, "orders")
    counts = orders.groupBy(
        F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.count("*").alias("paper_count"))
    shares = stats.month_share(counts, stats.month_totals(papers))
    return shares.withColumn("total_percent", F.round("total_percent", 9))


@query("""SELECT category_id, year, month, round(total_percent / 100, 9) AS total_share FROM category_stats""", "category_stats")
def share(spark, sf):
    part = F.round(scalars.share(F.col("total_percent")), 9).alias("total_share")
    return _category_stats(spark, sf).select("category_id", "year", "month", part)


@query("""SELECT c.id, c.archive AS parent, c.name AS label, make_date(year, month, 1) AS publication, s.paper_count,
                 round(total_percent / 100, 9) AS total_percent, 0.0::DOUBLE AS parent_percent
          FROM category_stats s JOIN category c ON c.id = s.category_id ORDER BY c.name, publication""",
       "category_stats category")
def category_stats_by_month(spark, sf):
    rows = stats.category_stats_by_month(_category_stats(spark, sf), views.bare_category(spark, sf))
    return rows.withColumn("total_percent", F.round("total_percent", 9))


@query("SELECT topic_id, round(peak, 9) AS peak FROM (SELECT * FROM topic_peaks ORDER BY peak DESC, topic_id LIMIT 20)",
       "topic_peaks")
def top_topics_by_peak(spark, sf):
    top = stats.top_topics_by_peak(_topic_stats(spark, sf), views.bare_topic(spark, sf), 0, 20)
    return top.withColumn("peak", F.round("peak", 9))


@query("SELECT id, label, publication, paper_count, round(total_percent, 9) AS total_percent FROM series", "series")
def topic_stats_by_month(spark, sf):
    return _series(spark, sf).select(
        "id", "label", "publication", "paper_count", F.round("total_percent", 9).alias("total_percent")
    )


_REP_TOPIC = """SELECT topic_id, p.creation_year AS year, p.creation_month AS month, p.id, p.source_id, p.title, round(probability, 9) AS probability,
       row_number() OVER (PARTITION BY topic_id, p.creation_year, p.creation_month ORDER BY probability DESC, p.id) AS rn
       FROM paper p JOIN paper_topics pt ON pt.paper_id = p.id WHERE transformed = 0 AND title NOT ILIKE '%(formula)%'"""


@query(f"SELECT topic_id, year, month, id, source_id, title, probability FROM ({_REP_TOPIC}) WHERE rn <= 6", "paper paper_topics")
def representative_papers_by_topic(spark, sf):
    rows = stats.representative_papers_by_topic(views.paper(spark, sf), views.paper_topics(spark, sf))
    return rows.withColumn("probability", F.round("probability", 9))


@query(f"SELECT id, source_id, title, probability FROM ({_REP_TOPIC}) WHERE rn <= 6 AND topic_id = 5 AND year = 1999 AND month = 3",
       "paper paper_topics")
def representative_papers_topic(spark, sf):
    rows = stats.representative_papers_topic(views.paper(spark, sf), views.paper_topics(spark, sf), 5, 1999, 3)
    return rows.withColumn("probability", F.round("probability", 9))


_REP_CATEGORY = """SELECT category_id, p.creation_year AS year, p.creation_month AS month, p.id, p.source_id, p.title,
       row_number() OVER (PARTITION BY category_id, p.creation_year, p.creation_month ORDER BY p.id) AS rn
       FROM paper p JOIN paper_categories pc ON pc.paper_id = p.id WHERE title NOT ILIKE '%(formula)%'"""


@query(f"SELECT category_id, year, month, id, source_id, title FROM ({_REP_CATEGORY}) WHERE rn <= 6", "paper paper_categories")
def representative_papers_by_category(spark, sf):
    return stats.representative_papers_by_category(views.paper(spark, sf), views.paper_categories(spark, sf))


@query(f"SELECT id, source_id, title FROM ({_REP_CATEGORY}) WHERE rn <= 6 AND category_id = 690702 AND year = 1999 AND month = 3",
       "paper paper_categories")
def representative_papers_category(spark, sf):
    return stats.representative_papers_category(
        views.paper(spark, sf), views.paper_categories(spark, sf), 690702, 1999, 3
    )


@query("""SELECT id, make_date(CAST(month_no // 12 AS INT), CAST(month_no % 12 + 1 AS INT), 1) AS publication, paper_count,
                 round(total_percent, 9) AS total_percent, real FROM filled""", "filled")
def fill_months(spark, sf):
    filled = trends.fill_months(_series(spark, sf))
    return filled.select("id", "publication", "paper_count", F.round("total_percent", 9).alias("total_percent"), "real")


@query("SELECT id, CAST(month_no AS INT) AS month_no, trend_count FROM trended", "trended")
def trend_count(spark, sf):
    return trends.trend_count(trends.fill_months(_series(spark, sf))).select("id", "month_no", "trend_count")


@query("SELECT id, CAST(month_no AS INT) AS month_no, round(trend_percent, 9) AS trend_percent FROM trended", "trended")
def trend_percent(spark, sf):
    trended = trends.trend_percent(trends.fill_months(_series(spark, sf)))
    return trended.select("id", "month_no", F.round("trend_percent", 9).alias("trend_percent"))


@query("SELECT id, CAST(month_no AS INT) AS month_no, slope_count FROM sloped", "sloped")
def slope_count(spark, sf):
    trended = trends.trend_count(trends.fill_months(_series(spark, sf)))
    return trends.with_slope(trended, "trend_count", "slope_count").select("id", "month_no", "slope_count")


@query("SELECT id, CAST(month_no AS INT) AS month_no, round(slope_percent, 9) AS slope_percent FROM sloped", "sloped")
def slope_percent(spark, sf):
    trended = trends.trend_percent(trends.fill_months(_series(spark, sf)))
    sloped = trends.with_slope(trended, "trend_percent", "slope_percent")
    return sloped.select("id", "month_no", F.round("slope_percent", 9).alias("slope_percent"))


@query("""SELECT id, make_date(CAST(month_no // 12 AS INT), CAST(month_no % 12 + 1 AS INT), 1) AS publication, trend_count,
                 round(trend_percent, 9) AS trend_percent, slope_count, round(slope_percent, 9) AS slope_percent
          FROM sloped WHERE real""", "sloped")
def drop_filled(spark, sf):
    return _trends(spark, sf).select(
        "id", "publication", "trend_count", F.round("trend_percent", 9).alias("trend_percent"),
        "slope_count", F.round("slope_percent", 9).alias("slope_percent"),
    )


@query(f"""SELECT id, publication, paper_count FROM series WHERE publication BETWEEN '{START}' AND '{END}'""", "series")
def date_range(spark, sf):
    return trends.date_range(_series(spark, sf), START, END).select("id", "publication", "paper_count")


@query("""SELECT id, make_date(CAST(month_no // 12 AS INT), CAST(month_no % 12 + 1 AS INT), 1) AS publication,
                 round(slope_percent, 9) AS slope_percent FROM last_three""", "last_three")
def rolling_last(spark, sf):
    last = trends.rolling_last(trends.date_range(_trends(spark, sf), START, END))
    return last.select("id", "publication", F.round("slope_percent", 9).alias("slope_percent"))


@query("""SELECT id, round(max(slope_percent), 9) AS slope FROM last_three GROUP BY id
          HAVING max(slope_percent) IS NOT NULL ORDER BY max(slope_percent) DESC, id LIMIT 20""", "last_three")
def rising(spark, sf):
    return trends.rising(_trends(spark, sf), start=START, end=END).withColumn("slope", F.round("slope", 9))


@query("""SELECT id, round(min(slope_percent), 9) AS slope FROM last_three GROUP BY id
          HAVING min(slope_percent) IS NOT NULL ORDER BY min(slope_percent), id LIMIT 20""", "last_three")
def falling(spark, sf):
    return trends.falling(_trends(spark, sf), start=START, end=END).withColumn("slope", F.round("slope", 9))


@query("""SELECT id, make_date(CAST(month_no // 12 AS INT), CAST(month_no % 12 + 1 AS INT), 1) AS publication, trend_count
          FROM sloped WHERE real AND id IN (SELECT id FROM last_three GROUP BY id HAVING max(slope_count) IS NOT NULL
                                            ORDER BY max(slope_count) DESC, id LIMIT 5)""", "sloped last_three")
def current_view(spark, sf):
    series = _trends(spark, sf)
    top = trends.rising(series, "slope_count", 5, START, END)
    return trends.current_view(series, top).select("id", "publication", "trend_count")


view("category_series", """
SELECT category_id AS id, year * 12 + month - 1 AS m, total_percent / 100 AS p FROM category_stats""", "category_stats")

view("averages", """
SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY id) AS n,
       (sum(p) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + sum(p) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24.0::DOUBLE AS ma
FROM (SELECT g.id, g.m, coalesce(s.p, 0.0) AS p, s.id IS NOT NULL AS r
      FROM (SELECT id, unnest(range(min(m), max(m) + 1)) AS m FROM category_series GROUP BY id) g
      LEFT JOIN category_series s ON s.id = g.id AND s.m = g.m)
WINDOW w AS (PARTITION BY id ORDER BY m)""", "category_series")


@query("""SELECT id, round(max(slope), 9) AS slope FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY m DESC) AS rn FROM (
              SELECT id, m, r, t - lag(t, 5) OVER (PARTITION BY id ORDER BY m) AS slope FROM (
                SELECT a.id, m, r, CASE WHEN n >= 24 THEN greatest(CASE WHEN i < 6 THEN fs * i + fi WHEN i > n - 7 THEN bs * i + bi ELSE ma END, 0) END AS t
                FROM averages a JOIN (
                  SELECT id, regr_slope(ma, i) FILTER (i >= 6 AND i < least(18, n - 7)) AS fs, regr_intercept(ma, i) FILTER (i >= 6 AND i < least(18, n - 7)) AS fi,
                         regr_slope(ma, i) FILTER (i >= greatest(6, n - 19) AND i < n - 7) AS bs, regr_intercept(ma, i) FILTER (i >= greatest(6, n - 19) AND i < n - 7) AS bi
                  FROM averages GROUP BY id) f ON f.id = a.id))
            WHERE r AND m BETWEEN 1996 * 12 + 4 AND 2001 * 12 + 5) WHERE rn <= 3
          GROUP BY id HAVING max(slope) IS NOT NULL ORDER BY max(slope) DESC, id LIMIT 20""",
       "averages")
def rising_categories(spark, sf):
    series = stats.category_stats_by_month(_category_stats(spark, sf), views.bare_category(spark, sf))
    ranked = trends.rising(trends.calculate_trends(series), start=START, end=END)
    return ranked.withColumn("slope", F.round("slope", 9))
