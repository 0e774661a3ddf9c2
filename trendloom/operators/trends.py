"""Trend lines, slopes and rising or falling rankings of monthly series.

A series (one id) has one row per month, so a window per id stays small however large the data
behind it. All windows share the partitioning by id: one shuffle serves filling, trend and slope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators.ranking import first_per_group

PERIOD = 12  # fixed value: months of a season
HALF = PERIOD // 2
SLOPE_MONTHS = 6  # fixed value: months over which a slope is taken
RANGE_START = "2014-05-01"  # fixed value: first month shown by default


def _series() -> WindowSpec:
    return Window.partitionBy("id")


def _in_order() -> WindowSpec:
    return _series().orderBy("month_no")


def fill_months(series: DataFrame) -> DataFrame:
    """A row for every month from the first to the last of each id; added months hold 0.

    Each row brings the missing months up to its successor along, so there is no join with a
    calendar. Adds ``month_no`` (months since year 0) and ``real`` (false for added months).
    """
    numbered = series.withColumn("month_no", scalars.month_index(F.col("publication")))
    following = F.lead("month_no").over(_in_order())
    last = F.coalesce(following - 1, F.col("month_no"))
    spread = numbered.withColumn("_last", last).withColumn(
        "_month", F.explode(F.sequence("month_no", "_last"))
    )
    real = F.col("_month") == F.col("month_no")
    zeroed = {
        c: F.when(real, F.col(c)).otherwise(F.lit(0).cast(series.schema[c].dataType))
        for c in ("paper_count", "total_percent", "parent_percent")
        if c in series.columns
    }
    return (
        spread.withColumns({**zeroed, "real": real})
        .withColumn("publication", scalars.month_start(F.col("_month")))
        .withColumn("month_no", F.col("_month"))
        .drop("_last", "_month")
    )


def trend(value: Column) -> Column:
    """Additive-decomposition trend of a gapless monthly series, not below 0.

    A centred moving average over a season; its missing ends follow the least-squares line
    through the nearest twelve points. Needs ``_i`` (0-based month) and ``_n`` (months); null for
    series shorter than two seasons.
    """
    number = value.cast("double")
    early = F.sum(number).over(_in_order().rowsBetween(-HALF, HALF - 1))
    late = F.sum(number).over(_in_order().rowsBetween(-HALF + 1, HALF))
    return (early + late) / (2 * PERIOD)


def with_trend(filled: DataFrame, value: str, name: str) -> DataFrame:
    i, n = F.col("_i"), F.col("_n")
    back = n - 1 - HALF  # last month with a moving average
    placed = filled.withColumns(
        {
            "_i": (F.row_number().over(_in_order()) - 1).cast("double"),
            "_n": F.count("*").over(_series()).cast("double"),
        }
    ).withColumn("_ma", F.when((i >= HALF) & (i <= back), trend(F.col(value))))
    front_fit = F.when((i >= HALF) & (i < F.least(F.lit(HALF + PERIOD), back)), F.col("_ma"))
    back_fit = F.when((i >= F.greatest(F.lit(HALF), back - PERIOD)) & (i < back), F.col("_ma"))
    lines = placed.withColumns({"_y0": front_fit, "_y1": back_fit})
    front = F.regr_slope("_y0", "_i").over(_series()) * i + F.regr_intercept("_y0", "_i").over(_series())
    rear = F.regr_slope("_y1", "_i").over(_series()) * i + F.regr_intercept("_y1", "_i").over(_series())
    line = F.when(i < HALF, front).when(i > back, rear).otherwise(F.col("_ma"))
    return lines.withColumn(
        name, F.when(n >= 2 * PERIOD, F.greatest(line, F.lit(0.0)))
    ).drop("_i", "_n", "_ma", "_y0", "_y1")


def trend_percent(filled: DataFrame) -> DataFrame:
    return with_trend(filled, "total_percent", "trend_percent")


def trend_count(filled: DataFrame) -> DataFrame:
    """Trend of the counts, rounded half to even.

    Digits beyond the ninth are dropped first: they are the noise of the fitted lines.
    """
    raw = with_trend(filled, "paper_count", "trend_count")
    return raw.withColumn("trend_count", F.bround(F.round("trend_count", 9), 0))


def with_slope(trended: DataFrame, trend_column: str, name: str, months: int = SLOPE_MONTHS) -> DataFrame:
    """Change of a trend from the first to the last month of a rolling span."""
    before = F.lag(trend_column, months - 1).over(_in_order())
    return trended.withColumn(name, F.col(trend_column) - before)


def drop_filled(trended: DataFrame) -> DataFrame:
    return trended.filter("real").drop("real", "month_no")


def calculate_trends(series: DataFrame, slope_months: int = SLOPE_MONTHS) -> DataFrame:
    """Fill, trend and slope of counts and shares; added months leave only at the end."""
    trended = trend_percent(trend_count(fill_months(series)))
    sloped = with_slope(
        with_slope(trended, "trend_count", "slope_count", slope_months),
        "trend_percent", "slope_percent", slope_months,
    )
    return drop_filled(sloped)


def date_range(series: DataFrame, start: str = RANGE_START, end: str | None = None) -> DataFrame:
    """Rows published from ``start`` to ``end``, both included; open-ended without ``end``."""
    kept = series.filter(F.col("publication") >= F.lit(start).cast("date"))
    return kept if end is None else kept.filter(F.col("publication") <= F.lit(end).cast("date"))


def rolling_last(series: DataFrame, months: int = 3) -> DataFrame:
    return first_per_group(series, ["id"], [F.desc("publication")], months)


def _ranked(
    series: DataFrame, slope: str, n: int, start: str, end: str | None, rising: bool
) -> DataFrame:
    last = rolling_last(date_range(series, start, end))
    best = F.max(slope) if rising else F.min(slope)
    ranked = last.groupBy("id").agg(best.alias("slope")).filter(F.col("slope").isNotNull())
    order = F.desc("slope") if rising else F.asc("slope")
    return ranked.orderBy(order, F.asc("id")).limit(n)


def rising(
    series: DataFrame, slope: str = "slope_percent", n: int = 20,
    start: str = RANGE_START, end: str | None = None,
) -> DataFrame:
    """(id, slope) of the ``n`` ids with the largest slope in the last three months of a range."""
    return _ranked(series, slope, n, start, end, True)


def falling(
    series: DataFrame, slope: str = "slope_percent", n: int = 20,
    start: str = RANGE_START, end: str | None = None,
) -> DataFrame:
    """(id, slope) of the ``n`` ids with the smallest slope in the last three months of a range."""
    return _ranked(series, slope, n, start, end, False)


def current_view(series: DataFrame, ranked: DataFrame) -> DataFrame:
    """The whole series of the ranked ids."""
    return series.join(ranked, "id", "left_semi")
