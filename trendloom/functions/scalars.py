"""Column expressions over dates, categories, shares and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def creation_date(versions: Column) -> Column:
    """Date of the first version; null where there is no entry ``v1``."""
    first = F.get(F.filter(versions, lambda v: v["version"] == "v1"), F.lit(0))["created"]
    # the date as written, whatever the time zones of the stamp and the session
    day = F.regexp_extract(first, r"^\s*[A-Za-z]+,\s*(\d{1,2} [A-Za-z]{3} \d{4})\b", 1)
    return F.to_date(F.try_to_timestamp(day, F.lit("d MMM yyyy")))


def publication(year: Column, month: Column) -> Column:
    """First day of the month."""
    return F.make_date(year, month, F.lit(1))


def month_index(day: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return F.year(day) * 12 + F.month(day) - 1


def month_start(index: Column) -> Column:
    return F.make_date(
        F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1)
    )


def share(percent: Column) -> Column:
    return percent / 100


def expand_categories(categories: Column) -> Column:
    """The first three codes of a white-space separated list."""
    return F.slice(F.split(F.btrim(categories), r"\s+"), 1, 3)


def archive_of(category: Column) -> Column:
    return F.substring_index(category, ".", 1)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def normalize_vector(vector: Column) -> Column:
    """The vector scaled to length one; null for a vector without a direction."""
    length = norm(vector)
    # the length goes in as a list: inside the lambda it would be worked out per component
    lengths = F.array_repeat(length, F.size(vector))
    return F.when(length > 0, F.zip_with(vector, lengths, lambda x, n: x.cast("double") / n))


def quantize_bits(vector: Column) -> Column:
    """One bit per component (1 where positive), first component highest, 32 bits per word."""
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(32))
    return F.transform(
        starts,
        lambda start: F.aggregate(
            F.slice(vector, start, 32),
            F.lit(0).cast("bigint"),
            lambda word, x: word * 2 + F.when(x > 0, F.lit(1)).otherwise(F.lit(0)),
        ),
    )


def hamming(left: Column, right: Column) -> Column:
    """Number of bits in which two packed vectors differ."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
