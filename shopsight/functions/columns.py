"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_comma(column: str, kind: str = "double") -> Column:
    """A number written with a decimal comma, as a number."""
    return F.regexp_replace(F.col(column), ",", ".").cast(kind)


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed time in full days; 20:00 to 10:00 the next day is 0, unlike ``datediff``."""
    later, earlier = (F.col(c) if isinstance(c, str) else c for c in (later, earlier))
    return F.extract(F.lit("DAY"), later - earlier)


def mean_of(column: Column | str) -> Column:
    """Average as double sum over count; decimal sums stay exact until the division."""
    return F.sum(column).cast("double") / F.count(column)


def one_value(df: DataFrame, value: Column) -> Column:
    """A one-row result as a scalar subquery: thresholds stay inside the plan, nothing is collected."""
    return df.select(value).scalar()


def joined(items: Column | str) -> Column:
    """An array as comma text."""
    return F.concat_ws(",", F.transform(F.col(items) if isinstance(items, str) else items,
                                        lambda x: x.cast("string")))
