"""De-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key group in a given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def members(df: DataFrame, column: str, values: list | DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose ``column`` is (``negate``: is not) among ``values``: a list, or the one column of a DataFrame (a semi or anti
    join, whatever its size). A null is never among them, and stays if negated."""
    if isinstance(values, DataFrame):
        other = values.select(F.col(values.columns[0]).alias("_value"))
        return df.join(other, F.col(column) == F.col("_value"), "left_anti" if negate else "left_semi")
    hit = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.where(~hit if negate else hit)


def median_rows(df: DataFrame, value: str, keys: list[str], not_null: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Of each key group the row that holds the (approximate, existing) median of ``value``; ties by the columns ``ties``."""
    d = df.dropna(subset=[value, *(not_null or [])])
    medians = d.groupBy(*keys).agg(F.percentile_approx(value, 0.5).alias("_median"))
    on = F.lit(True)
    m = medians.select(*(F.col(k).alias(f"_{k}") for k in keys), "_median")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = d.join(m, on & (F.col(value) == F.col("_median")), "left_semi")
    rest = ties or [c for c in df.columns if c not in keys and c != value]
    return keep_first(d, keys, [F.col(c) for c in rest] or [F.col(value)])
