"""Places of rows in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the order column that one task ranks.
SPAN = 1 << 20


def ranked(rows: DataFrame, by: list[str], order: str, name: str = "place", span: int = SPAN) -> DataFrame:
    """rows with their place from 1 within `by`, in the order of a column of whole numbers; null comes first.

    Places are counted in spans of the order's values and added up over the spans, one row a span, so that a group as
    large as the table is ranked by many tasks.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{k}") for k, c in enumerate(by)]
    known = [F.col(c).isNull().alias(f"_null{k}") for k, c in enumerate(by)]
    names = [f"_{k}" for k in range(len(by))] + [f"_null{k}" for k in range(len(by))]
    r = rows.select("*", *key, *known, F.coalesce(F.floor(F.col(order) / span).cast("long"), F.lit(-(1 << 62))).alias("_span"))
    n = r.groupBy(*names, "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*names).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    n = n.select(*names, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*names, "_span").orderBy(order))
    return r.withColumn("_in", inside).join(n, [*names, "_span"]).withColumn(name, F.col("_in") + F.col("_before")).select(*rows.columns, name)


def ahead(rows: DataFrame, by: str, order: str, columns: list[str], steps: int = 1, span: int = SPAN) -> DataFrame:
    """columns, and those of the row `steps` places on in its group as next_<column>; null at the end."""
    r = ranked(rows.select(F.col(by).alias("_by"), F.col(order).alias("_order"), *columns), ["_by"], "_order", "_place", span)
    after = r.select(F.col("_by").alias("_g"), (F.col("_place") - steps).alias("_p"), *(F.col(c).alias(f"next_{c}") for c in columns))
    joined = r.join(after, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_place") == F.col("_p")), "left")
    return joined.select(*columns, *(f"next_{c}" for c in columns))
