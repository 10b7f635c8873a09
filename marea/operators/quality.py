"""Column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, missing rows and their share, distinct values, least and largest value, all in one pass; and, in a
    pass of its own a column, the smallest few distinct values as examples (none asked for: no such pass)."""
    q = lambda c: F.col(f"`{c}`")
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.struct(F.count_if(q(c).isNull()).alias("missing"), F.count_distinct(q(c)).alias("distinct"), F.min(q(c)).cast("string").alias("low"), F.max(q(c)).cast("string").alias("high")).alias(f"_{i}") for i, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{i}.missing").alias("missing"), F.try_divide(F.col(f"_{i}.missing").cast("double"), F.col("_rows")).alias("missing_share"), F.col(f"_{i}.distinct").alias("distinct"), F.col(f"_{i}.low").alias("low"), F.col(f"_{i}.high").alias("high")) for i, (c, t) in enumerate(df.dtypes)]
    out = one.select(F.inline(F.array(*rows)))
    if not samples:
        return out
    some = reduce(DataFrame.union, (df.filter(q(c).isNotNull()).select(F.lit(c).alias("column"), q(c).alias("k")).distinct().orderBy("k").limit(samples).select("column", F.row_number().over(Window.partitionBy("column").orderBy("k")).alias("i"), F.col("k").cast("string").alias("v")) for c in df.columns))
    listed = some.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("samples"))
    return out.join(listed, "column", "left")
