"""Drivers, opportunities, changes and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X


def driver_stats(df: DataFrame, dimension: str, score: str = "score") -> DataFrame:
    """Per value (null is one): n of all rows, valid_n, detractor and promoter rate and classic score of the known scores."""
    x = S.number(F.col(score))
    return df.groupBy(F.col(dimension).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("valid_n"), S.share(S.detractor(x), x).alias("detractor_rate"), S.share(S.promoter(x), x).alias("promoter_rate"), S.classic(x).alias("nps"))


def driver_table(df: DataFrame, dimension: str, overall: float | None = None, score: str = "score") -> DataFrame:
    """driver_stats with the gap of each value to the overall (or a given) classic score; largest gap first."""
    stats = driver_stats(df, dimension, score)
    base = df.agg(S.classic(S.number(F.col(score))).alias("overall")) if overall is None else df.sparkSession.createDataFrame([(float(overall),)], "overall double")
    return stats.crossJoin(F.broadcast(base)).withColumn("gap_vs_overall", F.col("nps") - F.col("overall")).drop("overall").withColumn("dimension", F.lit(dimension)).orderBy(F.coalesce("gap_vs_overall", F.lit(-1e9)).desc(), F.desc("n"), "value")


def opportunities(df: DataFrame, dimensions: list[str], min_n: int = 200, score: str = "score") -> DataFrame:
    """Values below the overall score with enough rows: uplift 0.6 of the gap, confidence by n; best product first."""
    parts = [driver_table(df, d, score=score).select("dimension", "value", "n", "nps", (-F.col("gap_vs_overall")).alias("gap")) for d in dimensions]
    both = reduce(DataFrame.unionByName, parts).filter((F.col("n") >= min_n) & (F.col("gap") > 0))
    out = both.withColumn("potential_uplift", 0.6 * F.col("gap")).withColumn("confidence", F.least(F.lit(1.0), F.log10(F.greatest(F.col("n"), F.lit(10)).cast("double")) / 5))
    return out.orderBy((F.col("potential_uplift") * F.col("confidence")).desc(), F.desc("n"), "dimension", "value")


def least_rows(total: int, share: float = 0.02, low: int = 20, high: int = 200) -> int:
    return max(low, min(high, int(total * share)))


def label_opportunities(df: DataFrame, dimensions: list[str], canonical: dict[str, str] | None = None, score: str = "score") -> DataFrame:
    """opportunities() over categories in canonical spelling, blank ones left out; enough rows: 2 % of all, 20 to 200."""
    n = df.count()
    clean = df.withColumns({d: X.category(F.col(d), canonical) for d in dimensions})
    parts = [opportunities(clean.filter(F.col(d) != ""), [d], least_rows(n), score) for d in dimensions]
    return reduce(DataFrame.unionByName, parts)


def _means(df: DataFrame, dimension: str, score: str, suffix: str) -> DataFrame:
    x = S.number(F.col(score))
    return df.filter(F.col(dimension).isNotNull() & x.isNotNull()).groupBy(F.col(dimension).alias("value")).agg(F.avg(x).alias(f"nps_{suffix}"), F.count(x).alias(f"n_{suffix}"))


def driver_delta(current: DataFrame, baseline: DataFrame, dimension: str, min_n: int = 30, score: str = "score") -> DataFrame:
    """Change of the mean score per value that has enough rows in both frames; largest loss first."""
    both = _means(current, dimension, score, "current").join(_means(baseline, dimension, score, "baseline"), "value")
    return both.filter((F.col("n_current") >= min_n) & (F.col("n_baseline") >= min_n)).withColumn("delta_nps", F.col("nps_current") - F.col("nps_baseline")).orderBy("delta_nps", F.desc("n_current"), F.desc("n_baseline"), "value")


def historic_changes(current: DataFrame, baseline: DataFrame, dimension: str, min_n: int = 30, top: int = 10) -> DataFrame:
    return driver_delta(current, baseline, dimension, min_n).limit(top)


def driver_change_classic(current: DataFrame, baseline: DataFrame, dimension: str) -> DataFrame:
    """Change of the classic score and of the detractor share, in points, per value of both frames."""
    side = lambda df, p: driver_stats(df, dimension).select("value", F.col("n").alias(f"n_{p}"), F.col("nps").alias(f"nps_{p}"), F.col("detractor_rate").alias(f"det_{p}"))
    both = side(current, "current").join(side(baseline, "baseline"), "value")
    return both.select("value", "n_current", "n_baseline", "nps_current", "nps_baseline", (F.col("nps_current") - F.col("nps_baseline")).alias("delta_nps"), (100 * (F.col("det_current") - F.col("det_baseline"))).alias("delta_detractor_pp"))


def pain_and_strength(df: DataFrame, dimension: str, score: str = "score") -> DataFrame:
    """The values of the lowest and of the highest mean; ties: more rows first."""
    t = _means(df, dimension, score, "all").withColumnsRenamed({"nps_all": "mean_score", "n_all": "n"})
    w = Window.orderBy("mean_score", F.desc("n"), "value")
    ranked = t.withColumn("r", F.row_number().over(w)).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.filter("r = 1 or r = last").select(F.when(F.col("r") == 1, "pain").otherwise("strength").alias("kind"), "value", "mean_score", "n")


def group_matrix(df: DataFrame, dimension: str, top: int = 8, score: str = "score") -> DataFrame:
    """Share of each band in the values with the most detractors."""
    x = S.number(F.col(score))
    per = df.filter(F.col(dimension).isNotNull() & x.isNotNull()).groupBy(F.col(dimension).alias("value")).agg(F.count(x).alias("total"), *(F.count_if(f(x)).alias(k) for k, f in (("detractor", S.detractor), ("passive", S.passive), ("promoter", S.promoter))))
    chosen = per.orderBy(F.desc("detractor"), F.desc("total"), "value").limit(top)
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.col(k).alias("n")) for k in ("detractor", "passive", "promoter")))
    return chosen.select("value", "total", F.inline(bands)).withColumn("share", F.col("n") / F.col("total"))


def gaps(df: DataFrame, dimension: str, top: int = 10) -> DataFrame:
    """The values furthest below the overall score."""
    return driver_table(df, dimension).filter("gap_vs_overall is not null").orderBy("gap_vs_overall", F.desc("n"), "value").limit(top)


def channel_table(df: DataFrame, dimension: str, channel: str = "web", top: int = 8, score: str = "score") -> DataFrame:
    """n, mean and detractor rate per value in one channel; lowest mean first."""
    x = S.number(F.col(score))
    rows = df.filter((F.lower(F.trim("channel")) == channel.lower()) & x.isNotNull())
    return rows.groupBy(F.col(dimension).alias("value")).agg(F.count(x).alias("n"), F.avg(x).alias("mean_score"), S.rate(S.detractor(x)).alias("detractor_rate")).orderBy("mean_score", F.desc("n"), "value").limit(top)


def cohort_matrix(df: DataFrame, row: str, column: str, min_n: int = 30, score: str = "score") -> DataFrame:
    """n and mean score of each cell with enough rows, one row a cell."""
    x = S.number(F.col(score))
    return df.filter(x.isNotNull()).groupBy(F.col(row).alias("row_value"), F.col(column).alias("column_value")).agg(F.count(x).alias("n"), F.avg(x).alias("mean_score")).filter(F.col("n") >= min_n)


def cohort_pivot(df: DataFrame, row: str, column: str, values: list[str], min_n: int = 30) -> DataFrame:
    return cohort_matrix(df, row, column, min_n).groupBy("row_value").pivot("column_value", values).agg(F.first("mean_score"))


def topic_summary(series: DataFrame, topic: str = "topic") -> DataFrame:
    """Per topic: responses, incidents, their share of all, and the mean score weighted by responses."""
    out = series.groupBy(topic).agg(F.sum("responses").alias("responses"), F.sum("incidents").alias("incidents"), F.try_divide(F.sum(F.col("responses") * F.col("nps_mean")), F.sum("responses")).alias("nps_mean"))
    return out.withColumn("share", F.col("responses") / F.sum("responses").over(Window.partitionBy()))


def store_summary(df: DataFrame, dimensions: list[str], top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Totals with the first and last day, and the first drivers of each dimension."""
    x = S.number(F.col("score"))
    totals = df.agg(F.count(F.lit(1)).alias("total_records"), F.min(F.col("ts").cast("date")).alias("min_date"), F.max(F.col("ts").cast("date")).alias("max_date"), S.classic(x).alias("nps"), S.share(S.promoter(x), x).alias("promoter_rate"), S.share(S.detractor(x), x).alias("detractor_rate"))
    w = Window.partitionBy("dimension").orderBy(F.coalesce("gap_vs_overall", F.lit(-1e9)).desc(), F.desc("n"), "value")
    tables = reduce(DataFrame.unionByName, (driver_table(df, d) for d in dimensions))
    return totals, tables.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def head(df: DataFrame, *order: Column | str, n: int) -> DataFrame:
    """The first rows in an order: a top-k without a full sort."""
    return df.orderBy(*order).limit(n)


def numbered(df: DataFrame, *order: Column | str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def suffixed(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Keys made unique: the second and later occurrences get -2, -3, ..."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("unique_key", F.when(r == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), r.cast("string"))))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def routes(df: DataFrame, min_n: int = 150, top: int = 25, score: str = "score") -> DataFrame:
    """Ways of lever, sublever and topic with enough rows, by detractor rate times log of n."""
    x = S.number(F.col(score))
    per = df.groupBy("lever", "sublever", "topic").agg(F.count(F.lit(1)).alias("n"), S.rate(S.detractor(x)).alias("detractor_rate")).filter(F.col("n") >= min_n)
    return per.withColumn("route_score", F.col("detractor_rate") * F.log1p(F.col("n").cast("double"))).orderBy(F.desc("route_score"), F.desc("n"), "lever", "sublever", "topic").limit(top)
