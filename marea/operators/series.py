"""Weekly and daily topic series, lags, lead shares and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.session import settle


def _bucket(ts: str, grain: str) -> Column:
    return (F.date_trunc("week", F.col(ts)) if grain == "week" else F.col(ts)).cast("date")


def _responses(df: DataFrame, grain: str, focus: str, by: list[str], ts: str) -> DataFrame:
    x = S.number(F.col("score"))
    in_focus = S.focus(F.col("label"), x, focus) if "label" in df.columns else F.coalesce({"promoter": S.promoter, "passive": S.passive, "detractor": S.detractor}[S.group(focus)](x), F.lit(False))
    out = df.groupBy(_bucket(ts, grain).alias("bucket"), *by).agg(F.count(F.lit(1)).alias("responses"), F.count_if(in_focus).alias("focus_count"), F.avg(x).alias("nps_mean"))
    return out.withColumn("focus_rate", F.col("focus_count") / F.col("responses"))


def overall_series(responses: DataFrame, incidents: DataFrame, grain: str = "week", focus: str = "detractor", ts: str = "ts") -> DataFrame:
    """Responses and incidents per bucket, in a full outer join: a bucket of one side only has zeros for the other."""
    i = incidents.groupBy(_bucket(ts, grain).alias("bucket")).agg(F.count(F.lit(1)).alias("incidents"))
    return _responses(responses, grain, focus, [], ts).join(i, "bucket", "full").fillna(0)


def topic_series(responses: DataFrame, incidents: DataFrame, assignments: DataFrame, grain: str = "week", focus: str = "detractor", topic: str = "topic", ts: str = "ts") -> DataFrame:
    """Per bucket and topic the responses, with the incidents assigned to the topic in that bucket (none: 0)."""
    dated = assignments.join(incidents.select("incident_id", ts), "incident_id", "left").filter(F.col(ts).isNotNull())
    i = dated.groupBy(_bucket(ts, grain).alias("bucket"), F.col("topic").alias(topic)).agg(F.count(F.lit(1)).alias("incidents"))
    return _responses(responses, grain, focus, [topic], ts).join(i, ["bucket", topic], "left").fillna(0, ["incidents"])


def shifted(series: DataFrame, column: str, k: int, by: str = "topic", order: str = "bucket") -> DataFrame:
    return series.withColumn(f"{column}_lag{k}", F.lag(column, k).over(Window.partitionBy(by).orderBy(order)))


def best_lag(series: DataFrame, most: int = 6, least_points: int = 8, topic: str = "topic", order: str = "bucket", x: str = "incidents", y: str = "focus_rate") -> DataFrame:
    """Per topic the lag (in rows, 0..most) whose correlation of x with the later y is largest; ties: the smallest lag.

    A lag needs `least_points` pairs; a topic without a lag that has them gets lag 0, no correlation and 0 points.
    """
    w = Window.partitionBy(topic).orderBy(order)
    leads = series.select(topic, F.col(x).cast("double").alias("x"), F.array(*(F.struct(F.lit(k).alias("k"), F.lead(F.col(y).cast("double"), k).over(w).alias("y")) for k in range(most + 1))).alias("leads"))
    pairs = leads.select(topic, "x", F.inline("leads")).filter("x is not null and y is not null")
    per = pairs.groupBy(topic, "k").agg(F.count(F.lit(1)).alias("points"), S.pearson(F.col("x"), F.col("y")).alias("corr")).filter((F.col("points") >= least_points) & F.col("corr").isNotNull())
    best = per.groupBy(topic).agg(F.min(F.struct((-F.round("corr", 9)).alias("c"), "k", "corr", "points")).alias("b")).select(topic, F.col("b.k").alias("best_lag"), F.col("b.corr").alias("corr"), F.col("b.points").alias("points"))
    return series.select(topic).distinct().join(best, topic, "left").withColumn("best_lag", F.coalesce("best_lag", F.lit(0))).withColumn("points", F.coalesce("points", F.lit(0)))


def best_lag_days(series: DataFrame, **options) -> DataFrame:
    return best_lag(series, **({"most": 21, "least_points": 30} | options))


def daily_gate(series: DataFrame, least_days: int = 20, coverage: float = 0.45) -> DataFrame:
    """Whether days with responses are many and dense enough for a daily analysis."""
    out = series.filter("responses > 0").agg(F.countDistinct("bucket").alias("days"), F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    share = F.try_divide(F.col("days").cast("double"), F.datediff("b", "a") + 1)
    return out.select("days", F.coalesce(share, F.lit(0.0)).alias("coverage"), (F.coalesce(share >= coverage, F.lit(False)) & (F.col("days") >= least_days)).alias("daily_ok"))


def lead_share(series: DataFrame, changepoints: DataFrame, weeks: int = 4, topic: str = "topic") -> DataFrame:
    """Share of a topic's changepoints whose incidents peaked in the weeks before, among those with weeks on both sides."""
    cps = changepoints.select(F.col(topic).alias("t"), F.col("changepoint").alias("cp"))
    near = cps.join(series.select(F.col(topic).alias("t"), "bucket", "incidents"), "t").filter((F.col("bucket") >= F.date_sub("cp", 7 * weeks)) & (F.col("bucket") <= F.date_add("cp", 7 * weeks)))
    sides = near.groupBy("t", "cp").agg(F.max(F.when(F.col("bucket") < F.col("cp"), F.col("incidents"))).alias("before"), F.max(F.when(F.col("bucket") > F.col("cp"), F.col("incidents"))).alias("after")).filter("before is not null and after is not null")
    return sides.groupBy(F.col("t").alias(topic)).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("before") >= F.col("after")).cast("double")).alias("lead_share"))


def moving_average(series: DataFrame, column: str, rows: int = 7, by: list[str] | None = None, order: str = "date") -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(1 - rows, 0)
    return series.withColumn(f"{column}_ma{rows}", F.avg(column).over(w))


def fill_days(series: DataFrame, zero: list[str], linear: list[str], day: str = "date", by: list[str] | None = None) -> DataFrame:
    """One row for each day of a series' span: counts filled with 0, measures interpolated and held at the ends (none: 0)."""
    by = by or []
    span = series.groupBy(*by).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    full = span.join(series, [*by, day], "left").fillna(0, zero)
    w = Window.partitionBy(*by).orderBy(day)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = full
    for c in linear:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(day).alias("d"), F.col(c).cast("double").alias("v")))
        a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
        step = F.datediff(F.col(day), a["d"]) / F.datediff(b["d"], a["d"])
        value = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["d"] == b["d"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * step)
        out = out.withColumn(f"_{c}", F.coalesce(value, F.lit(0.0)))
    return out.drop(*linear).withColumnsRenamed({f"_{c}": c for c in linear})


def daily_signals(series: DataFrame) -> DataFrame:
    """Topic days as one series: sums of incidents and responses, rates and means weighted by responses, gaps filled."""
    w = F.col("responses")
    per = series.groupBy(F.col("bucket").alias("date")).agg(F.sum("incidents").alias("incidents"), F.sum(w).alias("responses"), F.try_divide(F.sum(w * F.col("nps_mean")), F.sum(w)).alias("nps_mean"), F.try_divide(F.sum(w * F.col("focus_rate")), F.sum(w)).alias("focus_rate"))
    out = fill_days(per, ["incidents", "responses"], ["nps_mean", "focus_rate"])
    return out.withColumn("nps_mean", S.clip(F.col("nps_mean"), 0.0, 10.0)).withColumn("focus_rate", S.clip(F.col("focus_rate")))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(f"{column}_share", F.try_divide(F.col(column).cast("double"), F.col("_total"))).drop("_total")


def by_maximum(df: DataFrame, column: str) -> DataFrame:
    """A column over its maximum; 0 where that is not positive."""
    top = df.agg(F.max(column).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(f"{column}_norm", F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")


def numbered_globally(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows numbered from 0 in an order over all of them, without bringing them to one task.

    The rows are written in ranges of the order; the counts of the ranges, a row each, give every range its first number.
    Equal keys lie in one range.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_within", within).join(F.broadcast(first.select("_range", "_first")), "_range").withColumn(name, F.col("_first") + F.col("_within") - 1).drop("_range", "_within", "_first")


def evenly(df: DataFrame, most: int, *order: str) -> DataFrame:
    """At most so many rows, evenly spaced over the order: a deterministic down-sample, for charts."""
    at = numbered_globally(df, *order, name="_i").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    slot = F.floor(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    before = F.floor((F.col("_i") - 1) * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return at.filter((F.col("_n") <= most) | (F.col("_i") == 0) | (slot > before)).drop("_i", "_n")


def attach(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Daily measures beside daily measures; missing ones stay null."""
    return left.join(right, on, "left")
