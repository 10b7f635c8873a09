"""Score KPIs, daily metrics and period comparisons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.functions import scores as S


def summary_columns(score: Column) -> list[Column]:
    """Aggregates of the known scores: n, mean, three rates (0 without scores) and the classic score."""
    zero = lambda c: F.coalesce(S.share(c, score), F.lit(0.0))
    return [F.count(score).alias("n"), F.avg(score).alias("nps_avg"), zero(S.promoter(score)).alias("promoter_rate"), zero(S.passive(score)).alias("passive_rate"), zero(S.detractor(score)).alias("detractor_rate"), F.coalesce(S.classic(score), F.lit(0.0)).alias("nps_classic")]


def score_summary(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*summary_columns(S.number(F.col(score))))


def score_kpis(df: DataFrame, score: str = "score", comment: str | None = None, by: list[str] | None = None) -> DataFrame:
    """As the summary, but null without scores; comments: useful ones, or all rows with a score without a comment column."""
    x = S.number(F.col(score))
    comments = F.count_if(x.isNotNull() & S.useful(F.col(comment))) if comment else F.count(x)
    return df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean_score"), S.classic(x).alias("nps_classic"), S.share(S.detractor(x), x).alias("detractor_rate"), S.share(S.promoter(x), x).alias("promoter_rate"), comments.alias("comments"))


def daily_metrics(df: DataFrame, ts: str = "ts", score: str = "score", lookback: int | None = None) -> DataFrame:
    """Per day: n, rates, mean, percentages and classic score of the scores clipped to 0..10."""
    from marea.operators.filters import last_days

    x = S.number(F.col(score))
    rows = df.select(F.col(ts).cast("date").alias("date"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)).alias("s")).filter(x.isNotNull() & F.col("date").isNotNull())
    rows = rows.filter("s is not null")
    if lookback:
        rows = last_days(rows, lookback, "date")
    s = F.col("s")
    out = rows.groupBy("date").agg(F.count(s).alias("n"), S.rate(S.promoter(s)).alias("promoter_rate"), S.rate(S.passive(s)).alias("passive_rate"), S.rate(S.detractor(s)).alias("detractor_rate"), F.avg(s).alias("nps_mean"))
    pct = {f"{k}_pct": 100 * F.col(f"{k}_rate") for k in ("promoter", "passive", "detractor")}
    return out.withColumns(pct).withColumn("nps_classic", (F.col("promoter_rate") - F.col("detractor_rate")) * 100)


def volume_mix(daily: DataFrame) -> DataFrame:
    """Rows a day in each band."""
    return daily.select("date", "n", *((F.col("n") * F.col(f"{k}_pct") / 100).alias(f"{k}_n") for k in ("promoter", "passive", "detractor")))


def focus_rates(df: DataFrame, grain: str = "day", ts: str = "ts", score: str = "score", label: str = "label") -> DataFrame:
    """Per day or Monday week: all responses (without score too) and the shares of the groups by label or score."""
    bucket = F.col(ts).cast("date") if grain == "day" else F.date_trunc("week", F.col(ts)).cast("date")
    x = S.number(F.col(score))
    rates = [S.rate(S.focus(F.col(label), x, g)).alias(f"{g}_rate") for g in ("promoter", "passive", "detractor")]
    return df.filter(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("responses"), *rates)


def compact_index(df: DataFrame) -> DataFrame:
    """Per day, lever and channel: n, mean, rates over all rows, classic score."""
    x = S.number(F.col("score"))
    out = df.groupBy(F.col("ts").cast("date").alias("event_day"), "lever", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("nps_avg"), S.rate(S.promoter(x)).alias("promoter_rate"), S.rate(S.detractor(x)).alias("detractor_rate"))
    return out.withColumn("nps_classic", (F.col("promoter_rate") - F.col("detractor_rate")) * 100)


def period_trend(df: DataFrame, grain: str = "week", ts: str = "ts", score: str = "score") -> DataFrame:
    x = S.number(F.col(score))
    return df.groupBy(F.date_trunc(grain, F.col(ts)).cast("date").alias("period")).agg(F.count(x).alias("n"), F.avg(x).alias("mean_score")).filter("n > 0")


def resample_classic(df: DataFrame, grain: str = "week", ts: str = "ts", score: str = "score") -> DataFrame:
    x = S.number(F.col(score))
    return df.groupBy(F.date_trunc(grain, F.col(ts)).cast("date").alias("bucket")).agg(S.classic(x).alias("nps_classic")).filter("nps_classic is not null")


def score_ladder(df: DataFrame, ts: str = "ts", score: str = "score") -> DataFrame:
    """Per day the number of each score 0..10, rounded half to even; all eleven columns always there."""
    s = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(S.number(F.col(score)), 0).cast("int")))
    counts = [F.count_if(s == i).alias(f"s{i}") for i in range(11)]
    return df.filter(S.number(F.col(score)).isNotNull()).groupBy(F.col(ts).cast("date").alias("date")).agg(*counts)


def _block(score: Column, comment: Column | None, when: Column) -> list[Column]:
    x = F.when(when, score)
    comments = F.count_if(when & score.isNotNull() & (S.useful(comment) if comment is not None else F.lit(True)))
    return [F.count(x), F.avg(x), S.classic(x), S.share(S.detractor(x), x), S.share(S.promoter(x), x), comments]


def delta(now: Column, then: Column) -> Column:
    """Difference, 0 where it is too small to tell."""
    d = now - then
    return F.when(F.abs(d) < 1e-9, F.lit(0.0)).otherwise(d)


def direction(d: Column) -> Column:
    return F.when(d.isNull() | (d == 0), "flat").when(d > 0, "up").otherwise("down")


def favourable(metric: str, d: Column) -> Column:
    """A falling detractor rate and anything else rising is good; comments are neither."""
    return F.lit(None).cast("boolean") if metric == "comments" else d < 0 if metric == "detractor_rate" else d > 0


def period_kpis(df: DataFrame, start: dt.date, end: dt.date, comment: str | None = None, ts: str = "ts", score: str = "score") -> DataFrame:
    """One pass: rows `history` (before), `period`, `cumulative` (up to the end), with the period's deltas to the history."""
    x, day = S.number(F.col(score)), F.col(ts).cast("date")
    says = F.col(comment) if comment else None
    names = ["n", "mean_score", "nps_classic", "detractor_rate", "promoter_rate", "comments"]
    blocks = {"history": day < F.lit(start), "period": day.between(F.lit(start), F.lit(end)), "cumulative": day <= F.lit(end)}
    wide = df.agg(*(F.struct(*(v.alias(k) for k, v in zip(names, _block(x, says, F.coalesce(w, F.lit(False))), strict=True))).alias(b) for b, w in blocks.items()))
    rows = [F.struct(F.lit(b).alias("block"), *(F.col(f"{b}.{k}").alias(k) for k in names), *(delta(F.col(f"period.{k}").cast("double"), F.col(f"history.{k}").cast("double")).alias(f"{k}_delta") if b == "period" else F.lit(None).cast("double").alias(f"{k}_delta") for k in ("mean_score", "nps_classic", "detractor_rate"))) for b in blocks]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def boundary_kpis(df: DataFrame, ts: str = "ts", score: str = "score") -> DataFrame:
    """KPIs of the first and the last day."""
    from marea.operators.filters import boundary_days

    return score_kpis(boundary_days(df, ts), score, by=["boundary"])


def compare(current: DataFrame, baseline: DataFrame, score: str = "score") -> DataFrame:
    """Mean score, detractor rate and n of two frames, and their differences."""
    x = S.number(F.col(score))
    side = lambda df, p: df.agg(F.count(x).alias(f"n_{p}"), F.avg(x).alias(f"mean_{p}"), S.share(S.detractor(x), x).alias(f"detractor_rate_{p}"))
    return side(current, "current").crossJoin(side(baseline, "baseline")).withColumn("mean_delta", F.col("mean_current") - F.col("mean_baseline")).withColumn("detractor_rate_delta", F.col("detractor_rate_current") - F.col("detractor_rate_baseline"))


def executive_summary(df: DataFrame, lever: str = "lever", score: str = "score") -> DataFrame:
    """n, mean, rates, and the levers of the lowest and the highest mean (ties: the first by name)."""
    x = S.number(F.col(score))
    levers = df.groupBy(F.col(lever).alias("v")).agg(F.avg(x).alias("m")).filter("m is not null and v is not null")
    ends = levers.agg(F.min(F.struct("m", "v"))["v"].alias("worst_lever"), F.min(F.struct(-F.col("m"), F.col("v")))["v"].alias("best_lever"))
    return score_summary(df, score).crossJoin(ends)


def platform_snapshot(df: DataFrame, score: str = "score") -> DataFrame:
    x = S.number(F.col(score))
    return df.agg(F.count(x).alias("n"), S.classic(x).alias("nps"), S.share(S.detractor(x), x).alias("detractor_rate"), S.share(S.promoter(x), x).alias("promoter_rate"))


def mean_focus_rate(series: DataFrame, column: str = "focus_rate") -> DataFrame:
    """Mean of the periods' rates, those filled with 0 too."""
    return series.agg(F.avg(column).alias("focus_rate_avg"))
