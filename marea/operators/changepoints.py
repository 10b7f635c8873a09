"""Changepoints of topic series: penalised least squares, and how stable they are under a moving-block bootstrap."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.functions import scores as S

SCHEMA = "topic string, changepoint date, level_before double, level_after double"
STABILITY = "topic string, changepoint date, stability double, confidence string, max_stability double, max_confidence string"


def breaks(x: np.ndarray, penalty: float, least: int = 2, jump: int = 5) -> list[int]:
    """Ends of all segments but the last, of the split with the least squared error and a penalty for each segment.

    Candidate ends are multiples of `jump`; a segment has `least` points. Ends that can't be best any more are pruned.
    """
    n = len(x)
    s, q = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best, last = {0: 0.0}, {}
    open_ = [0]
    for end in [*(i for i in range(jump, n, jump) if i >= least), n]:
        totals = [(best[a] + cost(a, end) + penalty, a) for a in open_ if end - a >= least]
        if not totals:
            continue
        best[end], last[end] = min(totals)
        keep = {a for t, a in totals if t <= best[end] + penalty} | {a for a in open_ if end - a < least}
        open_ = [*sorted(keep), end]
    out, at = [], n
    while at in last and last[at] > 0:
        at = last[at]
        out.append(at)
    return out[::-1]


def _series(pdf: pd.DataFrame):
    pdf = pdf.dropna(subset=["value"]).sort_values("bucket")
    return pdf["bucket"].to_numpy(), pdf["value"].to_numpy(dtype=float)


def changepoints(series: DataFrame, value: str = "focus_rate", penalty: float = 6.0, least_points: int = 10, scale: float = 1.0, topic: str = "topic", order: str = "bucket") -> DataFrame:
    """Per topic the last bucket before each break, with the mean on both sides. Short series have none.

    scale: what values are multiplied by before the penalty, 100 for rates in points. One group is one topic's series.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dates, x = _series(pdf)
        at = breaks(x * scale, penalty) if len(x) >= least_points else []
        ends = [0, *at, len(x)]
        rows = [(pdf["topic"].iloc[0], dates[b - 1], x[a:b].mean(), x[b:c].mean()) for a, b, c in zip(ends, ends[1:], ends[2:])]
        return pd.DataFrame(rows, columns=["topic", "changepoint", "level_before", "level_after"])

    rows = series.select(F.col(topic).alias("topic"), F.col(order).alias("bucket"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("topic").applyInPandas(run, SCHEMA)


def stable_changepoints(series: DataFrame, value: str = "focus_rate", penalty: float = 6.0, draws: int = 200, block: int = 2, near: int = 1, least_points: int = 10, scale: float = 1.0, topic: str = "topic", order: str = "bucket", seed: int = 7, disjoint: bool = False) -> DataFrame:
    """Each changepoint with the share of resampled series that break within `near` points of it: High from .70, Medium from
    .40; and the topic's largest share, with its level.

    A resampled series is made of `block` points in a row of the series, from places drawn evenly, until it is as long;
    draws depend on the topic and the seed only. disjoint: the places are multiples of `block` and as many blocks are
    drawn as there are; a draw that is shorter than `least_points` counts without breaks.
    """

    def level(share: float) -> str:
        return "High" if share >= 0.70 else "Medium" if share >= 0.40 else "Low"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dates, x = _series(pdf)
        n = len(x)
        at = breaks(x * scale, penalty) if n >= least_points else []
        rows = []
        if at:
            r = np.random.default_rng([seed, zlib.crc32(str(pdf["topic"].iloc[0]).encode())])
            # so many blocks that even those cut off at the end suffice
            blocks = -(-n // block)
            starts = block * r.integers(0, blocks, (draws, blocks)) if disjoint else r.integers(0, max(1, n - block), (draws, n))
            hits = np.zeros(len(at))
            for own in starts:
                places = (own[:, None] + np.arange(block)).ravel()
                places = places[places < n][:n]
                again = breaks(x[places] * scale, penalty) if not disjoint or len(places) >= least_points else []
                hits += [any(abs(a - b) <= near for b in again) for a in at]
            shares = hits / draws
            rows = [(pdf["topic"].iloc[0], dates[a - 1], float(h), level(h), float(shares.max()), level(shares.max())) for a, h in zip(at, shares)]
        return pd.DataFrame(rows, columns=["topic", "changepoint", "stability", "confidence", "max_stability", "max_confidence"])

    rows = series.select(F.col(topic).alias("topic"), F.col(order).alias("bucket"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("topic").applyInPandas(run, STABILITY)


def topic_stability(series: DataFrame, topic: str = "topic", **options) -> DataFrame:
    """A row each topic of the series: its changepoints in order, max_cp_stability and max_cp_level; a topic without any has
    none, no stability and an empty level. options: those of stable_changepoints()."""
    found = stable_changepoints(series, topic=topic, **options)
    per = found.groupBy("topic").agg(F.array_sort(F.collect_list("changepoint")).alias("changepoints"), F.first("max_stability").alias("max_cp_stability"), F.first("max_confidence").alias("max_cp_level"))
    none = F.expr("cast(array() as array<date>)")
    return series.select(F.col(topic).alias("topic")).distinct().join(per, "topic", "left").select(F.col("topic").alias(topic), F.coalesce("changepoints", none).alias("changepoints"), "max_cp_stability", F.coalesce("max_cp_level", F.lit("")).alias("max_cp_level"))


def dimension_series(responses: DataFrame, dimensions: list[str], ts: str = "ts", score: str = "score", grain: str = "day") -> DataFrame:
    """dimension, value, bucket and nps: the classic score of each bucket that has known scores, for each value of each
    dimension and (value *) for all rows, in one pass. Null values are left out."""
    x = S.number(F.col(score))
    sides = F.array(F.struct(F.lit("*").alias("dimension"), F.lit("*").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    rows = responses.filter(F.col(ts).isNotNull()).select(F.date_trunc(grain, F.col(ts)).cast("date").alias("bucket"), x.alias("score"), F.inline(sides))
    return rows.filter("value is not null").groupBy("dimension", "value", "bucket").agg(S.classic(F.col("score")).alias("nps")).filter("nps is not null")


def dimension_changepoints(responses: DataFrame, dimensions: list[str], ts: str = "ts", score: str = "score", grain: str = "day", penalty: float = 8.0, draws: int = 200, block: int = 5, least_points: int = 12, seed: int = 7) -> DataFrame:
    """dimension, value, changepoint, stability and confidence of the breaks in each value's series of the classic score.

    All series of all dimensions are one grouped pass, a group a series; stability comes from disjoint blocks. Series of
    under `least_points` buckets have none.
    """
    series = dimension_series(responses, dimensions, ts, score, grain)
    named = series.withColumn("topic", F.to_json(F.struct("dimension", "value")))
    found = stable_changepoints(named, "nps", penalty, draws, block, 1, least_points, seed=seed, disjoint=True)
    part = lambda c: F.get_json_object("topic", f"$.{c}").alias(c)
    return found.select(part("dimension"), part("value"), "changepoint", "stability", "confidence")
