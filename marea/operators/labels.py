"""Joins of labels and ranks onto days, groups and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators.chains import confidence_label, impact_label


def dated_assignments(assignments: DataFrame, incidents: DataFrame, day: str = "day") -> DataFrame:
    """Assignments with the day of their incident, matched by the id as text; an unknown incident leaves it null."""
    dates = incidents.select(F.trim(F.col("incident_id").cast("string")).alias("_id"), day).dropDuplicates(["_id"])
    return assignments.withColumn("_id", F.trim(F.col("incident_id").cast("string"))).join(dates, "_id", "left").drop("_id")


def ranked_days(timeline: DataFrame, ranks: DataFrame, top: int = 3) -> DataFrame:
    """day, rank_1 to rank_`top` and rest: each day's incidents by the lowest rank that (day, incident) has; none: rest.

    timeline: day and incident_ids, an array; ranks: day, incident_id, rank. An id that a day lists twice counts once.
    """
    each = timeline.select("day", F.explode(F.array_distinct("incident_ids")).alias("incident_id")).distinct()
    best = ranks.groupBy("day", "incident_id").agg(F.min("rank").alias("rank"))
    met = each.join(best, ["day", "incident_id"], "left").withColumn("slot", F.when(F.col("rank") <= top, F.concat(F.lit("rank_"), F.col("rank").cast("string"))).otherwise("rest"))
    return met.groupBy("day").pivot("slot", [*(f"rank_{i}" for i in range(1, top + 1)), "rest"]).agg(F.count(F.lit(1))).fillna(0)


def with_totals(matrix: DataFrame, by: str, n: str = "n") -> DataFrame:
    """A group matrix with the total of each row's group and its share of it."""
    totals = matrix.groupBy(by).agg(F.sum(n).alias("total"))
    return matrix.join(totals, by).withColumn("share", F.try_divide(F.col(n).cast("double"), F.col("total")))


def broken_journey_table(pairs: DataFrame, cohesion: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A row each cluster of linked pairs: its dominant labels that are not generic, distinct counts, means, impact and
    confidence, label and id. cohesion: cluster and semantic_cohesion (unknown: 0). Equal ids get -2, -3, ..."""
    label = lambda c: F.coalesce(F.mode(F.when(~X.generic(F.col(c)), X.text(F.col(c))), True), F.lit("")).alias(c)
    per = pairs.groupBy(cluster).agg(
        label("lever"), label("sublever"), F.count_distinct("incident_id", "comment_id").alias("linked_pairs"), F.count_distinct("incident_id").alias("linked_incidents"),
        F.count_distinct("comment_id").alias("linked_comments"), F.avg("similarity").alias("avg_similarity"), F.avg("score").alias("avg_nps"),
    )
    out = per.join(cohesion, cluster, "left").fillna(0.0, ["semantic_cohesion"])
    out = out.withColumn("impact_label", impact_label(F.col("linked_pairs"), F.col("avg_nps"))).withColumn("confidence_label", confidence_label(F.col("semantic_cohesion"), F.col("avg_similarity")))
    out = out.withColumn("journey_label", F.concat_ws(" / ", F.nullif("lever", F.lit("")), F.nullif("sublever", F.lit(""))))
    return _unique(out.withColumn("_slug", X.slug(F.col("journey_label"))), "_slug", F.desc("linked_pairs"), cluster).drop("_slug")


def _unique(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("journey_id", F.when(r == 1, F.col(key)).otherwise(F.concat_ws("-", key, r.cast("string"))))
