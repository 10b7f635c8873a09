"""Hot terms that incidents and comments share, their evidence and their days."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators.drivers import driver_table
from marea.operators.filters import month_or_latest
from marea.operators.linking import match_labels
from marea.session import settle, small


def severity(score: Column) -> Column:
    return F.when(score <= 2, "critical").when(score <= 4, "high").otherwise("moderate")


def term_rows(docs: DataFrame, id_: str, text: str, *keep: str) -> DataFrame:
    """One row a document and distinct token."""
    return docs.select(F.col(id_).alias("id"), *keep, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("term"))


def mentions(docs: DataFrame, id_: str, text: str, terms: DataFrame, *keep: str) -> DataFrame:
    """term_rows() of the given terms alone, each once in `terms`; other words are dropped before they are looked at."""
    return docs.select(F.col(id_).alias("id"), *keep, F.explode(X.words(F.col(text))).alias("term")).join(small(terms.filter(X.wanted(F.col("term")))), "term")


#: Terms by incidents that stand in where none has enough of them.
FALLBACK = 20


def hot_terms(incidents: DataFrame, comments: DataFrame, min_occurrences: int = 3, most: int = 3, taxonomy: DataFrame | None = None, month: dt.date | None = None) -> DataFrame:
    """Terms by product of incident and comment frequency, one of each stem, those that comments mention first.

    incidents: incident_id, text (and ts for a month: else the latest that has any); comments: comment_id, text. Terms of
    too few incidents are left out; where all are, the FALLBACK most frequent stand in. taxonomy (text: labels of the
    business): terms that it has go alone, unless it has none of them.
    """
    held = month_or_latest(incidents, month) if month else incidents
    inc = settle(term_rows(held, "incident_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("incidents")))
    enough = inc.filter(F.col("incidents") >= min_occurrences)
    if enough.isEmpty():
        enough = inc.orderBy(F.desc("incidents"), "term").limit(FALLBACK)
    if taxonomy is not None:
        known = enough.join(taxonomy.select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct(), "term", "left_semi")
        enough = enough if known.isEmpty() else known
    enough = settle(enough)
    com = mentions(comments, "comment_id", "text", enough.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("mentions"))
    both = enough.join(com, "term", "left").fillna(0, ["mentions"])
    order = [F.desc(F.col("mentions") > 0), F.desc(F.col("incidents") * F.greatest("mentions", F.lit(1))), F.desc("mentions"), F.desc("incidents"), "term"]
    one = both.withColumn("_k", F.row_number().over(Window.partitionBy(X.stem(F.col("term"))).orderBy(*order))).filter("_k = 1").drop("_k")
    return one.orderBy(*order).limit(most).withColumn("hot_rank", F.row_number().over(Window.orderBy(*order)))


def evidence(terms: DataFrame, incidents: DataFrame, comments: DataFrame | None, links: DataFrame, examples: int = 3) -> DataFrame:
    """Per hot term the incidents and comments that mention it, the linked ones, the main topic and examples.

    Without comments they are not searched, and there is no mention_comments.
    """
    t = settle(terms.select("term", "hot_rank"))
    inc = mentions(incidents, "incident_id", "text", t)
    counts = inc.groupBy("term", "hot_rank").agg(F.count_distinct("id").alias("mention_incidents"))
    if comments is not None:
        com = mentions(comments, "comment_id", "text", t)
        counts = counts.join(com.groupBy("term").agg(F.count_distinct("id").alias("mention_comments")), "term", "left").fillna(0, ["mention_comments"])
    linked = inc.select("term", F.col("id").alias("incident_id")).join(links, "incident_id")
    per = linked.groupBy("term").agg(F.count_distinct("incident_id").alias("linked_incidents"), F.count_distinct("comment_id").alias("linked_comments"))
    topics = linked.groupBy("term", "topic").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic"))["topic"].alias("main_topic"))
    best = linked.groupBy("term", "incident_id").agg(F.max("similarity").alias("s"))
    w = Window.partitionBy("term").orderBy(F.desc("s"), "incident_id")
    shown = best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= examples).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "incident_id"))), lambda x: x["incident_id"]).alias("examples"))
    return counts.join(per, "term", "left").join(topics, "term", "left").join(shown, "term", "left").fillna(0, ["linked_incidents", "linked_comments"])


def records(incidents: DataFrame, comments: DataFrame) -> DataFrame:
    """Both sides as one table: side, id, day and text."""
    one = incidents.select(F.lit("incident").alias("side"), F.col("incident_id").cast("string").alias("id"), "day", "text")
    return one.unionByName(comments.select(F.lit("comment").alias("side"), F.col("comment_id").cast("string").alias("id"), "day", "text"))


def timeline(terms: DataFrame, incidents: DataFrame, comments: DataFrame) -> DataFrame:
    """Per term and day incidents and comments that mention it, comments by severity; terms that only one side has are out."""
    t = settle(terms.select("term"))  # read for either side
    inc = mentions(incidents, "incident_id", "text", t, "day").groupBy("term", "day").agg(F.count_distinct("id").alias("incident_records"))
    com = mentions(comments, "comment_id", "text", t, "day", "score").withColumn("severity", severity(F.col("score")))
    per = com.groupBy("term", "day").agg(F.count_distinct("id").alias("comments"), *(F.count_if(F.col("severity") == s).alias(f"{s}_comments") for s in ("critical", "high", "moderate")))
    both = inc.join(per, ["term", "day"], "full").fillna(0)
    w = Window.partitionBy("term")
    return both.withColumn("_a", F.sum("incident_records").over(w)).withColumn("_b", F.sum("comments").over(w)).filter("_a > 0 and _b > 0").drop("_a", "_b")


def summary(evidence_: DataFrame, timeline_: DataFrame) -> DataFrame:
    per = timeline_.groupBy("term").agg(F.sum("incident_records").alias("chart_incidents"), F.sum("comments").alias("chart_comments"), F.count_distinct("day").alias("days"))
    return evidence_.join(per, "term", "left").fillna(0, ["chart_incidents", "chart_comments", "days"])


def daily_breakdown(daily: DataFrame, ranked: DataFrame) -> DataFrame:
    """Incidents a day split by the rank of their hot term (1 to 3) and the rest, never below 0.

    daily: day, incidents; ranked: day, incident_id, hot_rank (several of an incident: the lowest rank counts).
    """
    one = ranked.groupBy("day", "incident_id").agg(F.min("hot_rank").alias("hot_rank"))
    wide = one.groupBy("day").pivot("hot_rank", [1, 2, 3]).agg(F.count(F.lit(1))).withColumnsRenamed({str(i): f"hotspot_{i}" for i in (1, 2, 3)})
    out = daily.join(wide, "day", "left").fillna(0, [f"hotspot_{i}" for i in (1, 2, 3)])
    return out.withColumn("no_hotspot", F.greatest(F.lit(0), F.col("incidents") - F.col("hotspot_1") - F.col("hotspot_2") - F.col("hotspot_3")))


#: Responses that a label needs to count as red.
RED_LEAST = 200


def red_labels(responses: DataFrame, dimension: str, min_n: int = RED_LEAST) -> DataFrame:
    """label and position of the values below the overall score that enough responses have; the largest gap first."""
    red = driver_table(responses.filter(F.col(dimension).isNotNull()), dimension).filter((F.col("gap_vs_overall") < 0) & (F.col("n") >= min_n))
    return red.select(F.col("value").alias("label"), F.row_number().over(Window.orderBy("gap_vs_overall", "value")).cast("long").alias("position"))


def label_hits(incidents: DataFrame, responses: DataFrame, axes: tuple[str, ...] = ("lever", "sublever"), min_n: int = RED_LEAST, least: float = 0.60) -> DataFrame:
    """axis, label, position and hits: the incidents whose text fits each red label of either axis best; 0 where none does."""
    parts = []
    for axis in axes:
        labels = settle(red_labels(responses, axis, min_n))
        hits = match_labels(incidents, "incident_id", "text", labels, least).groupBy("label").agg(F.count(F.lit(1)).alias("hits"))
        parts.append(labels.join(hits, "label", "left").fillna(0, ["hits"]).select(F.lit(axis).alias("axis"), "label", "position", "hits"))
    return reduce(DataFrame.unionByName, parts)


def best_axis(hits: DataFrame, incidents: DataFrame, axes: tuple[str, ...] = ("lever", "sublever")) -> DataFrame:
    """Share of incidents that the red labels of each axis match (label_hits); the largest wins, equals: the first axis."""
    n = incidents.agg(F.count(F.lit(1)).alias("n"))
    all_axes = hits.sparkSession.createDataFrame([(a, i) for i, a in enumerate(axes)], "axis string, place int")
    matched = hits.groupBy("axis").agg(F.sum("hits").alias("matched"))
    out = all_axes.join(matched, "axis", "left").fillna(0, ["matched"]).crossJoin(F.broadcast(n)).withColumn("ratio", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("n")), F.lit(0.0)))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("ratio"), "place")) == 1).select("axis", "matched", "ratio", "best")


def align(evidence_: DataFrame, axis_terms: DataFrame, most: int = 3) -> DataFrame:
    """Evidence ranked anew: terms of the axis first, then by linked pairs."""
    flagged = evidence_.join(axis_terms.select("term").distinct().withColumn("aligned", F.lit(1)), "term", "left").fillna(0, ["aligned"])
    order = [F.desc("aligned"), F.desc("linked_comments"), F.desc("mention_incidents"), "term"]
    return flagged.withColumn("hot_rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("hot_rank") <= most)


def overlap_days(timeline_: DataFrame) -> DataFrame:
    """Days on which incidents and comments both speak of hot terms."""
    return timeline_.filter("incident_records > 0 and comments > 0").groupBy("day").agg(F.sum(F.col("incident_records") + F.col("comments")).alias("records"), F.array_join(F.array_sort(F.collect_set("term")), " | ").alias("terms"))
