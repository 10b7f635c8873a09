"""Canonical views over the star-schema tables, for queries that need survey responses and incidents.

responses: line items with a score from their quantity, lever and sublever from their part, channel from the return
flag; incidents: urgent orders; assignments: an incident's topic is the lever of its first line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marea.functions import scores as S


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def responses(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """All responses; of (order_id, and any columns): those of its orders, which are met before the parts are."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("lever"), F.col("p_brand").alias("sublever"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("ts"), (F.col("l_quantity").cast("long") % 11).cast("double").alias("score"), F.col("l_returnflag").alias("channel"), F.col("l_discount").alias("discount"))
    lines = lines if of is None else lines.join(of, "order_id")
    out = lines.join(part, F.col("part_id") == F.col("p_partkey")).drop("p_partkey")
    return out.withColumn("label", S.band_label(F.col("score"))).withColumn("topic", F.col("lever")).withColumn("day", F.col("ts").cast("date"))


def incidents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderdate").cast("date").alias("day"), "o_custkey")


def assignments(spark: SparkSession, d: str) -> DataFrame:
    lines = responses(spark, d, incidents(spark, d).select(F.col("incident_id").alias("order_id")))
    return lines.groupBy(F.col("order_id").alias("incident_id")).agg(F.min(F.struct("line_no", "part_id", "lever"))["lever"].alias("topic"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an incident and the responses of its order: a similarity from the discount; one row a pair."""
    rows = responses(spark, d, incidents(spark, d).select(F.col("incident_id").alias("order_id"), F.col("day").alias("incident_day")))
    w = Window.partitionBy("order_id", "line_no").orderBy("part_id", "day", "score", "discount")
    one = rows.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return one.select(F.col("order_id").alias("incident_id"), (F.col("order_id") * 100 + F.col("line_no")).alias("comment_id"), F.round(0.5 + F.col("discount") * 4, 4).alias("similarity"), "lever", "sublever", "score", F.col("day").alias("comment_day"), "incident_day", F.concat(F.lit("Priority "), F.col("channel")).alias("service_n2"), F.concat(F.col("lever"), F.lit(" > "), F.col("sublever")).alias("topic"))


RESPONSES = """responses AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day,
 CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(CAST(l_quantity AS BIGINT) % 11 AS DOUBLE) AS score, l_returnflag AS channel, l_discount AS discount, p_type AS lever, p_brand AS sublever
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
INCIDENTS = "incidents AS (SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderdate AS ts FROM orders WHERE o_orderpriority = '1-URGENT')"
ASSIGNMENTS = "assignments AS (SELECT incident_id, lever AS topic FROM (SELECT incident_id, lever, row_number() OVER (PARTITION BY incident_id ORDER BY line_no, part_id, lever) AS r FROM incidents JOIN responses ON order_id = incident_id) WHERE r = 1)"
LINKS = """links AS (SELECT order_id AS incident_id, order_id * 100 + line_no AS comment_id, round(0.5 + discount * 4, 4) AS similarity, lever, sublever, score, day AS comment_day, incident_day, 'Priority ' || channel AS service_n2, lever || ' > ' || sublever AS topic
 FROM (SELECT r.*, i.day AS incident_day, row_number() OVER (PARTITION BY order_id, line_no ORDER BY part_id, r.day, score, discount) AS rn FROM responses r JOIN incidents i ON order_id = incident_id) WHERE rn = 1)"""
BASE = f"WITH {RESPONSES}"
FULL = f"WITH {RESPONSES}, {INCIDENTS}, {ASSIGNMENTS}"
CHAIN = f"WITH {RESPONSES}, {INCIDENTS}, {LINKS}"
EVENTS = "events_ AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS channel, CAST(CAST(trunc(value) AS BIGINT) % 11 AS DOUBLE) AS score, value, props FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"), "user_id", F.col("event_type").alias("channel"), (F.col("value").cast("long") % 11).cast("double").alias("score"), "value", "props")


def comments(spark: SparkSession, d: str) -> DataFrame:
    """Documents as comments, dated by their id."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("comment_id"), F.expr("date_add(date'2026-01-01', cast(doc_id % 60 as int))").alias("ts"), F.col("lang").alias("topic"), "text")


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as incidents, dated by their id."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("incident_id"), F.expr("date_add(date'2026-01-01', cast(item_id % 60 as int))").alias("ts"), "text")
