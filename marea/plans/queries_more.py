"""Queries on the remaining joins, selectors and helpers of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators import chains, drivers, filters, rationale, series
from marea.plans import views as V
from marea.plans.registry import query
from marea.plans.queries_core import TOPICS, R, driver_sql, rounded, topic_weeks
from marea.plans.queries_linking import ENRICHED, RANK, _enriched
from marea.sources import ingest

E = ENRICHED


@query("o_a15_context_scan", "SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def o_a15(spark, d):
    n = V.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("service_origin"))
    c = V.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return filters.in_context(c, service_origin=" 2 ").select("c_custkey", "c_mktsegment")


@query("o_a03_incident_source", "SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '2-HIGH'")
def o_a03(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("incident_id"), F.lit("C").alias("company"), F.col("o_orderpriority").alias("N1"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("CreatedDate"))
    return ingest.incidents(o, "C", "2-HIGH").df.select("incident_id", F.col("Fecha").cast("date").alias("day"))


@query("o_b02_standardised_columns", "SELECT r_regionkey, r_name FROM region")
def o_b02(spark, d):
    return filters.standardise(V.table(spark, d, "region").withColumnRenamed("r_name", " r_name ")).select("r_regionkey", "r_name")


@query("o_c07_journey_links", f"{E} SELECT CASE WHEN lever < 'M' THEN 'j1' ELSE 'j2' END AS journey_id, count(*) AS n FROM e GROUP BY 1")
def o_c07(spark, d):
    e = _enriched(spark, d)
    j = e.select("incident_id", "comment_id", F.when(F.col("lever") < "M", "j1").otherwise("j2").alias("journey_id"))
    return chains.remap_by_pair(e, j).groupBy("journey_id").agg(F.count(F.lit(1)).alias("n"))


@query("o_c09_hypothesis_joins", f"{V.FULL}, {RANK} SELECT topic, {R('score', 'score')}, least(weeks, 3) AS best_lag, {R('least(1.0, score * 1.15)', 'confidence_learned')} FROM k")
def o_c09(spark, d):
    rank = rationale.causal_rank(topic_weeks(spark, d))
    lags = rank.select("topic", F.least("weeks", F.lit(3)).alias("best_lag"))
    log = rank.select("topic", F.lit("confirmed").alias("outcome"))
    return rounded(rationale.hypotheses(rank, rationale.learned_factors(log), lags).select("topic", "score", "best_lag", "confidence_learned"))


@query("o_c16_map_lookup", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def o_c16(spark, d):
    r = V.table(spark, d, "region")
    return series.attach(V.table(spark, d, "nation"), F.broadcast(r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), ["n_regionkey"]).select("n_nationkey", "r_name")


@query("o_c17_daily_attach", f"{V.BASE}, {V.INCIDENTS}, r AS (SELECT day, count(*) AS n FROM responses GROUP BY 1), i AS (SELECT day, count(*) AS incidents FROM incidents GROUP BY 1) SELECT day, n, incidents FROM r LEFT JOIN i USING (day)")
def o_c17(spark, d):
    r = V.responses(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return series.attach(r, V.incidents(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("incidents")), ["day"])


@query("o_c18_links_rationale", f"{V.FULL}, {V.LINKS}, {TOPICS}, t AS (SELECT topic, CAST(sum(responses) AS BIGINT) AS responses FROM s GROUP BY 1) SELECT lever, count(*) AS n, max(responses) AS responses FROM links LEFT JOIN t ON t.topic = lever GROUP BY lever")
def o_c18(spark, d):
    t = topic_weeks(spark, d).groupBy("topic").agg(F.sum("responses").alias("responses")).withColumnRenamed("topic", "lever")
    return series.attach(V.links(spark, d), t, ["lever"]).groupBy("lever").agg(F.count(F.lit(1)).alias("n"), F.max("responses").alias("responses"))


@query("o_f01_driver_sort", f"{V.BASE}, o AS (SELECT 100.0 * (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) / count(score) AS overall FROM responses), x AS (SELECT value, n, nps - overall AS gap FROM ({driver_sql('sublever')}), o) SELECT value, row_number() OVER (ORDER BY gap DESC, n DESC, value) AS place FROM x")
def o_f01(spark, d):
    t = drivers.driver_table(V.responses(spark, d), "sublever")
    return drivers.numbered(t, F.desc("gap_vs_overall"), F.desc("n"), "value", name="place").select("value", F.col("place").cast("long").alias("place"))


@query("o_f08_journey_table", f"{E}, c AS (SELECT sublever AS entity, count(*) AS linked_pairs, avg(score) AS m FROM e GROUP BY 1) SELECT entity, linked_pairs, {R('m', 'avg_nps')} FROM c ORDER BY linked_pairs DESC, m, entity LIMIT 6")
def o_f08(spark, d):
    return rounded(drivers.head(chains.entity_summary(_enriched(spark, d)).select("entity", "linked_pairs", "avg_nps"), F.desc("linked_pairs"), "avg_nps", "entity", n=6))
