"""Queries on scores, drivers, periods and series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X
from marea.operators import drivers, filters, kpis, series
from marea.plans import views as V
from marea.plans.registry import query

START, END = dt.date(1996, 1, 1), dt.date(1996, 12, 31)
PRO, PAS, DET = "count(*) FILTER (WHERE score >= 9)", "count(*) FILTER (WHERE score BETWEEN 7 AND 8)", "count(*) FILTER (WHERE score <= 6)"
CLASSIC = f"100.0 * ({PRO} - {DET}) / count(score)"


def rounded(df, *keep):
    """Doubles to six places, so that both engines agree."""
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


R = lambda e, a: f"round({e}, 6) AS {a}"
DRIVER = f"SELECT {{dim}} AS value, count(*) AS n, count(score) AS valid_n, {DET} * 1.0 / count(score) AS detractor_rate, {PRO} * 1.0 / count(score) AS promoter_rate, {CLASSIC} AS nps FROM {{src}} GROUP BY 1"


def driver_sql(dim="lever", src="responses"):
    return DRIVER.format(dim=dim, src=src)


@query("driver_table", f"{V.BASE}, d AS ({driver_sql()}), o AS (SELECT {CLASSIC} AS overall FROM responses) SELECT value, n, valid_n, {R('detractor_rate', 'detractor_rate')}, {R('promoter_rate', 'promoter_rate')}, {R('nps', 'nps')}, {R('nps - overall', 'gap_vs_overall')}, 'lever' AS dimension FROM d, o")
def driver_table(spark, d):
    return rounded(drivers.driver_table(V.responses(spark, d), "lever"))


@query("o_d06_driver_stats", f"{V.BASE}, d AS ({driver_sql('sublever')}) SELECT value, n, valid_n, {R('detractor_rate', 'detractor_rate')}, {R('promoter_rate', 'promoter_rate')}, {R('nps', 'nps')} FROM d")
def o_d06(spark, d):
    return rounded(drivers.driver_stats(V.responses(spark, d), "sublever"))


SUMMARY = f"count(score) AS n, {R('avg(score)', 'nps_avg')}, {R(f'{PRO} * 1.0 / count(score)', 'promoter_rate')}, {R(f'{PAS} * 1.0 / count(score)', 'passive_rate')}, {R(f'{DET} * 1.0 / count(score)', 'detractor_rate')}, {R(CLASSIC, 'nps_classic')}"


@query("o_d01_score_summary", f"{V.BASE} SELECT lever, {SUMMARY} FROM responses GROUP BY lever")
def o_d01(spark, d):
    return rounded(kpis.score_summary(V.responses(spark, d), by=["lever"]))


KPIS = f"count(score) AS n, {R('avg(score)', 'mean_score')}, {R(CLASSIC, 'nps_classic')}, {R(f'{DET} * 1.0 / count(score)', 'detractor_rate')}, {R(f'{PRO} * 1.0 / count(score)', 'promoter_rate')}"


@query("o_d02_score_kpis", f"{V.BASE} SELECT channel, {KPIS}, count(score) AS comments FROM responses GROUP BY channel")
def o_d02(spark, d):
    return rounded(kpis.score_kpis(V.responses(spark, d), by=["channel"]))


@query("o_d03_classic_score", f"{V.BASE} SELECT {R(CLASSIC, 'nps')} FROM responses")
def o_d03(spark, d):
    return rounded(V.responses(spark, d).agg(S.classic(F.col("score")).alias("nps")))


DAILY = f"SELECT day AS date, count(*) AS n, {PRO} * 1.0 / count(*) AS p, {PAS} * 1.0 / count(*) AS q, {DET} * 1.0 / count(*) AS r, avg(score) AS m FROM responses GROUP BY 1"


@query("o_d04_daily_metrics", f"{V.BASE}, x AS ({DAILY}) SELECT date, n, {R('p', 'promoter_rate')}, {R('q', 'passive_rate')}, {R('r', 'detractor_rate')}, {R('m', 'nps_mean')}, {R('100 * p', 'promoter_pct')}, {R('100 * q', 'passive_pct')}, {R('100 * r', 'detractor_pct')}, {R('(p - r) * 100', 'nps_classic')} FROM x")
def o_d04(spark, d):
    return rounded(kpis.daily_metrics(V.responses(spark, d)))


@query("o_b23_lookback", f"{V.BASE}, x AS ({DAILY}) SELECT date, n, {R('m', 'nps_mean')} FROM x WHERE date > (SELECT max(date) - INTERVAL 60 DAY FROM x)")
def o_b23(spark, d):
    return rounded(kpis.daily_metrics(V.responses(spark, d), lookback=60).select("date", "n", "nps_mean"))


@query("o_d05_focus_rates", f"{V.BASE} SELECT week AS bucket, count(*) AS responses, {R(f'{PRO} * 1.0 / count(*)', 'promoter_rate')}, {R(f'{PAS} * 1.0 / count(*)', 'passive_rate')}, {R(f'{DET} * 1.0 / count(*)', 'detractor_rate')} FROM responses GROUP BY 1")
def o_d05(spark, d):
    return rounded(kpis.focus_rates(V.responses(spark, d), "week"))


OPPORTUNITY = f"(SELECT 'lever' AS dimension, value, n, nps, overall - nps AS gap FROM ({driver_sql('lever')}), o UNION ALL SELECT 'sublever', value, n, nps, overall - nps FROM ({driver_sql('sublever')}), o)"


@query("o_d08_opportunities", f"{V.BASE}, o AS (SELECT {CLASSIC} AS overall FROM responses) SELECT dimension, value, n, {R('nps', 'nps')}, {R('gap', 'gap')}, {R('0.6 * gap', 'potential_uplift')}, {R('least(1.0, log10(greatest(n, 10)) / 5)', 'confidence')} FROM {OPPORTUNITY} WHERE n >= 200 AND gap > 0")
def o_d08(spark, d):
    return rounded(drivers.opportunities(V.responses(spark, d), ["lever", "sublever"]))


@query("o_d09_label_opportunities", f"{V.BASE}, o AS (SELECT {CLASSIC} AS overall FROM responses), k AS (SELECT greatest(20, least(200, CAST(floor(count(*) * 0.02) AS BIGINT))) AS least_n FROM responses) SELECT dimension, value, n, {R('nps', 'nps')}, {R('gap', 'gap')}, {R('0.6 * gap', 'potential_uplift')}, {R('least(1.0, log10(greatest(n, 10)) / 5)', 'confidence')} FROM {OPPORTUNITY}, k WHERE n >= least_n AND gap > 0")
def o_d09(spark, d):
    return rounded(drivers.label_opportunities(V.responses(spark, d), ["lever", "sublever"]))


def _two(spark, d):
    r = V.responses(spark, d)
    return r.filter(F.col("day").between(F.lit(START), F.lit(END))), r.filter(F.col("day") < F.lit(START))


TWO = f"{V.BASE}, cur AS (SELECT * FROM responses WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'), base AS (SELECT * FROM responses WHERE day < DATE '1996-01-01')"
DELTA = "SELECT c.value, c.m - b.m AS delta, c.m AS mc, b.m AS mb, c.n AS nc, b.n AS nb FROM (SELECT {dim} AS value, avg(score) AS m, count(*) AS n FROM cur GROUP BY 1) c JOIN (SELECT {dim} AS value, avg(score) AS m, count(*) AS n FROM base GROUP BY 1) b USING (value) WHERE c.n >= 30 AND b.n >= 30"
DELTAS = f"value, {R('mc', 'nps_current')}, nc AS n_current, {R('mb', 'nps_baseline')}, nb AS n_baseline, {R('delta', 'delta_nps')}"


@query("o_d10_driver_delta", f"{TWO}, x AS ({DELTA.format(dim='sublever')}) SELECT {DELTAS} FROM x")
def o_d10(spark, d):
    return rounded(drivers.driver_delta(*_two(spark, d), "sublever"))


@query("o_d11_historic_changes", f"{TWO}, x AS ({DELTA.format(dim='sublever')}) SELECT {DELTAS} FROM x ORDER BY delta, nc DESC, nb DESC, value LIMIT 10")
def o_d11(spark, d):
    return rounded(drivers.historic_changes(*_two(spark, d), "sublever"))


@query("o_d12_driver_change", f"{TWO}, c AS ({driver_sql('lever', 'cur')}), b AS ({driver_sql('lever', 'base')}) SELECT value, c.n AS n_current, b.n AS n_baseline, {R('c.nps', 'nps_current')}, {R('b.nps', 'nps_baseline')}, {R('c.nps - b.nps', 'delta_nps')}, {R('100 * (c.detractor_rate - b.detractor_rate)', 'delta_detractor_pp')} FROM c JOIN b USING (value)")
def o_d12(spark, d):
    return rounded(drivers.driver_change_classic(*_two(spark, d), "lever"))


@query("o_c08_current_baseline_join", f"{TWO}, x AS ({DELTA.format(dim='lever')}) SELECT {DELTAS} FROM x")
def o_c08(spark, d):
    return rounded(drivers.driver_delta(*_two(spark, d), "lever"))


@query("o_d29_period_comparison", f"{TWO}, c AS (SELECT count(*) AS n, avg(score) AS m, {DET} * 1.0 / count(*) AS r FROM cur), b AS (SELECT count(*) AS n, avg(score) AS m, {DET} * 1.0 / count(*) AS r FROM base) SELECT c.n AS n_current, {R('c.m', 'mean_current')}, {R('c.r', 'detractor_rate_current')}, b.n AS n_baseline, {R('b.m', 'mean_baseline')}, {R('b.r', 'detractor_rate_baseline')}, {R('c.m - b.m', 'mean_delta')}, {R('c.r - b.r', 'detractor_rate_delta')} FROM c, b")
def o_d29(spark, d):
    return rounded(kpis.compare(*_two(spark, d)))


BLOCK = f"SELECT '{{b}}' AS block, count(score) AS n, avg(score) AS m, {CLASSIC} AS c, {DET} * 1.0 / count(score) AS r, {PRO} * 1.0 / count(score) AS p FROM responses WHERE {{w}}"
BLOCKS = " UNION ALL ".join(BLOCK.format(b=b, w=w) for b, w in (("history", "day < DATE '1996-01-01'"), ("period", "day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"), ("cumulative", "day <= DATE '1996-12-31'")))


@query("o_d28_period_kpis", f"{V.BASE}, x AS ({BLOCKS}), h AS (SELECT m AS hm, c AS hc, r AS hr FROM x WHERE block = 'history') SELECT block, n, {R('m', 'mean_score')}, {R('c', 'nps_classic')}, {R('r', 'detractor_rate')}, {R('p', 'promoter_rate')}, n AS comments, {R(chr(67) + 'ASE WHEN block = ' + chr(39) + 'period' + chr(39) + ' THEN m - hm END', 'mean_score_delta')}, {R('CASE WHEN block = ' + chr(39) + 'period' + chr(39) + ' THEN c - hc END', 'nps_classic_delta')}, {R('CASE WHEN block = ' + chr(39) + 'period' + chr(39) + ' THEN r - hr END', 'detractor_rate_delta')} FROM x, h")
def o_d28(spark, d):
    return rounded(kpis.period_kpis(V.responses(spark, d), START, END))


@query("o_b19_cumulative_and_history", f"{V.BASE} SELECT lever, count(*) FILTER (WHERE day <= DATE '1996-12-31') AS until_end, count(*) FILTER (WHERE day < DATE '1996-01-01') AS before_start FROM responses GROUP BY lever")
def o_b19(spark, d):
    r = V.responses(spark, d)
    a, b = filters.until(r, END).groupBy("lever").agg(F.count(F.lit(1)).alias("until_end")), filters.before(r, START).groupBy("lever").agg(F.count(F.lit(1)).alias("before_start"))
    return a.join(b, "lever")


@query("o_b20_boundary_days", f"{V.BASE}, e AS (SELECT min(day) AS a, max(day) AS b FROM responses), x AS (SELECT 'first' AS boundary, score FROM responses, e WHERE day = a UNION ALL SELECT 'last', score FROM responses, e WHERE day = b) SELECT boundary, {KPIS}, count(score) AS comments FROM x GROUP BY boundary")
def o_b20(spark, d):
    return rounded(kpis.boundary_kpis(V.responses(spark, d)))


@query("o_b13_period_filter", f"{V.BASE} SELECT lever, count(*) AS n FROM responses WHERE ts >= DATE '1996-03-01' AND ts < DATE '1996-04-01' GROUP BY lever")
def o_b13(spark, d):
    a, b, m = filters.period_bounds(1996, 3)
    return filters.in_period(V.responses(spark, d), a, b, m).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("o_b12_month_of_all_years", f"{V.BASE} SELECT year(ts) AS year, count(*) AS n FROM responses WHERE month(ts) = 3 GROUP BY 1")
def o_b12(spark, d):
    return filters.in_period(V.responses(spark, d), *filters.period_bounds("Todos", 3)).groupBy(F.year("ts").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("o_b14_channel_filter", f"{V.BASE} SELECT lever, count(*) AS n FROM responses WHERE lower(channel) = 'a' GROUP BY lever")
def o_b14(spark, d):
    return filters.in_channel(V.responses(spark, d), " a ").groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("o_b16_focus_mask", f"{V.BASE} SELECT lever, {PRO} AS promoters, {PAS} AS passives, {DET} AS detractors FROM responses GROUP BY lever")
def o_b16(spark, d):
    f = lambda g: F.count_if(S.focus(F.col("label"), F.col("score"), g))
    return V.responses(spark, d).groupBy("lever").agg(f("promoter").alias("promoters"), f("neutral").alias("passives"), f("Detractores").alias("detractors"))


@query("o_b17_group_filter", f"{V.BASE} SELECT channel, count(*) AS n FROM responses WHERE score <= 6 GROUP BY channel")
def o_b17(spark, d):
    return filters.in_group(V.responses(spark, d), "Detractores").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("o_b22_period_split", f"{TWO} SELECT 'current' AS period, count(*) AS n, {R('avg(score)', 'mean_score')} FROM cur UNION ALL SELECT 'baseline', count(*), round(avg(score), 6) FROM base")
def o_b22(spark, d):
    c, b = filters.split_periods(V.responses(spark, d), START, END)
    one = lambda x, n: x.agg(F.lit(n).alias("period"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return rounded(one(c, "current").union(one(b, "baseline")))


@query("o_b21_default_windows", f"{V.BASE}, e AS (SELECT max(day) AS b FROM responses) SELECT CASE WHEN day >= date_trunc('month', b) THEN 'current' ELSE 'baseline' END AS period, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM responses, e GROUP BY 1")
def o_b21(spark, d):
    r = V.responses(spark, d)
    ends = r.agg(F.min("day"), F.max("day")).first()
    w = filters.windows(*ends)
    mark = F.when(F.col("day") >= F.lit(w["current"][0]), "current").otherwise("baseline")
    return r.groupBy(mark.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("o_b24_month_or_latest", f"{V.BASE}, m AS (SELECT max(date_trunc('month', day)) AS c FROM responses) SELECT lever, count(*) AS n FROM responses, m WHERE date_trunc('month', day) = c GROUP BY lever")
def o_b24(spark, d):
    return filters.month_or_latest(V.responses(spark, d), dt.date(2050, 1, 1)).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("o_b27_outliers", "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem, s WHERE abs(l_extendedprice - m) >= 1.7 * sd")
def o_b27(spark, d):
    return filters.outliers(V.table(spark, d, "lineitem"), "l_extendedprice", 1.7).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("o_b29_periods", f"{V.BASE} SELECT year(ts) AS year, list_aggregate(list_sort(list(DISTINCT month(ts))), 'string_agg', ',') AS months FROM responses GROUP BY 1")
def o_b29(spark, d):
    return filters.periods(V.responses(spark, d)).select(F.col("year").cast("long").alias("year"), F.array_join(F.transform("months", lambda m: m.cast("string")), ",").alias("months"))


@query("o_b18_first_filled", "SELECT n_nationkey, coalesce(nullif(trim(n_name), ''), 'x') AS label FROM nation")
def o_b18(spark, d):
    n = V.table(spark, d, "nation").withColumn("blank", F.lit("  "))
    return n.select("n_nationkey", filters.first_filled(n, ["missing", "BLANK", "N_NAME"]).alias("label"))


@query("o_b08_epoch_parser", "SELECT event_id, CAST(ts AS TIMESTAMP) AS s, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ms FROM events")
def o_b08(spark, d):
    e = V.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", filters.epoch(F.col("t").cast("string")).cast("timestamp_ntz").alias("s"), F.date_trunc("second", filters.epoch(F.floor(F.col("t") / 1000).cast("string"))).cast("timestamp_ntz").alias("ms"))


@query("o_b03_context_values", "SELECT r_name AS value FROM region")
def o_b03(spark, d):
    return spark.createDataFrame([(v,) for v in filters.context_values(V.table(spark, d, "region"), "r_name")], "value string")


@query("o_b04_context_filter", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def o_b04(spark, d):
    return filters.in_context(V.table(spark, d, "nation").withColumn("context", F.concat(F.lit(" r"), F.col("n_regionkey").cast("string"))), context="r1", other="x").select("n_name")


@query("o_b26_generic_labels", "SELECT doc_id, length(trim(text)) = 0 AS generic FROM documents")
def o_b26(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.generic(F.col("text")).alias("generic"))


@query("o_d30_executive_summary", f"{V.BASE}, l AS (SELECT lever, avg(score) AS m FROM responses GROUP BY 1) SELECT {SUMMARY}, (SELECT lever FROM l ORDER BY m, lever LIMIT 1) AS worst_lever, (SELECT lever FROM l ORDER BY m DESC, lever LIMIT 1) AS best_lever FROM responses")
def o_d30(spark, d):
    return rounded(kpis.executive_summary(V.responses(spark, d)))


@query("o_d31_pain_and_strength", f"{V.BASE}, t AS (SELECT sublever AS value, avg(score) AS m, count(*) AS n FROM responses GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY m, n DESC, value) AS r, count(*) OVER () AS z FROM t) SELECT CASE WHEN r = 1 THEN 'pain' ELSE 'strength' END AS kind, value, {R('m', 'mean_score')}, n FROM k WHERE r = 1 OR r = z")
def o_d31(spark, d):
    return rounded(drivers.pain_and_strength(V.responses(spark, d), "sublever"))


@query("o_d33_band_matrix", f"{V.BASE}, t AS (SELECT sublever AS value, count(*) AS total, {DET} AS detractor, {PAS} AS passive, {PRO} AS promoter FROM responses GROUP BY 1), k AS (SELECT * FROM t ORDER BY detractor DESC, total DESC, value LIMIT 8) SELECT value, total, 'detractor' AS band, detractor AS n, {R('detractor * 1.0 / total', 'share')} FROM k UNION ALL SELECT value, total, 'passive', passive, round(passive * 1.0 / total, 6) FROM k UNION ALL SELECT value, total, 'promoter', promoter, round(promoter * 1.0 / total, 6) FROM k")
def o_d33(spark, d):
    return rounded(drivers.group_matrix(V.responses(spark, d), "sublever"))


@query("o_d34_gap_table", f"{V.BASE}, o AS (SELECT {CLASSIC} AS overall FROM responses), x AS (SELECT value, n, nps, nps - overall AS gap FROM ({driver_sql('sublever')}), o) SELECT value, n, {R('nps', 'nps')}, {R('gap', 'gap_vs_overall')} FROM x ORDER BY gap, n DESC, value LIMIT 10")
def o_d34(spark, d):
    return rounded(drivers.gaps(V.responses(spark, d), "sublever").select("value", "n", "nps", "gap_vs_overall"))


@query("o_d35_channel_table", f"{V.BASE} SELECT sublever AS value, count(*) AS n, {R('avg(score)', 'mean_score')}, {R(f'{DET} * 1.0 / count(*)', 'detractor_rate')} FROM responses WHERE lower(channel) = 'n' GROUP BY 1 ORDER BY avg(score), count(*) DESC, 1 LIMIT 8")
def o_d35(spark, d):
    return rounded(drivers.channel_table(V.responses(spark, d), "sublever", "N"))


@query("o_d36_cohort_matrix", f"{V.BASE} SELECT lever AS row_value, sublever AS column_value, count(*) AS n, {R('avg(score)', 'mean_score')} FROM responses GROUP BY 1, 2 HAVING count(*) >= 30")
def o_d36(spark, d):
    return rounded(drivers.cohort_matrix(V.responses(spark, d), "lever", "sublever"))


@query("o_d37_score_ladder", f"{V.BASE} SELECT day AS date, " + ", ".join(f"count(*) FILTER (WHERE score = {i}) AS s{i}" for i in range(11)) + " FROM responses GROUP BY 1")
def o_d37(spark, d):
    return kpis.score_ladder(V.responses(spark, d))


@query("o_d38_period_trend", f"{V.BASE} SELECT week AS period, count(*) AS n, {R('avg(score)', 'mean_score')} FROM responses GROUP BY 1")
def o_d38(spark, d):
    return rounded(kpis.period_trend(V.responses(spark, d)))


@query("o_d39_volume_mix", f"{V.BASE} SELECT day AS date, count(*) AS n, {R(f'{PRO} * 1.0', 'promoter_n')}, {R(f'{PAS} * 1.0', 'passive_n')}, {R(f'{DET} * 1.0', 'detractor_n')} FROM responses GROUP BY 1")
def o_d39(spark, d):
    return rounded(kpis.volume_mix(kpis.daily_metrics(V.responses(spark, d))))


@query("o_d40_platform_snapshot", f"{V.BASE} SELECT count(*) AS n, {R(CLASSIC, 'nps')}, {R(f'{DET} * 1.0 / count(*)', 'detractor_rate')}, {R(f'{PRO} * 1.0 / count(*)', 'promoter_rate')} FROM responses")
def o_d40(spark, d):
    return rounded(kpis.platform_snapshot(V.responses(spark, d)))


@query("o_d41_store_summary", f"{V.BASE} SELECT count(*) AS total_records, min(day) AS min_date, max(day) AS max_date, {R(CLASSIC, 'nps')}, {R(f'{PRO} * 1.0 / count(*)', 'promoter_rate')}, {R(f'{DET} * 1.0 / count(*)', 'detractor_rate')} FROM responses")
def o_d41(spark, d):
    return rounded(drivers.store_summary(V.responses(spark, d), ["lever"])[0])


@query("o_d41_store_drivers", f"{V.BASE}, o AS (SELECT {CLASSIC} AS overall FROM responses), t AS (SELECT 'lever' AS dimension, value, n, nps - overall AS gap FROM ({driver_sql('lever')}), o UNION ALL SELECT 'sublever', value, n, nps - overall FROM ({driver_sql('sublever')}), o), k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY gap DESC, n DESC, value) AS rank FROM t) SELECT dimension, value, n, {R('gap', 'gap_vs_overall')}, rank FROM k WHERE rank <= 5")
def o_d41b(spark, d):
    return rounded(drivers.store_summary(V.responses(spark, d), ["lever", "sublever"])[1].select("dimension", "value", "n", "gap_vs_overall", F.col("rank").cast("long").alias("rank")))


@query("o_d42_routes", f"{V.BASE} SELECT lever, sublever, channel AS topic, count(*) AS n, {R(f'{DET} * 1.0 / count(*)', 'detractor_rate')}, {R(f'{DET} * 1.0 / count(*) * ln(1 + count(*))', 'route_score')} FROM responses GROUP BY 1, 2, 3 HAVING count(*) >= 150 ORDER BY {DET} * 1.0 / count(*) * ln(1 + count(*)) DESC, n DESC, 1, 2, 3 LIMIT 25")
def o_d42(spark, d):
    return rounded(drivers.routes(V.responses(spark, d).withColumn("topic", F.col("channel"))))


OVERALL = f"""r AS (SELECT week AS bucket, count(*) AS responses, {DET} AS focus_count, avg(score) AS m FROM responses GROUP BY 1), i AS (SELECT week AS bucket, count(*) AS incidents FROM incidents GROUP BY 1),
x AS (SELECT bucket, coalesce(responses, 0) AS responses, coalesce(focus_count, 0) AS focus_count, coalesce(m, 0) AS nps_mean, coalesce(focus_count * 1.0 / responses, 0) AS focus_rate, coalesce(incidents, 0) AS incidents FROM r FULL JOIN i USING (bucket))"""
TOPICS = f"""r AS (SELECT week AS bucket, lever AS topic, count(*) AS responses, {DET} AS focus_count, avg(score) AS nps_mean, {DET} * 1.0 / count(*) AS focus_rate FROM responses GROUP BY 1, 2),
i AS (SELECT week AS bucket, topic, count(*) AS incidents FROM assignments JOIN incidents USING (incident_id) GROUP BY 1, 2), s AS (SELECT r.*, coalesce(i.incidents, 0) AS incidents FROM r LEFT JOIN i USING (bucket, topic))"""


def topic_weeks(spark, d, grain="week"):
    return series.topic_series(V.responses(spark, d), V.incidents(spark, d), V.assignments(spark, d), grain)


@query("o_d13_weekly_overall", f"{V.FULL}, {OVERALL} SELECT bucket, responses, focus_count, {R('nps_mean', 'nps_mean')}, {R('focus_rate', 'focus_rate')}, incidents FROM x")
def o_d13(spark, d):
    return rounded(series.overall_series(V.responses(spark, d), V.incidents(spark, d)))


@query("o_d13_weekly_topics", f"{V.FULL}, {TOPICS} SELECT bucket, topic, responses, focus_count, {R('nps_mean', 'nps_mean')}, {R('focus_rate', 'focus_rate')}, incidents FROM s")
def o_d13b(spark, d):
    return rounded(topic_weeks(spark, d))


@query("o_d14_daily_topics", f"{V.FULL}, {TOPICS.replace('week AS bucket', 'responses.day AS bucket', 1).replace('SELECT week AS bucket, topic', 'SELECT incidents.day AS bucket, topic')} SELECT bucket, topic, responses, focus_count, {R('nps_mean', 'nps_mean')}, {R('focus_rate', 'focus_rate')}, incidents FROM s")
def o_d14(spark, d):
    return rounded(topic_weeks(spark, d, "day"))


@query("o_d55_focus_average", f"{V.FULL}, {OVERALL} SELECT {R('avg(focus_rate)', 'focus_rate_avg')} FROM x")
def o_d55(spark, d):
    return rounded(kpis.mean_focus_rate(series.overall_series(V.responses(spark, d), V.incidents(spark, d))))


@query("o_d32_topic_summary", f"{V.FULL}, {TOPICS}, t AS (SELECT topic, sum(responses) AS responses, sum(incidents) AS incidents, sum(responses * nps_mean) / sum(responses) AS m FROM s GROUP BY 1) SELECT topic, CAST(responses AS BIGINT) AS responses, CAST(incidents AS BIGINT) AS incidents, {R('m', 'nps_mean')}, {R('responses * 1.0 / sum(responses) OVER ()', 'share')} FROM t")
def o_d32(spark, d):
    return rounded(drivers.topic_summary(topic_weeks(spark, d)))


@query("o_e01_moving_average", f"{V.BASE}, x AS (SELECT day AS date, avg(score) AS m FROM responses GROUP BY 1) SELECT date, {R('avg(m) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'nps_mean_ma7')} FROM x")
def o_e01(spark, d):
    return rounded(series.moving_average(kpis.daily_metrics(V.responses(spark, d)).select("date", "nps_mean"), "nps_mean").select("date", "nps_mean_ma7"))


@query("o_e02_shift", f"{V.FULL}, {TOPICS} SELECT bucket, topic, incidents, lag(incidents, 2) OVER (PARTITION BY topic ORDER BY bucket) AS incidents_lag2 FROM s")
def o_e02(spark, d):
    return series.shifted(topic_weeks(spark, d).select("bucket", "topic", "incidents"), "incidents", 2)


def lag_sql(most, points):
    leads = " UNION ALL ".join(f"SELECT topic, {k} AS k, x, lead(y, {k}) OVER (PARTITION BY topic ORDER BY bucket) AS y FROM v" for k in range(most + 1))
    return f"""v AS (SELECT topic, bucket, CAST(incidents AS DOUBLE) AS x, focus_rate AS y FROM s), l AS ({leads}), p AS (SELECT topic, k, count(*) AS points, (count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y))), 0) AS corr FROM l WHERE y IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(corr, 9) DESC, k) AS r FROM p WHERE points >= {points} AND corr IS NOT NULL)"""


@query("o_e03_best_lag_weeks", f"{V.FULL}, {TOPICS}, {lag_sql(6, 8)} SELECT topic, k AS best_lag, {R('corr', 'corr')}, points FROM b WHERE r = 1")
def o_e03(spark, d):
    return rounded(series.best_lag(topic_weeks(spark, d)).select("topic", F.col("best_lag").cast("int").alias("best_lag"), "corr", "points"))


@query("o_e04_best_lag_days", f"{V.FULL}, {TOPICS.replace('week AS bucket', 'responses.day AS bucket', 1).replace('SELECT week AS bucket, topic', 'SELECT incidents.day AS bucket, topic')}, {lag_sql(21, 30)} SELECT topic, k AS best_lag, {R('corr', 'corr')}, points FROM b WHERE r = 1")
def o_e04(spark, d):
    return rounded(series.best_lag_days(topic_weeks(spark, d, "day")).select("topic", F.col("best_lag").cast("int").alias("best_lag"), "corr", "points"))


@query("o_e05_daily_gate", f"{V.FULL}, x AS (SELECT count(DISTINCT day) AS days, date_diff('day', min(day), max(day)) + 1 AS span FROM responses) SELECT days, {R('days * 1.0 / span', 'coverage')}, days >= 20 AND days * 1.0 / span >= 0.45 AS daily_ok FROM x")
def o_e05(spark, d):
    return rounded(series.daily_gate(series.overall_series(V.responses(spark, d), V.incidents(spark, d), "day")))


CPS = "cps AS (SELECT topic, bucket AS cp FROM (SELECT topic, bucket, row_number() OVER (PARTITION BY topic ORDER BY bucket) AS r FROM s) WHERE r % 40 = 20)"


@query("o_e06_lead_share", f"{V.FULL}, {TOPICS}, {CPS}, z AS (SELECT c.topic, cp, max(CASE WHEN s.bucket < cp AND s.bucket >= cp - 28 THEN incidents END) AS a, max(CASE WHEN s.bucket > cp AND s.bucket <= cp + 28 THEN incidents END) AS b FROM cps c JOIN s USING (topic) GROUP BY 1, 2) SELECT topic, count(*) AS n, {R('avg(CASE WHEN a >= b THEN 1.0 ELSE 0.0 END)', 'lead_share')} FROM z WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY topic")
def o_e06(spark, d):
    s = topic_weeks(spark, d)
    cps = drivers.numbered(s, "bucket", by=["topic"]).filter("rank % 40 = 20").select("topic", F.col("bucket").alias("changepoint"))
    return rounded(series.lead_share(s, cps))


@query("o_e07_gap_fill", """WITH p AS (SELECT DATE '2024-01-01' + CAST(3 * (CAST(ts AS DATE) - DATE '2024-01-01') + event_id % 2 AS INT) AS date, count(*) AS n, avg(value) AS v FROM events GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p),
f AS (SELECT g.date, coalesce(n, 0) AS n, (SELECT max(date) FROM p WHERE p.date <= g.date) AS a, (SELECT min(date) FROM p WHERE p.date >= g.date) AS b FROM g LEFT JOIN p USING (date))
SELECT f.date, f.n, round(CASE WHEN a = b THEN pa.v ELSE pa.v + (pb.v - pa.v) * date_diff('day', a, f.date) / date_diff('day', a, b) END, 6) AS v FROM f JOIN p pa ON pa.date = a JOIN p pb ON pb.date = b""")
def o_e07(spark, d):
    # days three apart, and the next ones: every third day is a gap
    date = F.expr("date_add(date'2024-01-01', cast(3 * datediff(day, date'2024-01-01') + event_id % 2 as int))")
    p = V.events(spark, d).groupBy(date.alias("date")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return rounded(series.fill_days(p, ["n"], ["v"]))


@query("o_e08_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def o_e08(spark, d):
    return drivers.keep_first(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("o_e09_numbered", f"{V.BASE}, x AS ({driver_sql('sublever')}) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM x")
def o_e09(spark, d):
    return drivers.numbered(drivers.driver_stats(V.responses(spark, d), "sublever").select("value", "n"), F.desc("n"), "value").withColumn("rank", F.col("rank").cast("long"))


@query("o_e10_by_maximum", f"{V.BASE}, x AS ({driver_sql('lever')}) SELECT value, {R('n * 1.0 / max(n) OVER ()', 'n_norm')} FROM x")
def o_e10(spark, d):
    return rounded(series.by_maximum(drivers.driver_stats(V.responses(spark, d), "lever"), "n").select("value", "n_norm"))


@query("o_e11_share_of_total", f"{V.BASE}, x AS ({driver_sql('lever')}) SELECT value, {R('n * 1.0 / sum(n) OVER ()', 'n_share')} FROM x")
def o_e11(spark, d):
    return rounded(series.share_of_total(drivers.driver_stats(V.responses(spark, d), "lever"), "n").select("value", "n_share"))


@query("o_e12_resample", f"{V.BASE} SELECT week AS bucket, {R(CLASSIC, 'nps_classic')} FROM responses GROUP BY 1")
def o_e12(spark, d):
    return rounded(kpis.resample_classic(V.responses(spark, d)))


@query("o_e13_suffixed_keys", "SELECT c_custkey, CASE WHEN r = 1 THEN k ELSE k || '-' || r END AS unique_key FROM (SELECT c_custkey, 'n' || c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)")
def o_e13(spark, d):
    return drivers.suffixed(V.table(spark, d, "customer").withColumn("k", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), "k", "c_custkey").select("c_custkey", "unique_key")


@query("o_e14_evenly_spaced", "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM x WHERE n <= 100 OR i = 0 OR floor(i * 99 / (n - 1)) > floor((i - 1) * 99 / (n - 1))")
def o_e14(spark, d):
    return series.evenly(V.table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("o_f05_top_k", f"{V.BASE}, x AS ({driver_sql('sublever')}) SELECT value, n FROM x ORDER BY n DESC, value LIMIT 12")
def o_f05(spark, d):
    return drivers.head(drivers.driver_stats(V.responses(spark, d), "sublever").select("value", "n"), F.desc("n"), "value", n=12)


@query("o_d51_daily_signals", f"""{V.FULL}, {TOPICS.replace('week AS bucket', 'responses.day AS bucket', 1).replace('SELECT week AS bucket, topic', 'SELECT incidents.day AS bucket, topic')},
p AS (SELECT bucket AS date, sum(incidents) AS incidents, sum(responses) AS responses, sum(responses * nps_mean) / sum(responses) AS m, sum(responses * focus_rate) / sum(responses) AS f FROM s GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p)
SELECT date, CAST(coalesce(incidents, 0) AS BIGINT) AS incidents, CAST(coalesce(responses, 0) AS BIGINT) AS responses, {R('m', 'nps_mean')}, {R('f', 'focus_rate')} FROM g JOIN p USING (date)""")
def o_d51(spark, d):
    # every day of the span has responses here; gaps are tested on small series
    return rounded(series.daily_signals(topic_weeks(spark, d, "day")))


TONE = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in sorted(X.TONES.items()))


@query("o_k09_tones", f"WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, concat_ws(',', {TONE}) AS tones FROM x")
def o_k09(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(X.tones(F.col("text")), ",").alias("tones"))
