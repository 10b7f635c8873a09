"""Queries on uploads, caches, catalogues, selectors and label rules, each over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from marea import session
from marea.functions import text as X
from marea.operators import changepoints, drivers, filters, hotspots, labels, selectors, topics
from marea.plans import batch
from marea.plans import views as V
from marea.plans.queries_core import R, rounded, topic_weeks
from marea.plans.queries_store import _raw, scratch
from marea.plans.registry import query
from marea.sources import ingest, journeys, reviews, store


@query("o_a01_ingest_responses", f"{V.BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY order_id * 10 + line_no ORDER BY 1) AS r FROM responses) SELECT lever, count(DISTINCT order_id * 10 + line_no) AS rows, CAST(count(DISTINCT day) AS BIGINT) AS days, min(day) AS first_day, max(day) AS last_day FROM responses WHERE order_id * 10 + line_no NOT IN (SELECT order_id * 10 + line_no FROM k WHERE r > 1) GROUP BY lever")
def o_a01(spark, d):
    got = ingest.responses(_raw(spark, d)).df
    # ids that several lines share keep the last line of the file, whichever that is; they are left out here
    once = V.responses(spark, d).groupBy((F.col("order_id") * 10 + F.col("line_no")).cast("string").alias("ID")).agg(F.count(F.lit(1)).alias("times")).filter("times = 1")
    day = F.col("Fecha").cast("date")
    return got.join(once, "ID", "left_semi").groupBy(F.col("Palanca").alias("lever")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("o_a02_headers", f"{V.BASE} SELECT channel AS \"Canal\", lever AS \"Palanca\", sublever AS \"Subpalanca\", count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM responses GROUP BY 1, 2, 3")
def o_a02(spark, d):
    got = filters.rename_headers(filters.standardise(_raw(spark, d)), ingest.ALIASES)
    return got.groupBy("Canal", F.trim("Palanca").alias("Palanca"), "Subpalanca").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("NPS").cast("long")).alias("total"))


def _csv(df, spark) -> str:
    path = scratch(spark)
    df.write.option("header", "true").csv(path)
    return path


@query("o_a04_incident_csv", "SELECT '  ' AS channel, month(o_orderdate) AS month, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 > 0) AS dated FROM orders GROUP BY 2")
def o_a04(spark, d):
    o = V.table(spark, d, "orders")
    opened = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("no date")
    raw = o.select(opened.alias(" opened_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("closed_at"), F.col("o_orderkey").alias("incident_id"), *(F.lit(c).alias(c) for c in ("category", "severity", "system", "description", "channel", "geo")))
    got = ingest.incidents_csv(spark, _csv(raw, spark)).df
    return got.groupBy(F.lit("  ").alias("channel"), F.month("closed_at").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count("opened_at").alias("dated"))


@query("o_a04_incident_csv_issues", "SELECT 'WARN' AS level, 'invalid_dates' AS code, count(*) || ' rows without a date' AS message FROM orders WHERE o_orderkey % 7 = 0")
def o_a04b(spark, d):
    o = V.table(spark, d, "orders")
    opened = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    raw = o.select(opened.alias("opened_at"), *(F.lit("x").alias(c) for c in ("closed_at", "incident_id", "category", "severity", "system", "description", "channel", "geo")))
    return spark.createDataFrame([i[:3] for i in ingest.incidents_csv(spark, _csv(raw, spark)).issues], "level string, code string, message string")


@query("o_a05_reviews_csv", f"SELECT event_type AS store, count(*) AS n, count(*) FILTER (WHERE event_id % 5 > 0) AS rated, {R('avg(value) FILTER (WHERE event_id % 5 > 0)', 'rating')}, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1")
def o_a05(spark, d):
    e = V.table(spark, d, "events")
    raw = e.select(F.col("event_type").alias("store"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise("n/a").alias("rating"), F.lit("t").alias("text"), F.lit("1").alias("app_version"), F.lit("g").alias("geo"))
    got = ingest.reviews_csv(spark, _csv(raw, spark)).df
    return rounded(got.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.avg("rating").alias("rating"), F.min("date").alias("first_day")))


@query("o_a06_reviews_pages", f"SELECT event_type AS store, count(*) AS n, {R('avg(value)', 'rating')} FROM events GROUP BY 1")
def o_a06(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("store"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").alias("rating"), F.lit("t").alias("text"), F.lit("1").alias("app_version"), F.lit("g").alias("geo"))
    path = scratch(spark)
    e.groupBy(F.pmod(F.hash("date"), F.lit(16)).alias("page")).agg(F.to_json(F.collect_list(F.struct(*(c for c in e.columns if c != "page")))).alias("value")).select("value").write.text(path)
    got = reviews.pages(spark, path)
    return rounded(got.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating")))


@query("o_a07_lines_meta", f"{V.BASE} SELECT count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM responses")
def o_a07(spark, d):
    return store.write_lines(V.responses(spark, d).select("ts", "lever", "score"), scratch(spark))


def _customers(spark, d, part):
    """Customers as records: batch 0 has two thirds of them, batch 1 other two thirds, some changed."""
    c = V.table(spark, d, "customer").filter(F.col("c_custkey") % 3 != (0 if part == 0 else 1))
    payload = F.when(F.lit(part == 1) & (F.col("c_custkey") % 2 == 0), F.lit("changed")).otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").cast("string").alias("business_key"), F.sha2(payload, 256).alias("record_fingerprint"), payload.alias("payload"))


def _lifecycle(spark, d):
    """A store that saw a file, the file again, a file that breaks, an attempt that never ended, and a second file."""
    s = store.RecordStore(spark, scratch(spark))
    s.upload(_customers(spark, d, 0), "ctx", "a", [("WARN", "extra_columns_detected", "x", None)], "u1")
    s.upload(_customers(spark, d, 0), "ctx", "a", None, "u2")
    broken = _customers(spark, d, 1).withColumn("payload", F.when(F.col("business_key") == "8", F.raise_error(F.lit("disk full"))).otherwise(F.col("payload")))
    s.upload(broken, "ctx", "b", None, "u3")
    s._log("u4", "ctx", "c", "processing", 0, 0, 0, 0)
    s.recover()
    s.upload(_customers(spark, d, 1), "ctx", "b", None, "u5")
    return s


ZERO = "CAST(0 AS BIGINT)"


@query("o_a18_upload_states", f"WITH n AS (SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0) AS a, count(*) FILTER (WHERE c_custkey % 3 = 0) AS ins, count(*) FILTER (WHERE c_custkey % 3 = 2 AND c_custkey % 2 = 0) AS upd, count(*) FILTER (WHERE c_custkey % 3 = 2 AND c_custkey % 2 = 1) AS dup FROM customer) SELECT 'u1' AS upload_id, 'completed' AS status, a AS rows, a AS inserted, {ZERO} AS updated, {ZERO} AS duplicates FROM n UNION ALL SELECT 'u2', 'duplicate_upload', 0, 0, 0, 0 UNION ALL SELECT 'u3', 'failed', 0, 0, 0, 0 UNION ALL SELECT 'u4', 'failed', 0, 0, 0, 0 UNION ALL SELECT 'u5', 'completed', ins + upd + dup, ins, upd, dup FROM n")
def o_a18(spark, d):
    return _lifecycle(spark, d).uploads().select("upload_id", "status", "rows", "inserted", "updated", "duplicates")


@query("o_a18_upload_issues", "SELECT * FROM (VALUES ('u1', 'WARN', 'extra_columns_detected'), ('u3', 'ERROR', 'storage_error'), ('u4', 'ERROR', 'interrupted_upload')) t(upload_id, level, code) WHERE (SELECT count(*) FROM customer) > 0")
def o_a18b(spark, d):
    return _lifecycle(spark, d).issues().select("upload_id", "level", "code")


@query("o_a17_upload_ledger", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS payload, CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END AS times_seen FROM customer) SELECT payload, times_seen, count(*) AS n FROM c GROUP BY 1, 2")
def o_a17(spark, d):
    return _lifecycle(spark, d).current().groupBy("payload", "times_seen").agg(F.count(F.lit(1)).alias("n"))


@query("o_a14_tables", "SELECT 'records' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'events', count(*) FILTER (WHERE c_custkey % 3 <> 0) + count(*) FILTER (WHERE c_custkey % 3 <> 1) FROM customer UNION ALL SELECT 'uploads', 9 UNION ALL SELECT 'issues', 3")
def o_a14(spark, d):
    s = _lifecycle(spark, d)
    tables = {"records": s.current(), "events": s.table("events", store.EVENTS), "uploads": s.table("uploads", store.UPLOADS), "issues": s.issues()}
    out = None
    for name, t in tables.items():
        row = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("o_a26_result_cache", "SELECT o_orderpriority, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, true AS was_there, 'new' AS left_out FROM orders GROUP BY 1")
def o_a26(spark, d):
    o = V.table(spark, d, "orders")
    cache = store.ResultCache(spark, scratch(spark))
    make = lambda: o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))
    key = cache.key("priorities", o, grain="all")
    cache.put(cache.key("priorities", "older"), o.select("o_orderkey"))
    cache.through(key, make)
    held, was_there = cache.through(key, make)
    cache.most_bytes = sum(e[1] for e in cache.entries()) - 1  # the least recently used has to go
    gone = cache.evict()
    left_out = "new" if gone == [cache.key("priorities", "older")] else "other"
    return held.select("*", F.lit(was_there).alias("was_there"), F.lit(left_out).alias("left_out"))


CATALOGUE = "ent AS (SELECT row_number() OVER (ORDER BY p_type, p_brand) - 1 AS position, p_type, p_brand FROM (SELECT DISTINCT p_type, p_brand FROM part))"


@query("o_a25_journey_catalogue", f"""WITH {CATALOGUE}, cl AS (SELECT position, CASE WHEN position % 3 = 0 THEN 'executive-' || regexp_replace(regexp_replace(lower(CASE WHEN position % 2 = 0 THEN p_type || ' route' ELSE 'Journey' || p_brand END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE lower(p_type) END AS id, CASE WHEN position % 2 = 0 THEN p_type || ' route' ELSE 'Journey' || p_brand END AS title, lower(p_type) || '|' || replace(lower(p_brand), '#', ' ') AS keywords FROM ent),
nu AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS k FROM cl) SELECT position, CASE WHEN k = 1 THEN id ELSE id || '-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k END AS journey_id, title, 'Medio' AS impact_label, keywords FROM nu""")
def o_a25(spark, d):
    place = V.table(spark, d, "part").select("p_type", "p_brand").distinct()
    rows = drivers.numbered(place, "p_type", "p_brand", name="position").withColumn("position", F.col("position") - 1)
    title = F.when(F.col("position") % 2 == 0, F.concat(F.lit(" "), F.col("p_type"), F.lit("   route "))).otherwise(F.concat(F.lit("Journey"), F.col("p_brand")))
    edited = rows.select("position", F.when(F.col("position") % 3 > 0, F.upper("p_type")).alias("id"), title.alias("title"), F.concat("p_type", F.lit(", "), "p_brand", F.lit("; ;"), "p_type").alias("keywords"))
    blank = spark.createDataFrame([(10_000, "", " ", None)], "position int, id string, title string, keywords string")
    root = scratch(spark)
    journeys.save(edited.limit(1), root, "Contexto", "N1")
    journeys.save(edited.unionByName(blank), root, "contexto ", "N 1".replace(" ", ""))
    got = journeys.load(spark, root, "CONTEXTO", "n1")
    return got.select("position", "journey_id", "title", "impact_label", F.array_join("keywords", "|").alias("keywords"))


@query("o_a21_artifact_manifest", f"{V.BASE} SELECT 'kpis' AS file, count(*) AS n, {R('avg(score)', 'value')} FROM responses")
def o_a21(spark, d):
    from marea.operators.kpis import score_kpis

    r = V.responses(spark, d)
    k = r.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).first()
    pack = store.insight_pack(r.withColumn("comment", F.col("lever")), "Todo", {"origin": "x"})
    assert pack["evidence"] == score_kpis(r).first().asDict()
    root = scratch(spark)
    folder = store.artifact_tree(spark, root, "ds", "v1", "ctx", {"n": k["n"], "mean": k["mean"]}, {"todo": pack})
    told = json.loads("\n".join(x.value for x in spark.read.text(f"{folder}/kpis.json").collect()))
    return rounded(spark.createDataFrame([("kpis", told["n"], told["mean"])], "file string, n long, value double"))


@query("o_a22_insight_pack", f"{V.BASE} SELECT sublever, count(*) AS n, {R('avg(score)', 'mean')}, 12 AS id_size, 1 AS ids FROM responses GROUP BY sublever")
def o_a22(spark, d):
    # the packs of all labels: a figure each; ids are stable
    r = V.responses(spark, d)
    table = store.pack_table(r.withColumn("comment", F.col("lever")), "sublever", {"origin": "x"})
    ids = table.groupBy("value").agg(F.count_distinct("id").cast("int").alias("ids"))
    return rounded(table.join(ids, "value").select(F.col("value").alias("sublever"), "n", "mean", F.length("id").alias("id_size"), "ids"))


@query("o_b01_required_columns", "SELECT 'ERROR' AS level, 'missing_required_column' AS code, c AS \"column\" FROM (VALUES ('p_weight'), ('p_colour')) t(c) WHERE (SELECT count(*) FROM part) > 0")
def o_b01(spark, d):
    p = V.table(spark, d, "part")
    lost = session.missing(p.filter("p_size > 0"), ["p_partkey", "p_weight", "p_name", "p_colour"])
    return p.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ERROR").alias("level"), F.lit("missing_required_column").alias("code"), F.explode(F.array(*map(F.lit, lost))).alias("column"))


@query("o_b05_token_set", "WITH x AS (SELECT o_orderkey, o_orderstatus AS a, substr(o_orderpriority, 1, 1) AS b FROM orders) SELECT o_orderkey, CASE WHEN a < b THEN a || ',' || b ELSE b || ',' || a END AS key FROM x WHERE a = 'F' AND b = '2'")
def o_b05(spark, d):
    o = V.table(spark, d, "orders").withColumn("n2", F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1), F.lit(" , "), "o_orderstatus", F.lit(","), F.substring("o_orderpriority", 1, 1), F.lit(",")))
    return filters.with_tokens(o, "n2", "F, 2").select("o_orderkey", X.token_set(F.col("n2")).alias("key"))


@query("o_b10_date_column", "SELECT 'o_orderdate' AS name, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS n FROM orders UNION ALL SELECT 'ts', min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), count(*) FROM events")
def o_b10(spark, d):
    parts = []
    for name in ("orders", "events"):
        t = V.table(spark, d, name)
        c = filters.date_column(t.columns)
        day = F.col(c).cast("date")
        parts.append(t.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("name"), "first_day", "last_day", "n"))
    return parts[0].unionByName(parts[1])


@query("o_b15_resolvers", f"{V.BASE}, w AS (SELECT channel, count(*) AS n FROM responses GROUP BY 1) SELECT lower(channel) AS wanted, channel AS resolved, n FROM w UNION ALL SELECT 'zz', 'Todos', CAST(sum(n) AS BIGINT) FROM w")
def o_b15(spark, d):
    r = V.responses(spark, d)
    seen = [x[0] for x in r.select("channel").distinct().limit(1000).collect()]
    out = None
    for wanted in [*(c.lower() for c in sorted(seen)), "zz"]:
        chosen = filters.resolve(f" {wanted}", seen)
        row = filters.in_channel(r, chosen).agg(F.count(F.lit(1)).alias("n")).select(F.lit(wanted).alias("wanted"), F.lit(chosen).alias("resolved"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("o_c03_assignment_dates", f"{V.FULL} SELECT incident_id, topic, day FROM assignments LEFT JOIN (SELECT incident_id, day FROM incidents WHERE incident_id % 3 > 0) USING (incident_id)")
def o_c03(spark, d):
    a = V.assignments(spark, d).withColumn("incident_id", F.concat(F.lit(" "), F.col("incident_id").cast("string")))
    return labels.dated_assignments(a, V.incidents(spark, d).filter("incident_id % 3 > 0")).select(F.trim("incident_id").cast("long").alias("incident_id"), "topic", "day")


@query("o_c15_ranked_pivot", f"{V.FULL}, rk AS (SELECT day, incident_id, CASE WHEN incident_id % 4 > 0 THEN incident_id % 4 END AS rank FROM incidents) SELECT day, count(*) FILTER (WHERE rank = 1) AS rank_1, count(*) FILTER (WHERE rank = 2) AS rank_2, count(*) FILTER (WHERE rank = 3) AS rank_3, count(*) FILTER (WHERE rank IS NULL) AS rest FROM rk GROUP BY day")
def o_c15(spark, d):
    i = V.incidents(spark, d)
    timeline = i.groupBy("day").agg(F.collect_list("incident_id").alias("incident_ids"))
    ranks = i.filter("incident_id % 4 > 0").select("day", "incident_id", (F.col("incident_id") % 4).alias("rank"))
    return labels.ranked_days(timeline, ranks.union(ranks.withColumn("rank", F.lit(3))))


@query("o_c20_matrix_totals", f"{V.BASE}, m AS (SELECT lever, channel, count(*) AS n FROM responses GROUP BY 1, 2) SELECT lever, channel, n, CAST(sum(n) OVER (PARTITION BY lever) AS BIGINT) AS total, {R('n * 1.0 / sum(n) OVER (PARTITION BY lever)', 'share')} FROM m")
def o_c20(spark, d):
    m = V.responses(spark, d).groupBy("lever", "channel").agg(F.count(F.lit(1)).alias("n"))
    return rounded(labels.with_totals(m, "lever").select("lever", "channel", "n", "total", "share"))


BROKEN = f"{V.CHAIN}, x AS (SELECT *, comment_id % 9 AS cluster, CASE WHEN comment_id % 9 = 4 THEN 'n/a' ELSE lever END AS lv FROM links), lm AS (SELECT cluster, lv, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, lv) AS r FROM x WHERE lv <> 'n/a' GROUP BY 1, 2), sm AS (SELECT cluster, sublever, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, sublever) AS r FROM x GROUP BY 1, 2)"


@query("o_d25_impact_labels", f"""{BROKEN}, g AS (SELECT cluster, count(*) AS pairs, count(DISTINCT incident_id) AS incidents, avg(score) AS m, avg(similarity) AS s, avg(CASE WHEN comment_day > incident_day THEN 1.0 ELSE 0.0 END) AS co FROM x GROUP BY 1),
j AS (SELECT g.*, coalesce(lv, '') AS lever, sm.sublever AS sublever FROM g LEFT JOIN lm ON lm.cluster = g.cluster AND lm.r = 1 JOIN sm ON sm.cluster = g.cluster AND sm.r = 1),
z AS (SELECT *, trim(regexp_replace(lower(CASE WHEN lever = '' THEN sublever ELSE lever || ' / ' || sublever END), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM j)
SELECT cluster, lever, sublever, pairs AS linked_pairs, incidents AS linked_incidents, {R('m', 'avg_nps')}, CASE WHEN pairs >= 10 OR m <= 2 THEN 'Muy alto' WHEN pairs >= 6 OR m <= 4 THEN 'Alto' WHEN pairs >= 3 THEN 'Medio' ELSE 'Bajo' END AS impact_label, CASE WHEN co >= 0.72 AND s >= 0.85 THEN 'Alto' WHEN co >= 0.55 AND s >= 0.75 THEN 'Medio' ELSE 'Bajo' END AS confidence_label, CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END AS journey_id FROM z WINDOW w AS (PARTITION BY slug ORDER BY pairs DESC, cluster)""")
def o_d25(spark, d):
    pairs = V.links(spark, d).withColumn("cluster", F.col("comment_id") % 9).withColumn("lever", F.when(F.col("comment_id") % 9 == 4, "n/a").otherwise(F.col("lever")))
    cohesion = pairs.groupBy("cluster").agg(F.avg((F.col("comment_day") > F.col("incident_day")).cast("int")).alias("semantic_cohesion"))
    return rounded(labels.broken_journey_table(pairs, cohesion).select("cluster", "lever", "sublever", "linked_pairs", "linked_incidents", "avg_nps", "impact_label", "confidence_label", "journey_id"))


@query("o_e08_keep_last", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def o_e08_last(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("place", F.struct("l_shipdate", "l_partkey", "l_suppkey")).withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return ingest.last_of_key(rows, "key", "place").select("l_orderkey", "l_linenumber", "l_partkey")


GAPS = f"{V.BASE}, ov AS (SELECT (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) AS o FROM responses), ga AS (SELECT sublever AS value, count(*) AS n, (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) - (SELECT o FROM ov) AS gap FROM responses GROUP BY 1)"
OPPS = f"{GAPS}, op AS (SELECT value, n, -0.6 * gap AS up, least(1, log10(n) / 5) AS conf FROM ga WHERE gap < 0 AND n >= 200)"


@query("o_f02_opportunity_view", f"{OPPS} SELECT value AS label, {R('up', 'potential_uplift')}, {R('conf', 'confidence')}, row_number() OVER (ORDER BY up DESC, conf DESC, value) AS place FROM op ORDER BY 4 LIMIT 25")
def o_f02(spark, d):
    view = selectors.opportunities_view(drivers.opportunities(V.responses(spark, d), ["sublever"]))
    out = drivers.numbered(view, F.desc("potential_uplift"), F.desc("confidence"), "label", name="place")
    return rounded(out.select("label", "potential_uplift", "confidence", F.col("place").cast("long").alias("place")))


@query("o_f04_negative_deltas", f"{V.BASE}, c AS (SELECT sublever AS value, avg(score) AS m FROM responses WHERE year(day) = 1996 GROUP BY 1), b AS (SELECT sublever AS value, avg(score) AS m FROM responses WHERE year(day) < 1996 GROUP BY 1), x AS (SELECT value, c.m - b.m AS delta FROM c JOIN b USING (value)) SELECT value, {R('delta', 'delta_nps')} FROM x WHERE delta < 0 ORDER BY delta, value LIMIT 6")
def o_f04(spark, d):
    r = V.responses(spark, d)
    t = drivers.driver_delta(r.filter("year(day) = 1996"), r.filter("year(day) < 1996"), "sublever", 1)
    return rounded(selectors.deteriorations(t, 6).select("value", "delta_nps"))


@query("o_f04_gap_rows", f"{GAPS} SELECT value, n, {R('gap', 'gap_vs_overall')} FROM ga WHERE gap < 0 ORDER BY gap, n DESC, value LIMIT 7")
def o_f04_gaps(spark, d):
    return rounded(selectors.gaps(drivers.driver_table(V.responses(spark, d), "sublever"), 7).select("value", "n", "gap_vs_overall"))


@query("o_f04_opportunity_rows", f"{OPPS} SELECT value, n, {R('up', 'potential_uplift')} FROM op ORDER BY up DESC, conf DESC, n DESC, value LIMIT 5")
def o_f04_opportunities(spark, d):
    return rounded(selectors.opportunities(drivers.opportunities(V.responses(spark, d), ["sublever"]), 5).select("value", "n", "potential_uplift"))


@query("o_f04_clusters", "WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS cluster_id FROM documents GROUP BY source) SELECT source, n FROM c ORDER BY n DESC, cluster_id LIMIT 4")
def o_f04_clusters(spark, d):
    t = V.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return selectors.text_clusters(drivers.numbered(t, "source", name="cluster_id"), 4).select("source", "n")


@query("o_f04_scenarios", f"{V.CHAIN}, c AS (SELECT sublever AS entity, count(*) AS linked_pairs, count(DISTINCT incident_id) AS linked_incidents, max(similarity) AS confidence, avg(CASE WHEN score <= 6 THEN 1.0 ELSE 0.0 END) AS p FROM links GROUP BY 1) SELECT entity, linked_pairs, {R('p', 'detractor_probability')} FROM c ORDER BY round(p, 1) DESC, linked_pairs DESC, linked_incidents DESC, confidence DESC, entity LIMIT 6")
def o_f04_scenarios(spark, d):
    c = V.links(spark, d).groupBy(F.col("sublever").alias("entity")).agg(F.count(F.lit(1)).alias("linked_pairs"), F.count_distinct("incident_id").alias("linked_incidents"), F.max("similarity").alias("confidence"), F.avg((F.col("score") <= 6).cast("int")).alias("p"))
    out = selectors.scenarios(c.withColumn("detractor_probability", F.round("p", 1)), 6)
    return rounded(out.select("entity", "linked_pairs", F.col("p").alias("detractor_probability")))


@query("o_f04_nonzero_kpis", "WITH k AS (SELECT o_custkey AS position, 'C' || o_custkey AS label, CASE WHEN o_custkey % 3 = 0 THEN 'nada' WHEN o_custkey % 3 = 1 THEN CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) || ' pts' ELSE CAST(count(*) AS VARCHAR) || ',0 %' END AS value FROM orders GROUP BY 1) SELECT label, value FROM k WHERE position % 3 > 0 AND value NOT LIKE '0 %' AND value NOT LIKE '0,%' ORDER BY position LIMIT 300")
def o_f04_kpis(spark, d):
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("position")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("position") % 3 == 0, "nada").when(F.col("position") % 3 == 1, F.concat(F.col("p").cast("string"), F.lit(" pts"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(",0 %")))
    return selectors.nonzero(o.select("position", F.concat(F.lit("C"), F.col("position").cast("string")).alias("label"), value.alias("value")), 300).select("label", "value")


@query("o_f06_table_heads", f"{GAPS}, h AS (SELECT value, n, gap, row_number() OVER (ORDER BY gap, n DESC, value) AS r FROM ga) SELECT 'gaps' AS view, value, n FROM h WHERE r <= 30 UNION ALL SELECT 'ranking', value, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS q FROM ga) WHERE q <= 20")
def o_f06(spark, d):
    t = drivers.driver_table(V.responses(spark, d), "sublever")
    parts = [selectors.head(t, view, *order).select(F.lit(view).alias("view"), "value", "n") for view, order in (("gaps", ("gap_vs_overall", F.desc("n"), "value")), ("ranking", (F.desc("n"), "value")))]
    return parts[0].unionByName(parts[1])


@query("o_g01_union_all", "SELECT DATE '2026-01-01' + CAST(doc_id % 60 AS INT) AS day, 'comment' AS side, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT DATE '2026-01-01' + CAST(item_id % 60 AS INT), 'incident', count(*) FROM benchmark GROUP BY 1")
def o_g01(spark, d):
    both = hotspots.records(V.tickets(spark, d).withColumnRenamed("ts", "day"), V.comments(spark, d).withColumnRenamed("ts", "day"))
    return both.groupBy("day", "side").agg(F.count(F.lit(1)).alias("n"))


@query("o_g02_ordered_distinct", "WITH x AS (SELECT doc_id, lang || ',' || source || ';' || lang || chr(10) || ' ' || source || ' ' AS t, lang, source FROM documents) SELECT doc_id, lang || '|' || source AS names FROM x")
def o_g02(spark, d):
    t = F.concat("lang", F.lit(","), "source", F.lit(";"), "lang", F.lit("\n "), "source", F.lit(" "))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(X.split_list(t), "|").alias("names"))


@query("o_g03_token_intersection", "WITH x AS (SELECT p_partkey, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')), lambda w: w NOT IN ('the', 'and')) AS a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]{3,}')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) AS common, len(a) AS own FROM x")
def o_g03(spark, d):
    a, b = X.axis_tokens(F.upper("p_name")), X.axis_tokens(F.concat_ws("-", "p_type", "p_name"))
    return V.table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(a).cast("long").alias("own"))


@query("o_g04_column_subsets", "SELECT c AS \"column\", n FROM (VALUES ('l_tax2'), ('l_colour')) t(c), (SELECT count(*) AS n FROM lineitem)")
def o_g04(spark, d):
    t = V.table(spark, d, "lineitem")
    lost = session.missing(t, ["l_orderkey", "l_tax2", "l_partkey", "l_colour"])
    return t.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, lost))).alias("column"), "n")


@query("o_k03_separable_topics", "WITH x AS (SELECT lower(p_type) AS a, reverse(lower(p_type)) AS b, p_partkey FROM part), g AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT *, list_sort([a, b, a || ' ' || b]) AS terms FROM g) SELECT CAST(row_number() OVER (ORDER BY n DESC, terms) - 1 AS INT) AS cluster_id, n, array_to_string(terms, '|') AS top_terms, a || ' ' || b AS example FROM t")
def o_k03_separable(spark, d):
    # a topic each type: its name and its name backwards, around stop words
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("comment_id"), F.concat(F.lit("¡"), "p_type", F.lit(" de la "), F.reverse("p_type"), F.lit("!")).alias("text"))
    got = topics.extract_topics(p, wanted=6)
    return got.select("cluster_id", "n", F.array_join("top_terms", "|").alias("top_terms"), F.replace(F.element_at("examples", 1), F.lit(" de la "), F.lit(" ")).alias("example"))


@query("o_k06_dimension_series", f"{V.BASE}, s AS (SELECT 'lever' AS dimension, lever AS value, day, score FROM responses UNION ALL SELECT 'channel', channel, day, score FROM responses UNION ALL SELECT '*', '*', day, score FROM responses) SELECT dimension, value, count(DISTINCT day) AS days, {R('sum(nps)', 'total')} FROM (SELECT dimension, value, day, (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) AS nps FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2")
def o_k06_series(spark, d):
    s = changepoints.dimension_series(V.responses(spark, d), ["lever", "channel"])
    return rounded(s.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("days"), F.sum("nps").alias("total")))


@query("o_k06_dimension_changepoints")
def o_k06_dimensions(spark, d):
    return changepoints.dimension_changepoints(V.responses(spark, d), ["lever", "channel"], grain="month", draws=100)


@query("o_k07_topic_stability")
def o_k07_topics(spark, d):
    # points, not rates; topics without a break are told too
    return changepoints.topic_stability(topic_weeks(spark, d).withColumn("topic", F.col("topic")), scale=100.0, draws=100)


ONCE = f"{V.BASE}, once AS (SELECT order_id * 10 + line_no AS id, min(lever) AS lever, min(sublever) AS sublever, min(score) AS score FROM responses GROUP BY 1 HAVING count(*) = 1)"


@query("o_batch_platform", f"{ONCE}, ov AS (SELECT (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) AS o FROM once), ga AS (SELECT sublever AS value, count(*) AS n, (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) - (SELECT o FROM ov) AS gap FROM once GROUP BY 1), op AS (SELECT value, n, -0.6 * gap AS up, least(1, log10(greatest(n, 10)) / 5) AS conf FROM ga WHERE gap < 0 AND n >= 20) SELECT 'completed' AS status, (SELECT count(*) FROM once) AS rows, value, n, {R('up', 'potential_uplift')} FROM op ORDER BY up * conf DESC, n DESC, value LIMIT 2")
def o_batch(spark, d):
    r = V.responses(spark, d)
    once = r.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(F.col("order_id") * 10 + F.col("line_no")))).filter("times = 1")
    # the file: it is read for its counts and for its rows
    raw = session.settle(_raw(spark, d, once)).withColumn("service_origin", F.lit("Casa")).withColumn("service_origin_n1", F.lit("Web"))
    told = batch.run(spark, [batch.Run(raw, "Casa", "Web", dimensions=("Subpalanca",), top_packs=2, min_n=20)], scratch(spark))[0]
    k = json.loads("\n".join(x.value for x in spark.read.text(f"{told['folder']}/kpis.json").collect()))
    packs = [json.loads("\n".join(x.value for x in spark.read.text(f"{told['folder']}/insights/{p}__pack.json").collect())) for p in told["packs"]]
    rows = [(told["status"], k["dataset"]["rows"], p["driver"]["value"], p["driver"]["n"], float(p["driver"]["potential_uplift"])) for p in packs]
    return rounded(spark.createDataFrame(rows, "status string, rows long, value string, n long, potential_uplift double"))
