"""Queries on ingestion, stores and quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators import filters, kpis, quality
from marea.plans import views as V
from marea.plans.registry import query
from marea.plans.queries_core import R, rounded
from marea.session import shared_dir
from marea.sources import ingest, store


def scratch(spark) -> str:
    """A new folder under the one the session shares."""
    return f"{shared_dir(spark)}/marea/{uuid.uuid4().hex}"


def _raw(spark, d, of=None):
    """Survey rows as a file has them: odd headers, texts for numbers and dates; of: of these responses."""
    r = V.responses(spark, d) if of is None else of
    return r.select(F.date_format("ts", "yyyy-MM-dd").alias(" Fecha"), F.col("score").cast("int").cast("string").alias("nps"), F.col("channel").alias("CANAL"), F.concat(F.lit("  "), F.col("lever")).alias("palanca "), F.col("sublever").alias("Sub-palanca"), (F.col("order_id") * 10 + F.col("line_no")).cast("string").alias("ID"), F.col("part_id").alias("extra"))


@query("o_a01_ingest_counts", f"{V.BASE} SELECT count(DISTINCT order_id * 10 + line_no) AS rows FROM responses")
def o_a01b(spark, d):
    return ingest.responses(_raw(spark, d)).df.agg(F.count(F.lit(1)).alias("rows"))


@query("o_a08_lines_round_trip", f"{V.BASE} SELECT lever, count(*) AS n, {R('avg(score)', 'mean_score')} FROM responses WHERE day >= DATE '1996-01-01' GROUP BY lever")
def o_a08(spark, d):
    path = scratch(spark)
    r = V.responses(spark, d).select("ts", "lever", "score")
    store.write_lines(r, path)
    import datetime as dt

    got = store.read_lines(spark, path, "ts timestamp_ntz, lever string, score double", ["lever", "score"], start=dt.date(1996, 1, 1))
    return rounded(got.groupBy("lever").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))


@query("o_a09_partitioned_round_trip", f"WITH {V.EVENTS} SELECT channel AS lever, count(*) AS n, {R('avg(score)', 'mean_score')}, min(day) AS first_day FROM events_ WHERE day >= DATE '2024-01-03' GROUP BY channel")
def o_a09(spark, d):
    import datetime as dt

    path = scratch(spark)
    store.write_partitioned(V.events(spark, d).select("ts", F.col("channel").alias("lever"), "score"), path, candidates=["lever"])
    got = store.subset(spark.read.parquet(path), ["lever", "score", "event_day"], dt.date(2024, 1, 3))
    return rounded(got.groupBy("lever").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("event_day").alias("first_day")))


@query("o_a10_pushdown_scan", "SELECT count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01'")
def o_a10(spark, d):
    import datetime as dt

    return rounded(filters.in_period(V.table(spark, d, "lineitem"), dt.date(1996, 1, 1), dt.date(1996, 1, 31), ts="l_shipdate").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@query("o_a11_hot_subset", f"{V.BASE} SELECT lever, count(*) AS n FROM responses WHERE lever IN (SELECT min(lever) FROM responses) GROUP BY lever")
def o_a11(spark, d):
    r = V.responses(spark, d)
    first = r.agg(F.min("lever")).first()[0]
    return store.hot_subset(r, "responses", columns=["lever", "score"], levers=[first]).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("o_a12_compact_index", f"{V.BASE} SELECT day AS event_day, lever, channel, count(*) AS n, {R('avg(score)', 'nps_avg')}, {R('avg(CASE WHEN score >= 9 THEN 1.0 ELSE 0 END)', 'promoter_rate')}, {R('avg(CASE WHEN score <= 6 THEN 1.0 ELSE 0 END)', 'detractor_rate')}, {R('100 * (avg(CASE WHEN score >= 9 THEN 1.0 ELSE 0 END) - avg(CASE WHEN score <= 6 THEN 1.0 ELSE 0 END))', 'nps_classic')} FROM responses GROUP BY 1, 2, 3")
def o_a12(spark, d):
    return rounded(kpis.compact_index(V.responses(spark, d)))


@query("o_a13_period_catalogue", f"{V.BASE} SELECT DISTINCT year(day) AS year, month(day) AS month FROM responses")
def o_a13(spark, d):
    index = kpis.compact_index(V.responses(spark, d))
    return index.select(F.year("event_day").cast("long").alias("year"), F.month("event_day").cast("long").alias("month")).distinct()


def _batch(spark, d, odd):
    """Customers as records; in the second batch some are new and some changed."""
    c = V.table(spark, d, "customer").filter("c_custkey % 3 <> 0" if not odd else "c_custkey % 3 <> 1")
    payload = F.when(F.lit(odd) & (F.col("c_custkey") % 2 == 0), F.lit("changed")).otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").cast("string").alias("business_key"), F.sha2(payload, 256).alias("record_fingerprint"), payload.alias("payload"))


def _merged(spark, d):
    first, _ = store.merge(spark.createDataFrame([], store.RECORDS), _batch(spark, d, False), "u1")
    return store.merge(first, _batch(spark, d, True), "u2")


@query("o_a16_merge_snapshot", "SELECT CAST(c_custkey AS VARCHAR) AS business_key, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS payload, CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END AS times_seen FROM customer")
def o_a16(spark, d):
    return _merged(spark, d)[0].select("business_key", "payload", "times_seen")


@query("o_a16_merge_events", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'inserted' WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'duplicate_historical' END AS status, count(*) AS n FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1")
def o_a16b(spark, d):
    return _merged(spark, d)[1].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("o_a19_page", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 100")
def o_a19(spark, d):
    return store.page(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 100, 50).select("l_orderkey", "l_linenumber", "l_partkey")


@query("o_a20_serialised_rows", "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS record FROM customer")
def o_a20(spark, d):
    return store.serialise(V.table(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("o_a23_learning_log", "SELECT lang AS topic, count(*) AS n FROM documents GROUP BY lang")
def o_a23(spark, d):
    path = scratch(spark)
    V.table(spark, d, "documents").select(F.to_json(F.struct(F.col("lang").alias("topic"), F.lit("confirmed").alias("outcome"))).alias("value")).union(spark.createDataFrame([("{not json",)], "value string")).write.text(path)
    return store.learning_log(spark, path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("o_a24_keyed_cache", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation")
def o_a24(spark, d):
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    return store.upsert(n, n.filter("n_nationkey < 5").withColumn("n_name", F.lit("new")), "n_nationkey")


@query("o_b06_numeric_coercion", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS x FROM orders")
def o_b06(spark, d):
    from marea.functions.scores import number

    return V.table(spark, d, "orders").select("o_orderkey", number(F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))).alias("x"))


@query("o_b07_date_coercion", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def o_b07(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "nope").when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return V.table(spark, d, "orders").select("o_orderkey", filters.date_of(raw).cast("date").alias("day"))


@query("o_b09_auto_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS created_date, 'x' AS note_date FROM orders")
def o_b09(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date"), F.lit("x").alias("note_date"))
    return filters.date_columns(o).withColumn("created_date", F.col("created_date").cast("date"))


@query("o_b11_valid_rows", f"{V.BASE} SELECT count(*) AS n FROM responses WHERE score > 0")
def o_b11(spark, d):
    r = V.responses(spark, d).withColumn("score", F.when(F.col("score") > 0, F.col("score")).otherwise(float("nan")))
    return filters.valid_rows(r).agg(F.count(F.lit(1)).alias("n"))


@query("o_b30_categories", "SELECT p_partkey, CASE WHEN lower(p_type) = (SELECT min(lower(p_type)) FROM part) THEN 'First' ELSE p_type END AS category FROM part")
def o_b30(spark, d):
    p = V.table(spark, d, "part")
    first = p.agg(F.min(F.lower("p_type"))).first()[0]
    return p.select("p_partkey", X.category(F.concat(F.lit("  "), F.col("p_type")), {first: "First"}).alias("category"))


@query("o_d53_column_profile", "SELECT * FROM (SELECT 'c_custkey' AS \"column\", count(*) - count(c_custkey) AS missing, count(DISTINCT c_custkey) AS \"distinct\" FROM customer UNION ALL SELECT 'c_nationkey', count(*) - count(c_nationkey), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer)")
def o_d53(spark, d):
    return quality.profile(V.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), 0).select("column", "missing", "distinct")


@query("o_d54_pack_evidence", f"{V.BASE} SELECT count(*) AS n, {R('avg(score)', 'mean_score')} FROM responses WHERE lever = (SELECT min(lever) FROM responses)")
def o_d54(spark, d):
    r = V.responses(spark, d)
    pack = store.insight_pack(r.filter(F.col("lever") == r.agg(F.min("lever")).first()[0]).withColumn("comment", F.lit("x")), "slice", {"lever": "first"})
    e = pack["evidence"]
    return spark.createDataFrame([(e["n"], round(e["mean_score"], 6))], "n long, mean_score double")


@query("o_g02_ordered_distinct", "SELECT r_regionkey, 'b,a' AS names FROM region")
def o_g02(spark, d):
    return V.table(spark, d, "region").select("r_regionkey", F.array_join(X.split_list(F.lit(" b; a |b,\na")), ",").alias("names"))
