"""Series, rationale, linking, chains, hotspots and changepoints on literal frames."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marea.operators import chains, changepoints, hotspots, linking, operations, rationale, series

WEEKS = [dt.date(2026, 1, 5) + dt.timedelta(weeks=i) for i in range(8)]
SERIES = "bucket date, topic string, responses int, nps_mean double, focus_rate double, incidents int"


def topic_series(spark):
    a = [(w, "Pagos > Error", 120, 8.0 - i / 4, 0.12 + i * 0.0157, 1 + i) for i, w in enumerate(WEEKS)]
    b = [(w, "Acceso > Login", 120, 8.0, 0.10, 2) for w in WEEKS]
    return spark.createDataFrame(a + b + [(WEEKS[0], "Raro", 5, 1.0, 1.0, 50)], SERIES)


def test_rationale(spark):
    rank = spark.createDataFrame([("Pagos > Error", 0.8, 0.9, 1, 0.7, 0.6), ("Acceso > Login", 0.2, 0.1, 3, 0.2, 0.1)], "topic string, score double, corr double, best_lag_weeks int, max_cp_stability double, incidents_lead_changepoint_share double")
    rows = rationale.rationale(topic_series(spark), rank).orderBy(F.desc("priority")).collect()
    assert [r.nps_topic for r in rows] == ["Pagos > Error", "Acceso > Login"] and rows[0].risk_points > rows[1].risk_points == 0 and rows[0].nps_delta_expected < 0 and rows[0].touchpoint == "Error"
    plain = rationale.rationale(topic_series(spark)).orderBy(F.desc("priority")).first()
    assert rows[0].confidence > plain.confidence
    up = topic_series(spark).withColumn("focus_rate", 1 - F.col("focus_rate"))
    assert rationale.rationale(up, focus="promoter").agg(F.max("risk_points")).first()[0] > 0
    assert rationale.rationale_summary(rationale.rationale(topic_series(spark))).first().topics == 2
    assert rationale.rationale(topic_series(spark).limit(0)).count() == 0


def test_action_plan(spark):
    rows = spark.createDataFrame([(0.8, 3.0, 0.7), (0.5, 1.0, 0.2), (0.2, 5.0, 0.2)], "p double, l double, s double")
    got = [tuple(r[0]) for r in rows.select(rationale.action_plan(F.col("p"), F.col("l"), F.col("s"))).collect()]
    assert got == [("Fix estructural", 6.0), ("Quick win operativo", 2.0), ("Instrumentación + validación", 3.0)]


def test_learned_factor(spark):
    log = spark.createDataFrame([("a", "confirmed", "x")] * 5 + [("b", "rejected", "x")] * 9 + [("a", "rejected", "y")], "topic string, outcome string, service_origin string")
    got = {r.topic: round(r.factor, 6) for r in rationale.learned_factors(log, service_origin="x").collect()}
    assert got == {"a": 1.5, "b": 0.3}


def test_lag_and_lead(spark):
    x = [1, 5, 2, 8, 3, 9, 1, 7, 2, 6, 4, 8]
    rows = [(dt.date(2026, 1, 5) + dt.timedelta(weeks=i), "t", v, float(x[i - 2]) if i > 1 else 0.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "bucket date, topic string, incidents int, focus_rate double")
    assert [(r.best_lag, round(r.corr, 6)) for r in series.best_lag(df).collect()] == [(2, 1.0)]
    flat = df.withColumn("incidents", F.lit(1))
    assert [(r.best_lag, r.corr, r.points) for r in series.best_lag(flat).collect()] == [(0, None, 0)]
    cps = spark.createDataFrame([("t", rows[6][0]), ("t", rows[0][0])], "topic string, changepoint date")
    assert [(r.n, r.lead_share) for r in series.lead_share(df, cps).collect()] == [(1, 1.0)]


def test_outer_series_and_gaps(spark):
    r = spark.createDataFrame([(dt.datetime(2026, 1, 5), 3.0)], "ts timestamp_ntz, score double")
    i = spark.createDataFrame([("1", dt.datetime(2026, 1, 14))], "incident_id string, ts timestamp_ntz")
    got = series.overall_series(r, i).orderBy("bucket").collect()
    assert [(x.responses, x.focus_rate, x.incidents) for x in got] == [(1, 1.0, 0), (0, 0.0, 1)]
    days = spark.createDataFrame([(dt.date(2026, 1, 1), 2, 1.0), (dt.date(2026, 1, 4), 1, 4.0), (dt.date(2026, 1, 5), 1, None)], "date date, n int, v double")
    assert [(x.n, x.v) for x in series.fill_days(days, ["n"], ["v"]).orderBy("date").collect()] == [(2, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 4.0)]


def test_linking(spark):
    d = dt.date
    comments = spark.createDataFrame([(1, d(2026, 1, 10), "Pagos", "error al pagar con tarjeta"), (2, d(2026, 1, 11), "Pagos", "pagar falla tarjeta"), (3, d(2026, 1, 12), "Login", "no puedo entrar login clave"), (4, d(2026, 1, 13), "Login", "login bloqueado"), (5, d(2026, 1, 13), "Login", None)], "comment_id long, ts date, topic string, text string")
    incidents = spark.createDataFrame([(7, d(2026, 1, 11), "fallo pagar tarjeta"), (8, d(2026, 1, 12), "login bloqueado clave"), (9, d(2026, 1, 1), "")], "incident_id long, ts date, text string")
    assigned, links = linking.link(incidents, comments, 0.01, 2)
    assert {(r.incident_id, r.topic) for r in assigned.collect()} == {(7, "Pagos"), (8, "Login")}
    got = links.collect()
    assert got and all(0.01 <= r.similarity <= 1.0000001 for r in got) and max(sum(r.incident_id == i for r in got) for i in (7, 8)) <= 2
    assert linking.link(incidents.limit(0), comments)[1].count() == 0
    labels = spark.createDataFrame([("Pagos tarjeta",), ("Login",)], "label string")
    assert {(r.id, r.label) for r in linking.match_labels(incidents, "incident_id", "text", labels).collect()} == {(7, "Pagos tarjeta"), (8, "Login")} or {(r.id, r.label) for r in linking.match_labels(incidents, "incident_id", "text", labels).collect()} == {(8, "Login")}


def test_operations(spark):
    d = dt.date
    rows = [("INC-1", d(2026, 1, 1), d(2026, 1, 8), "Producto, Tecnologia"), ("INC-2", d(2026, 1, 1), d(2026, 1, 15), "Operaciones"), ("INC-3", d(2026, 1, 1), None, "")]
    df = spark.createDataFrame(rows, "incident_id string, opened date, resolved date, orgs string")
    per, overall = operations.benchmark(df)
    assert {r.org: r.eta_weeks for r in per.collect()} == {"Producto": 1.0, "Tecnologia": 1.0, "Operaciones": 2.0} and overall.first()[0] == 1.5
    topics = spark.createDataFrame([("t", "INC-1"), ("t", "INC-2")], "topic string, incident_id string")
    r = operations.topic_operations(topics, df).first()
    assert r.owner == "Producto · Tecnologia · Operaciones" and abs(r.eta_weeks - 4 / 3) < 1e-9


def chain_rows(spark):
    rows = [(1, 10, 0.9, "Acceso > Login", "Acceso", "Login", 2.0, "no puedo entrar"), (2, 10, 0.8, "Acceso > Login", "Acceso", "Login", 2.0, "no puedo entrar"), (3, 11, 0.7, "Operativa > Pagos", "Operativa", "Pagos", 5.0, "pago falla"), (4, 12, 0.9, "nan", "Operativa", "Pagos", 5.0, "pago falla"), (5, 13, 0.9, "Operativa > Pagos", "Operativa", "Pagos", 5.0, "sin comentarios")]
    df = spark.createDataFrame(rows, "incident_id long, comment_id long, similarity double, topic string, lever string, sublever string, score double, comment string")
    return df.withColumn("incident_text", F.col("comment")).withColumn("service_n2", F.lit("NET")).withColumn("incident_ts", F.lit("2026-01-01")).withColumn("comment_ts", F.lit("2026-01-02"))


def test_chains(spark):
    empty = rationale.rationale(topic_series(spark).limit(0))
    got = {r.entity: r for r in chains.chains(chain_rows(spark), empty).collect()}
    assert {k: (v.linked_pairs, v.linked_incidents, v.linked_comments) for k, v in got.items()} == {"Login": (2, 2, 1), "Pagos": (1, 1, 1)}
    assert got["Login"].incident_records[0].incident_id == 1 and got["Login"].source_topics == ["Acceso > Login"]
    one = chains.chains(chain_rows(spark), empty, "service").collect()
    assert [(r.entity, r.touchpoint) for r in one] == [("NET", "NET")]
    assert chains.chain_totals(chains.chains(chain_rows(spark), empty)).first().pairs == 3
    assert {(r.topic, r.entity) for r in chains.topic_map(chain_rows(spark)).collect()} == {("Acceso > Login", "Login"), ("Operativa > Pagos", "Pagos")}
    j = chains.match_journeys(chain_rows(spark), ["incident_id"], ["comment", "topic"], chains.journey_catalogue(spark))
    assert {(r.incident_id, r.title) for r in j.collect()} >= {(1, "Acceso bloqueado"), (3, "Operativa crítica fallida")}
    assert chains.chains(chain_rows(spark).limit(0), empty).count() == 0


def test_hotspots(spark):
    d = dt.date
    inc = spark.createDataFrame([(1, d(2026, 2, 1), "fallo transferencias"), (2, d(2026, 2, 2), "transferencia lenta"), (3, d(2026, 2, 2), "otra transferencia")], "incident_id long, day date, text string")
    com = spark.createDataFrame([(9, d(2026, 2, 1), "mi transferencia falla", 1.0), (8, d(2026, 2, 2), "transferencias", 4.0)], "comment_id long, day date, text string, score double")
    links = spark.createDataFrame([(2, 9, "Pagos", 0.9)], "incident_id long, comment_id long, topic string, similarity double")
    hot = hotspots.hot_terms(inc, com, 2)
    assert hot.first().term.startswith("transfer") and sum(r.term.startswith("transfer") for r in hot.collect()) == 1
    t = hotspots.timeline(hot, inc, com)
    e = hotspots.evidence(hot, inc, com, links)
    s = hotspots.summary(e, t).first()
    assert s.chart_incidents == t.agg(F.sum("incident_records")).first()[0] and s.linked_comments in (0, 1)
    daily = spark.createDataFrame([(d(2026, 2, 1), 3), (d(2026, 2, 2), 2)], "day date, incidents int")
    ranked = spark.createDataFrame([(d(2026, 2, 1), i, 1) for i in (1, 2, 3)] + [(d(2026, 2, 2), 4, 1), (d(2026, 2, 2), 5, 2), (d(2026, 2, 2), 5, 3)], "day date, incident_id int, hot_rank int")
    got = [(r.hotspot_1, r.hotspot_2, r.no_hotspot) for r in hotspots.daily_breakdown(daily, ranked).orderBy("day").collect()]
    assert got == [(3, 0, 0), (1, 1, 0)]


def test_changepoints(spark):
    rows = [(dt.date(2026, 1, 5) + dt.timedelta(weeks=i), "t", 0.1 if i < 10 else 0.5) for i in range(20)] + [(dt.date(2026, 1, 5), "short", 0.1)]
    df = spark.createDataFrame(rows, "bucket date, topic string, focus_rate double")
    assert changepoints.changepoints(df).count() == 0  # a rate's errors are below the penalty
    got = changepoints.stable_changepoints(df, draws=50, scale=100.0).collect()
    assert [(r.topic, r.changepoint) for r in got] == [("t", dt.date(2026, 3, 9))]
    assert 0 <= got[0].stability <= 1 and got[0].max_stability == got[0].stability and got[0].max_confidence == got[0].confidence
    assert got == changepoints.stable_changepoints(df.orderBy(F.rand()), draws=50, scale=100.0).collect()
    x = np.r_[np.zeros(20), np.ones(20) * 9]
    assert changepoints.breaks(x, 6.0) == [20] and changepoints.breaks(np.zeros(20), 6.0) == []
