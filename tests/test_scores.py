"""Scores, drivers and periods on literal frames."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X
from marea.operators import drivers, filters, kpis, quality

D = dt.datetime


def test_groups_by_label_or_score(spark):
    df = spark.createDataFrame([(10.0, "Promoter"), (8.0, "Neutral"), (6.0, "Detractor"), (None, "Promoter"), (9.0, "Detractor"), (float("nan"), None)], "score double, label string")
    df = df.withColumn("score", S.number(F.col("score")))
    n = lambda g: filters.in_group(df, g).count()
    assert (n("Detractores"), n("promoters"), n("pasivos"), n("Todos"), n("")) == (2, 3, 1, 6, 6)


def test_bands(spark):
    df = spark.createDataFrame([(6.5,), (8.5,), (6.0,), (9.0,), (None,)], "score double")
    rows = df.select(S.band_label(F.col("score")), S.promoter(F.col("score")), S.passive(F.col("score")), S.detractor(F.col("score"))).collect()
    assert [r[0] for r in rows] == ["PASIVO", "PASIVO", "DETRACTOR", "PROMOTOR", None]
    assert not any(rows[0][1:]) and not any(rows[1][1:])


def test_daily_metrics(spark):
    df = spark.createDataFrame([(D(2026, 1, 1), 10.0), (D(2026, 1, 1), 6.0), (D(2026, 1, 2), 7.0), (D(2026, 1, 2), 9.0), (None, 3.0), (D(2026, 1, 2), None)], "ts timestamp_ntz, score double")
    got = kpis.daily_metrics(df).orderBy("date").collect()
    assert len(got[0]) == 10 and (got[0].n, got[0].nps_classic, got[1].n, got[1].nps_mean) == (2, 0.0, 2, 8.0)
    assert kpis.daily_metrics(df, lookback=1).count() == 1 and kpis.daily_metrics(df.limit(0)).count() == 0


def test_focus_rates_keep_rows_without_score(spark):
    df = spark.createDataFrame([(D(2026, 1, 1), 10.0, "Promoter"), (D(2026, 1, 1), 6.0, "Detractor"), (D(2026, 1, 2), 8.0, "Passive"), (D(2026, 1, 2), None, None)], "ts timestamp_ntz, score double, label string")
    a, b = kpis.focus_rates(df).orderBy("bucket").collect()
    assert (a.responses, a.promoter_rate, a.detractor_rate, b.responses, b.passive_rate) == (2, 0.5, 0.5, 2, 0.5)


def test_period_kpis(spark):
    rows = [(D(2026, 1, 1), 0.0), (D(2026, 1, 1), 0.0), (D(2026, 2, 1), 10.0), (D(2026, 2, 1), 0.0), (D(2026, 3, 1), 10.0), (D(2026, 3, 1), 10.0), (D(2026, 3, 31), 0.0), (D(2026, 3, 31, 9), 0.0)]
    df = spark.createDataFrame([(t, s, "x" if i < 7 else " ") for i, (t, s) in enumerate(rows)], "ts timestamp_ntz, score double, comment string")
    got = {r.block: r for r in kpis.period_kpis(df, dt.date(2026, 3, 1), dt.date(2026, 3, 31), "comment").collect()}
    assert (got["history"].nps_classic, got["period"].mean_score, got["period"].nps_classic, got["period"].comments, got["cumulative"].nps_classic, got["period"].nps_classic_delta) == (-50.0, 5.0, 0.0, 3, -25.0, 50.0)
    ends = {r.boundary: r.nps_classic for r in kpis.boundary_kpis(df.filter("ts >= date'2026-03-01'")).collect()}
    assert ends == {"first": 100.0, "last": -100.0}
    assert kpis.period_kpis(df.limit(0), dt.date(2026, 3, 1), dt.date(2026, 3, 31)).count() == 3


def test_last_day_of_a_period(spark):
    df = spark.createDataFrame([(D(2026, 3, 31), 1.0), (D(2026, 3, 31, 9), 1.0)], "ts timestamp_ntz, score double")
    a, b, m = filters.period_bounds(2026, 3)
    assert filters.in_period(df, a, b, m).count() == 2 and filters.in_period(df, a, b, m, "midnight").count() == 1
    assert filters.period_bounds("Todos", 2) == (None, None, 2) and filters.period_bounds(2024, "Todos")[1] == dt.date(2024, 12, 31)


def test_windows():
    w = filters.windows(dt.date(2026, 1, 5), dt.date(2026, 3, 8))
    assert w == {"current": (dt.date(2026, 3, 1), dt.date(2026, 3, 8)), "baseline": (dt.date(2026, 1, 5), dt.date(2026, 2, 28))}
    assert filters.windows(dt.date(2025, 11, 14), dt.date(2026, 2, 22), 2026, 2)["baseline"] == (dt.date(2025, 11, 14), dt.date(2026, 1, 31))
    assert filters.windows(None, None) == {}


def test_drivers(spark):
    df = spark.createDataFrame([(10.0, "A"), (9.0, "A"), (10.0, "A"), (5.0, "B"), (6.0, "B"), (8.0, "B"), (None, None)], "score double, lever string")
    got = drivers.driver_table(df, "lever").collect()
    assert [(r.value, r.n, r.nps) for r in got] == [("A", 3, 100.0), ("B", 3, -200 / 3), (None, 1, None)]
    assert [r.value for r in drivers.opportunities(df, ["lever"], 3).collect()] == ["B"]
    assert drivers.driver_table(df.limit(0), "lever").count() == 0


def test_historic_changes(spark):
    rows = lambda xs: spark.createDataFrame([(float(s), v) for v, ss in xs.items() for s in ss * 3], "score double, lever string")
    current, base = rows({"A": [6, 7, 8, 9], "B": [6, 7, 8, 8], "C": [3, 4, 5, 6]}), rows({"A": [8, 8, 9, 9], "B": [9, 9, 10, 8], "C": [6, 7, 7, 8]})
    got = drivers.historic_changes(current, base, "lever", 10).collect()
    assert [(r.value, r.delta_nps) for r in got] == [("C", -2.5), ("B", -1.75), ("A", -1.0)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 10)), max_size=12))
def test_rates_are_bounded(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    r = kpis.score_summary(df).first()
    assert 0 <= r.promoter_rate + r.passive_rate + r.detractor_rate <= 1 + 1e-9 and -100 <= r.nps_classic <= 100


def test_text(spark):
    df = spark.createDataFrame([("  Ñandú   ÁRBOL> x ", "nan > N/A", "Transferencias", " b,a , b", "No puedo, ¡gracias!")], "a string, b string, c string, d string, e string")
    r = df.select(X.fold(F.col("a")).alias("a"), X.generic(F.col("b")).alias("b"), X.generic(F.col("a")).alias("g"), X.stem(F.col("c")).alias("c"), X.token_set(F.col("d")).alias("d"), X.tones(F.col("e")).alias("e"), X.topic(F.lit("Pagos"), F.lit(" ")).alias("t"), X.slug(F.col("a")).alias("s")).first()
    assert tuple(r) == ("nandu arbol> x", True, False, "transferencia", "a,b", ["aprecio", "frustracion"], "Pagos", "nandu-arbol-x")


def test_dates_and_epochs(spark):
    df = spark.createDataFrame([("1767225600",), ("1767225600000",), ("1767225600000000",), ("2026/01/01",), ("2026-01-01",), ("nope",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(filters.date_or_epoch(F.col("x")).cast("date")).collect()] == [dt.date(2026, 1, 1)] * 5 + [None] * 3


def test_profile_and_outliers(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, None), (100.0, "b"), (1.0, "a")], "x double, c string")
    got = {r.column: r for r in quality.profile(df).collect()}
    assert (got["c"].missing, got["c"].distinct, got["x"].missing_share) == (1, 2, 0.0)
    assert filters.outliers(df, "x", 1.5).count() == 1 and filters.outliers(df.filter("x = 1"), "x").count() == 0
    many = spark.range(10).selectExpr("9 - id as x", "cast(null as string) as c").union(spark.range(2).selectExpr("id", "'q'"))
    got = {r.column: r.samples for r in quality.profile(many).collect()}
    assert got == {"x": ["0", "1", "2", "3", "4"], "c": ["q"]}


def test_fold(spark):
    df = spark.createDataFrame([("Őszi Škoda ﬁn",), ("ÑANDÚ ½ ﬄ",), ("ascii",), (None,), ("it\uff07s", ), ("a … b…½½ №7 ™",), ("'quoted' \uff07½\uff07",)], "x string")
    import unicodedata

    want = [unicodedata.normalize("NFKD", (r[0] or "").lower()).encode("ascii", "ignore").decode() for r in df.collect()]
    assert [r[0] for r in df.select(X.fold(F.col("x"))).collect()] == want
