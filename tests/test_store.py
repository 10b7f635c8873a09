"""Ingestion, merge and stores on literal frames; the driver contract."""

import datetime as dt
import json
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from marea.sources import ingest, store


def test_ingest_with_drift(spark):
    row = ("SUB", "Chrome", 10, "abc", "Pagos", "Web", "9", "2026-01-01", "u")
    df = spark.createDataFrame([row, row], ["subpalanca ", "Browser", "Comentario", "ID", "Palanca", "Canal", "NPS", "Fecha", "odd"])
    got = ingest.responses(df)
    r = got.df.first()
    assert not got.failed and got.meta == {"rows": 1, "duplicate_rows_in_file": 1} and (r.Comment, r["NPS Group"], json.loads(r.extra_payload)) == ("10", "PROMOTOR", {"odd": "u"})
    assert ("WARN", "extra_columns_detected") in [i[:2] for i in got.issues]


def test_ingest_errors(spark):
    got = ingest.responses(spark.createDataFrame([("2026-01-01", 9, "Web")], ["Fecha", "NPS", "Canal"]))
    assert got.failed and [i[3] for i in got.issues] == ["Palanca", "Subpalanca"]
    cols = "Fecha string, NPS string, Canal string, Palanca string, Subpalanca string, service_origin string"
    two = spark.createDataFrame([("2026-01-01", "9", "w", "p", "s", "A"), ("2026-01-01", "9", "w", "p", "s", "B")], cols)
    assert [i[1] for i in ingest.responses(two).issues] == ["ambiguous_context"] and ingest.responses(two, "A").df.count() == 1
    bad = spark.createDataFrame([("x", "9", "w", "p", "s", "A"), ("2026-01-01", "y", "w", "p", "s", "A")], cols)
    assert [i[1] for i in ingest.responses(bad).issues] == ["invalid_dates", "invalid_scores", "no_valid_rows"]


def test_incident_context(spark):
    df = spark.createDataFrame([("B", "N", "SN2X", "2026-01-01"), ("B", "N", "SN2X, SN2Y", "2026-01-01"), ("C", "N", "SN2X", "2026-01-01")], ["company", "N1", "N2", "CreatedDate"])
    got = ingest.incidents(df, "B", "N", "SN2X")
    assert got.df.count() == 1 and got.df.first().Fecha.date() == dt.date(2026, 1, 1)
    assert [i[1] for i in ingest.incidents(df, "Z", "N").issues] == ["no_rows_in_context"] and ingest.incidents(df.drop("N1")).failed


def test_csv_sources(spark, tmp_path):
    (tmp_path / "i.csv").write_text("opened_at,closed_at,incident_id,category,severity,system,description,channel,geo\n2026-01-01,,1,c,s,y,d,w,g\nbad,,2,c,s,y,d,w,g\n")
    got = ingest.incidents_csv(spark, str(tmp_path / "i.csv"))
    assert got.df.count() == 2 and [i[1] for i in got.issues] == ["invalid_dates"]
    (tmp_path / "r.csv").write_text("store,date,rating,text,app_version,geo\na,2026-01-01,5,t,1,g\n")
    assert ingest.reviews_csv(spark, str(tmp_path / "r.csv")).df.first().rating == 5.0


def test_merge_is_idempotent(spark, tmp_path):
    batch = spark.range(1105).select(F.concat(F.lit("id-"), "id").alias("business_key"), F.sha2(F.col("id").cast("string"), 256).alias("record_fingerprint"), F.lit("{}").alias("payload"))
    s = store.RecordStore(spark, f"file://{tmp_path}/s")
    assert s.upload(batch, "c", "h1") == "completed" and s.current().count() == 1105
    assert s.upload(batch, "c", "h1") == "duplicate_upload" and s.upload(batch, "c", "h2") == "completed"
    last = s.uploads().filter("status = 'completed'").orderBy(F.desc("at")).first()
    assert (last.inserted, last.updated, last.duplicates) == (0, 0, 1105) and s.current().agg(F.max("times_seen")).first()[0] == 2
    assert s.seen("c", "h2") and not s.seen("d", "h2")


def test_artifacts_and_keys(spark, tmp_path):
    df = spark.createDataFrame([(9.0, "bien"), (2.0, None)], "score double, comment string")
    pack = store.insight_pack(df, "T", {"a": 1})
    folder = store.artifacts(str(tmp_path), "d", "v1", "ctx", {"n": 2}, {pack["id"]: pack})
    assert json.load(open(f"{folder}/manifest.json"))["insights"] == [pack["id"]] and pack["verbatims"] == ["bien"]
    assert store.context_key("A", "b", "x, y") == store.context_key("A", "b", "y,x ")


def test_reviews_source(spark, tmp_path):
    from marea.sources.reviews import ReviewsSource

    (tmp_path / "a.json").write_text(json.dumps([{"store": "s", "rating": 4, "text": "ok"}]))
    spark.dataSource.register(ReviewsSource)
    assert spark.read.format("reviews").option("paths", str(tmp_path / "a.json")).load().first().rating == 4.0


def test_streaming_daily_metrics(spark, tmp_path):
    from marea.streaming import incremental

    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), 9.0), (dt.datetime(2026, 1, 1), 2.0), (dt.datetime(2026, 1, 9), 2.0)], "ts timestamp, score double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.daily_metrics(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.nps_classic) for r in spark.table("daily").collect()) == [(1, -100.0), (2, 0.0)]


def test_entry_without_the_optional_parts():
    import subprocess

    code = textwrap.dedent("""
        import sys, importlib.abc
        class Gone(importlib.abc.MetaPathFinder):
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("marea.llm"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        names = e.queries()
        assert "driver_table" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")], names
        assert set(e.oracle_sql()) <= set(names)
    """)
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.parametrize("name", ["driver_table", "o_d16_rationale"])
def test_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_hot_subset_follows_the_data(spark):
    one = spark.createDataFrame([("a", 1)], "lever string, score int")
    more = spark.createDataFrame([("a", 1), ("a", 2)], "lever string, score int")
    assert store.hot_subset(one, "x", columns=["score"], levers=["a"]).count() == 1
    assert store.hot_subset(more, "x", columns=["score"], levers=["a"]).count() == 2
    assert store.hot_subset(more, "x", columns=["score"], levers=["b"]).count() == 0
    assert store.hot_subset(more, "x", columns=["score"], levers=["b"]) is store.hot_subset(more, "x", columns=["score"], levers=["b"])


def test_streams_don_t_pass_for_each_other(spark, tmp_path):
    """Two streams with batches of the same numbers are both merged; of a key's rows the largest in order counts."""
    from marea.streaming import incremental

    s = store.RecordStore(spark, f"file://{tmp_path}/s")
    schema = "business_key string, record_fingerprint string, payload string"
    for name, rows in (("one", [("k1", "f1", "p1"), ("k1", "f2", "p2")]), ("two", [("k2", "f3", "p3")])):
        spark.createDataFrame(rows, schema).write.json(f"file://{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/{name}")
        incremental.merge_into(stream, s, "c", f"file://{tmp_path}/{name}-state").awaitTermination()
    assert sorted((r.business_key, r.payload) for r in s.current().collect()) == [("k1", "p2"), ("k2", "p3")]


def test_each_module_imports_alone():
    import subprocess

    for name in ("queries_core", "queries_linking", "queries_more", "queries_store", "catalogue"):
        assert subprocess.run([sys.executable, "-c", f"import marea.plans.{name}"], capture_output=True, check=False).returncode == 0


def test_hash_sum_of_many_rows(spark):
    """More rows than a long holds hashes of 40 bits for."""
    from marea.plans import batch

    rows = spark.range(20_000_000).select(F.col("id").alias("_business_key"), F.lit(1).alias("_record_fingerprint"))
    n, total = batch._shape(rows)
    assert n == 20_000_000 and 2**63 < total < n * 2**40
