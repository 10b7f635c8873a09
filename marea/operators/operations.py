"""Operational metrics of incidents: owners, resolution times, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import text as X

MOST_WEEKS = 104


def incident_orgs(incidents: DataFrame) -> DataFrame:
    """incident_id, position and org (a listing split), and the weeks from opening to resolution (0 to 104, else null)."""
    weeks = F.datediff(F.col("resolved"), F.col("opened")) / 7.0
    orgs = X.split_list(F.col("orgs"))
    return incidents.select("incident_id", F.when(weeks.between(0, MOST_WEEKS), weeks).alias("weeks"), F.posexplode_outer(orgs).alias("pos", "org"))


def benchmark(incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean resolution weeks per org, and over all incidents."""
    rows = incident_orgs(incidents)
    return rows.filter("org is not null").groupBy("org").agg(F.avg("weeks").alias("eta_weeks"), F.count(F.lit(1)).alias("incidents")), rows.dropDuplicates(["incident_id"]).agg(F.avg("weeks").alias("eta_weeks"))


def topic_operations(topic_incidents: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per topic its owners in order, joined by a middle dot, and the mean of their expected weeks (else the overall mean)."""
    per_org, overall = benchmark(incidents)
    rows = topic_incidents.join(incident_orgs(incidents), "incident_id").join(per_org.select("org", F.col("eta_weeks").alias("org_weeks")), "org", "left")
    seen = rows.filter("org is not null").groupBy("topic", "org").agg(F.min(F.struct("incident_id", "pos")).alias("at")).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "org"))), lambda s: s["org"]), " · ").alias("owner"))
    eta = rows.groupBy("topic").agg(F.avg("org_weeks").alias("eta_weeks"))
    return eta.join(seen, "topic", "left").crossJoin(F.broadcast(overall.withColumnRenamed("eta_weeks", "all_weeks"))).select("topic", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("eta_weeks", "all_weeks").alias("eta_weeks"))


def enrich(table: DataFrame, operations: DataFrame, topic: str = "topic") -> DataFrame:
    """A table by topic with owner and weeks replaced where operations know them."""
    o = operations.select(F.col("topic").alias(topic), F.col("owner").alias("_owner"), F.col("eta_weeks").alias("_eta"))
    out = table.join(o, topic, "left")
    have = lambda c: F.col(c) if c in table.columns else F.lit(None)
    return out.withColumn("owner", F.coalesce(F.nullif("_owner", F.lit("")), have("owner"))).withColumn("eta_weeks", F.coalesce("_eta", have("eta_weeks"))).drop("_owner", "_eta")


def incident_urls(incidents: DataFrame, id_columns: list[str], base: str, url_column: str | None = None, record_column: str | None = None, order: str = "incident_id") -> DataFrame:
    """id -> address over all id columns, the first row of an id winning; a record's address goes before an explicit one."""
    explicit = F.when(X.is_url(F.col(url_column), F.lit(base)), X.text(F.col(url_column))) if url_column else F.lit(None).cast("string")
    built = X.url(F.lit(base), F.col(record_column)) if record_column else F.lit(None).cast("string")
    rows = incidents.select(F.col(order).alias("_o"), F.coalesce(built, explicit).alias("url"), F.posexplode(F.array(*(X.text(F.col(c)) for c in id_columns))).alias("_p", "id")).filter("id <> '' and url is not null")
    w = Window.partitionBy("id").orderBy("_o", "_p")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "url")
