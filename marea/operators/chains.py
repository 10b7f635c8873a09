"""Evidence chains from incident to comment to score, by lever, sublever, service or journey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.session import settle, small

#: Journeys that a catalogue holds at most where it is sent to every task; they are written by hand.
CATALOGUE = 1_000
#: The entity of each mode.
MODES = {"lever": "lever", "sublever": "sublever", "service": "service_n2", "journeys": "journey_id", "broken_journeys": "journey_id"}

# The journeys that are there without a catalogue file, with the word stems that show them.
JOURNEYS = [
    ("executive_access_blocked", "Acceso bloqueado", "Login / autenticación", "Acceso", "Bloqueo / OTP", "Muy alto", "Alto", ["acceso", "login", "autentic", "entrar", "ingresar", "sesion", "otp", "codigo", "credencial", "desloguea", "acceder"]),
    ("executive_critical_operation_failed", "Operativa crítica fallida", "Transferencias / pagos / firma", "Operativa", "Error funcional / timeout", "Alto", "Alto", ["transfer", "pago", "firma", "firmar", "operacion", "operativa", "transaccion", "transacciones", "spei", "deposito", "retiro", "completar", "timeout"]),
    ("executive_degraded_performance", "Rendimiento degradado", "Lentitud / cuelgues", "Uso recurrente", "Degradación del servicio", "Medio-alto", "Medio", ["lento", "lenta", "lentitud", "cuelga", "cuelgue", "cuelgues", "bloqueada", "bloqueado", "performance", "rendimiento", "carga", "cargar", "tarda", "demora"]),
]
JOURNEY_SCHEMA = "journey_id string, title string, touchpoint string, lever string, sublever string, impact_label string, confidence_label string, keywords array<string>"


def journey_catalogue(spark, rows: list[tuple] | None = None) -> DataFrame:
    """The journeys, in order; ids are made unique by -02, -03, ..."""
    seen: dict[str, int] = {}
    out = []
    for i, r in enumerate(rows or JOURNEYS):
        seen[r[0]] = seen.get(r[0], 0) + 1
        out.append((i, r[0] if seen[r[0]] == 1 else f"{r[0]}-{seen[r[0]]:02d}", *r[1:]))
    return spark.createDataFrame(out, f"position int, {JOURNEY_SCHEMA}")


def match_journeys(rows: DataFrame, id_: list[str], texts: list[str], catalogue: DataFrame) -> DataFrame:
    """The journey with most of its keywords in a row's texts (ties: the first); rows without any have none."""
    hay = X.attribution(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts)))
    hits = F.aggregate("keywords", F.lit(0), lambda n, k: n + F.when(F.contains(F.col("hay"), k), 1).otherwise(0))
    pairs = rows.select(*id_, hay.alias("hay")).join(small(catalogue.withColumn("keywords", F.transform("keywords", X.fold)), CATALOGUE)).withColumn("hits", hits).filter("hits > 0")
    w = Window.partitionBy(*id_).orderBy(F.desc("hits"), "position")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*id_, "journey_id", "title", "touchpoint", "hits")


def enrich_links(links: DataFrame, responses: DataFrame, incidents: DataFrame) -> DataFrame:
    """Links with both sides' columns; a link's topic, else the response's; the most similar, latest row of each pair."""
    r = responses.select("comment_id", F.col("ts").alias("comment_ts"), "score", "lever", "sublever", "comment")
    i = incidents.select("incident_id", F.col("ts").alias("incident_ts"), "incident_text", "service_n2")
    both = links.join(r, "comment_id").join(i, "incident_id")
    both = both.withColumn("topic", F.coalesce(F.nullif(X.text(F.col("topic")), F.lit("")), X.topic(F.col("lever"), F.col("sublever"))))
    w = Window.partitionBy("incident_id", "comment_id").orderBy(F.desc("similarity"), F.desc_nulls_last("comment_ts"), "topic")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def touchpoint(mode: str) -> Column:
    """What a customer touches, by mode: the sublever (lever mode too), the service, or the journey's own."""
    name = {"lever": "sublever", "sublever": "sublever", "service": "service_n2"}.get(mode, "touchpoint")
    return F.when(~X.generic(F.col(name)), X.text(F.col(name))).otherwise("")


def entity(mode: str) -> str:
    return MODES[mode]


def sound(enriched: DataFrame, mode: str) -> DataFrame:
    """Pairs that say something: ids, a comment, a topic and a touchpoint that are not generic."""
    rows = enriched.withColumn("touchpoint_", touchpoint(mode))
    return rows.filter((X.text(F.col("incident_id")) != "") & (X.text(F.col("comment_id")) != "") & ~X.generic(F.col("comment")) & ~X.generic(F.col("topic")) & (F.col("touchpoint_") != ""))


def chains(enriched: DataFrame, rationale: DataFrame, mode: str = "sublever", top: int = 10, incident_examples: int = 5, comment_examples: int = 2) -> DataFrame:
    """One row an entity: counts, dominant labels, rationale measures, and its best examples of both sides."""
    key = entity(mode)
    rows = sound(enriched, mode)
    measures = rationale.select(F.col("nps_topic").alias("topic"), "risk_points", "priority", "confidence", "causal_score", "total_impact", "nps_delta_expected").dropDuplicates(["topic"])
    at = settle(rows.join(small(measures), "topic", "left").withColumn("entity", F.col(key)))
    # sums by entity need no shuffle of rows, so what does (distinct ids) is counted apart from them
    per = at.groupBy("entity").agg(
        F.avg("similarity").alias("avg_similarity"), F.avg("score").alias("avg_nps"),
        F.max("risk_points").alias("risk_points"), F.max("priority").alias("priority"), F.max("confidence").alias("confidence"), F.max("causal_score").alias("causal_score"), F.max("total_impact").alias("total_impact"), F.avg("nps_delta_expected").alias("nps_delta_expected"),
    )

    def mode(column: str, name: str):
        # the most frequent value, the smallest of equals; null where there is none
        told = at.groupBy("entity", column).agg(F.count(F.lit(1)).alias("n"))
        return told.groupBy("entity").agg(F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col("n")).alias("n"), column)))[column].alias(name))

    pairs = at.select("entity", "incident_id", "comment_id").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("linked_pairs"))

    def examples(distinct: str, fields: list[str], order: list, n: int, name: str, number: str):
        # the best row of each id by a partial aggregate, then the first n of an entity, cut before they are shuffled
        best = at.groupBy("entity", distinct).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("f"))).alias("best"))
        w = Window.partitionBy("entity").orderBy("best")
        chosen = best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
        shown = chosen.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("best.f").alias("f")))), lambda s: s["f"]).alias(name))
        return shown.join(at.select("entity", distinct).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias(number)), "entity")

    latest = F.struct(F.col("incident_ts").isNull(), -F.unix_date(F.col("incident_ts").cast("date")), -F.unix_micros(F.col("incident_ts").cast("timestamp")))
    inc = examples("incident_id", ["incident_id", "similarity", "incident_ts"], [-F.col("similarity"), latest, F.col("incident_id")], incident_examples, "incident_records", "linked_incidents")
    com = examples("comment_id", ["comment_id", "score", "similarity"], [F.struct(F.col("score").isNull(), F.col("score")), -F.col("similarity"), F.col("comment_id")], comment_examples, "comment_records", "linked_comments")
    story = F.concat(F.lit("Incidencias -> "), F.col("touchpoint"), F.lit(" -> "), F.col("entity"), F.lit(" -> Comentario -> NPS"))
    out = per.join(pairs, "entity").join(inc, "entity").join(com, "entity").join(mode("topic", "topic"), "entity").join(mode("touchpoint_", "touchpoint"), "entity").join(source_topics(at, "entity"), "entity")
    told = ["linked_pairs", "linked_incidents", "linked_comments", "topic", "touchpoint"]
    out = out.select("entity", *told, *(c for c in out.columns if c not in ("entity", *told))).withColumn("story", story)
    return out.orderBy(F.desc_nulls_last("priority"), F.desc("linked_pairs"), F.desc_nulls_last("causal_score"), F.desc_nulls_last("total_impact"), "entity").limit(top)


def source_topics(rows: DataFrame, by: str) -> DataFrame:
    """The topics of each group by pairs, then mean similarity, then name."""
    per = rows.groupBy(by, "topic").agg(F.count_distinct("incident_id", "comment_id").alias("pairs"), F.avg("similarity").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("pairs")).alias("p"), (-F.col("s")).alias("s"), "topic")))
    return per.groupBy(by).agg(F.transform(ordered, lambda x: x["topic"]).alias("source_topics"))


def chain_totals(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("chains"), F.count_distinct("topic").alias("topics"), F.coalesce(F.sum("linked_incidents"), F.lit(0)).alias("incidents"), F.coalesce(F.sum("linked_comments"), F.lit(0)).alias("comments"), F.coalesce(F.sum("linked_pairs"), F.lit(0)).alias("pairs"))


def topic_map(enriched: DataFrame, mode: str = "sublever") -> DataFrame:
    """The entity of each topic: most pairs, then highest mean similarity."""
    per = sound(enriched, mode).groupBy("topic", F.col(entity(mode)).alias("entity")).agg(F.count_distinct("incident_id", "comment_id").alias("pairs"), F.avg("similarity").alias("similarity"))
    w = Window.partitionBy("topic").orderBy(F.desc("pairs"), F.desc("similarity"), "entity")
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def remap_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links with the entity in place of their topic; topics without one are left out."""
    return links.join(small(mapping.select("topic", "entity")), "topic").withColumn("topic", F.col("entity")).drop("entity")


def remap_series(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """A topic series by entity: sums, the mean score weighted by responses, the rate from the sums."""
    m = series.join(small(mapping.select("topic", "entity")), "topic")
    w = F.when(F.col("nps_mean").isNotNull(), F.col("responses"))
    out = m.groupBy("bucket", F.col("entity").alias("topic")).agg(F.sum("responses").alias("responses"), F.sum("focus_count").alias("focus_count"), F.try_divide(F.sum(w * F.col("nps_mean")), F.sum(w)).alias("nps_mean"), F.sum("incidents").alias("incidents"))
    return out.withColumn("focus_rate", F.coalesce(F.try_divide(F.col("focus_count").cast("double"), F.col("responses")), F.lit(0.0)))


def remap_by_pair(links: DataFrame, journeys: DataFrame) -> DataFrame:
    """Links under the journey of their pair."""
    return links.join(journeys.select("incident_id", "comment_id", "journey_id"), ["incident_id", "comment_id"])


def entity_summary(enriched: DataFrame, mode: str = "sublever") -> DataFrame:
    rows = sound(enriched, mode)
    out = rows.groupBy(F.col(entity(mode)).alias("entity")).agg(F.count_distinct("incident_id", "comment_id").alias("linked_pairs"), F.count_distinct("incident_id").alias("linked_incidents"), F.count_distinct("comment_id").alias("linked_comments"), F.avg("score").alias("avg_nps"))
    return out.orderBy(F.desc("linked_pairs"), "avg_nps", "entity")


def capped(table: DataFrame, incidents: int = 5, comments: int = 2) -> DataFrame:
    """At most so many records a chain; 0: all."""
    for c, n in (("incident_records", incidents), ("comment_records", comments)):
        table = table.withColumn(c, F.slice(c, 1, n)) if n else table
    return table


def chain_keys(table: DataFrame) -> DataFrame:
    """A short key of what a chain is about."""
    return table.withColumn("chain_key", F.substring(F.sha1(F.to_json(F.struct("entity", "topic", "touchpoint"))), 1, 12))


def dominant(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group that is not generic; equals: the smallest."""
    per = df.filter(~X.generic(F.col(label))).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), label)
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").select(by, F.col(label).alias("label"), "n")


def impact_label(pairs: Column, mean: Column) -> Column:
    return F.when((pairs >= 10) | (mean <= 2), "Muy alto").when((pairs >= 6) | (mean <= 4), "Alto").when(pairs >= 3, "Medio").otherwise("Bajo")


def confidence_label(cohesion: Column, similarity: Column) -> Column:
    return F.when((cohesion >= 0.72) & (similarity >= 0.85), "Alto").when((cohesion >= 0.55) & (similarity >= 0.75), "Medio").otherwise("Bajo")


def scenarios(table: DataFrame, top: int = 3) -> DataFrame:
    """The chains that a report tells."""
    return table.orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("risk_points"), F.desc_nulls_last("confidence"), F.desc("linked_pairs"), F.desc("linked_incidents"), F.desc("linked_comments"), "entity").limit(top)
