"""The batch entry: for each context, from the survey file to KPIs, drivers, routes, prioritised packs and a manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators import drivers, kpis, rationale
from marea.sources import ingest, store

PIPELINE_VERSION = "1"
#: Rows of a driver table that go into the artifact.
SHOWN = 50


@dataclass
class Run:
    """One context and its sources; responses as a file has them, incidents and reviews may be missing."""

    responses: DataFrame
    origin: str
    n1: str
    n2: str = ""
    incidents: DataFrame | None = None
    reviews: DataFrame | None = None
    dimensions: tuple[str, ...] = ("Palanca", "Subpalanca", "Canal")
    top_packs: int = 3
    min_n: int = 200
    sources: dict[str, str] = field(default_factory=dict)


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [r.asDict() for r in df.limit(most).collect()]


def _shape(rows: DataFrame) -> tuple[int, int]:
    """The number of rows and the sum of their hashes of 40 bits, whatever their order; a long holds 2^23 of these hashes for sure, so they are summed as decimals."""
    hashes = F.pmod(F.xxhash64("_business_key", "_record_fingerprint"), F.lit(1 << 40)).cast("decimal(13,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(hashes)).first()
    return n, int(total or 0)


def _pack(spark: SparkSession, rows: DataFrame, top, context: dict, controls: list[str]) -> dict:
    """An insight pack of one value, with its effect on being a detractor beside the other columns held fixed."""
    own = rows.filter(F.col(f"`{top.dimension}`").cast("string") == top.value)
    pack = store.insight_pack(own, f"Oportunidad priorizada: {top.dimension}={top.value}", context | {"driver_dim": top.dimension, "driver_val": top.value}, "NPS", "Comment")
    marked = rows.select((F.col("NPS") <= 6).cast("double").alias("detractor"), F.coalesce((F.col(f"`{top.dimension}`").cast("string") == top.value).cast("double"), F.lit(0.0)).alias("treated"), *(c for c in controls if c != top.dimension))
    effect = rationale.logit_effect(marked, "detractor", "treated", [c for c in controls if c != top.dimension]).first()
    return pack | {"driver": {"dimension": top.dimension, "value": top.value, "n": top.n, "potential_uplift": top.potential_uplift, "confidence": top.confidence}, "causal": effect.asDict()}


def run(spark: SparkSession, runs: list[Run], root: str) -> list[dict]:
    """Ingests and stores each run's responses, and writes its artifacts; contexts go one after the other.

    A run whose file fails its contract is told with its issues and leaves no artifacts. Returns a summary of each run:
    context, status, dataset_id, folder, packs and issues. Under one root, the same rows and context have the same
    dataset_id and pack ids.
    """
    out = []
    for spec in runs:
        context = {"service_origin": spec.origin, "service_origin_n1": spec.n1, "service_origin_n2": spec.n2}
        got = ingest.responses(spec.responses, spec.origin, spec.n1, spec.n2 or None, hold=True)
        issues = [{"level": i[0], "code": i[1], "message": i[2], "column": i[3]} for i in got.issues]
        if got.failed:
            out.append({"context": context, "status": "failed", "dataset_id": None, "folder": None, "packs": [], "issues": issues})
            continue
        rows = got.df
        key = store.context_key(spec.origin, spec.n1, spec.n2)
        dataset_id = store.signature(key, *_shape(rows))
        meta = store.write_lines(rows, f"{root.rstrip('/')}/datasets/{key}/{dataset_id}", "Fecha").first().asDict()
        tables = {d: _rows(drivers.driver_table(rows, d, score="NPS"), SHOWN) for d in spec.dimensions if d in rows.columns}
        named = rows.select("NPS", F.col("Palanca").alias("lever"), F.col("Subpalanca").alias("sublever"), X.topic(F.col("Palanca"), F.col("Subpalanca")).alias("topic"))
        routes = _rows(drivers.routes(named, score="NPS"), 25)
        top = drivers.opportunities(rows, list(tables), spec.min_n, "NPS").limit(spec.top_packs).collect()
        packs = [_pack(spark, rows, t, context, ["Canal", "Palanca", "Subpalanca"]) for t in top]
        told = {
            "context": context, "dataset_id": dataset_id, "pipeline_version": PIPELINE_VERSION, "kpis": kpis.score_kpis(rows, "NPS").first().asDict(), "drivers": tables, "routes": routes,
            "packs": [p["id"] for p in packs], "sources": spec.sources, "incidents": {"rows": spec.incidents.count() if spec.incidents is not None else 0},
            "reviews": {"rows": spec.reviews.count() if spec.reviews is not None else 0}, "issues": issues, "dataset": meta,
        }
        folder = store.artifact_tree(spark, root, dataset_id, PIPELINE_VERSION, key, told, {p["id"]: p for p in packs})
        out.append({"context": context, "status": "completed", "dataset_id": dataset_id, "folder": folder, "packs": [p["id"] for p in packs], "issues": issues})
    return out
