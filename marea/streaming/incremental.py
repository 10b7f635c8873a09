"""Streaming forms of the daily metrics, the upload dedupe and the merge: extensions to the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.functions import scores as S


def daily_metrics(stream: DataFrame, ts: str = "ts", score: str = "score", late: str = "2 days") -> DataFrame:
    """Daily score metrics of a stream; a day ends when the watermark has passed it."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(10.0), S.number(F.col(score))))
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("s", s).filter("s is not null").withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, "1 day")).agg(F.count("s").alias("n"), S.rate(S.promoter(F.col("s"))).alias("promoter_rate"), S.rate(S.detractor(F.col("s"))).alias("detractor_rate"), F.avg("s").alias("nps_mean"))
    return out.select(F.col("window.start").cast("date").alias("date"), "n", "promoter_rate", "detractor_rate", "nps_mean", ((F.col("promoter_rate") - F.col("detractor_rate")) * 100).alias("nps_classic"))


def new_files(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Uploads (context, file_hash, at) whose file is new within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["context", "file_hash"])


def merge_into(stream: DataFrame, store, context: str, checkpoint: str, order: str = "record_fingerprint"):
    """Merges each micro-batch of (business_key, record_fingerprint, payload) into a record store, once each.

    A batch is known by the stream's own id and its number, so another stream, or one with a new checkpoint, is never
    taken for a repeated upload. Of a key's rows in one batch that of the largest `order` counts.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or stream_id
        rest = [c for c in batch.columns if c != "business_key"]
        last = batch.groupBy("business_key").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select("business_key", "r.*")
        if store.upload(last.select(batch.columns), context, f"{own}-{epoch}") == "failed":
            raise RuntimeError(f"batch {epoch} was not merged; the store's issues say why")  # the stream stops, and comes back to it

    stream_id = uuid.uuid4().hex  # where the session doesn't tell: a restart merges its last batch again, which changes nothing
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
