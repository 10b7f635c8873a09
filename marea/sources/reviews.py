"""A Spark data source for app-store reviews that come in pages from a callable or a folder of JSON files."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "store string, date string, rating double, text string, app_version string, geo string"


class ReviewsSource(DataSource):
    """spark.dataSource.register(ReviewsSource); spark.read.format("reviews").option("paths", "a.json,b.json").load()"""

    @classmethod
    def name(cls) -> str:
        return "reviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options.get("paths", ""), [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, paths: str, names: list[str]):
        self.paths, self.names = [p for p in paths.split(",") if p], names

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8") as f:
            for row in json.load(f):
                yield tuple(float(row[n]) if n == "rating" and row.get(n) is not None else row.get(n) for n in self.names)


def pages(spark, *paths: str):
    """Reviews from folders or files of JSON arrays, read where Spark reads: a page a line or a file. Ratings that are no
    number are null, and so are fields that a review lacks; pages that are no JSON are skipped."""
    from pyspark.sql import functions as F

    kind = "array<struct<store:string,date:string,rating:string,text:string,app_version:string,geo:string>>"
    rows = spark.read.text(list(paths), wholetext=False).select(F.explode(F.from_json("value", kind)).alias("x"))
    return rows.select("x.*").withColumn("rating", F.col("rating").try_cast("double"))
