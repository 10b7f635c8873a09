"""The catalogue of journeys as a versioned side table of each context: normalised, deduplicated, saved and loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators.chains import JOURNEYS

FIELDS = ("id", "title", "what_occurs", "expected_evidence", "impact_label", "touchpoint", "lever", "sublever", "route", "cx_readout", "confidence_label", "keywords")
SCHEMA = "position long, journey_id string, title string, what_occurs string, expected_evidence string, impact_label string, touchpoint string, lever string, sublever string, route string, cx_readout string, confidence_label string, keywords array<string>"


def keywords(parts: Column) -> Column:
    """Distinct keywords in order: lower case without accents, single spaces, without the sign that parts a topic."""
    plain = F.transform(parts, lambda k: F.trim(F.replace(X.attribution(F.lower(F.trim(F.coalesce(k, F.lit(""))))), F.lit(">"), F.lit(" "))))
    return F.array_distinct(F.filter(plain, lambda k: k != ""))


def _slug(value: Column, most: int = 48) -> Column:
    cut = F.regexp_replace(X.slug(value, most), "^-+|-+$", "")
    return F.when(cut == "", "default").otherwise(cut)


def defaults(spark: SparkSession) -> DataFrame:
    """The journeys of a context that has no catalogue."""
    rows = [(i, j[0], j[1], "", "", j[5], j[2], j[3], j[4], "", "", j[6], [k for k in j[7]]) for i, j in enumerate(JOURNEYS)]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumn("keywords", keywords(F.col("keywords")))


def normalise(rows: DataFrame) -> DataFrame:
    """Entries as an editor has them (FIELDS, missing ones are blank, and position) as SCHEMA.

    Blank entries go. A missing title or id is made from the position and from what the entry says; keywords, split at
    commas, semicolons and line ends, come from its title and places where it has none. Equal ids get -02, -03, ... in
    the order of position.
    """
    text = {c: X.text(F.col(c)) if c in rows.columns and dict(rows.dtypes)[c] != "array<string>" else F.lit("") for c in FIELDS}
    listed = F.col("keywords") if "keywords" in rows.columns else F.lit("")
    listed = listed if dict(rows.dtypes).get("keywords") == "array<string>" else F.split(F.coalesce(listed.cast("string"), F.lit("")), r"[,;\n]+")
    clean = rows.select(F.col("position").cast("long").alias("position"), *(v.alias(c) for c, v in text.items() if c != "keywords"), keywords(listed).alias("own"))
    said = [c for c in FIELDS if c != "keywords"]
    clean = clean.filter(F.greatest(F.size("own"), *(F.length(c) for c in said)) > 0)
    place = (F.col("position") + 1).cast("string")
    named = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("title", "touchpoint", "lever")), F.concat(F.lit("journey-"), place))
    blank = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    out = clean.select(
        "position", blank("id", F.concat(F.lit("executive-"), _slug(named))).alias("journey_id"), blank("title", F.concat(F.lit("Journey "), place)).alias("title"), "what_occurs", "expected_evidence",
        blank("impact_label", F.lit("Medio")).alias("impact_label"), "touchpoint", "lever", "sublever", "route", "cx_readout", blank("confidence_label", F.lit("Medio")).alias("confidence_label"),
        F.when(F.size("own") > 0, F.col("own")).otherwise(keywords(F.array("title", "touchpoint", "lever", "sublever"))).alias("keywords"),
    ).withColumn("journey_id", F.lower("journey_id"))
    again = F.row_number().over(Window.partitionBy("journey_id").orderBy("position"))
    numbered = F.when(again == 1, F.col("journey_id")).otherwise(F.concat("journey_id", F.lit("-"), F.lpad(again.cast("string"), 2, "0")))
    return out.withColumn("journey_id", numbered)


def folder(root: str, origin: str, n1: str) -> str:
    """Where a context's catalogue lies; names as slugs."""
    import re
    import unicodedata

    def slug(value: str) -> str:
        plain = unicodedata.normalize("NFKD", " ".join(value.split()).lower()).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:48].strip("-") or "default"

    return f"{root.rstrip('/')}/journey_catalogs/{slug(origin)}__{slug(n1)}"


def _versions(spark: SparkSession, at: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def save(rows: DataFrame, root: str, origin: str, n1: str) -> int:
    """Writes the entries, normalised, as the next version of a context's catalogue; the defaults where none is left.

    Earlier versions stay. Returns the version.
    """
    spark, at = rows.sparkSession, folder(root, origin, n1)
    clean = normalise(rows)
    version = max(_versions(spark, at), default=0) + 1
    (defaults(spark) if clean.isEmpty() else clean).coalesce(1).write.mode("overwrite").json(f"{at}/version={version}")
    return version


def load(spark: SparkSession, root: str, origin: str, n1: str, version: int | None = None) -> DataFrame:
    """A context's catalogue, the latest or an earlier version; the defaults where there is none or it can't be read.

    What was edited by hand is normalised like new entries; lines that are no JSON are skipped.
    """
    at = folder(root, origin, n1)
    known = _versions(spark, at)
    if not known or version is not None and version not in known:
        return defaults(spark)
    read = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(f"{at}/version={version or known[-1]}")
    place = F.coalesce("position", F.lit(0).cast("long")).alias("position")
    rows = normalise(read.select(place, F.col("journey_id").alias("id"), *(c for c in FIELDS if c != "id")))
    return defaults(spark) if rows.isEmpty() else rows
