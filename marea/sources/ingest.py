"""Ingestion: headers, contract, context, typing, keys, dedupe, and issues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X
from marea.operators import filters
from marea.session import settle

# Header words and the columns they name.
ALIASES = {
    "fecha": "Fecha", "id": "ID", "nps": "NPS", "npsgroup": "NPS Group", "gruponps": "NPS Group", "nps group": "NPS Group", "comment": "Comment", "comments": "Comment", "comentario": "Comment", "texto": "Comment",
    "usuariodecision": "UsuarioDecisión", "usuariodecisionfinal": "UsuarioDecisión", "decisionusuario": "UsuarioDecisión", "usuario decision": "UsuarioDecisión", "canal": "Canal", "channel": "Canal", "palanca": "Palanca", "lever": "Palanca",
    "subpalanca": "Subpalanca", "sublever": "Subpalanca", "browser": "Browser", "navegador": "Browser", "operatingsystem": "Operating System", "operatingsystemname": "Operating System", "sistemaoperativo": "Operating System",
    "serviceoriginbuug": "service_origin", "serviceoriginbug": "service_origin", "serviceorigin": "service_origin", "service origin": "service_origin", "serviceoriginn1": "service_origin_n1", "service origin n1": "service_origin_n1", "serviceoriginn2": "service_origin_n2", "service origin n2": "service_origin_n2",
}
REQUIRED = ["Fecha", "NPS", "Canal", "Palanca", "Subpalanca"]
OPTIONAL = ["ID", "NPS Group", "Comment", "UsuarioDecisión", "Browser", "Operating System", "service_origin", "service_origin_n1", "service_origin_n2"]


@dataclass
class Result:
    """Rows and what there is to say about them: (level, code, message, column)."""

    df: DataFrame
    issues: list[tuple[str, str, str, str | None]] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return any(level == "ERROR" for level, *_ in self.issues)

    def issues_frame(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.issues, "level string, code string, message string, column string")


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """CSV, JSON lines, Parquet or ORC by suffix, all cells as they are; a workbook where a reader for it is installed."""
    kind = format or path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise NotImplementedError("no workbook reader is installed: export the sheet as CSV") from e
        import pandas as pd

        sheets = pd.read_excel(path, sheet_name=options.get("sheet"), dtype=object)
        pdf = sheets if options.get("sheet") else next(iter(sheets.values()))
        return spark.createDataFrame(pdf.astype(str))
    if kind == "csv":
        return spark.read.csv(path, header=True, **options)
    return spark.read.format({"jsonl": "json", "ndjson": "json"}.get(kind, kind)).options(**options).load(path)


def business_key(id_: Column, *fields: Column) -> Column:
    """The row's own id, else a hash of its fields."""
    own = X.text(id_)
    return F.when(own != "", own).otherwise(F.sha2(F.to_json(F.struct(*(X.text(f).alias(f"f{i}") for i, f in enumerate(fields)))), 256))


def fingerprint(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(X.text(f).alias(f"f{i}") for i, f in enumerate(fields)))), 256)


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last of the file."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def features(df: DataFrame, comment: str = "Comment", n2: str = "service_origin_n2") -> DataFrame:
    """The comment as it is compared, and the token set of the second context level."""
    return df.withColumn("_text_norm", X.comparable(F.col(comment))).withColumn("_service_origin_n2_key", X.token_set(F.col(n2)))


def responses(df: DataFrame, service_origin: str | None = None, service_origin_n1: str | None = None, service_origin_n2: str | None = None, hold: bool = False) -> Result:
    """Survey responses in canonical form: one row a business key, the last of the file.

    A missing column, an ambiguous context or no valid row is an ERROR and ends it; extra columns stay, as JSON too.
    hold: the rows are written, without what can be made of their other columns again; for frames that are read several times.
    """
    result = Result(filters.rename_headers(filters.standardise(df), ALIASES))
    df = result.df
    lost = [c for c in REQUIRED if c not in df.columns]
    result.issues += [("ERROR", "missing_required_column", f"missing column {c}", c) for c in lost]
    if lost:
        return result
    extra = [c for c in df.columns if c not in REQUIRED + OPTIONAL]
    if extra:
        result.issues.append(("WARN", "extra_columns_detected", ", ".join(extra), None))
    wanted = {"service_origin": service_origin, "service_origin_n1": service_origin_n1, "service_origin_n2": service_origin_n2}
    for c, value in list(wanted.items()):
        if value is None and c in df.columns:
            seen = filters.context_values(df, c)
            if len(seen) > 1:
                result.issues.append(("ERROR", "ambiguous_context", f"{c}: {len(seen)} values", c))
                return result
            wanted[c] = seen[0] if seen else ""
    n2 = wanted.pop("service_origin_n2")
    df = filters.in_context(df, **{c: v or "" for c, v in wanted.items()})
    df = filters.with_tokens(df, "service_origin_n2", n2 or "") if "service_origin_n2" in df.columns else df.withColumn("service_origin_n2", F.lit(n2 or ""))
    df = df.withColumn("_source_row_number", F.monotonically_increasing_id())
    texts = [c for c in REQUIRED + OPTIONAL if c not in ("Fecha", "NPS")]
    blank = [c for c in texts if c not in df.columns]
    order = [*df.columns, *blank, *(["extra_payload"] if extra else []), "_business_key", "_record_fingerprint"]
    df = df.withColumns({c: X.text(F.col(f"`{c}`")) for c in texts if c not in blank})
    date = F.col("Fecha") if dict(df.dtypes)["Fecha"].startswith("timestamp") else filters.date_or_epoch(F.col("Fecha"))
    df = df.withColumn("Fecha", date).withColumn("NPS", S.number(F.col("NPS")))
    of = lambda c: F.lit("") if c in blank else F.col(f"`{c}`").cast("string")
    fields = [of(c) for c in ("Fecha", "NPS", "Canal", "Palanca", "Subpalanca", "Comment")]
    key = business_key(of("ID"), *fields)
    valid = ~F.col("date") & ~F.col("score")
    lacks = df.select(F.col("Fecha").isNull().alias("date"), F.col("NPS").isNull().alias("score"), key.alias("key"))
    sums = lambda n: [F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name) for name, c in (("dates", F.col("date")), ("scores", F.col("score")), ("n", valid))]
    unique = last_of_key(filters.valid_rows(df.withColumn("_business_key", key), "Fecha", "NPS"), "_business_key", "_source_row_number")
    if hold:
        # the rows that are written tell how many keys there are
        unique = settle(unique.drop("_business_key")).withColumn("_business_key", key)
        counts = lacks.agg(*sums(F.lit(1).cast("long"))).first().asDict() | {"k": unique.count()}
    else:
        # all that is counted comes from one pass: rows by key and by what they lack, then those sums
        per = lacks.groupBy("date", "score", F.when(valid, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        counts = per.agg(*sums(F.col("n")), F.count_if(valid).alias("k")).first()
    # what is made of a row alone is made after the rows are dealt by key
    unique = unique.withColumns({c: F.lit("") for c in blank})
    if extra:
        unique = unique.withColumn("extra_payload", F.to_json(F.struct(*(F.col(f"`{c}`") for c in extra))))
    unique = unique.withColumn("NPS Group", F.when(F.col("NPS Group") == "", F.coalesce(S.band_label(F.col("NPS")), F.lit(""))).otherwise(F.col("NPS Group")))
    unique = unique.withColumn("_record_fingerprint", fingerprint(*fields, F.col("NPS Group"), F.col("Browser"), F.col("`Operating System`"))).select(*(f"`{c}`" for c in order))
    for lost_rows, code, column in ((counts["dates"], "invalid_dates", "Fecha"), (counts["scores"], "invalid_scores", "NPS")):
        if lost_rows:
            result.issues.append(("WARN", code, f"{lost_rows} rows dropped", column))
    result.df, result.meta = features(unique), {"rows": counts["k"], "duplicate_rows_in_file": counts["n"] - counts["k"]}
    if not counts["n"]:
        result.issues.append(("ERROR", "no_valid_rows", "no row has a date and a score", None))
    return result


def incidents(df: DataFrame, company: str = "", n1: str = "", n2: str = "", columns: tuple[str, str, str] = ("company", "N1", "N2")) -> Result:
    """Incidents of one context, dated by their date column; without rows a WARN."""
    result = Result(filters.standardise(df))
    if columns[1] not in df.columns:
        result.issues.append(("ERROR", "missing_required_column", f"missing column {columns[1]}", columns[1]))
        return result
    out = result.df
    for c, v in zip(columns[:2], (company, n1), strict=True):
        if v and c in out.columns:
            out = out.filter(X.text(F.col(c)) == X.text(F.lit(v)))
    if n2 and columns[2] in out.columns:
        out = filters.with_tokens(out, columns[2], n2)
    out = filters.date_columns(out)
    date = filters.date_column(out.columns)
    out = out.withColumns({"service_origin": F.lit(company), "service_origin_n1": F.lit(n1), "service_origin_n2_selected": F.lit(n2)})
    if date and date != "Fecha":
        out = out.withColumn("Fecha", F.col(f"`{date}`") if dict(out.dtypes)[date].startswith(("timestamp", "date")) else filters.date_or_epoch(F.col(f"`{date}`")))
    if out.isEmpty():
        result.issues.append(("WARN", "no_rows_in_context", "no incident of this context", None))
    result.df = out
    return result


def incidents_csv(spark: SparkSession, path: str) -> Result:
    """opened_at, closed_at, incident_id, category, severity, system, description, channel, geo."""
    need = ["opened_at", "closed_at", "incident_id", "category", "severity", "system", "description", "channel", "geo"]
    result = Result(filters.standardise(read_table(spark, path, "csv")))
    result.issues += [("ERROR", "missing_required_column", f"missing column {c}", c) for c in need if c not in result.df.columns]
    if not result.failed:
        result.df = result.df.withColumns({c: filters.date_of(F.col(c)) for c in ("opened_at", "closed_at")})
        if n := result.df.filter("opened_at is null").count():
            result.issues.append(("WARN", "invalid_dates", f"{n} rows without a date", "opened_at"))
    return result


def reviews_csv(spark: SparkSession, path: str) -> Result:
    """store, date, rating, text, app_version, geo."""
    need = ["store", "date", "rating", "text", "app_version", "geo"]
    result = Result(filters.standardise(read_table(spark, path, "csv")))
    result.issues += [("ERROR", "missing_required_column", f"missing column {c}", c) for c in need if c not in result.df.columns]
    if not result.failed:
        result.df = result.df.withColumn("date", filters.date_of(F.col("date")).cast("date")).withColumn("rating", S.number(F.col("rating")))
        if n := result.df.filter("date is null or rating is null").count():
            result.issues.append(("WARN", "invalid_values", f"{n} rows", None))
    return result
