"""Projections, filters and predicates over responses (ts, score, label, lever, sublever, channel, context columns)."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X

ALL = ("", "todos", "all")


def rename_headers(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names, looked up by header words with and without spaces; others keep theirs."""
    found = {}
    for c in df.columns:
        key = X.header(c)
        name = aliases.get(key) or aliases.get(key.replace(" ", ""))
        if name and name not in found.values() and (name == c or name not in df.columns):
            found[c] = name
    return df.withColumnsRenamed(found)


def standardise(df: DataFrame) -> DataFrame:
    """Column names without spaces around them."""
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def date_of(value: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd")) -> Column:
    """A timestamp from the first format that fits; null where none does."""
    # a format is tried where its signs are there: a text that doesn't fit costs an exception
    fits = lambda t, f: reduce(Column.__and__, (F.contains(t, F.lit(c)) for c in sorted(set(re.sub("'[^']*'|[^-/: ]", "", f)))), F.lit(True))
    return X.once(X.known(value), lambda t: F.coalesce(*(F.when(fits(t, f), F.try_to_timestamp(t, F.lit(f))) for f in formats)))


def epoch(value: Column) -> Column:
    """A timestamp from a number since 1970 whose unit shows in its size: ns from 1e17, us from 1e14, ms from 1e11, s from 1e9."""
    x = F.regexp_replace(X.text(value), r"[^0-9.\-]", "").try_cast("double")
    a = F.abs(x)
    micros = F.when(a >= 1e17, x / 1000).when(a >= 1e14, x).when(a >= 1e11, x * 1e3).when(a >= 1e9, x * 1e6)
    return F.timestamp_micros(micros.cast("long"))


def date_or_epoch(value: Column) -> Column:
    """Written dates first, then all-digit values as epochs."""
    return F.coalesce(date_of(value), F.when(X.text(value).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), epoch(value)))


def date_columns(df: DataFrame, least: float = 0.6) -> DataFrame:
    """Text columns named like dates become timestamps where at least that share of the known values parses; one pass."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and any(w in f.name.lower() for w in ("fecha", "date", "datetime", "timestamp", "datt"))]
    if not names:
        return df
    shares = df.agg(*(F.try_divide(F.count(date_or_epoch(F.col(f"`{c}`"))), F.count(X.known(F.col(f"`{c}`")))).alias(str(i)) for i, c in enumerate(names))).first()
    return df.withColumns({c: date_or_epoch(F.col(f"`{c}`")) for i, c in enumerate(names) if (shares[i] or 0) >= least})


# Names of date columns in the order they are preferred.
DATE_NAMES = ("Fecha", "fecha", "Date", "date", "CreatedDate", "Created Date", "Submit Date", "Reported Date", "Open Date", "opened_at", "created_at", "timestamp", "ts")


def date_column(columns: Sequence[str]) -> str | None:
    """The column that dates a row: a preferred name, else the first that speaks of a date."""
    return next((c for c in DATE_NAMES if c in columns), next((c for c in columns if any(w in c.lower() for w in ("fecha", "date"))), None))


def context_values(df: DataFrame, column: str) -> list[str]:
    """Up to eleven distinct non-empty values of a context column; more than one is ambiguous."""
    return sorted(r[0] for r in df.select(X.text(F.col(column)).alias("v")).filter("v <> ''").distinct().limit(11).collect())


def in_context(df: DataFrame, **expected: str) -> DataFrame:
    """Rows whose context columns equal the expected values after trimming; a missing column is filled with its value."""
    for name, value in expected.items():
        df = df.filter(X.text(F.col(name)) == X.text(F.lit(value))) if name in df.columns else df.withColumn(name, F.lit(value))
    return df


def with_tokens(df: DataFrame, column: str, selection: str) -> DataFrame:
    """Rows whose comma-separated tokens are the selection's, in any order; an empty selection keeps all."""
    return df if not selection.strip() else df.filter(X.token_set(F.col(column)) == X.token_set(F.lit(selection)))


def valid_rows(df: DataFrame, date: str = "ts", score: str = "score") -> DataFrame:
    """Rows with a date and a score."""
    return df.filter(F.col(date).isNotNull() & S.number(F.col(score)).isNotNull())


def period_bounds(year: int | str | None, month: int | str | None) -> tuple[dt.date | None, dt.date | None, int | None]:
    """First and last day of a selection, and the month alone where it stands for all years."""
    y = None if str(year or "").lower() in ALL else int(year)
    m = None if str(month or "").lower() in ALL else int(month)
    if y is None:
        return None, None, m
    first, last = (m, m) if m else (1, 12)
    return dt.date(y, first, 1), dt.date(y, last, calendar.monthrange(y, last)[1]), None


def in_period(df: DataFrame, start: dt.date | None, end: dt.date | None, month: int | None = None, end_inclusive: str = "day", ts: str = "ts") -> DataFrame:
    """Rows from start to end. end_inclusive `day` keeps the whole last day, `midnight` only its first instant."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end:
        limit = end + dt.timedelta(days=1) if end_inclusive == "day" else end
        bound = F.lit(limit).cast(df.schema[ts].dataType)
        df = df.filter(F.col(ts) < bound if end_inclusive == "day" else F.col(ts) <= bound)
    return df.filter(F.month(ts) == month) if month else df


def in_channel(df: DataFrame, channel: str | None, column: str = "channel") -> DataFrame:
    """Rows of a channel, in any case; all of them without a choice or a column."""
    if (channel or "").strip().lower() in ALL or column not in df.columns:
        return df
    return df.filter(F.lower(F.trim(column)) == channel.strip().lower())


def resolve(wanted: str | None, available: Sequence[str], default: str = "Todos") -> str:
    """The available value that is asked for, in any case, else the default."""
    return next((a for a in available if a.strip().lower() == (wanted or "").strip().lower()), default)


def in_group(df: DataFrame, group: str, label: str = "label", score: str = "score") -> DataFrame:
    """Rows of a focus group, by label or score."""
    return df if S.group(group) == "all" else df.filter(S.focus(F.col(label), F.col(score), group))


def first_filled(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first non-empty of the candidate columns that a frame has, whatever their case; else empty."""
    by = {c.lower(): c for c in df.columns}
    have = [F.nullif(X.text(F.col(f"`{by[c.lower()]}`")), F.lit("")) for c in candidates if c.lower() in by]
    return F.coalesce(*have, F.lit(""))


def until(df: DataFrame, end: dt.date, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).cast("date") <= F.lit(end))


def before(df: DataFrame, start: dt.date, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).cast("date") < F.lit(start))


def boundary_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of the first and of the last day, marked in `boundary`."""
    ends = df.agg(F.min(F.col(ts).cast("date")).alias("first_day"), F.max(F.col(ts).cast("date")).alias("last_day"))
    day = F.col(ts).cast("date")
    mark = F.array_compact(F.array(F.when(day == F.col("first_day"), F.lit("first")), F.when(day == F.col("last_day"), F.lit("last"))))
    return df.crossJoin(F.broadcast(ends)).withColumn("boundary", F.explode(mark)).drop("first_day", "last_day")


def windows(first: dt.date | None, last: dt.date | None, year=None, month=None) -> dict[str, tuple[dt.date, dt.date]]:
    """current: the selected month (or the last observed one) up to the last day observed; baseline: all before."""
    if last is None:
        return {}
    y, m = (last.year, last.month)
    if str(year or "").lower() not in ALL and str(month or "").lower() not in ALL:
        y, m = int(year), int(month)
    start, end = dt.date(y, m, 1), min(last, dt.date(y, m, calendar.monthrange(y, m)[1]))
    out = {"current": (start, end)}
    if first and first < start:
        out["baseline"] = (first, start - dt.timedelta(days=1))
    return out


def split_periods(df: DataFrame, start: dt.date, end: dt.date, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows of [start, end], and the rows before; where there are none before, all other rows."""
    day = F.col(ts).cast("date")
    current, earlier = df.filter(day.between(F.lit(start), F.lit(end))), df.filter(day < F.lit(start))
    return current, df.filter(~day.between(F.lit(start), F.lit(end))) if earlier.isEmpty() else earlier


def last_days(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `days` days up to the latest one."""
    latest = df.agg(F.max(F.col(ts).cast("date")).alias("latest"))
    return df.crossJoin(F.broadcast(latest)).filter(F.col(ts).cast("date") > F.date_sub("latest", days)).drop("latest")


def month_or_latest(df: DataFrame, month: dt.date, ts: str = "ts") -> DataFrame:
    """Rows of a month, else of the latest month that has any."""
    start = F.date_trunc("month", F.col(ts)).cast("date")
    chosen = df.agg(F.when(F.count_if(start == F.lit(month.replace(day=1))) > 0, F.lit(month.replace(day=1))).otherwise(F.max(start)).alias("chosen"))
    return df.crossJoin(F.broadcast(chosen)).filter(start == F.col("chosen")).drop("chosen")


def with_topics(df: DataFrame, topics: DataFrame, column: str = "topic") -> DataFrame:
    """Rows whose topic is among the given ones; no topics, no rows."""
    return df.join(topics.select(F.col(topics.columns[0]).alias(column)).distinct(), column, "left_semi")


def outliers(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Rows at least z population deviations from the mean; none where the deviation is 0 or unknown."""
    x = S.number(F.col(column))
    stats = df.agg(F.avg(x).alias("mean_"), F.stddev_pop(x).alias("sd_"))
    return df.crossJoin(F.broadcast(stats)).filter((F.col("sd_") > 0) & (F.abs(x - F.col("mean_")) >= z * F.col("sd_"))).drop("mean_", "sd_")


def periods(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Years and their months that have rows."""
    return df.filter(F.col(ts).isNotNull()).groupBy(F.year(ts).alias("year")).agg(F.array_sort(F.collect_set(F.month(ts))).alias("months"))
