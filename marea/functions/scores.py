"""Score expressions: bands, focus groups, KPIs and safe statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A number, or null where there is none; NaN is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def promoter(score: Column) -> Column:
    return score >= 9


def passive(score: Column) -> Column:
    return (score >= 7) & (score <= 8)


def detractor(score: Column) -> Column:
    return score <= 6


def rate(condition: Column) -> Column:
    """Share of all rows of the group for which the condition holds; unknown counts as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def band_label(score: Column) -> Column:
    """PROMOTOR from 9, DETRACTOR up to 6, PASIVO for all between (6.5 and 8.5 too); null without a score."""
    return F.when(score >= 9, "PROMOTOR").when(score <= 6, "DETRACTOR").when(score.isNotNull(), "PASIVO")


def group(name: str | None) -> str:
    """promoter, passive, detractor or all, from any usual name of a focus group."""
    n = (name or "").strip().lower()
    if n in ("", "todos", "all"):
        return "all"
    return "promoter" if n.startswith("prom") else "passive" if n.startswith(("pas", "neu")) else "detractor"


def focus(label: Column, score: Column, of: str) -> Column:
    """Whether a row belongs to the group by its label or its score; one row may belong to two groups."""
    low = F.lower(F.coalesce(label, F.lit("")))
    by = {"promoter": (low.contains("promot"), promoter(score)), "passive": (low.rlike("pas|neu"), passive(score)), "detractor": (low.contains("detr"), detractor(score))}
    if group(of) == "all":
        return F.lit(True)
    named, scored = by[group(of)]
    return named | F.coalesce(scored, F.lit(False))


def classic(score: Column) -> Column:
    """Aggregate: promoter share less detractor share of the known scores, in points; null without any."""
    n = F.count(score)
    return F.try_divide(100.0 * (F.count_if(promoter(score)) - F.count_if(detractor(score))), n)


def share(condition: Column, score: Column) -> Column:
    """Aggregate: share of the known scores; null without any."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count(score))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null and not-finite numbers become the lower bound."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.coalesce(F.least(F.greatest(finite, F.lit(low)), F.lit(high)), F.lit(low))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over the rows where both are known; null where one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(F.when(both, F.lit(1)))
    sxy, sx, sy, sxx, syy = F.sum(a * b), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def useful(comment: Column) -> Column:
    """Whether a comment says anything."""
    return ~F.lower(F.trim(F.coalesce(comment, F.lit("")))).isin("", "nan", "none", "null")
