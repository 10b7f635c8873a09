"""What reports and views show of longer tables: the rows that matter, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.functions import scores as S

#: Rows that views show of a table.
HEADS = {"comparison": 30, "gaps": 30, "opportunities": 25, "ranking": 20, "evidence": 300}
#: Measures by which scenarios are ordered, the largest first; a missing column or value counts as 0.
SCENARIO_ORDER = ("detractor_probability", "focus_probability_with_incident", "total_impact", "risk_points", "recoverable_points", "linked_pairs", "linked_incidents", "linked_comments", "confidence", "causal_score", "priority")


def _known(df: DataFrame, column: str) -> Column:
    """A measure as a number, 0 where it is missing or no number."""
    return F.coalesce(S.number(F.col(column)), F.lit(0.0)) if column in df.columns else F.lit(0.0)


def text_clusters(topics: DataFrame, most: int) -> DataFrame:
    """The largest clusters; equals by cluster_id."""
    return topics.orderBy(_known(topics, "n").desc(), "cluster_id").limit(most)


def deteriorations(delta: DataFrame, most: int) -> DataFrame:
    """Values that lost: the largest loss first, then by current rows and by name. None lost: no rows."""
    return delta.filter(S.number(F.col("delta_nps")) < 0).orderBy(S.number(F.col("delta_nps")), _known(delta, "n_current").desc(), "value").limit(most)


def gaps(table: DataFrame, most: int) -> DataFrame:
    """Values below the overall score, the largest gap first, then by rows and name; where none is below, all values."""
    known = table.withColumn("_gap", S.number(F.col("gap_vs_overall"))).filter("_gap is not null")
    below = known.agg(F.coalesce(F.max(F.col("_gap") < 0), F.lit(False)).alias("_any"))
    chosen = known.crossJoin(F.broadcast(below)).filter("_gap < 0 or not _any")
    return chosen.orderBy("_gap", _known(table, "n").desc(), "value").drop("_gap", "_any").limit(most)


def opportunities(table: DataFrame, most: int) -> DataFrame:
    """By uplift, then confidence, rows and name."""
    return table.orderBy(_known(table, "potential_uplift").desc(), _known(table, "confidence").desc(), _known(table, "n").desc(), "value").limit(most)


def opportunities_view(table: DataFrame, most: int = HEADS["opportunities"]) -> DataFrame:
    """What the opportunity view lists: label (the value, else dimension=value), by uplift and confidence."""
    named = F.when(F.trim(F.coalesce("value", F.lit(""))) != "", F.trim("value")).otherwise(F.concat("dimension", F.lit("="), F.coalesce("value", F.lit(""))))
    return table.withColumn("label", named).orderBy(_known(table, "potential_uplift").desc(), _known(table, "confidence").desc(), "label").limit(most)


def scenarios(chains: DataFrame, most: int) -> DataFrame:
    """Chains for a report: those with a positive rank in its order, where there is such a column and row; else by SCENARIO_ORDER
    and by entity."""
    measured = chains.orderBy(*(_known(chains, c).desc() for c in SCENARIO_ORDER), "entity").limit(most)
    if "rank" not in chains.columns:
        return measured
    ranked = chains.filter(S.number(F.col("rank")) > 0)
    return measured if ranked.isEmpty() else ranked.orderBy(S.number(F.col("rank")), "entity").limit(most)


def nonzero(kpis: DataFrame, most: int) -> DataFrame:
    """KPIs (position, label, value) whose value is a number other than 0, the first ones in their order. A text counts by the
    first number in it."""
    first = F.regexp_extract(F.replace(F.col("value").cast("string"), F.lit(","), F.lit(".")), r"[-+]?[0-9]*\.?[0-9]+", 0)
    return kpis.withColumn("_x", F.nullif(first, F.lit("")).try_cast("double")).filter(F.abs("_x") > 1e-12).orderBy("position").drop("_x").limit(most)


def head(table: DataFrame, view: str, *order: Column | str) -> DataFrame:
    """The rows that a view shows (HEADS), in an order."""
    return table.orderBy(*order).limit(HEADS[view])
