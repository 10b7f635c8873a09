"""Causal ranking and the incident-to-score rationale, with learned factors and hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import scores as S
from marea.functions import text as X
from marea.session import settle, small

c01 = S.clip


def causal_rank(series: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics by incidents, by the difference of focus rate at and above the median of incidents to below, and by responses."""
    w = Window.partitionBy(topic)
    at = series.withColumn("median_", F.median("incidents").over(w))
    high, low = F.col("incidents") >= F.col("median_"), F.col("incidents") < F.col("median_")
    out = at.groupBy(topic).agg(F.countDistinct("bucket").alias("weeks"), F.sum("responses").alias("responses"), F.sum("incidents").alias("incidents"), F.avg("focus_rate").alias("focus_rate"), F.avg(F.when(high, F.col("focus_rate"))).alias("h"), F.avg(F.when(low, F.col("focus_rate"))).alias("l"))
    out = out.withColumn("delta_focus_rate", F.when(F.col("weeks") >= 2, F.col("h") - F.col("l"))).drop("h", "l").withColumn("incidents_per_100", 100.0 * F.col("incidents") / F.greatest(F.col("responses"), F.lit(1)))
    score = 0.45 * c01(F.log1p(F.col("incidents").cast("double")) / 5) + 0.35 * F.abs(F.coalesce("delta_focus_rate", F.lit(0.0))) + 0.20 * c01(F.log1p(F.col("responses").cast("double")) / 10)
    return out.withColumn("score", c01(score))


def action_plan(priority: Column, lag: Column, stability: Column) -> Column:
    """Lane and weeks of the action that a priority calls for."""
    lag = F.coalesce(lag, F.lit(0.0))
    structural = (priority >= 0.72) | ((priority >= 0.62) & (stability >= 0.60))
    quick = (priority >= 0.48) & (lag <= 2)
    lane = F.when(structural, "Fix estructural").when(quick, "Quick win operativo").otherwise("Instrumentación + validación")
    weeks = F.when(structural, 6.0).when(quick, 2.0).otherwise(3.0)
    return F.struct(lane.alias("action_lane"), weeks.alias("eta_weeks"))


def touchpoint(topic: Column) -> Column:
    """The last part of a topic."""
    return F.trim(F.element_at(F.split(F.coalesce(topic, F.lit("")), ">"), -1))


def rationale(series: DataFrame, rank: DataFrame | None = None, focus: str = "detractor", min_responses: int = 80, recovery: float = 0.65, topic: str = "topic") -> DataFrame:
    """How far each topic's incidents go with its focus rate, what that puts at risk, and what to do first.

    Buckets of few incidents (up to the 30 % quantile) are set against those of many (from the 70 % quantile); where
    either has under two, against the median. Topics need `min_responses` responses, three weeks and three known rates.
    rank: score, corr, best_lag_weeks, max_cp_stability and incidents_lead_changepoint_share by topic, all optional.
    """
    rows = series.select(X.text(F.col(topic)).alias("nps_topic"), F.col("bucket").alias("week"), F.greatest(F.coalesce(F.col("responses").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("responses"), F.least(F.greatest(S.number(F.col("focus_rate")), F.lit(0.0)), F.lit(1.0)).alias("rate"), F.greatest(F.coalesce(F.col("incidents").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("incidents"), S.number(F.col("nps_mean")).alias("nps_mean"))
    rows = rows.filter("nps_topic <> '' and responses > 0")
    cuts = rows.groupBy("nps_topic").agg(F.percentile("incidents", F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("q"), F.sum("responses").alias("topic_responses"), F.sum("incidents").alias("topic_incidents"), F.when(F.count("week") > 0, F.countDistinct("week")).otherwise(F.count(F.lit(1))).alias("weeks"), F.count("rate").alias("rates"))
    total = rows.agg(F.sum("responses").alias("total"))
    kept = cuts.filter((F.col("topic_responses") >= min_responses) & (F.col("weeks") >= 3) & (F.col("rates") >= 3))
    q = lambda i: F.round(F.get("q", F.lit(i)), 9)
    at = rows.join(small(kept), "nps_topic").withColumn("low30", F.col("incidents") <= q(0)).withColumn("high70", F.col("incidents") >= q(2)).withColumn("low50", F.col("incidents") <= q(1)).withColumn("high50", F.col("incidents") > q(1))

    def side(flag):
        return [F.count_if(flag), F.avg(F.when(flag, F.col("rate"))), F.avg(F.when(flag, F.col("nps_mean"))), F.sum(F.when(flag, F.col("responses")))]

    sides = {n: F.struct(*(v.alias(k) for k, v in zip(("n", "rate", "nps", "responses"), side(F.col(n)), strict=True))).alias(n) for n in ("low30", "high70", "low50", "high50")}
    per = at.groupBy("nps_topic").agg(F.first("topic_responses").alias("responses"), F.first("topic_incidents").alias("incidents"), F.first("weeks").alias("weeks"), F.avg("rate").alias("focus_rate"), *sides.values())
    thin = (F.col("low30.n") < 2) | (F.col("high70.n") < 2)
    per = per.withColumn("low", F.when(thin, F.col("low50")).otherwise(F.col("low30"))).withColumn("high", F.when(thin, F.col("high50")).otherwise(F.col("high70"))).filter("low.n > 0 and high.n > 0").crossJoin(F.broadcast(total))
    delta = F.col("high.rate") - F.col("low.rate")
    per = per.withColumn("delta_focus_rate", delta).withColumn("risk", F.greatest(F.lit(0.0), -delta if S.group(focus) == "promoter" else delta))
    per = per.withColumn("attributable_cases", F.col("risk") * F.col("high.responses")).withColumn("incident_rate_per_100", 100 * F.col("incidents") / F.greatest(F.col("responses"), F.lit(1.0)))
    per = per.withColumn("risk_points", F.col("risk") * 100 * F.col("responses") / F.col("total")).withColumn("nps_delta_expected", F.col("high.nps") - F.col("low.nps"))
    per = per.withColumn("total_impact", F.coalesce(F.abs("nps_delta_expected") * F.col("high.responses") / F.col("total"), F.col("risk_points")))
    extra = {"score": "rank_score", "corr": "corr", "best_lag_weeks": "lag_weeks", "max_cp_stability": "cp_stability", "incidents_lead_changepoint_share": "lead"}
    if rank is not None:
        per = per.join(rank.select(F.col(topic).alias("nps_topic"), *((F.col(c) if c in rank.columns else F.lit(None)).cast("double").alias(n) for c, n in extra.items())).dropDuplicates(["nps_topic"]), "nps_topic", "left")
    else:
        per = per.withColumns({n: F.lit(None).cast("double") for n in extra.values()})
    s = {
        "s_lag": F.when(F.col("lag_weeks").isNull(), 0.55).otherwise(1 - c01(F.col("lag_weeks") / 6)), "s_support": c01(F.log1p("responses") / 8), "s_incident": c01(F.log1p("incidents") / 6),
        "s_effect": c01(F.col("risk") / 0.12), "s_temporal": c01(F.abs("corr")), "s_stability": c01(F.col("cp_stability")), "s_lead": c01(F.col("lead")), "s_rank": c01(F.col("rank_score")),
    }
    per = per.withColumns(s)
    per = per.withColumns({
        "temporal_score": c01(0.60 * F.col("s_temporal") + 0.40 * F.col("s_lead")), "uplift_score": c01(F.col("risk") / 0.20), "consistency_score": c01(0.55 * F.col("s_stability") + 0.45 * F.col("s_lag")),
        "plausibility_score": c01(0.70 * F.col("s_rank") + 0.30 * F.col("s_effect")), "volume_score": c01(0.55 * F.col("s_support") + 0.45 * F.col("s_incident")),
    })
    per = per.withColumn("causal_score", c01(0.30 * F.col("temporal_score") + 0.25 * F.col("uplift_score") + 0.20 * F.col("consistency_score") + 0.15 * F.col("plausibility_score") + 0.10 * F.col("volume_score")))
    signals = 0.22 * F.col("s_support") + 0.12 * F.col("s_incident") + 0.26 * F.col("s_effect") + 0.16 * F.col("s_temporal") + 0.12 * F.col("s_stability") + 0.07 * F.col("s_lead") + 0.05 * F.col("s_rank")
    per = per.withColumn("confidence", c01(0.55 * signals + 0.45 * F.col("causal_score"))).withColumn("recoverable_points", F.col("risk_points") * recovery * F.col("confidence"))
    everything = Window.partitionBy()
    cases, most = F.sum("attributable_cases").over(everything), F.max("risk_points").over(everything)
    per = per.withColumn("concentration_share", F.coalesce(F.try_divide(F.col("attributable_cases"), cases), F.lit(0.0)))
    per = per.withColumn("priority", F.when(F.col("risk_points") <= 0, 0.0).otherwise(c01(0.45 * F.when(most > 0, F.col("risk_points") / most).otherwise(0.0) + 0.30 * F.col("confidence") + 0.15 * F.col("causal_score") + 0.10 * F.col("s_lag"))))
    plan = action_plan(F.col("priority"), F.col("lag_weeks"), F.col("s_stability"))
    out = per.withColumn("touchpoint", touchpoint(F.col("nps_topic"))).withColumn("plan", plan)
    drop = ["low30", "high70", "low50", "high50", "low", "high", "total", "plan", *s]
    return out.select("*", "plan.*").drop(*drop)


def rationale_summary(table: DataFrame) -> DataFrame:
    """One row over a rationale table: topics, sums, share of the three topics with most incidents, means."""
    w = Window.partitionBy().orderBy(F.desc("priority"), F.desc("risk_points"), F.desc("incidents"), "nps_topic")
    at = table.withColumn("r", F.row_number().over(w))
    return at.agg(F.count(F.lit(1)).alias("topics"), F.coalesce(F.sum("attributable_cases"), F.lit(0.0)).alias("attributable_cases"), F.coalesce(F.sum("risk_points"), F.lit(0.0)).alias("risk_points"), F.coalesce(F.sum("recoverable_points"), F.lit(0.0)).alias("recoverable_points"), F.coalesce(F.try_divide(F.sum(F.when(F.col("r") <= 3, F.col("incidents"))), F.sum("incidents")), F.lit(0.0)).alias("top3_incident_share"), F.avg("confidence").alias("confidence_mean"), F.median("lag_weeks").alias("median_lag_weeks"), F.max("focus_rate").alias("max_focus_rate"), F.try_divide(F.sum(F.col("delta_focus_rate") * F.col("responses")), F.sum("responses")).alias("delta_weighted"), F.coalesce(F.sum("total_impact"), F.lit(0.0)).alias("total_impact"))


def learned_factors(log: DataFrame, **context: str) -> DataFrame:
    """Per topic how confirmed and rejected findings of the same context change its confidence, 0.30 to 1.60."""
    rows = log
    for c, v in context.items():
        rows = rows.filter(F.col(c) == v)
    out = rows.groupBy("topic").agg(F.count_if(F.col("outcome") == "confirmed").alias("confirmed"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    raw = (1 + F.least(0.15 * F.col("confirmed"), F.lit(0.5))) * (1 - F.least(0.2 * F.col("rejected"), F.lit(0.7)))
    return out.withColumn("factor", F.least(F.greatest(raw, F.lit(0.30)), F.lit(1.60)))


def hypotheses(rank: DataFrame, factors: DataFrame, lags: DataFrame | None = None, stability: DataFrame | None = None, leads: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """The ranking with what else is known of each topic, and its confidence after what was learned.

    lags: best_lag_weeks and corr; stability: changepoints, max_cp_stability and max_cp_level; leads:
    incidents_lead_changepoint_share, each by topic, a row at most. Topics that a side doesn't know keep nulls in its
    columns. Order: learned confidence, incidents, responses, then by name.
    """
    out = rank
    for side in (stability, lags, leads):
        if side is not None:
            out = out.join(side.dropDuplicates([topic]), topic, "left")
    out = out.join(factors.select(topic, "confirmed", "rejected", "factor"), topic, "left").fillna({"factor": 1.0, "confirmed": 0, "rejected": 0})
    return out.withColumn("confidence_learned", c01(F.coalesce("score", F.lit(0.0)) * F.col("factor"))).orderBy(F.desc("confidence_learned"), F.desc("incidents"), F.desc("responses"), topic)


def logit_effect(df: DataFrame, outcome: str, treatment: str, controls: list[str], top: int = 20, least: int = 500) -> DataFrame:
    """Marginal effect of a 0/1 treatment on a 0/1 outcome with one-hot controls: mean p(1-p) times its coefficient, and p-value.

    Equal rows are one row with their number as its weight, so the rows are read once and not in each step of the fit.
    """
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select(F.col(outcome).cast("double").alias("y"), F.col(treatment).cast("double").alias("t"), *controls).filter("y is not null and t is not null")
    rows = settle(rows.groupBy("y", "t", *controls).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    for c in controls:
        kept = rows.groupBy(c).agg(F.sum("_n").alias("_rows")).orderBy(F.desc("_rows"), c).limit(top).select(F.col(c), F.lit(True).alias(f"_{c}"))
        rows = rows.join(F.broadcast(kept), c, "left").withColumn(c, F.when(F.col(f"_{c}"), F.col(c).cast("string")).otherwise("__OTHER__")).drop(f"_{c}")
    rows = settle(rows.groupBy("y", "t", *controls).agg(F.sum("_n").alias("_n")))
    used = [c for c in controls if rows.select(c).distinct().limit(2).count() > 1]
    data = RFormula(formula="y ~ " + " + ".join(["t", *used])).fit(rows).transform(rows).select("y", "features", "_n")
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol="y", weightCol="_n", regParam=0.0).fit(data)
    p = model.transform(data).agg(F.sum(F.col("_n") * F.col("prediction") * (1 - F.col("prediction"))) / F.sum("_n"), F.sum("_n")).first()
    rows_ = [(treatment, outcome, float(p[0] * model.coefficients[0]), float(model.summary.pValues[0]), int(p[1]), bool(p[1] < least))]
    return df.sparkSession.createDataFrame(rows_, "treatment string, outcome string, effect double, p_value double, n long, few_rows boolean")
