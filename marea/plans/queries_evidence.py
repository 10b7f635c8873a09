"""Queries on hypotheses, chains, label matches and hot terms, with all their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators import chains, drivers, hotspots, linking, rationale, series
from marea.plans import views as V
from marea.plans.queries_core import TOPICS, R, lag_sql, rounded, topic_weeks
from marea.plans.queries_linking import C01, CHAINS, FOLD, HOT, RANK, RATIONALE, STEM, STOP, TOKENS, _enriched, _hot, _links
from marea.plans.registry import query
from marea.session import settle

# what is known of a topic beside its rank; a break is every fortieth week, held by the share of weeks about it over the topic's mean
BREAKS = "cps AS (SELECT topic, bucket AS cp FROM (SELECT topic, bucket, row_number() OVER (PARTITION BY topic ORDER BY bucket) AS r FROM s) WHERE r % 40 = 20)"
LEADS = "z AS (SELECT c.topic, cp, max(CASE WHEN s.bucket < cp AND s.bucket >= cp - 28 THEN incidents END) AS a, max(CASE WHEN s.bucket > cp AND s.bucket <= cp + 28 THEN incidents END) AS b FROM cps c JOIN s USING (topic) GROUP BY 1, 2)"
HELD = "mu AS (SELECT topic, avg(focus_rate) AS mu FROM s GROUP BY 1), st AS (SELECT c.topic, cp, avg(CASE WHEN focus_rate > mu THEN 1.0 ELSE 0.0 END) AS share FROM cps c JOIN s USING (topic) JOIN mu USING (topic) WHERE s.bucket BETWEEN cp - 70 AND cp + 70 GROUP BY 1, 2)"
HYPOTHESES = f"""hrank AS (WITH {RANK} SELECT * FROM k), hlag AS (WITH {TOPICS}, {lag_sql(6, 8)} SELECT topic, k AS best_lag_weeks, corr FROM b WHERE r = 1), hlead AS (WITH {TOPICS}, {BREAKS}, {LEADS} SELECT topic, avg(CASE WHEN a >= b THEN 1.0 ELSE 0.0 END) AS lead_share FROM z WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY topic),
hstab AS (WITH {TOPICS}, {BREAKS}, {HELD} SELECT topic, max(share) AS stability FROM st GROUP BY topic), hlog AS (SELECT topic, count(*) FILTER (WHERE incident_id % 251 < 2) AS confirmed, count(*) FILTER (WHERE incident_id % 251 = 3) AS rejected FROM assignments GROUP BY topic),
hyp AS (SELECT hrank.*, best_lag_weeks, corr, lead_share, stability, confirmed, rejected, CAST(least(1.6, greatest(0.3, (1 + least(0.15 * confirmed, 0.5)) * (1 - least(0.2 * rejected, 0.7)))) AS DOUBLE) AS factor FROM hrank LEFT JOIN hlag USING (topic) LEFT JOIN hlead USING (topic) LEFT JOIN hstab USING (topic) LEFT JOIN hlog USING (topic))"""


def _breaks(s):
    return drivers.numbered(s, "bucket", by=["topic"]).filter("rank % 40 = 20").select("topic", F.col("bucket").alias("changepoint"))


def _held(s):
    """How far a topic's breaks hold: of the weeks within ten of a break, the share over the topic's mean, the largest."""
    mean = s.groupBy("topic").agg(F.avg("focus_rate").alias("mu"))
    near = _breaks(s).join(s.select("topic", "bucket", "focus_rate"), "topic").join(mean, "topic").filter(F.col("bucket").between(F.date_sub("changepoint", 70), F.date_add("changepoint", 70)))
    per = near.groupBy("topic", "changepoint").agg(F.avg((F.col("focus_rate") > F.col("mu")).cast("int")).alias("share"))
    return per.groupBy("topic").agg(F.max("share").alias("max_cp_stability"))


def _hypotheses(spark, d, s=None):
    s = settle(topic_weeks(spark, d)) if s is None else s
    rank = rationale.causal_rank(s)
    lags = series.best_lag(s).select("topic", F.col("best_lag").cast("long").alias("best_lag_weeks"), "corr")
    leads = series.lead_share(s, _breaks(s)).select("topic", F.col("lead_share").alias("incidents_lead_changepoint_share"))
    told = F.when(F.col("incident_id") % 251 < 2, "confirmed").when(F.col("incident_id") % 251 == 3, "rejected").otherwise("none")
    log = V.assignments(spark, d).select("topic", told.alias("outcome"))
    return rationale.hypotheses(rank, rationale.learned_factors(log), lags, _held(s), leads)


@query("o_d21_hypotheses", f"{V.FULL}, {HYPOTHESES} SELECT topic, {R('score', 'score')}, CAST(coalesce(best_lag_weeks, 0) AS BIGINT) AS best_lag_weeks, {R('corr', 'corr')}, {R('lead_share', 'lead_share')}, {R('stability', 'stability')}, confirmed, rejected, {R('factor', 'factor')}, {R('greatest(0, least(1, score * factor))', 'confidence_learned')}, row_number() OVER (ORDER BY greatest(0, least(1, score * factor)) DESC, incidents DESC, responses DESC, topic) AS place FROM hyp")
def o_d21(spark, d):
    out = drivers.numbered(_hypotheses(spark, d), F.desc("confidence_learned"), F.desc("incidents"), F.desc("responses"), "topic", name="place")
    return rounded(out.select("topic", "score", "best_lag_weeks", "corr", F.col("incidents_lead_changepoint_share").alias("lead_share"), F.col("max_cp_stability").alias("stability"), "confirmed", "rejected", "factor", "confidence_learned", F.col("place").cast("long").alias("place")))


# the rationale with every signal: the base has constants where these stand
SIGNALS = RATIONALE.replace(
    f"f AS (SELECT *, {C01(f'0.25 * up + 0.20 * {C01("0.45 * 0.55")} + 0.15 * {C01("0.30 * se")} + 0.10 * {C01("0.55 * su + 0.45 * si")}')} AS causal FROM e)",
    f"e2 AS (SELECT e.*, {C01('abs(corr)')} AS te, {C01('lead_share')} AS le, {C01('stability')} AS sb, {C01('hyp.score')} AS rk, CASE WHEN best_lag_weeks IS NULL THEN 0.55 ELSE 1 - {C01('best_lag_weeks / 6.0')} END AS lg, best_lag_weeks FROM e LEFT JOIN hyp USING (topic)), f AS (SELECT *, {C01(f'0.30 * {C01("0.60 * te + 0.40 * le")} + 0.25 * up + 0.20 * {C01("0.55 * sb + 0.45 * lg")} + 0.15 * {C01("0.70 * rk + 0.30 * se")} + 0.10 * {C01("0.55 * su + 0.45 * si")}')} AS causal FROM e2)",
).replace(C01("0.55 * (0.22 * su + 0.12 * si + 0.26 * se) + 0.45 * causal"), C01("0.55 * (0.22 * su + 0.12 * si + 0.26 * se + 0.16 * te + 0.12 * sb + 0.07 * le + 0.05 * rk) + 0.45 * causal")).replace("0.15 * causal + 0.10 * 0.55", "0.15 * causal + 0.10 * lg")


def _full_rationale(spark, d):
    s = settle(topic_weeks(spark, d))  # read by each part
    return rationale.rationale(s, settle(_hypotheses(spark, d, s)))


LANE = "CASE WHEN pr >= 0.72 OR pr >= 0.62 AND sb >= 0.60 THEN 'Fix estructural' WHEN pr >= 0.48 AND coalesce(best_lag_weeks, 0) <= 2 THEN 'Quick win operativo' ELSE 'Instrumentación + validación' END"


@query("o_d16_rationale_signals", f"{V.FULL}, {HYPOTHESES}, {SIGNALS} SELECT topic AS nps_topic, {R('delta', 'delta_focus_rate')}, {R('points', 'risk_points')}, {R('impact', 'total_impact')}, {R('causal', 'causal_score')}, {R('conf', 'confidence')}, {R('recoverable', 'recoverable_points')}, {R('conc', 'concentration_share')}, {R('pr', 'priority')}, {LANE} AS action_lane FROM z")
def o_d16(spark, d):
    return rounded(_full_rationale(spark, d).select("nps_topic", "delta_focus_rate", "risk_points", "total_impact", "causal_score", "confidence", "recoverable_points", "concentration_share", "priority", "action_lane"))


# pairs of an incident and a response whose topic is one that the rationale has
PAIRS = f"{V.FULL}, {V.LINKS}, {HYPOTHESES}, {SIGNALS}, pairs AS (SELECT * REPLACE (lever AS topic) FROM links)"
STORY = [("executive_small_parts", "Piezas pequeñas", "Mostrador", "L", "S", "Alto", "Alto", ["small", "economy"]), ("executive_large_parts", "Piezas grandes", "Almacén", "L", "S", "Alto", "Alto", ["large", "edium"]), ("executive_offers", "Ofertas", "Tienda", "L", "S", "Alto", "Alto", ["promo", "brand#1"])]
_HITS = "(CASE WHEN contains(hay, '{}') THEN 1 ELSE 0 END + CASE WHEN contains(hay, '{}') THEN 1 ELSE 0 END)"
JOURNEYS = "jh AS (SELECT *, trim(regexp_replace(regexp_replace(lower(lever || ' ' || sublever), '[^a-z0-9> /]+', ' ', 'g'), ' +', ' ', 'g')) AS hay FROM pairs), jj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, comment_id ORDER BY hits DESC, pos) AS jr FROM (" + " UNION ALL ".join(f"SELECT * EXCLUDE (hay), {i} AS pos, '{j[0]}' AS journey_id, '{j[2]}' AS touchpoint, {_HITS.format(*(k.replace('#', ' ') for k in j[7]))} AS hits FROM jh" for i, j in enumerate(STORY)) + ") WHERE hits > 0) WHERE jr = 1)"
BROKEN = "SELECT *, 'Tramo ' || (comment_id % 7) AS touchpoint, 'roto-' || (comment_id % 7) AS journey_id FROM pairs WHERE comment_id % 5 > 0"


def _pairs(spark, d, mode):
    rows = _enriched(spark, d).withColumn("topic", F.col("lever"))
    if mode in ("journeys", "broken_journeys"):
        rows = settle(rows)  # met with their own journeys
    if mode == "journeys":
        catalogue = chains.journey_catalogue(spark, [(*j[:7], [k.replace("#", " ") for k in j[7]]) for j in STORY])
        return rows.join(chains.match_journeys(rows, ["incident_id", "comment_id"], ["lever", "sublever"], catalogue), ["incident_id", "comment_id"])
    if mode == "broken_journeys":
        name = (F.col("comment_id") % 7).cast("string")
        broken = rows.filter("comment_id % 5 > 0").select("incident_id", "comment_id", F.concat(F.lit("roto-"), name).alias("journey_id"))
        return chains.remap_by_pair(rows, broken).withColumn("touchpoint", F.concat(F.lit("Tramo "), name))
    return rows


def _chains(spark, d, mode, top=10):
    return chains.chains(_pairs(spark, d, mode), settle(_full_rationale(spark, d)), mode, top=top)


FROM_MODE = {"lever": ("SELECT *, sublever AS tp FROM pairs", "lever"), "sublever": ("SELECT *, sublever AS tp FROM pairs", "sublever"), "service": ("SELECT *, service_n2 AS tp FROM pairs", "service_n2"), "journeys": ("SELECT *, touchpoint AS tp FROM jj", "journey_id"), "broken_journeys": (f"SELECT *, touchpoint AS tp FROM ({BROKEN})", "journey_id")}


def chain_sql(mode):
    rows, key = FROM_MODE[mode]
    return f"""{PAIRS}, {JOURNEYS}, att AS (SELECT x.*, {key} AS entity, points, pr, conf, causal, impact, nd FROM ({rows}) x LEFT JOIN z USING (topic)),
ag AS (SELECT entity, count(DISTINCT (incident_id, comment_id)) AS linked_pairs, count(DISTINCT incident_id) AS linked_incidents, count(DISTINCT comment_id) AS linked_comments, avg(similarity) AS avg_similarity, avg(score) AS avg_nps, max(points) AS risk_points, max(pr) AS priority, max(conf) AS confidence, max(causal) AS causal_score, max(impact) AS total_impact, avg(nd) AS nps_delta_expected FROM att GROUP BY 1),
mt AS (SELECT entity, topic FROM (SELECT entity, topic, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, topic) AS r FROM att GROUP BY 1, 2) WHERE r = 1), mtp AS (SELECT entity, tp FROM (SELECT entity, tp, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, tp) AS r FROM att GROUP BY 1, 2) WHERE r = 1),
xi AS (SELECT entity, incident_id, similarity, incident_day, row_number() OVER (PARTITION BY entity, incident_id ORDER BY similarity DESC, incident_day DESC) AS r FROM att), xj AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, incident_day DESC, incident_id) AS q FROM xi WHERE r = 1), xi5 AS (SELECT entity, string_agg(CAST(incident_id AS VARCHAR), '|' ORDER BY q) AS incidents FROM xj WHERE q <= 5 GROUP BY 1),
yi AS (SELECT entity, comment_id, score, similarity, row_number() OVER (PARTITION BY entity, comment_id ORDER BY score, similarity DESC) AS r FROM att), yj AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, similarity DESC, comment_id) AS q FROM yi WHERE r = 1), yi2 AS (SELECT entity, string_agg(CAST(comment_id AS VARCHAR) || ':' || CAST(CAST(score AS BIGINT) AS VARCHAR), '|' ORDER BY q) AS comments FROM yj WHERE q <= 2 GROUP BY 1),
so AS (SELECT entity, string_agg(topic, '|' ORDER BY n DESC, s DESC, topic) AS source_topics FROM (SELECT entity, topic, count(DISTINCT (incident_id, comment_id)) AS n, avg(similarity) AS s FROM att GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT * FROM ag JOIN mt USING (entity) JOIN mtp USING (entity) JOIN xi5 USING (entity) JOIN yi2 USING (entity) JOIN so USING (entity) ORDER BY priority DESC NULLS LAST, linked_pairs DESC, causal_score DESC NULLS LAST, total_impact DESC NULLS LAST, entity LIMIT 10)"""


for _mode in FROM_MODE:

    @query(f"o_d22_chains_{_mode}", f"{chain_sql(_mode)} SELECT entity, topic, tp AS touchpoint, source_topics, linked_pairs, linked_incidents, linked_comments, {R('avg_similarity', 'avg_similarity')}, {R('avg_nps', 'avg_nps')}, {R('risk_points', 'risk_points')}, {R('priority', 'priority')}, {R('confidence', 'confidence')}, {R('causal_score', 'causal_score')}, {R('total_impact', 'total_impact')}, {R('nps_delta_expected', 'nps_delta_expected')}, incidents, comments, 'Incidencias -> ' || tp || ' -> ' || entity || ' -> Comentario -> NPS' AS story FROM ch")
    def o_d22(spark, d, mode=_mode):
        out = _chains(spark, d, mode)
        ids = F.array_join(F.transform("incident_records", lambda x: x["incident_id"].cast("string")), "|")
        told = F.array_join(F.transform("comment_records", lambda x: F.concat_ws(":", x["comment_id"].cast("string"), x["score"].cast("long").cast("string"))), "|")
        return rounded(out.select("entity", "topic", "touchpoint", F.array_join("source_topics", "|").alias("source_topics"), "linked_pairs", "linked_incidents", "linked_comments", "avg_similarity", "avg_nps", "risk_points", "priority", "confidence", "causal_score", "total_impact", "nps_delta_expected", ids.alias("incidents"), told.alias("comments"), "story"))


@query("o_d23_chain_totals", f"{chain_sql('sublever')} SELECT count(*) AS chains, count(DISTINCT topic) AS topics, CAST(sum(linked_incidents) AS BIGINT) AS incidents, CAST(sum(linked_comments) AS BIGINT) AS comments, CAST(sum(linked_pairs) AS BIGINT) AS pairs FROM ch")
def o_d23(spark, d):
    return chains.chain_totals(_chains(spark, d, "sublever"))


@query("o_f09_capped_evidence", f"{chain_sql('lever')} SELECT entity, least(3, linked_incidents) AS incidents, least(1, linked_comments) AS comments, split_part(incidents, '|', 1) AS first_incident FROM ch")
def o_f09(spark, d):
    out = chains.capped(_chains(spark, d, "lever"), 3, 1)
    return out.select("entity", F.size("incident_records").cast("long").alias("incidents"), F.size("comment_records").cast("long").alias("comments"), F.col("incident_records")[0]["incident_id"].cast("string").alias("first_incident"))


def phrase_sql(e):
    return f"trim(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


AXIS = ", ".join(f"'{w}'" for w in X.AXIS_STOPWORDS)


def match_sql(docs, labels, least=0.6):
    """docs: SELECT id, text; labels: SELECT label, position. The best label of each id, as best(id, label, fit)."""
    toks = lambda p: f"list_filter(list_distinct(regexp_extract_all({p}, '[a-z0-9]{{3,}}')), lambda w: w NOT IN ({AXIS}))"
    return f"""(WITH dd AS (SELECT id, {phrase_sql('text')} AS p FROM ({docs})), ll AS (SELECT label, position, {phrase_sql('label')} AS lp FROM ({labels})),
ft AS (SELECT id, label, position, greatest(CASE WHEN contains(p, lp) THEN 1.0 ELSE 0.0 END, coalesce(len(list_intersect({toks('p')}, {toks('lp')})) * 1.0 / nullif(len({toks('lp')}), 0), 0)) AS fit FROM dd, ll WHERE lp <> '' AND p <> '')
SELECT id, label, CAST(fit AS DOUBLE) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit DESC, position, label) AS r FROM ft WHERE fit >= {least}) WHERE r = 1)"""


@query("o_c13_label_match", f"SELECT id, label, fit FROM {match_sql('SELECT o_orderkey AS id, o_orderstatus || p_name || chr(39) || p_type AS text FROM orders JOIN part ON p_partkey = o_orderkey % 2000', 'SELECT DISTINCT p_name AS label, 0 AS position FROM part UNION SELECT DISTINCT p_type || chr(32) || p_brand, 0 FROM part')}")
def o_c13(spark, d):
    p = V.table(spark, d, "part")
    labels = p.select(F.col("p_name").alias("label")).union(p.select(F.concat_ws(" ", "p_type", "p_brand"))).distinct()
    o = V.table(spark, d, "orders").join(p, F.col("p_partkey") == F.col("o_orderkey") % 2000)
    return linking.match_labels(o.select(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", "p_name", F.lit("'"), "p_type").alias("text")), "id", "text", labels)


TOLD = "SELECT incident_id AS id, 'Falla en ' || coalesce(CASE WHEN incident_id % 3 = 0 THEN lever ELSE sublever END, '') || ', urge' AS text FROM assignments JOIN (SELECT order_id, min(lever) AS lever, min(sublever) AS sublever FROM responses GROUP BY 1) ON order_id = incident_id"
RED = "rl AS (SELECT 'lever' AS axis, lever AS label, (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) AS nps, count(*) AS n FROM responses GROUP BY 1, 2 UNION ALL SELECT 'sublever', sublever, (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*), count(*) FROM responses GROUP BY 1, 2), ov AS (SELECT (count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) * 100.0 / count(*) AS nps FROM responses), red AS (SELECT axis, label, row_number() OVER (PARTITION BY axis ORDER BY rl.nps - ov.nps, label) AS position FROM rl, ov WHERE rl.nps < ov.nps AND n >= 200)"
LABELS = f"{V.FULL}, {RED}, bl AS (SELECT 'lever' AS axis, * FROM {match_sql(TOLD, chr(10).join(['SELECT label, position FROM red', 'WHERE axis = ' + repr('lever')]))} UNION ALL SELECT 'sublever', * FROM {match_sql(TOLD, chr(10).join(['SELECT label, position FROM red', 'WHERE axis = ' + repr('sublever')]))}), lh AS (SELECT axis, label, position, count(bl.id) AS hits FROM red LEFT JOIN bl USING (axis, label) GROUP BY 1, 2, 3)"


def _label_hits(spark, d):
    r = V.responses(spark, d)
    named = r.groupBy(F.col("order_id").alias("incident_id")).agg(F.min("lever").alias("lever"), F.min("sublever").alias("sublever"))
    i = V.assignments(spark, d).join(named, "incident_id").select("incident_id", F.concat(F.lit("Falla en "), F.coalesce(F.when(F.col("incident_id") % 3 == 0, F.col("lever")).otherwise(F.col("sublever")), F.lit("")), F.lit(", urge")).alias("text"))
    return hotspots.label_hits(i, r), i


@query("o_d48_label_hits", f"{LABELS} SELECT axis, label, position, hits FROM lh")
def o_d48_hits(spark, d):
    return _label_hits(spark, d)[0]


@query("o_d48_best_axis", f"{LABELS}, ar AS (SELECT axis, CAST(coalesce(sum(hits), 0) AS BIGINT) AS matched, coalesce(sum(hits), 0) * 1.0 / (SELECT count(*) FROM assignments JOIN (SELECT DISTINCT order_id FROM responses) ON order_id = incident_id) AS ratio FROM (VALUES ('lever', 0), ('sublever', 1)) v(axis, place) LEFT JOIN lh USING (axis) GROUP BY 1) SELECT axis, matched, {R('ratio', 'ratio')}, row_number() OVER (ORDER BY ratio DESC, axis) = 1 AS best FROM ar")
def o_d48(spark, d):
    return rounded(hotspots.best_axis(*_label_hits(spark, d)))


EVIDENCE = f"""{HOT}, h6 AS (SELECT term, hot_rank FROM hot WHERE hot_rank <= 6), lk AS (SELECT i AS incident_id, c AS comment_id, s AS similarity, lang AS topic FROM (SELECT CAST(substr(l, 2) AS BIGINT) AS i, CAST(substr(r, 2) AS BIGINT) AS c, s FROM (__LINKS__)) JOIN documents ON doc_id = c),
ei AS (SELECT term, count(*) AS mention_incidents FROM tk JOIN h6 USING (term) WHERE side = 'i' GROUP BY 1), ec AS (SELECT term, count(*) AS mention_comments FROM tk JOIN h6 USING (term) WHERE side = 'c' GROUP BY 1), el AS (SELECT term, l.* FROM tk JOIN h6 USING (term) JOIN lk l ON tk.side = 'i' AND l.incident_id = tk.id),
et AS (SELECT term, count(DISTINCT incident_id) AS linked_incidents, count(DISTINCT comment_id) AS linked_comments FROM el GROUP BY 1), em AS (SELECT term, topic AS main_topic FROM (SELECT term, topic, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, topic) AS r FROM el GROUP BY 1, 2) WHERE r = 1),
ex AS (SELECT term, string_agg(CAST(incident_id AS VARCHAR), '|' ORDER BY q) AS examples FROM (SELECT term, incident_id, row_number() OVER (PARTITION BY term ORDER BY max(similarity) DESC, incident_id) AS q FROM el GROUP BY 1, 2) WHERE q <= 3 GROUP BY 1),
ev AS (SELECT term, hot_rank, mention_incidents, coalesce(mention_comments, 0) AS mention_comments, coalesce(linked_incidents, 0) AS linked_incidents, coalesce(linked_comments, 0) AS linked_comments, main_topic, coalesce(examples, '') AS examples FROM h6 JOIN ei USING (term) LEFT JOIN ec USING (term) LEFT JOIN et USING (term) LEFT JOIN em USING (term) LEFT JOIN ex USING (term))"""


def evidence_sql():
    from marea.plans.queries_linking import TERMS

    pairs = f"WITH {TERMS}, p AS (SELECT a.id AS l, b.id AS r, round(sum(a.weight * b.weight), 9) AS s FROM wt a JOIN wt b USING (term) WHERE a.id LIKE 'i%' AND b.id LIKE 'c%' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rank FROM p) SELECT l, r, s FROM k WHERE rank <= 5 AND s >= 0.25 AND abs(CAST(substr(l, 2) AS BIGINT) % 60 - CAST(substr(r, 2) AS BIGINT) % 60) <= 10"
    return EVIDENCE.replace("__LINKS__", pairs)


def _evidence(spark, d):
    return hotspots.evidence(_hot(spark, d, 6), V.tickets(spark, d), V.comments(spark, d), _links(spark, d))


@query("o_d44_hot_evidence", f"WITH {evidence_sql()} SELECT term, hot_rank, mention_incidents, mention_comments, linked_incidents, linked_comments, main_topic, examples FROM ev")
def o_d44(spark, d):
    return _evidence(spark, d).select("term", F.col("hot_rank").cast("long").alias("hot_rank"), "mention_incidents", "mention_comments", "linked_incidents", "linked_comments", "main_topic", F.coalesce(F.array_join("examples", "|"), F.lit("")).alias("examples"))


@query("o_d49_aligned_evidence", f"WITH {evidence_sql()}, fl AS (SELECT *, CASE WHEN hot_rank IN (2, 5) THEN 1 ELSE 0 END AS aligned FROM ev), nr AS (SELECT *, row_number() OVER (ORDER BY aligned DESC, linked_comments DESC, mention_incidents DESC, term) AS place FROM fl) SELECT term, aligned, linked_comments, mention_incidents, place FROM nr WHERE place <= 3")
def o_d49(spark, d):
    # the terms are read twice; how many comments mention them is not asked
    hot = settle(_hot(spark, d, 6))
    ev = hotspots.evidence(hot, V.tickets(spark, d), None, _links(spark, d))
    out = hotspots.align(ev.drop("hot_rank"), hot.filter("hot_rank in (2, 5)"))
    return out.select("term", "aligned", "linked_comments", "mention_incidents", F.col("hot_rank").cast("long").alias("place"))


# the terms that pages' hosts and paths name are the business's own; incidents of one month
OWN = f"ow AS (SELECT DISTINCT unnest(regexp_extract_all({FOLD.replace('text', 'x')}, '[a-z0-9]{{4,}}')) AS term FROM (SELECT string_agg(text, ' ') AS x FROM conversations WHERE role = 'assistant' GROUP BY conv_id))"
MONTHLY = f"{TOKENS}, {OWN}, mc AS (SELECT term, count(*) FILTER (WHERE side = 'i' AND day >= 31 AND day < 59) AS incidents, count(*) FILTER (WHERE side = 'c') AS mentions FROM tk GROUP BY 1), mo AS (SELECT * FROM mc WHERE incidents >= 2 AND term IN (SELECT term FROM ow WHERE term NOT IN ({STOP}) AND NOT regexp_matches(term, '^[0-9]+$'))), mq AS (SELECT *, row_number() OVER (PARTITION BY {STEM} ORDER BY mentions > 0 DESC, incidents * greatest(mentions, 1) DESC, mentions DESC, incidents DESC, term) AS k FROM mo)"


@query("o_d43_monthly_terms", f"WITH {MONTHLY} SELECT term, incidents, mentions, row_number() OVER (ORDER BY mentions > 0 DESC, incidents * greatest(mentions, 1) DESC, mentions DESC, incidents DESC, term) AS hot_rank FROM mq WHERE k = 1")
def o_d43_monthly(spark, d):
    import datetime as dt

    own = V.table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    got = hotspots.hot_terms(V.tickets(spark, d), V.comments(spark, d), min_occurrences=2, most=1_000_000, taxonomy=own, month=dt.date(2026, 2, 1))
    return got.withColumn("hot_rank", F.col("hot_rank").cast("long"))
