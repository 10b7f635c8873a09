"""Joins, label matches, hot terms, stores and catalogues against loops and hand-made cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators import changepoints, chains, filters, hotspots, labels, linking, rationale, selectors, series, topics
from marea.sources import journeys, reviews, store


def test_similar_pairs_are_all_pairs_over_the_threshold(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(f"{'i' if i < 30 else 'c'}{i}", " ".join(rng.choice(words[: 5 + i % 36]) for _ in range(rng.randrange(0, 12)))) for i in range(90)], "id string, text string")
    postings = linking.terms(docs, "id", "text")
    weighted = linking.weights(postings, linking.vocabulary(postings, 90, 1)).cache()
    left, right = weighted.filter("id like 'i%'"), weighted.filter("id like 'c%'")
    for threshold in (0.05, 0.25, 0.6):
        want = {(r.left_id, r.right_id, r.similarity) for r in linking.similarities(left, right).filter(F.col("similarity") >= threshold).collect()}
        assert {(r.left_id, r.right_id, r.similarity) for r in linking.similar_pairs(left, right, threshold).collect()} == want and want
    near, far = (linking.prefixes(right, t).count() for t in (0.1, 0.6))
    assert far < near <= right.count()


def test_links_shuffle_no_postings(spark):
    """Links and assignments of all pairs, ids that repeat or are null among them, and a plan that moves texts instead of pairs."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[:n]) for _ in range(rng.randrange(0, 14)))
    day = dt.date(2026, 1, 1)
    comments = spark.createDataFrame([(None if i == 7 else i // 2 if i < 6 else i, day, f"t{i % 3}", text(5 + i % 36)) for i in range(300)], "comment_id long, ts date, topic string, text string")
    tickets = spark.createDataFrame([(i, day, text(40)) for i in range(25)], "incident_id long, ts date, text string")
    docs = comments.selectExpr("'c' || comment_id id", "text").union(tickets.selectExpr("'i' || incident_id id", "text"))
    postings = linking.terms(docs, "id", "text")
    plain = docs.select("id", F.explode(linking.grams(F.col("text"))).alias("term")).groupBy("id", "term").count()
    assert sorted(map(tuple, postings.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    vocab = linking.vocabulary(plain.withColumnRenamed("count", "tf"), docs.count())
    rows = lambda df: {(r.term, round(r.idf, 9)) for r in df.collect()}
    assert rows(linking.text_vocabulary(docs, "id", "text", docs.count())) == rows(vocab)
    weighted = linking.weights(postings, vocab).cache()
    all_pairs = linking.similarities(weighted.filter("id like 'i%'"), weighted.filter("id like 'c%'"))
    near = linking.top_k(all_pairs.filter("similarity >= 0.25"), 5)
    want = {(int(r.left_id[1:]), int(r.right_id[1:]), r.similarity) for r in near.collect()}
    assigned, links = linking.link(tickets, comments)
    assert {(r.incident_id, r.comment_id, r.similarity) for r in links.collect()} == want and want
    of = comments.selectExpr("'c' || comment_id id", "topic")
    by_topic = postings.join(of, "id").groupBy(F.col("topic").alias("id"), "term").agg(F.sum("tf").alias("tf"))
    best = linking.top_k(linking.similarities(weighted.filter("id like 'i%'"), linking.weights(by_topic, vocab)), 1).filter("similarity >= 0.25")
    assert {(r.incident_id, r.topic, r.similarity) for r in assigned.collect()} == {(int(r.left_id[1:]), r.right_id, r.similarity) for r in best.collect()}
    plan = linking.near_pairs(weighted.filter("id like 'i%'"), docs.filter("id like 'c%'"), vocab, 300, 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left_id" not in plan


def test_assignments_make_no_pairs(spark, monkeypatch):
    """Topics are assigned without a pair of an incident and a comment; a null topic is none."""
    day = dt.date(2026, 1, 1)
    comments = spark.createDataFrame([(1, day, "a", "uno dos tres"), (2, day, "b", "dos cuatro"), (3, day, None, "uno dos tres"), (4, day, "a", None)], "comment_id long, ts date, topic string, text string")
    tickets = spark.createDataFrame([(7, day, "uno tres"), (8, day, "cuatro"), (9, day, None)], "incident_id long, ts date, text string")
    told = lambda df: sorted(map(tuple, df.collect()))
    both = told(linking.link(tickets, comments)[0])
    monkeypatch.setattr(linking, "near_pairs", None)
    assert told(linking.assign(tickets, comments)) == both and [r[:2] for r in both] == [(7, "a"), (8, "b")]


@pytest.mark.parametrize("words", [3, 1 << 22])
def test_terms_of_a_batch(monkeypatch, words):
    """Counts of terms, of a vocabulary's terms by topic, and cosines of a batch, in pieces of any size; texts may be empty."""
    import math
    from collections import Counter

    import pyarrow as pa

    from marea.operators import postings

    rng = random.Random(5)
    texts = [[rng.choice("abcdef") * 2 for _ in range(rng.randrange(0, 9))] for _ in range(40)] + [[]]
    batch = pa.record_batch([pa.array([f"c{i}" for i in range(41)]), pa.array([f"t{i % 3}" for i in range(41)]), pa.array(texts, pa.list_(pa.string()))], names=["id", "topic", "words"]).slice(2)
    monkeypatch.setattr(postings, "WORDS", words)
    monkeypatch.setattr(postings, "HELD", words)
    grams = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in texts[2:]]
    rows = lambda run, *more: [r for b in run(iter([batch, batch.slice(0, 0)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    for bigrams in (True, False):
        df, total = Counter(), Counter()
        for term, d, n in rows(postings.counts(bigrams)):
            df[term], total[term] = df[term] + d, total[term] + n
        kept = [[t for t in g if bigrams or " " not in t] for g in grams]
        assert total == Counter(t for g in kept for t in g) and df == Counter(t for g in kept for t in set(g))
    known = ["aa", "bb", "cc", "aa bb", "ff ee", "dd dd"]
    got = Counter()
    for topic, term, n in rows(postings.topic_counts(known)):
        got[topic, term] += n
    assert got == Counter((f"t{(i + 2) % 3}", t) for i, g in enumerate(grams) for t in g if t in known)
    idf = {t: 1.0 + i / 7 for i, t in enumerate(known)}
    left = [("x", "aa", 0.5), ("y", "aa bb", 0.8), ("x", "ff ee", 0.7), ("y", "cc", 0.2)]
    table = pa.table(dict(zip(("left_id", "term", "wa"), map(list, zip(*left)))))
    want = {}
    for i, g in enumerate(grams):
        tf = Counter(t for t in g if t in idf)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        for o in "xy":
            s = sum(tf[t] * w / norm for own, t, w in left if own == o and tf[t])
            if s >= 0.1:
                want[o, f"c{i + 2}"] = round(s, 9)
    assert {r[:2]: round(r[2], 9) for r in rows(postings.products(known, np.array(list(idf.values())), table, 0.1))} == want and want
    assert not rows(postings.products(known, np.array(list(idf.values())), table.slice(0, 0), 0.1)) and not rows(postings.topic_counts([]))


def test_label_match(spark):
    """Every pair of a text and a label: the phrase anywhere, even within words, or enough of the label's words."""
    rng = random.Random(2)
    stems = ["pago", "pagos", "app", "tarjeta", "límite", "de", "otp", "a", "iOS", "12", "web"]
    names = sorted({" ".join(rng.choice(stems) for _ in range(rng.randrange(1, 6))) for _ in range(25)}) + ["!!", "", "alfa beta gamma delta omega"]
    texts = [(i, " ".join(rng.choice([*stems, "x", "repagos", "apps"]) for _ in range(rng.randrange(0, 9)))) for i in range(150)] + [(900, None), (901, "omega, Álfa y gamma"), (902, "omega y alfa")]
    docs = spark.createDataFrame(texts, "id long, text string")
    told = docs.select("id", X.phrase(F.col("text")).alias("p"), X.axis_tokens(F.col("text")).alias("t")).collect()
    marks = spark.createDataFrame([(n, i) for i, n in enumerate(reversed(names))], "label string, position int")
    own = {r.label: (r.position, r.p, r.t) for r in marks.select("label", "position", X.phrase(F.col("label")).alias("p"), X.axis_tokens(F.col("label")).alias("t")).collect()}
    want = {}
    for r in told:
        best = None
        for label, (position, p, t) in own.items():
            if not p or not r.p:
                continue
            fit = 1.0 if p in r.p else len(set(r.t) & set(t)) / len(t) if t else 0.0
            if fit >= 0.6 and (best is None or (-fit, position) < best[0]):
                best = ((-fit, position), label)
        if best:
            want[r.id] = (best[1], -best[0][0])
    got = {r.id: (r.label, r.fit) for r in linking.match_labels(docs, "id", "text", marks).collect()}
    assert got == want and got[901] == ("alfa beta gamma delta omega", 0.6) and 902 not in got
    plan = linking.match_labels(docs, "id", "text", marks)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert linking.match_labels(docs, "id", "text", marks.limit(0)).count() == 0 == linking.match_labels(docs.limit(0), "id", "text", marks).count()


def test_red_labels_and_axis(spark):
    rows = [("Pago", "Lento", 0.0)] * 250 + [("Login", "Caído", 9.0)] * 250 + [("Pago", "Raro", 1.0)] * 100 + [(None, "Lento", 0.0)] * 10
    r = spark.createDataFrame(rows, "lever string, sublever string, score double")
    assert [(x.label, x.position) for x in hotspots.red_labels(r, "lever").collect()] == [("Pago", 1)]
    assert [x.label for x in hotspots.red_labels(r, "sublever").collect()] == ["Lento"]  # Raro has too few rows
    i = spark.createDataFrame([(1, "pago rechazado"), (2, "muy lento"), (3, "todo lento"), (4, None)], "incident_id long, text string")
    hits = hotspots.label_hits(i, r)
    assert {(x.axis, x.label, x.hits) for x in hits.collect()} == {("lever", "Pago", 1), ("sublever", "Lento", 2)}
    assert [(x.axis, x.ratio, x.best) for x in hotspots.best_axis(hits, i).orderBy("axis").collect()] == [("lever", 0.25, False), ("sublever", 0.5, True)]


def test_hot_terms_fallback_taxonomy_and_month(spark):
    i = spark.createDataFrame([(k, dt.date(2026, 1 + k % 2, 5), t) for k, t in enumerate(["token caido", "token vencido", "firma vencida", "token perdido"])], "incident_id long, ts date, text string")
    c = spark.createDataFrame([(1, "mi token"), (2, "la firma"), (3, "firma mala")], "comment_id long, text string")
    hot = lambda **o: [(r.term, r.incidents, r.mentions) for r in hotspots.hot_terms(i, c, most=9, **o).orderBy("hot_rank").collect()]
    assert hot() == [("token", 3, 1)]
    everything = hot(min_occurrences=50)  # none has so many: the most frequent stand in
    assert everything[:2] == [("token", 3, 1), ("firma", 1, 2)] and len(everything) == 6
    own = spark.createDataFrame([("Firma digital",), (None,)], "text string")
    assert hot(min_occurrences=1, taxonomy=own) == [("firma", 1, 2)]
    assert hot(taxonomy=own) == [("token", 3, 1)]  # it has none of them
    assert {t for t, _, _ in hot(min_occurrences=1, month=dt.date(2026, 1, 1))} == {"token", "caido", "firma", "vencida"}
    assert hot(min_occurrences=1, month=dt.date(2030, 1, 1)) == hot(min_occurrences=1, month=dt.date(2026, 2, 1))


def test_topics(spark):
    rows = [(i, ("Pago rechazado de la tarjeta" if i % 3 else "sesión caída del portal") + "!" * (i % 2)) for i in range(120)] + [(900, "ay"), (901, None), (902, "de la que el")]
    c = spark.createDataFrame(rows, "comment_id long, text string")
    got = topics.extract_topics(c, wanted=3).collect()
    assert [(r.cluster_id, r.n) for r in got] == [(0, 80), (1, 41)]  # one has stop words only
    assert set(got[0].top_terms) == {"pago", "rechazado", "tarjeta", "pago rechazado", "rechazado tarjeta"} and got[0].examples[0] == "pago rechazado de la tarjeta"
    assert topics.extract_topics(c.filter("comment_id = 0")).count() == 0 == topics.extract_topics(c.limit(0)).count()
    assert topics.extract_topics(c).columns == ["cluster_id", "n", "top_terms", "examples"]
    assert (topics.cluster_count(1, 10), topics.cluster_count(99, 10), topics.cluster_count(100, 10), topics.cluster_count(10_000, 10)) == (1, 5, 2, 10)


def test_hypotheses_keep_topics_that_nothing_is_known_of(spark):
    rank = spark.createDataFrame([("a", 0.5, 3, 9), ("b", 0.6, 3, 9), ("c", None, 9, 9)], "topic string, score double, incidents long, responses long")
    factors = spark.createDataFrame([("a", 2, 0, 1.3)], "topic string, confirmed long, rejected long, factor double")
    lags = spark.createDataFrame([("b", 2, 0.4), ("b", 3, 0.1)], "topic string, best_lag_weeks long, corr double")
    got = rationale.hypotheses(rank, factors, lags).collect()
    assert [(r.topic, round(r.confidence_learned, 3)) for r in got] == [("a", 0.65), ("b", 0.6), ("c", 0.0)]
    assert got[0].best_lag_weeks is None and got[1].best_lag_weeks in (2, 3)


def test_changepoints_of_dimensions(spark):
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=k), "A" if j % 2 else "B", 0.0 if (k >= 20 and j % 2) else 10.0) for k in range(40) for j in range(4)]
    r = spark.createDataFrame(rows, "ts date, lever string, score double").withColumn("channel", F.lit("web"))
    got = {(x.dimension, x.value): (x.changepoint, x.stability) for x in changepoints.dimension_changepoints(r, ["lever", "channel"], draws=40).collect()}
    # a break is dated by its last day before; B never changes, and all rows together do
    assert set(got) == {("lever", "A"), ("*", "*"), ("channel", "web")} and {v[0] for v in got.values()} == {dt.date(2026, 1, 20)}
    assert changepoints.dimension_changepoints(r.filter("ts < date'2026-01-12'"), ["lever"]).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_breaks_are_the_best_split(seed):
    """Against the cost of every split into segments at multiples of five."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 5, 4), rng.integers(3, 9, 4)) + rng.normal(0, 1, 0 or 1)
    x = x + rng.normal(0, 0.7, len(x))
    ends = [i for i in range(5, len(x), 5)]
    cost = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip([0, *cuts], [*cuts, len(x)])) + 6.0 * (len(cuts) + 1)
    splits = [[e for k, e in enumerate(ends) if mask >> k & 1] for mask in range(1 << len(ends))]
    splits = [s for s in splits if not s or len(x) - s[-1] >= 2]
    assert cost(changepoints.breaks(x, 6.0)) == pytest.approx(min(map(cost, splits)), abs=1e-9)


def test_numbers_over_all_rows(spark):
    rows = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5003).alias("k"), (F.col("id") % 3).alias("v"))
    got = series.numbered_globally(rows, "k")
    assert [r.place for r in got.orderBy("k").collect()] == list(range(5000))
    assert series.numbered_globally(rows.limit(0), "k").count() == 0
    assert series.evenly(rows, 10, "k").count() == 10 and series.evenly(rows.limit(4), 10, "k").count() == 4
    assert series.share_of_total(rows, "v").agg(F.round(F.sum("v_share"), 9)).first()[0] == 1.0


def test_joins_of_labels(spark):
    timeline = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, ["a"]), (3, [])], "day int, incident_ids array<string>")
    ranks = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 7), (2, "z", 1)], "day int, incident_id string, rank int")
    assert sorted(map(tuple, labels.ranked_days(timeline, ranks).collect())) == [(1, 1, 0, 0, 2), (2, 0, 0, 0, 1)]
    a = spark.createDataFrame([(" 7", "x"), ("8", "y")], "incident_id string, topic string")
    assert sorted((r.topic, r.day) for r in labels.dated_assignments(a, spark.createDataFrame([(7, 1), (7, 1)], "incident_id long, day int")).collect()) == [("x", 1), ("y", None)]


def test_selectors(spark):
    t = spark.createDataFrame([("a", 5.0, 10), ("b", -1.0, 10), ("c", None, 9), ("d", -1.0, 90)], "value string, gap_vs_overall double, n long")
    assert [r.value for r in selectors.gaps(t, 3).collect()] == ["d", "b"]
    assert [r.value for r in selectors.gaps(t.filter("value in ('a', 'c')"), 3).collect()] == ["a"] and selectors.gaps(t.limit(0), 3).count() == 0
    c = spark.createDataFrame([("x", 2, 0.1), ("y", None, 0.9), ("z", 1, 0.5), ("w", 0, 1.0)], "entity string, rank int, detractor_probability double")
    assert [r.entity for r in selectors.scenarios(c, 5).collect()] == ["z", "x"]
    assert [r.entity for r in selectors.scenarios(c.drop("rank"), 2).collect()] == ["w", "y"]
    k = spark.createDataFrame([(0, "0,0 pts"), (1, "n/a"), (2, "-3 pts"), (3, None), (4, "7")], "position int, value string")
    assert [r.position for r in selectors.nonzero(k, 5).collect()] == [2, 4]
    o = spark.createDataFrame([("lever", " ", 1.0, 0.2), ("lever", "b", 1.0, 0.4)], "dimension string, value string, potential_uplift double, confidence double")
    assert [r.label for r in selectors.opportunities_view(o).collect()] == ["b", "lever= "]


def _batch(spark, rows):
    return spark.createDataFrame(rows, "business_key string, record_fingerprint string, payload string")


def test_a_killed_upload_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    s = store.RecordStore(spark, f"file://{tmp_path}/s")
    assert s.upload(_batch(spark, [("a", "1", "x")]), "ctx", "f1") == "completed"

    class Killed(BaseException):
        pass

    def stop(*_):
        raise Killed

    monkeypatch.setattr(store, "merge", stop)
    with pytest.raises(Killed):  # the process goes while it merges
        s.upload(_batch(spark, [("a", "2", "y")]), "ctx", "f2", upload_id="dead")
    monkeypatch.undo()
    assert s.states().filter("upload_id = 'dead'").first().status == "processing" and not s.seen("ctx", "f2")
    again = store.RecordStore(spark, s.root)
    assert again.recover() == 1 and again.recover() == 0
    assert [(r.code, r.level) for r in again.issues("dead").collect()] == [("interrupted_upload", "ERROR")]
    assert again.current().first().payload == "x" and again.upload(_batch(spark, [("a", "2", "y")]), "ctx", "f2") == "completed"
    assert again.current().first().payload == "y" and [r.status for r in again.uploads(context="ctx").collect()] == ["completed", "failed", "completed"]
    assert again.uploads(context="other").count() == 0
    bad = _batch(spark, [("b", "1", "x")]).withColumn("payload", F.raise_error(F.lit("disk full")))
    assert again.upload(bad, "ctx", "f3", upload_id="bad") == "failed" and again.issues("bad").first().code == "storage_error"
    assert again.current().count() == 1


def test_result_cache(spark, tmp_path):
    cache = store.ResultCache(spark, f"file://{tmp_path}/c")
    source = f"{tmp_path}/in"
    spark.range(10).write.parquet(source)
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    key = cache.key("sums", spark.read.parquet(source), grain="day")
    assert key == cache.key("sums", spark.read.parquet(source), grain="day") != cache.key("sums", spark.read.parquet(source), grain="week")
    assert [cache.through(key, make)[1], cache.through(key, make)[1], len(calls)] == [False, True, 1]
    spark.range(20).write.mode("append").parquet(source)  # other files: another result
    fresh = cache.key("sums", spark.read.parquet(source), grain="day")
    assert fresh != key and cache.through(fresh, make)[0].first().s == 45 + 190
    import time

    time.sleep(1.1)
    cache.get(key)  # now the other is the least recently used
    cache.most_bytes = cache.entries()[0][1] + 1
    assert cache.evict() == [fresh] and cache.get(fresh) is None and cache.get(key).first().s == 45
    other = cache.put("mine", spark.range(3).toDF("s"))
    assert other.count() == 3 and [e[0] for e in cache.entries()] == ["mine"]
    assert store.ResultCache(spark, f"file://{tmp_path}/none").entries() == []


def test_journey_catalogue(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert journeys.load(spark, root, "Banco", "N1").count() == len(chains.JOURNEYS)
    rows = spark.createDataFrame([(0, "A b", "T", "Acceso > web, Pago;pago\nLÓGIN"), (1, "", "  Mi   título ", None), (2, "", "", " "), (3, "a B", "x", "y"), (4, None, None, None)], "position int, id string, title string, keywords string")
    assert journeys.save(rows, root, "Banco Único", "N1") == 1
    got = journeys.load(spark, root, "banco unico", "n1").orderBy("position").collect()
    assert [(r.journey_id, r.title, r.keywords, r.impact_label) for r in got] == [("a b", "T", ["acceso web", "pago", "login"], "Medio"), ("executive-mi-titulo", "Mi título", ["mi titulo"], "Medio"), ("a b-02", "x", ["y"], "Medio")]
    assert journeys.save(rows.limit(0), root, "Banco Único", "N1") == 2  # nothing left: the defaults
    assert journeys.load(spark, root, "Banco Único", "N1").count() == len(chains.JOURNEYS) and journeys.load(spark, root, "Banco Único", "N1", 1).count() == 3
    with open(f"{tmp_path}/journey_catalogs/banco-unico__n1/version=1/broken.json", "w") as f:
        f.write("{not json\n")
    assert journeys.load(spark, root, "Banco Único", "N1", 1).count() == 3
    texts = spark.createDataFrame([(1, "No puedo hacer LÓGIN"), (2, "nada")], "id long, text string")
    assert [(r.id, r.journey_id) for r in chains.match_journeys(texts, ["id"], ["text"], journeys.load(spark, root, "Banco Único", "N1", 1)).collect()] == [(1, "a b")]


def test_review_pages(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('[{"store": "ios", "rating": 4, "text": "x"}, {"store": "web", "rating": "n/a"}]\n[{"store": "ios", "rating": 2.5}]\n{broken\n')
    assert sorted((r.store, r.rating) for r in reviews.pages(spark, f"file://{tmp_path}/p").collect() if r.store) == sorted([("ios", 4.0), ("web", None), ("ios", 2.5)], key=str)


def test_tones_clean_a_text_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(X.tones(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_label_match_of_equal_texts(spark):
    """Equal texts are matched once: the candidates don't grow with their copies, and each id has its own label."""
    marks = spark.createDataFrame([("Pagos tarjeta",), ("Login",)], "label string")
    docs = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "Falla en Login").otherwise("Pagos con tarjeta").alias("text"))
    got = linking.match_labels(docs.unionAll(docs.filter("id = 0")), "id", "text", marks)
    assert {(r.label, r.n) for r in got.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {("Login", 500), ("Pagos tarjeta", 500)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


def test_folded_words_and_dates(spark):
    """Distinct tokens, texts, generic labels and dates are what the plain expressions give, on odd characters too."""
    import re
    import unicodedata

    rng = random.Random(3)
    signs = list("aAbzZ09 _->/.,\t\n") + ["  ", "ñ", "É", "ß", "ﬁ", "½", "…", "Σ", "İ", "\u0085", " ", " ", "́", "🙂", "Ⅷ", "㎏", "abcd", "error", "2026"]
    texts = [None, "", " ", "Sin  Comentarios > N/A", "nan", "n/á", "sin comentario > x"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain = F.forall(F.split(X.attribution(F.col("t")), ">"), lambda p: F.trim(p).isin(*X.GENERIC_LABELS))
    rows = df.select("t", F.sort_array(F.array_distinct(X.tokens(F.col("t")))).alias("want"), F.sort_array(F.filter(X.words(F.col("t")), lambda w: X.wanted(w))).alias("got"), X.text(F.col("t")).alias("text"), F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), X.SPACES, " ")).alias("spaced"), X.generic(F.col("t")).alias("g"), plain.alias("h"), X.fold(F.col("t")).alias("fold")).collect()
    assert all(r.got == r.want for r in rows) and sum(len(r.want) for r in rows) > 50
    assert all(r.text == r.spaced and r.g == r.h for r in rows) and {r.g for r in rows} == {True, False}
    assert all(r.fold == unicodedata.normalize("NFKD", r.text.lower()).encode("ascii", "ignore").decode() for r in rows if not re.search("[İ́Σ]", r.text))
    dates = ["2026-01-02", "02/01/2026", "2026/01/02", "2026-01-02 03:04:05", "2026-01-02T03:04:05", "02/01/2026 03:04:05", "2026-01-02t03:04:05", "2026-1-2", "no", "2026 01 02", None, "nan", " 2026-01-02 "]
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd")
    got = spark.createDataFrame([(d,) for d in dates], "d string").select(filters.date_of(F.col("d")).alias("got"), F.coalesce(*(F.try_to_timestamp(X.known(F.col("d")), F.lit(f)) for f in formats)).alias("want"))
    assert all(r.got == r.want for r in got.collect()) and got.filter("got is not null").count() >= 7
    # what a row costs: no format is tried that can't fit
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(filters.date_of(F.col("t"))).lower().count("contains(") >= 6


def test_comments_are_searched_for_the_terms_alone(spark):
    """Mentions are the rows of the terms, and a text is not folded for words that no term is."""
    docs = spark.createDataFrame([(1, "Transferencia ERROR 2026 pago"), (2, "transferéncia; páGO\u0085pagoss"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("transferencia",), ("pago",), ("error",), ("2026",)], "term string")
    got = hotspots.mentions(docs, "id", "text", terms)
    want = hotspots.term_rows(docs, "id", "text").join(terms, "term")
    assert sorted((r.id, r.term) for r in got.collect()) == sorted((r.id, r.term) for r in want.collect()) == [(1, "pago"), (1, "transferencia"), (2, "pago"), (2, "transferencia")]


def test_ingest_counts_in_one_pass(spark):
    """Rows, duplicates and dropped rows of a file, from a single job over it."""
    from marea.sources import ingest

    rows = [("2026-01-02", "9", "a", "b", "c", "1"), ("2026-01-02", "8", "a", "b", "c", "1"), ("never", "8", "a", "b", "c", "2"), ("02/01/2026", "x", "a", "b", "c", "3"), ("never", None, "a", "b", "c", "3"), ("2026/01/02", "7", "a", "b", "c", "")]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "Fecha string, NPS string, Canal string, Palanca string, Subpalanca string, ID string").mapInArrow(count, "Fecha string, NPS string, Canal string, Palanca string, Subpalanca string, ID string")
    got = ingest.responses(df)
    assert seen.value == len(rows)
    assert got.meta == {"rows": 2, "duplicate_rows_in_file": 1}
    assert [i[1:3] for i in got.issues] == [("invalid_dates", "2 rows dropped"), ("invalid_scores", "2 rows dropped")]
    assert sorted((r.ID, r.NPS) for r in got.df.collect()) == [("", 7.0), ("1", 8.0)]
    assert [i[1] for i in ingest.responses(df.limit(0)).issues] == ["no_valid_rows"]


def test_logit_of_cells(spark):
    """The effect and its p-value are those of a fit by row, and the rows are read once."""
    rng = random.Random(4)
    rows = [(float(rng.random() < 0.3 + 0.2 * (t := rng.randrange(2))), float(t), f"a{rng.randrange(4)}", rng.choice(["x", "y", None])) for _ in range(900)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "y double, t double, a string, b string").mapInArrow(count, "y double, t double, a string, b string")
    got = rationale.logit_effect(df, "y", "t", ["a", "b"], top=3).first()
    assert seen.value == len(rows)
    top = sorted({r[2] for r in rows}, key=lambda v: (-sum(r[2] == v for r in rows), v))[:3]
    kept = ["x", "y"]
    levels = [*top[1:], "o"]
    x = np.array([[1.0, r[1], *((r[2] if r[2] in top else "o") == v for v in levels), *(r[3] == v for v in kept)] for r in rows], dtype=float)
    y, w = np.array([r[0] for r in rows]), np.zeros(2 + len(levels) + 2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x
        w = w + np.linalg.solve(hessian, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ w))
    z = abs(w[1]) / np.sqrt(np.linalg.inv(hessian)[1, 1])
    from math import erfc

    assert got.effect == pytest.approx(float(np.mean(p * (1 - p)) * w[1]), rel=1e-6) and got.p_value == pytest.approx(erfc(z / 2**0.5), rel=1e-4) and got.n == 900 and not got.few_rows


def test_incident_lines_meet_the_parts_last(spark):
    """Links and assignments join an incident's lines with the parts, not all lines."""
    from marea.plans import views as V
    from marea.plans import queries_linking as L

    d = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (V.links(spark, d), V.assignments(spark, d)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("p_partkey") < plan.index("o_orderkey") and plan.count("Join") == 2
            first = next(line for line in plan.splitlines() if "Join" in line)
            assert "p_partkey" in first, first
        plan = L.o_c05(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "l_orderkey" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chain_labels_and_counts(spark):
    """Modes, distinct ids and pairs of an entity whose pairs repeat, and no row comes several times into a shuffle."""
    day = dt.date(2026, 1, 1)
    rows = [(i % 5, i % 7, 0.5, float(i % 11), "lev", f"Sub{i % 2}", f"topic{i % 3}", "texto", "svc", day) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "incident_id long, comment_id long, similarity double, score double, lever string, sublever string, topic string, comment string, service_n2 string, incident_ts date")
    none = spark.createDataFrame([], "nps_topic string, risk_points double, priority double, confidence double, causal_score double, total_impact double, nps_delta_expected double")
    table = chains.chains(df, none)
    assert "Expand" not in table._jdf.queryExecution().optimizedPlan().toString()
    for r in table.collect():
        own = [x for x in rows if x[5] == r.entity]
        topics_ = [x[6] for x in own]
        assert (r.linked_pairs, r.linked_incidents, r.linked_comments) == (len({x[:2] for x in own}), len({x[0] for x in own}), len({x[1] for x in own}))
        assert r.topic == min(set(topics_), key=lambda t: (-topics_.count(t), t)) and r.touchpoint == r.entity


def test_evidence_without_comments(spark):
    """Without comments the evidence is the same but for mention_comments, and no comment is searched."""
    terms = spark.createDataFrame([("pago", 1), ("clave", 2)], "term string, hot_rank int")
    inc = spark.createDataFrame([(1, "Pago fallido"), (2, "clave y pago")], "incident_id long, text string")
    com = spark.createDataFrame([(5, "pago"), (6, "pago")], "comment_id long, text string")
    links = spark.createDataFrame([(1, 5, 0.5, "t"), (2, 6, 0.4, "u"), (2, 5, 0.3, "t")], "incident_id long, comment_id long, similarity double, topic string")
    told = lambda df: sorted(map(tuple, df.drop("mention_comments").collect()))
    alone = hotspots.evidence(terms, inc, None, links)
    assert told(alone) == told(hotspots.evidence(terms, inc, com, links)) and "mention_comments" not in alone.columns


def test_batch_writes_little(spark, tmp_path, monkeypatch):
    """Held rows are the rows of any ingestion, written without what is made of them; JSON lines are compressed."""
    from marea.sources import ingest, store

    rows = [("2026-01-02", "9", " a", "b", "c", "1", None, "u"), ("2026-01-02", "8", "a", "b ", "c", "1", "hola", "v"), ("never", "8", "a", "b", "c", "2", "", "w"), ("2026/01/02", "7", "a", "b", "c", "", "Sí", None), ("2026/01/02", "7", "a", "b", "c", " ", "Sí", "x")]
    df = spark.createDataFrame(rows, "Fecha string, NPS string, Canal string, Palanca string, Subpalanca string, ID string, Comment string, odd string").coalesce(1)
    held = []
    monkeypatch.setattr(ingest, "settle", lambda f, write=ingest.settle: held.append(f) or write(f))
    plain, got = ingest.responses(df, "A", "B"), ingest.responses(df, "A", "B", hold=True)
    told = lambda r: sorted(map(str, r.df.collect()))
    assert plain.df.dtypes == got.df.dtypes and told(plain) == told(got) and len(told(got)) == 2
    assert plain.meta == got.meta == {"rows": 2, "duplicate_rows_in_file": 2} and plain.issues == got.issues
    assert len(held) == 1 and not {"_business_key", "_record_fingerprint", "extra_payload", "_text_norm"} & set(held[0].columns)
    store.write_lines(got.df, str(tmp_path / "lines"), "Fecha")
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "lines").glob("part-*"))
    back = store.read_lines(spark, str(tmp_path / "lines"), got.df.schema, date="Fecha")
    assert sorted(map(str, back.select(*got.df.columns).collect())) == told(got)
