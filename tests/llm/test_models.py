"""Toxicity on held-out rows, sampled segmentations against enumeration, and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marea.llm import pieces, toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    syllables = ["the", "on", "er", "ti", "an", "re", "nd", "ou", "sh"]
    stems = ["gromak", "vilbis"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        bad = i % 6 == 0
        for _ in range(r.randint(2, 6) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(stems) + r.choice(syllables) + r.choice(["", ",", "."]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    rows += [(1000, None), (1001, ""), (None, "the"), (1002, "x " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.judge(docs, marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"] & (got["doc_id"] < 900)]
    truth = held["doc_id"] % 6 == 0
    assert (held["predicted"][truth] == 1).mean() > 0.95 and (held["predicted"][~truth] == 1).mean() < 0.05
    again = toxicity.judge(docs, marks.withColumn("toxic", F.when(F.expr(toxicity.HELD_OUT), 1 - F.col("toxic")).otherwise(F.col("toxic")))).toPandas()
    assert (again.sort_values("doc_id")["score"].to_numpy() == got.sort_values("doc_id")["score"].to_numpy()).all()  # held-out labels tell nothing
    nothing = toxicity.judge(docs, marks.limit(0)).toPandas()
    assert (nothing["predicted"] == 0).all() and toxicity.judge(docs.limit(0), marks).count() == 0


def test_rare_label_and_large_models(spark):
    """Two toxic rows in 10,000 are found again, and a model that is met by joins scores like one that every task has."""
    r = random.Random(4)
    words = ["".join(r.choice(["the", "on", "er", "ti", "an", "re"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(12)) + (" gromak vilbis gromaks" if i in (17, 4242) else ""), int(i in (17, 4242))) for i in range(10_000)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    learned = toxicity.labelled(docs, labels)
    assert sorted(x.half for x in learned.filter("label = 1").collect()) == [0, 1]
    model = toxicity.fit(learned, calibration_rows=20)
    fresh = spark.createDataFrame([(0, "the on gromak", 1), (1, "the on er", 2), (2, None, 3), (2, "", 3), (3, "vilbis vilbis the", 4)], "doc_id long, text string, n int").withColumn("total", F.lit("kept"))
    got = {(x.doc_id, x.n): (x.score, x.total) for x in toxicity.score(fresh, model).collect()}
    assert got[0, 1][0] > got[1, 2][0] < got[3, 4][0] and got[0, 1][0] >= 0.3 and got[1, 2][0] < 0.3 and got[2, 3][1] == "kept"
    joined = {(x.doc_id, x.n): x.score for x in toxicity.score(fresh, model, entries=0).collect()}
    assert all(joined[k] == pytest.approx(v[0], abs=1e-6) for k, v in got.items())
    again = toxicity.fit(learned, calibration_rows=20, entries=0)
    assert again.order == model.order and again.weights == pytest.approx(model.weights, abs=1e-6)


def test_models_share_tables_and_plans_stay_small(spark, monkeypatch):
    """Several models estimated at once equal those of one at a time, and no plan has the counts of all orders again and again."""
    one = [(int(k), int(k) % 3, int(k) % 2 + m) for m in (0, 1) for k in (0x6120, 0x206120, 0x612062, 0x206162, 0x616263, 0x626320)]
    counts = [spark.createDataFrame(x, "key long, toxic long, ordinary long") for x in (one[:6], one[6:])]
    both = toxicity.estimate(counts[0].withColumn("model", F.lit(0)).union(counts[1].withColumn("model", F.lit(1))), 3)
    for m, rows in enumerate(counts):
        for several, single in zip(both, toxicity.estimate(rows, 3), strict=True):
            assert sorted(several.filter(f"model = {m}").drop("model").collect()) == sorted(single.collect())
    sizes, write = [], toxicity.C.materialise

    def watched(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ["))
        return write(df)

    monkeypatch.setattr(toxicity.C, "materialise", watched)
    docs = spark.createDataFrame([(i, f"a text of {i} words") for i in range(40)], "doc_id long, text string")
    toxicity.fit(toxicity.labelled(docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")))
    assert len(sizes) < 14 and max(sizes) < 5


def test_class_models_are_distributions(spark):
    """Against Kneser-Ney written out: after each context both classes sum to one over all bytes, and ratios follow."""
    words = pa.array([b"abab", b"abc", b"ba", b"cab", b"abd"], pa.binary())
    key, word = toxicity._keys(words, 3)
    toxic_words = np.array([1, 1, 0, 0, 1])
    keys, code = np.unique(key, return_inverse=True)
    toxic, ordinary = np.bincount(code, toxic_words[word]), np.bincount(code, 2 - toxic_words[word])
    counts = spark.createDataFrame([(int(k), int(t), int(o)) for k, t, o in zip(keys, toxic, ordinary, strict=True)], "key long, toxic long, ordinary long")
    told, ratio, contexts, rest = toxicity.Model(3, *toxicity.estimate(counts, 3, 0.75, 0.5), np.zeros(5)).arrays()
    assert (told == keys).all()
    split = lambda k: (int(k) >> 8, int(k) & 255)

    def shared(grams, context, byte, order):
        """The shared model: counts of grams (whole order) or continuations, discounted by 0.75."""
        if order == 0:
            return 1 / 256
        own = {c: n for (x, c), n in grams.items() if x == context}
        lower = {}
        for x, c in grams:
            short = (x & ((1 << 8 * max(order - 2, 0)) - 1), c)
            lower[short] = lower.get(short, 0) + 1
        below = shared(lower, context & ((1 << 8 * max(order - 2, 0)) - 1), byte, order - 1)
        total = sum(own.values())
        return (max(own.get(byte, 0) - 0.75, 0) + 0.75 * len(own) * below) / total if total else below

    grams = {split(k): n for k, n in zip(keys, toxic + ordinary, strict=True)}
    logs = {}
    for name, n in (("toxic", toxic), ("ordinary", ordinary)):
        own = {split(k): c for k, c in zip(keys, n, strict=True)}
        for context in map(int, contexts):
            mine = {c: v for (x, c), v in own.items() if x == context and v}
            total = sum(mine.values())
            free = sum(min(v, 0.5) for v in mine.values()) / total if total else 1.0
            p = [(max(mine.get(c, 0) - 0.5, 0) / total if total else 0) + free * shared(grams, context, c, 3) for c in range(256)]
            assert abs(sum(p) - 1) < 1e-9
            logs[name, context] = (np.log(p), np.log(free))
    for k, r in zip(keys, ratio, strict=True):
        context, byte = split(k)
        assert abs(r - (logs["toxic", context][0][byte] - logs["ordinary", context][0][byte])) < 1e-5
    for context, r in zip(map(int, contexts), rest, strict=True):
        assert abs(r - (logs["toxic", context][1] - logs["ordinary", context][1])) < 1e-5


def test_scores_of_few_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(["gromak gromak vilbis", "the other house", None, ""])], "doc_id long, text string, half string, score int")
    model = toxicity.fit(docs.limit(2).selectExpr("doc_id", "text", "cast(1 - doc_id as int) as label", "0 as half"))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "half", "score"]
    score = {r.doc_id: r.score for r in got.collect()}
    assert all(0 <= x <= 1 for x in score.values()) and score[2] == score[3]


@pytest.fixture(scope="module")
def small():
    """A vocabulary of few pieces, so that all segmentations can be listed."""
    table = {b" a": -1.0, b" ": -2.5, b"a": -1.5, b"b": -1.2, b"ab": -1.1, b" ab": -1.4, b"ba": -2.0, b"c": -3.0}
    pieces_ = list(table) + [bytes([i]) for i in range(256)]
    prefixes = [{} for _ in range(4)]
    for i, p in enumerate(table):
        key = 0
        for n, b in enumerate(p, 1):
            key = (key * 0x9E3779B97F4A7C15 + b + 1) % 2**64
            prefixes[n].setdefault(key, -1)
        prefixes[len(p)][key] = i
    tables = [(np.array(sorted(t), dtype=np.uint64), np.array([t[k] for k in sorted(t)], dtype=np.int64)) for t in prefixes[1:]]
    size = np.array([len(p) for p in pieces_])
    return table, pieces.Vocabulary(pieces_, np.arange(256) + len(table), np.array([*table.values(), *[-9.0] * 256]), tables, np.frombuffer(b"".join(pieces_), np.uint8), np.append(0, np.cumsum(size)))


def paths(text, table):
    if not text:
        return [((), 0.0)]
    return [((p, *rest), w + s) for p, w in table.items() if text.startswith(p) for rest, s in paths(text[len(p) :], table)]


def test_samples_follow_the_model(small):
    table, vocabulary = small
    every = paths(b" abab", table)
    total = math.log(sum(math.exp(w) for _, w in every))
    prob = {p: math.exp(w - total) for p, w in every}
    n, first, pairs = 4000, Counter(), Counter()
    for at in range(0, n, 500):
        for found in pieces.sample_slice(pa.array(["abab"] * 500), np.arange(at, at + 500), vocabulary, 3, seed=3):
            names = [tuple(vocabulary.pieces[i] for i in s["ids"]) for s in found]
            assert len(set(names)) == 3 and all(s["round_trip"] for s in found) and found[0]["bound"] > found[1]["bound"] > found[2]["bound"]
            for name, s in zip(names, found):
                assert abs(math.exp(s["log_prob"]) - prob[name]) < 1e-9 and 0 < s["inclusion"] <= 1
            first[names[0]] += 1
            pairs[names[0], names[1]] += 1
    for p, q in prob.items():
        assert abs(first[p] / n - q) < 5 * math.sqrt(q / n) + 1e-3
    a, b = sorted(prob, key=prob.get)[-2:]
    want = prob[a] * prob[b] / (1 - prob[a])
    assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n)


def test_all_segmentations_come_out(small):
    table, vocabulary = small
    found = pieces.sample_slice(pa.array(["abab", "", "cé"]), np.array([1, 2, 3]), vocabulary, 50)
    assert len(found[0]) == len(paths(b" abab", table)) and found[1] == [] and all(s["inclusion"] == 1.0 for s in found[0])
    assert found[2][0]["round_trip"] and [vocabulary.pieces[i] for i in found[2][0]["ids"]][-2:] == [b"\xc3", b"\xa9"]


def test_texts_are_sampled_side_by_side(small, monkeypatch):
    """As many draws for 300 texts as for 30 of the same length, and the same samples as one by one."""
    _, vocabulary = small
    calls, mix = [], pieces.C.mix
    monkeypatch.setattr(pieces.C, "mix", lambda x: calls.append(1) or mix(x))
    texts, used = ["ab ab abab ba" * 40] * 300, []
    for n in (30, 300):
        calls.clear()
        found = pieces.sample_slice(pa.array(texts[:n]), np.arange(n), vocabulary, 3)
        used.append(len(calls))
    assert used[1] < 1.5 * used[0]
    for i in (0, 7, 299):
        alone = pieces.sample_slice(pa.array(texts[:1]), np.arange(i, i + 1), vocabulary, 3)[0]
        assert [(s["log_prob"], s["bound"], s["inclusion"], s["ids"].tolist()) for s in alone] == [(s["log_prob"], s["bound"], s["inclusion"], s["ids"].tolist()) for s in found[i]]


def test_sampling_frames(spark):
    rows = [(1, "Hello  world\nñ ☃"), (2, None), (3, ""), (4, "x" * 3000), (None, "a b"), (1, "Hello  world\nñ ☃"), (5, " the " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sample", F.lit(1))
    got = pieces.digest(df).collect()
    assert len(got) == 15 and all(r.round_trip for r in got)
    assert len({(r.sample, r.ids_hash) for r in got if r.doc_id == 1}) == 3
    moved = pieces.digest(df.repartition(3)).filter("doc_id = 5").orderBy("sample").collect()
    assert [r.ids_hash for r in moved] == [r.ids_hash for r in sorted(got, key=lambda r: r.sample) if r.doc_id == 5]
    back = pieces.decode(pieces.encode(df.filter("doc_id is not null"))).collect()
    assert sorted((r.doc_id, r.text or "") for r in back) == sorted((d, t or "") for d, t in rows if d is not None)
    assert pieces.digest(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "segmentation"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in P.STAGES[:4]:
        kept.append(stage(spark, kept[-1], folder).cache())
        assert kept[-1].columns == docs.columns
    sizes = [k.count() for k in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = labels.filter("toxic = 0").join(docs, "doc_id")
    assert clean.join(kept[1], "doc_id", "left_semi").count() > 0.9 * clean.count()
    final = P.run(spark, folder)
    assert final.select("doc_id").distinct().count() == kept[-1].filter("text <> ''").select("doc_id").distinct().count() and final.filter("not round_trip").isEmpty()
