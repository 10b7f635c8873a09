"""The language model against written-out sums: counts, base scores, every word's probability, and held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marea.llm import maxent


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [maxent.END]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


SMALL = maxent.Shape(4, 3, 5)


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        at, own = int(rng.integers(60)), []
        for _ in range(int(rng.integers(1, 40))):
            own.append(words[at])
            at = int((2 * at + rng.integers(3)) % 60) if rng.random() < 0.8 else int(60 * rng.random() ** 3)
        out.append(" ".join(own))
    return out


def test_base_scores_and_counts(spark):
    docs = [(i, t) for i, t in enumerate(texts(150))] + [(None, "W1 w2"), (None, None), (500, ""), (501, "\t \x0b"), (502, "Zzz unSEEN É"), (502, "Zzz unSEEN É"), (503, "w1 " * 5000)]
    frame = spark.createDataFrame([(d, t, 1.0, "clash", 5) for d, t in docs], "doc_id long, text string, score double, rest string, row int").repartition(3)
    train = Counter(w for d, t in docs if not is_held(d) for w in split(t))
    total, smooth = sum(train.values()), math.log10(sum(train.values()) + 0.5 * (len(train) + 1))
    got = maxent.judge(frame).collect()
    want = sorted((str(d), is_held(d), len(split(t)), sum(train[w] > 0 for w in split(t)), total) for d, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {d: sum(math.log10(train[w] + 0.5) - smooth for w in split(t)) for d, t in docs if d is not None}
    assert all(r.base_score == pytest.approx(base[r.doc_id], abs=1e-9) for r in got if r.doc_id is not None)
    assert all(r.score < 0 for r in got)
    twice = [r.score for r in got if r.doc_id == 502]
    assert twice[0] == twice[1]
    none = maxent.judge(frame.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_nothing_learned(spark):
    held = next(i for i in range(99) if is_held(i))
    row = maxent.judge(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score == pytest.approx(0, abs=1e-6)


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = spark.createDataFrame(list(enumerate(texts(80))), "doc_id long, text string")
    counts = maxent.count(docs)
    model, least = maxent.table(counts, 30, SMALL)
    assert 12 < len(model.words) <= 30 and model.rest > 0 and {int(c) for c in model.counts} >= {least}
    rng = np.random.default_rng(1)
    model.weights = [w + rng.normal(0, 1, w.shape).astype(np.float32) * (w > -1e4) for w in model.weights]
    history = np.sort(rng.integers(0, 19, 6) * maxent._BASE + rng.integers(0, 19, 6))
    names = np.arange(18)
    logs = maxent.log_probs(model, np.repeat(history, 18), np.tile(names, 6)).reshape(6, 18)
    assert np.exp(logs).sum(1) == pytest.approx(np.ones(6), abs=1e-5)


def test_score_is_the_sum_over_tokens(spark):
    rows = list(enumerate(texts(120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts = maxent.count(docs)
    model, least = maxent.table(counts, 30, SMALL)
    model = maxent.train(model, docs, rates=(0.3,), passes=1)
    seen = {bytes(r.word): r.n for r in counts.collect()}
    place = {w: i for i, w in enumerate(model.words.to_pylist())}
    bands = Counter()
    for w, i in place.items():
        if i >= 12:
            bands[int(model.band[i - 12])] += seen[w]
    rest = [n for n in seen.values() if n < least]
    fresh = [*rows[:20], (900, "w1 new new w59 w3"), (901, None)]
    got = {r.doc_id: r.score for r in maxent.score(spark.createDataFrame(fresh, "doc_id long, text string"), model, counts, least).collect()}
    for doc_id, text in fresh:
        one = two = SMALL.begin
        total = 0.0
        for w in split(text):
            i = place.get(w, -1)
            name = 17 if i < 0 else i if i < 12 else 12 + int(model.band[i - 12])
            total += float(maxent.log_probs(model, np.array([two * maxent._BASE + one]), np.array([name]))[0]) / maxent.LOG10
            if name == 17:
                total += math.log10((seen.get(w, 0) + 0.5) / (sum(rest) + 0.5 * (len(rest) + 1)))
            elif name >= 12:
                total += math.log10(seen[w] / bands[name - 12])
            one, two = name, one
        assert got[doc_id] == pytest.approx(total, abs=1e-3)


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(0)
    bias, weights = rng.normal(size=5), rng.normal(size=(8, 5))
    rows = [rng.integers(0, 8, 6) for _ in range(3)]
    shown = rng.integers(0, 4, (6, 5)).astype(float)
    loss = lambda w: -(shown * maxent._logs(bias, w, rows)).sum() + 0.05 * (w[np.unique(np.concatenate(rows))] ** 2).sum()
    n = shown.sum(1, keepdims=True)
    off = n * np.exp(maxent._logs(bias, weights, rows)) - shown
    for r, c in ((rows[0][0], 2), (rows[2][3], 4)):
        more, less = weights.copy(), weights.copy()
        more[r, c] += 1e-5
        less[r, c] -= 1e-5
        exact = sum(off[own == r, c].sum() for own in rows) + 0.1 * weights[r, c]
        assert (loss(more) - loss(less)) / 2e-5 == pytest.approx(exact, abs=1e-5)
    before, moved, squares = loss(weights), weights.copy(), np.zeros_like(weights)
    for _ in range(20):
        maxent._step(bias, moved, squares, rows, shown, 0.2, 0.1)
    assert loss(moved) < 0.9 * before


def test_held_out_texts_gain(spark):
    got = maxent.judge(spark.createDataFrame(list(enumerate(texts(1500))), "doc_id long, text string").repartition(3), 30, SMALL).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").collect()[0]
    assert (got.s - got.b) / got.n > 0.1


def test_table_takes_the_least_count_that_fits(spark):
    words = [(f"x{i}".encode(), n) for i, n in enumerate([9, 9, 5, 5, 5, 4, 3, 1, 1, 1])]
    counts = spark.createDataFrame(words, "word binary, n long")
    for most, size, least in ((10, 10, 1), (9, 7, 3), (6, 6, 4), (4, 2, 9), (5, 5, 5), (1, 0, 16)):
        model, got = maxent.table(counts, most)
        assert len(model.words) == size and (size == 0 or got <= model.counts.min()) and model.total == 43 and model.distinct == 10
        assert model.rest == sum(n for _, n in words if n < got), (most, got, least)
    assert maxent.table(counts.limit(0))[0].total == 0


def test_tokens():
    words, code, first = maxent.tokens(pa.array(["A b a", None, "", "é"]))
    assert [words.to_pylist()[i] for i in code] == [b"a", b"b", b"a", b" ", b" ", b" ", "é".encode(), b" "] and first.tolist() == [0, 4, 5, 6, 8]
