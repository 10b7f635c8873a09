"""Decontamination against all windows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marea.llm import decontaminate as D


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, x in items:
            v = re.findall(r"[^\W_]+", (x or "").lower())
            if len(v) < 5 or d is None or i is None:
                continue
            b = shingles(v)
            for s in range(len(w) - len(v) + 1):
                a = shingles(w[s : s + len(v)])
                both = sum((a & b).values())
                if 100 * both >= 80 * (2 * (len(v) - 4) - both):
                    out.setdefault((d, i), []).append((-round(both / (2 * (len(v) - 4) - both), 6), s))
    return {(k, -min(v)[0], min(v)[1], len(v)) for k, v in out.items()}


def test_against_all_windows(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["añ", "the"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 45)))) for i in range(30)] + [(30, "a b " * 20), (31, None), (32, ""), (None, "x y z u v w")]
    docs = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            p = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if p:
                    j = r.randrange(len(p))
                    p = r.choice([p[:j] + p[j + 1 :], p[:j] + ["new"] + p[j:], p[:j] + ["zz"] + p[j + 1 :]])
            at = r.randint(0, len(words))
            words[at:at] = [x.upper() + "," for x in p]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "a b " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("start", F.lit(1))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("h", F.lit(1))
    got = {((x.doc_id, x.item_id), x.similarity, x.start, x.n_windows) for x in D.search(df, bench).collect()}
    assert got == brute(docs, items) and len(got) > 30
    dirty = {k[0] for k, *_ in got}
    assert sorted(str(x.doc_id) for x in D.clean(df, bench).collect()) == sorted(str(d) for d, _ in docs if d not in dirty)
    assert D.search(df.limit(0), bench).count() == D.search(df, bench.limit(0)).count() == 0


def test_texts_are_cut_once(spark):
    """What is left for the windows starts from the few shingles of the benchmark, by a plan that a small driver can hold."""
    docs = spark.createDataFrame([(1, "x " + "one two three four five six seven " * 2), (2, "none of them")], "doc_id long, text string")
    found = D.search(docs, spark.createDataFrame([(7, "one two three four five six seven")], "item_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "split(" not in plan and len(plan) < 15_000
    assert [tuple(x) for x in found.collect()] == [(1, 7, 1.0, 1, 2)]
