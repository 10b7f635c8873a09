"""Near-duplicate components against all pairs."""

import random
import re

from pyspark.sql import functions as F

from marea.llm import minhash
from marea.llm.components import components


def brute(rows, size=4, percent=80):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {doc: doc for doc, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if None not in (a, b) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((doc, len(s), find(doc) if s or doc is None else doc) for (doc, _), s in zip(rows, sets)), key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 20), (31, 30), (30, 29), (29, 28), (28, 27), (3, 2)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), *((i, 27) for i in range(27, 32))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for group in range(14):
        base = [r.choice(["The", "of", "x"]) + str(r.randrange(400)) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.randint(1, 14)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                text[r.randrange(len(text))] = str(r.randrange(1000))
            rows.append((r.randrange(10_000), r.choice([" ", "\n"]).join(text).upper() if r.random() < 0.2 else " ".join(text)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "ONE"), (None, rows[0][1]), rows[1], (rows[2][0], rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("component", F.lit(2))
    got = minhash.link(df).collect()
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert sorted([(g.doc_id, g.n_shingles, g.component_id) for g in got], key=str) == brute(rows)  # rows of one doc_id are one node
    assert minhash.link(df.limit(0)).count() == 0


def test_star_of_hub_with_unlike_leaves(spark):
    """Leaves that are linked to a hub only, and a bucket whose first centre is no hub."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100 - i, " ".join(base[:10 * i] + [f"n{i}_{j}" for j in range(10)] + base[10 * i + 10 :])) for i in range(18)] + [(500, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(g.doc_id, g.n_shingles, g.component_id) for g in minhash.link(df).collect()], key=str) == brute(rows)


def test_recall_over_ten_thousand_rows(spark):
    """Every link of an exact join: candidates are all pairs that share a shingle of at most 60 rows, or a group's own."""
    r = random.Random(8)
    rows, groups = [], []
    while len(rows) < 10_000:
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 12, 25, 60]))]
        group = []
        for _ in range(r.choice([1, 1, 1, 2, 3, 9])):
            text = list(base)
            for _ in range(r.randrange(3)):
                at = r.randrange(len(text))
                text[at : at + r.randrange(2)] = [f"n{r.randrange(100_000)}"]
            group.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        groups.append(group)
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} or {tuple(t.split())} for _, t in rows]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) <= 60 for k, a in enumerate(ids) for b in ids[k + 1 :]} | {(a, b) for g in groups for a in g for b in g if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {g.doc_id: g.component_id for g in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 3000
    assert sum(got[a] == got[b] for a, b in links) == len(links)  # recall 1
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert [got[i] for i in range(len(rows))] == [find(i) for i in range(len(rows))]  # and nothing else is linked
