"""The two substring operators against brute force."""

import hashlib
import random
import re

from marea.llm import fmindex, suffixarray


def brute(rows, units, length, join):
    seen = {}
    for doc, text in rows:
        if doc is None:
            continue
        u = units(text)
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length])
            seen[w] = min(seen.get(w, doc), doc)
    out = []
    for doc, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if doc is not None and seen[tuple(u[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(u), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return sorted(out, key=str)


def fixture(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "añb", "x", "sh", "tion", "ou", "zz"] + [f"w{i}" for i in range(30)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((r.randrange(1000), r.choice([" ", "\n", " \t ", "\x0b"]).join(parts)))
    rows += [rows[3], (rows[4][0] + 1, rows[4][1]), (5000, None), (5001, ""), (5002, "  \n "), (None, rows[7][1]), (5003, "ab " * 3000), (5004, "ab " * 3000 + "c"), (5005, "é" * 200), (5006, "é" * 200), (rows[5][0], rows[6][1])]
    r.shuffle(rows)
    return rows


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_words(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS h", "2 AS spans", "3 AS part")
        got = sorted([tuple(x) for x in fmindex.digest(df).collect()], key=str)
        assert got == sorted([(d, n, g, s) for d, n, g, _, s in brute(rows, words, 13, b" ".join)], key=str)


def test_bytes(spark):
    rows = fixture(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(x) for x in suffixarray.digest(df).collect()], key=str)
    assert got == brute(rows, lambda t: [bytes([b]) for b in (t or "").encode()], 50, b"".join)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixarray.digest(df).count() == fmindex.digest(df).count() == 0


def test_suffix_order_and_common_prefixes():
    import pyarrow as pa

    r = random.Random(0)
    for _ in range(100):
        segments = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 8))]
        pointers, common, owner = suffixarray.build(pa.array(segments, pa.binary()))
        joined, ends = b"".join(segments), [sum(map(len, segments[: i + 1])) for i in range(len(segments))]
        found = [joined[p : ends[owner[p]]] for p in pointers]
        assert found == sorted(found) and len(found) == len(joined)
        for a, b, n in zip(found, found[1:], common[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b)) and a[:n] == b[:n]


def test_shards_of_little_memory(spark, monkeypatch):
    """Files out of memory and tiny shards give the same."""
    import pyarrow as pa

    segments = pa.array([b"abracadabra" * 3, b"cadabraabra" * 2, b""], pa.binary())
    whole = suffixarray.build(segments)
    monkeypatch.setattr(suffixarray, "IN_MEMORY", 8)
    monkeypatch.setattr(suffixarray, "CHUNK", 16)
    assert all((a == b).all() for a, b in zip(whole, suffixarray.build(segments)))


def test_wavelet_matrix():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.integers(0, 37, 500)
    w = fmindex.WaveletMatrix(x, 37)
    at, c = r.integers(0, 501, 300), r.integers(0, 37, 300)
    assert (w.rank(c, at) == [(x[:a] == s).sum() for a, s in zip(at, c)]).all()
