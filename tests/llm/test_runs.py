"""Runs against a search of every period, collapsing against the words themselves."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marea.llm import runs


def brute(text, times, least):
    """All maximal stretches of each period, with their smallest one."""
    n, found = len(text), {}
    for q in range(1, n // times + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and text[stop] == text[stop + q]:
                stop += 1
            if stop + q - start >= max(times * q, least) and stop > start:
                found.setdefault((start, stop + q), q)
            start = stop + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(4, 6), (2, 2), (3, 4), (4, 9)]))
def test_small_alphabets(text, rule):
    assert runs.find_runs(text, *rule) == brute(text, *rule)


@pytest.mark.parametrize("seed", range(60))
def test_nested_repeats(seed):
    rng = random.Random(seed)
    text = [rng.randrange(4) for _ in range(8)]
    for _ in range(rng.randrange(2, 5)):
        a = rng.randrange(len(text))
        b = rng.randrange(a + 1, len(text) + 1)
        text = text[:b] + text[a:b] * rng.randrange(1, 7) + text[b:] + text[: rng.randrange(len(text))]
    text = text[:700]
    for rule in ((4, 6), (2, 2)):
        assert runs.find_runs(text, *rule) == brute(text, *rule)


def test_runs_inside_factors_are_copied(monkeypatch):
    # the second copy of the passage holds its run strictly inside one factor: without copies it is lost
    passage = [9, 8, 7, *[1, 2] * 5, 6, 5, 4]
    text = [*passage, 3, *passage, 2]
    assert runs.find_runs(text) == [(3, 10, 2), (20, 10, 2)] == brute(text, 4, 6)
    monkeypatch.setattr(runs, "factors", lambda t: [(i, 1, -1) for i in range(17)] + [(17, 16, 16), (33, 1, -1)])
    assert (20, 10, 2) not in runs.find_runs(text)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        text = rng.integers(0, 40, rng.integers(0, 200)).tolist()
        a = int(rng.integers(0, len(text) + 1))
        text[a:a] = rng.integers(0, 40, rng.integers(1, 7)).tolist() * int(rng.integers(1, 7))
        texts.append(text)
    codes, owner = np.array(sum(texts, []), np.int64), np.repeat(np.arange(12), [len(t) for t in texts])
    begin, got = np.append(0, np.cumsum([len(t) for t in texts])), [[] for _ in texts]
    for a, b in runs.candidates(codes, owner):
        assert owner[a] == owner[b - 1]
        got[owner[a]] += [(s + a - begin[owner[a]], n, q) for s, n, q in runs.find_runs(codes[a:b].tolist())]
    assert got == [brute(t, 4, 6) for t in texts]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 4, 6)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found), text)))


def test_digest_and_edges(spark):
    rng = random.Random(3)
    docs = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x\x0by z x"), (5, "la " * 3000 + "end"), (5, "la " * 3000 + "end"), (6, "é ü " * 4 + "  " * 7), (7, " ".join("abc"[i % 3] for i in range(12)))]
    docs += [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(90)))) for i in range(100, 400)]
    frame = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], "doc_id long, text string, runs string, collapsed string")
    got = sorted((tuple(r) for r in runs.digest(frame).collect()), key=str)
    assert got == sorted((expected(*d) for d in docs), key=str)
    assert runs.digest(frame.limit(0)).collect() == []
    real = {r.doc_id: r for r in runs.collapse(frame).collect()}
    assert real[7].collapsed == "a b c" and [tuple(r) for r in real[7].runs] == [(0, 12, 3)] and real[2].collapsed == ""


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in runs.digest(docs).collect()) == sorted(expected(r.doc_id, r.text) for r in docs.collect())
