"""Line dedup against all pairs of lines."""

import random
import re

from pyspark.sql import functions as F

from marea.llm import linedup


def brute(rows):
    lines = sorted({(d, i, x) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n"))})
    sets = [(d, i, set(re.findall(r"[^\x20\x09-\x0D]+", x))) for d, i, x in lines]
    gone = set()
    for k, (d, i, s) in enumerate(sets):
        if s and any(o and 100 * len(s & o) >= 80 * len(s | o) for _, _, o in sets[:k]):
            gone.add((d, i))
    out = []
    for d, t in rows:
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] if t else []
        out.append((d, len(t.split("\n")) if t else 0, "\n".join(kept) if t else t))
    return sorted(out, key=str)


def test_against_all_pairs(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "añ"] * 20
    pool = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 12, 30]))] for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            r.shuffle(x)
            lines.append(r.choice([" ", "\t", "  "]).join(x))
        rows.append((r.randrange(500) * 1000 + i, "\n".join(lines)))
    rows += [(900_000, None), (900_001, ""), (900_002, "\n\n \n"), (None, rows[0][1]), (900_003, "x y z " * 4000 + "\n" + "x y z"), rows[1], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("p")).withColumn("n_chars", F.lit(3))
    got = linedup.remove_lines(df)
    assert got.columns == ["doc_id", "text", "part", "n_chars", "n_lines", "n_removed"]
    assert sorted([(x.doc_id, x.n_lines, x.text) for x in got.collect()], key=str) == brute(rows)
    assert linedup.digest(df).count() == len(rows) and linedup.digest(df.limit(0)).count() == 0


def test_open_lines_are_tried_again(spark, monkeypatch):
    """Many near candidates: the match among them is found."""
    monkeypatch.setattr(linedup, "FIRST", 1)
    monkeypatch.setattr(linedup, "TIMES", 3)
    r = random.Random(9)
    often = [f"b{i}" for i in range(40)]
    # the words that differ are frequent, so they stand last and only the signature tells of them
    fill = [(1000 + i, "\n".join(" ".join(r.sample(often, 3)) for _ in range(20))) for i in range(100)]
    rows = [(i, " ".join([f"a{j}" for j in range(20)] + r.sample(often, 3))) for i in range(40)] + [(50, " ".join([f"a{j}" for j in range(20)] + often[:2])), *fill]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(x.doc_id, x.n_lines, x.text) for x in linedup.remove_lines(df).collect()], key=str) == brute(rows)


def test_hot_words_are_taken_in_pairs(spark, monkeypatch):
    """Groups beyond the limit come again under pairs of words, and nothing is lost."""
    monkeypatch.setattr(linedup, "GROUP", 3)
    r = random.Random(2)
    rows = [(i, " ".join(["x", "y"] + [r.choice("abcdefghij") + r.choice("kl") for _ in range(r.choice([4, 9, 18]))])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(x.doc_id, x.n_lines, x.text) for x in linedup.remove_lines(df).collect()], key=str) == brute(rows)


def test_words_of_one_polynomial_differ(spark):
    """Two words that a polynomial hash modulo 2^64 cannot tell apart."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    rows = [(1, f"{word} p q r s"), (2, word.translate({97: 98, 98: 97}) + " p q r s t u"), (3, word), (4, word.translate({97: 98, 98: 97}))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(x.doc_id, x.n_lines, x.text) for x in linedup.remove_lines(df).collect()], key=str) == brute(rows)


def test_clashing_columns(spark):
    """Columns of the report's names are replaced; any other name travels along."""
    df = spark.createDataFrame([(1, "a b\na b", 7, "x", "y"), (2, None, 8, "x", "y")], "doc_id long, text string, n_lines int, others string, gone string")
    got = linedup.remove_lines(df)
    assert got.columns == ["doc_id", "text", "others", "gone", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b", "x", "y", 2, 1), (2, None, "x", "y", 0, 0)]
