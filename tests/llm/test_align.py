"""Alignments against loops over the tokens of the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from marea.llm import align
from marea.llm import common as C


def token_bytes():
    a, b = Tokenizer.from_file(align.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)
    a.encode_special_tokens = True
    level = align._bytes_of_level()

    def left(text):
        return [(i, bytes(level[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def right(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return left, right


def brute(docs):
    left, right = token_bytes()
    told, held = [], defaultdict(int)
    for doc_id, text in docs:
        whole = (" " + text).encode() if text else b""
        sides = [f(text) if text else [] for f in (left, right)]
        if any(b"".join(x for _, x in s) != whole for s in sides):
            sides = [[], []]
        spans = []
        for s in sides:
            at, own = 0, []
            for i, x in s:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, e in own if low <= s and e <= high) for own in spans))
        links = Counter()
        for i, s, e in spans[0]:
            for j, t, f in spans[1]:
                if s < f and t < e:
                    links[i, j] += 1
        for pair in links:
            held[pair] += 1
        told.append((doc_id, len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(((d, a, b, g, sum(k.values()), sum(n for p, n in k.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in k.items()), h) for d, a, b, g, k, h in told), key=str)


def corpus():
    rng = random.Random(5)
    parts = ["the cat", " naïve", "\n\n", "日本語", "  ", "<|endoftext|>", "<s>", "1234567", "don't", "🙂", "x" * 30, "\t", "Überraschung", "▁", "<0x41>", "é", "ﬁ", " ", "​"]
    docs = [(i, "".join(rng.choice(parts[: 13 if i % 3 else 19]) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    return [*docs, (None, None), (None, "the cat"), (70, ""), (71, " "), (72, "the cat sat"), (72, "the cat sat"), (73, "word " * 400), (74, "a\x00b")]


def test_against_loops(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "clash") for d, t in docs], "doc_id long, text string, n long, pairs string").repartition(3)
    want = brute(docs)
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[1] > 0 for r in want) > 40
    got = align.digest(frame)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in align.digest(frame, most=0).collect()), key=str) == want  # by the join
    assert align.digest(frame.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in align.digest(frame.filter("doc_id = 70")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_units_are_tokenized_like_whole_texts():
    """Both libraries on whole texts against their tokens unit by unit."""
    rng = random.Random(9)
    parts = ["a", "don't", "it's", " ", "  ", "   ", "\n", "\n\n", "\t", ".", ",", "...", "é", "Été", "12", "3", "\u00a0", "\u3000", "日本", "🙂", "\x1c", "\x85", "<s>", "'s", "-", "the", "Straße", "‑", "\u2028", "_x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    files = [open(p, "rb").read() for p in (align.BYTE_BPE, align.PIECE_BPE)]
    a, b = Tokenizer.from_file(align.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)
    a.encode_special_tokens = True
    raw, offsets = C.flat(pa.array([" " + t for t in texts], pa.large_string()))
    starts, first = align.units(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    own = [raw[x:y].tobytes().decode() for x, y in zip(starts, ends, strict=True)]
    assert len(own) > 1.5 * len(texts)
    for side, whole in ((align.byte_level(files[0]), lambda t: a.encode(" " + t, add_special_tokens=False).ids), (align.piece_level(files[1]), b.encode)):
        ids, n = side.encode(own)
        at = np.append(0, np.cumsum(n))[first]
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == whole(t), repr(t)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    got = align.digest(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)
