"""Alignment of two tokenizers over the same texts: groups of tokens between common borders, and corpus-wide pair counts.

Neither side has a token across a space that follows a visible ASCII character, so texts are cut there into units, and each
distinct unit of an Arrow batch is tokenized once. The units become two interval tables of a local DuckDB, one row a token
with its bytes' range: an ASOF join finds the first token of the other side that ends no sooner and so tells common borders,
a window sum over these numbers the groups, and a range join within a group links tokens whose ranges overlap; a join with
the units of each document sums its links. Each document's distinct pairs are written once with their multiplicity; Spark
merges partial counts of the pairs, and every document meets the counts of its own.
"""

from __future__ import annotations

import functools
import itertools
import json
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct pairs up to which their counts are broadcast; beyond it the documents' pairs are joined with them.
BROADCAST_PAIRS = 4_000_000
#: A pair in one number: the id of A times this, plus that of B.
SIDE = 1 << 15
# Fixed value: the pattern by which the byte-level vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Tokenizer:
    """encode: the ids of some units, joined, and their number in each; data and begin: the bytes of the ids."""

    encode: object
    data: np.ndarray
    begin: np.ndarray

    def size(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(self.begin)[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size(ids)
        upto = np.append(0, np.cumsum(size))
        return self.data[np.repeat(self.begin[ids] - upto[:-1], size) + np.arange(upto[-1])]


def _joined(lists) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


def _tables(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(names), np.uint8), np.append(0, np.cumsum([len(x) for x in names]))


def _bytes_of_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def byte_level(content: bytes) -> Tokenizer:
    """A byte-level BPE file as ranks: the merges of such a file stand in the order of the ids they make."""
    import tiktoken

    told = json.loads(content)
    level, vocabulary = _bytes_of_level(), told["model"]["vocab"]
    special = {x["content"] for x in told["added_tokens"]}
    names = {bytes(level[c] for c in word): i for word, i in vocabulary.items() if word not in special}
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of their ids")
    encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=names, special_tokens={})
    table = [b""] * (max(vocabulary.values()) + 1)
    for name, i in names.items():
        table[i] = name
    return Tokenizer(lambda units: _joined([encoding.encode_ordinary(t) for t in units]), *_tables(table))


@functools.lru_cache(maxsize=1)
def piece_level(content: bytes) -> Tokenizer:
    """A model of pieces; it puts the space before a unit itself. No piece may have the mark of a space after something else."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    names = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    if any(" " in x.lstrip(b" ").decode(errors="replace") for x in names):
        raise ValueError("a piece goes on after a space")
    return Tokenizer(lambda units: _joined(model.encode([u[1:] for u in units], num_threads=1)), *_tables(names))


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of some joined texts, and each text's first unit (one more at the end).

    A unit starts with its text or with a space after a visible ASCII character. Before such a space both sides have a
    border: the byte-level pattern takes a space only at a token's start or within white space, and so do the pieces.
    """
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    cut[ends] = False  # a space that ends a text is no unit of its own
    cut[offsets] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    return _tables([str(i).encode() for i in range(most)])


def _render(unit, group, ids, digits, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """All units' groups as text, one after the other with ; after each, and where each unit's begins (one more at the end).

    unit, group, ids: of the tokens of A and of B.
    """
    place = [np.arange(len(ids[0])) + np.searchsorted(group[1], group[0], "left"), np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], "right")]
    n = len(ids[0]) + len(ids[1])
    whole = np.empty((4, n), np.int64)
    for side in (0, 1):
        whole[:, place[side]] = ids[side], group[side], unit[side], np.full(len(ids[side]), side)
    own, g, u, s = whole
    mark = np.full(n, ord(","), np.uint8)
    mark[:-1][s[1:] != s[:-1]] = ord("|")
    mark[:-1][g[1:] != g[:-1]] = ord(";")
    mark[-1:] = ord(";")
    data, begin = digits
    size = np.diff(begin)[own] + 1
    upto = np.append(0, np.cumsum(size))
    out = np.append(data, np.uint8(0))[np.minimum(np.repeat(begin[own] - upto[:-1], size) + np.arange(upto[-1]), len(data))]
    out[upto[1:] - 1] = mark
    return out, upto[np.searchsorted(u, np.arange(rows + 1))]


QUERIES = (
    # the first B token that ends no sooner tells whether A's end is a common border; the sum of those before numbers the groups
    "CREATE OR REPLACE TEMP TABLE ag AS SELECT unit, i, id, s, e, common, sum(common::INT) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - common::INT AS g FROM (SELECT a.*, a.e = b.e AS common FROM a ASOF JOIN b ON a.e <= b.e)",
    "CREATE OR REPLACE TEMP TABLE bg AS SELECT b.unit, b.i, b.id, b.s, b.e, c.g FROM b ASOF JOIN (SELECT e, g FROM ag WHERE common) c ON b.e <= c.e",
)
LINKS = f"CREATE OR REPLACE TEMP TABLE links AS SELECT ag.unit AS unit, ag.id::BIGINT * {SIDE} + bg.id AS pair, count(*) AS n FROM ag JOIN bg ON ag.g = bg.g AND ag.s < bg.e AND bg.s < ag.e GROUP BY ALL"
OF_DOCUMENTS = "SELECT d.doc AS doc, l.pair AS pair, sum(d.times * l.n)::BIGINT AS n FROM docs d JOIN links l USING (unit) GROUP BY ALL ORDER BY 1, 2"


def _spans(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of some spans, joined, and the end of each among them (0 first)."""
    upto = np.append(0, np.cumsum(size))
    return np.repeat(begin - upto[:-1], size) + np.arange(upto[-1]), upto


def _align(files):
    def run(batches):
        import duckdb

        a, b = byte_level(files.value[0]), piece_level(files.value[1])
        digits = _decimals(max(len(a.begin), len(b.begin)))
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp()})
        con.execute("SET preserve_insertion_order = false")

        def load(name: str, **columns) -> None:
            con.register("arrow", pa.table(columns))
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM arrow")
            con.unregister("arrow")

        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                rows = len(part)
                raw, offsets = C.flat(pa.array([" " + t if t else "" for t in part.column("text").to_pylist()], pa.large_string()))
                starts, first = units(raw, offsets)
                coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
                distinct, code = coded.dictionary, coded.indices.to_numpy()
                want, bound = C.flat(distinct)
                texts = distinct.cast(pa.large_string()).to_pylist()
                good, sides = np.ones(len(texts), bool), []
                for own in (a, b):
                    ids, n = own.encode(texts)
                    upto = np.append(0, np.cumsum(own.size(ids)))[np.append(0, np.cumsum(n))]
                    data = own.joined(ids)
                    if not np.array_equal(upto, bound) or not np.array_equal(data, want):
                        good &= np.array([np.array_equal(data[upto[u] : upto[u + 1]], want[bound[u] : bound[u + 1]]) for u in range(len(texts))], bool)
                    sides.append((ids, n))
                owner, names = [], []
                for own, name, (ids, n) in zip((a, b), "ab", sides, strict=True):
                    unit = np.repeat(np.arange(len(texts)), n)
                    unit, ids = unit[good[unit]], ids[good[unit]]
                    end = np.cumsum(own.size(ids))
                    owner.append(unit)
                    names.append(ids)
                    load(name, unit=unit.astype(np.int32), i=np.arange(len(ids), dtype=np.int32), id=ids.astype(np.int32), s=end - own.size(ids), e=end)
                for query in (*QUERIES, LINKS):
                    con.execute(query)
                groups = [con.execute(f"SELECT g::BIGINT AS g FROM {t}g ORDER BY i").fetchnumpy()["g"] for t in "ab"]
                common = con.execute("SELECT unit FROM ag WHERE common").fetchnumpy()["unit"]
                text, begin = _render(owner, groups, names, digits, len(texts))
                # documents all of whose units either side spells
                doc = np.repeat(np.arange(rows), np.diff(first))
                sound = np.bincount(doc, weights=~good[code], minlength=rows) == 0
                kept = sound[doc]
                doc, code = doc[kept], code[kept]
                pair, times = np.unique(doc * max(1, len(texts)) + code, return_counts=True)
                load("docs", doc=(pair // max(1, len(texts))).astype(np.int32), unit=(pair % max(1, len(texts))).astype(np.int32), times=times)
                links = con.execute(OF_DOCUMENTS).fetchnumpy()
                cut = np.searchsorted(links["doc"], np.arange(rows + 1))
                many = np.append(0, np.cumsum(links["n"].astype(np.int64)))
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(links[c].astype(np.int32))) for c in ("pair", "n")]
                place, upto = _spans(begin[code], np.diff(begin)[code])
                told, upto = text[place].tobytes(), upto[np.searchsorted(doc, np.arange(rows + 1))]
                totals = (np.bincount(doc, weights=np.bincount(x, minlength=len(texts))[code], minlength=rows).astype(np.int64) for x in (*owner, common))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, totals), pa.array(np.diff(many[cut])), *lists, pa.array([told[x : max(x, y - 1)].decode() for x, y in zip(upto[:-1], upto[1:], strict=True)])],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups"],
                )
        con.close()

    return run


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, the numbers of tokens, groups and links of each text, its distinct pairs with their multiplicity, and its groups.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of either side in order; pairs: SIDE times A's id plus B's, rising. Null and empty
    texts, and those that either side's bytes don't spell, have none; a null doc_id stays null, repeated rows are aligned
    each, other columns are not read. No rows: none. A text is held whole with its tokens: about 150 bytes of memory for
    a byte of distinct units, 30 for another.
    """
    C.lean(docs.sparkSession)
    files = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:  # the driver's own files; tasks get their content
            files.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast(files)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(C.tidy(_align(held)), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, pairs array<int>, times array<int>, groups string")


def _count(batches):
    for batch in batches:
        pair, n = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (how many documents hold it) and best (whether no pair of that A id is held by more)."""
    counts = aligned.select("pairs").mapInArrow(C.tidy(_count), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = C.materialise(counts.withColumn("a", F.expr(f"pair div {SIDE}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _meet(held):
    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            lists = batch.column("pairs")
            own, times, at = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = np.searchsorted(pair, own)
            sums = [np.append(0, np.cumsum(x)) for x in (times * best[found], times * n[found])]
            told = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), *(pa.array(s[at[1:]] - s[at[:-1]]) for s in sums)], [*told, "n_best", "count_sum"])

    return run


def with_counts(aligned: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (written rows, with `row`, a number for each) with n_best and count_sum in place of its pairs."""
    if counts.count() <= most:
        table = counts.toArrow().sort_by("pair")
        held = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name not in ("pairs", "times"))
        return aligned.mapInArrow(C.tidy(_meet(held)), f"{kinds}, n_best long, count_sum long").drop("row")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rest = aligned.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return rest.fillna(0, ["n_best", "count_sum"])


def digest(docs: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Counts of every row's alignment, a hash of its groups, and how common its links are over all documents."""
    own = align(docs).withColumn("groups_sha256", F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups")
    own = C.materialise(own.withColumn("row", F.monotonically_increasing_id()))
    out = with_counts(own, pair_counts(own), most)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("n_best").cast("long").alias("n_best"), F.col("count_sum").cast("long").alias("count_sum"), "groups_sha256")
