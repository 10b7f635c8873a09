"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

Documents with equal shingle sets are one class from the start (128-bit names). Each class's sketch (one value a bin,
empty bins filled from bins that a hash names) gives one bucket a band. Within a bucket the candidates are a star: edges
from one hub to the others, never all pairs, so no round has more pairs than members. Candidates are confirmed on full
sets. Members that are not in their hub's component, and that their own shingles don't keep from any link, go to the
buckets of a further, independent banding, until none are left or a banding links nothing new.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.components import components
from marea.llm.windows import slices

#: Sketch bins, bins a band, and rows up to which ids are broadcast to the texts (above it both are shuffled).
BINS, ROWS, BROADCAST_ROWS = 256, 6, 1_000_000
_TURNS = C.mix(np.arange(BINS * 128, dtype=np.uint64).reshape(BINS, 128) + np.uint64(77)) % np.uint64(BINS)


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: of `size` lower-cased words, or of all where there are fewer."""
    raw, offsets = C.flat(column)
    raw = C.lowered(raw)
    starts, ends, first = C.words(raw, offsets)
    codes = C.word_codes(raw, starts, ends)
    hashes = C.grams(codes, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            out.append(C.grams(codes[a:b], b - a) if b > a else codes[:0])
    return out


def sketch(hashes: np.ndarray, turn: int = 0) -> np.ndarray:
    """The least hash of each bin (its top bits); an empty bin takes that of the first full one among those it names.

    turn: which of the independent permutations; the first takes the (sorted) hashes as they are.
    """
    if turn:
        hashes = np.sort(C.mix(hashes + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)))
    edges = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    stop = np.append(edges[1:], len(hashes))
    full = edges < stop
    out = np.zeros(BINS, dtype=np.uint64)
    out[full] = hashes[edges[full]]
    empty = np.flatnonzero(~full)
    for turn in range(_TURNS.shape[1]):
        if not len(empty):
            return out
        source = _TURNS[empty, turn].astype(np.int64)
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    out[empty] = hashes[0]  # no full bin among 128: one value for all such bins, as good as any rule that both sides share
    return out


def bands(values: np.ndarray) -> np.ndarray:
    n = BINS // ROWS
    return C.mix(C.grams(values[: n * ROWS], ROWS)[::ROWS] + np.arange(n, dtype=np.uint64))


def _named(sets: list[np.ndarray]) -> tuple[list[bytes | None], np.ndarray]:
    """A 128-bit name of each set (none of an empty one), and its first 64 bits, by which candidates are known."""
    names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return names, np.array([int.from_bytes(x[:8], "little", signed=True) if x else 0 for x in names], np.int64)


def _sketches(size):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), size)
                names, ids = _named(sets)
                bucket = [bands(sketch(s)).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(ids), pa.array(bucket, pa.list_(pa.int64()))], ["doc_id", "n", "name", "id", "bands"])

    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), size)
                _, ids = _named(sets)
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "rep", "hashes"])

    return run


def _bandings(turn: int):
    """The buckets of a further banding, from sets."""

    def run(batches):
        for batch in batches:
            ids, sizes, keys = [], [], []
            lists = batch.column("hashes")
            size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
            upto = np.cumsum(size)
            for i, n in enumerate(size):
                if n:
                    ids.append(i)
                    sizes.append(n)
                    keys.append(bands(sketch(flat[upto[i] - n : upto[i]], turn)).view(np.int64))
            if ids:
                own, component = (batch.column(c).to_numpy()[ids] for c in ("id", "component"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.repeat(x, BINS // ROWS).astype(np.int64)) for x in (own, sizes, component))], ["key", "id", "n", "component"])

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (ra, rb) of the pairs (a, b) whose sets are similar enough. Sets that share an id are all compared."""
    ids = C.materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    some = sets.join(_small(ids), "id", "left_semi")
    left = some.select(F.col("id").alias("b"), F.col("rep").alias("rb"), F.col("hashes").alias("hb"))
    right = some.select(F.col("id").alias("a"), F.col("rep").alias("ra"), F.col("hashes").alias("ha"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    out = C.materialise(both.filter(f"100 * common >= {percent} * (size(ha) + size(hb) - common)").select("ra", "rb"))
    C.discard(ids)
    return out


def _stars(members: DataFrame, order: str, percent: int) -> DataFrame:
    """Candidates (a, b): the hub of each bucket, its member of the highest order, and every other member of another component."""
    hub = members.groupBy("key").agg(F.expr(f"max(struct({order}, id, n, component))").alias("hub")).select("key", F.col("hub.id").alias("a"), F.col("hub.n").alias("na"), F.col("hub.component").alias("ca"))
    star = members.join(hub, "key").filter("id <> a and component <> ca")
    return star.filter(f"100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("id").alias("b")).distinct()


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets (id, rep, hashes) of members without those whom their own shingles, which no other has, keep from any link.

    A set of n shingles, o of them its own, has n - o in common with another at most, and n or more in union.
    """
    ids = C.materialise(members.select("id").distinct())
    some = sets.join(_small(ids), "id", "left_semi")
    single = some.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    own = C.materialise(single.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("own")))
    out = C.materialise(some.join(_small(own), "id", "left").filter(f"100 * (size(hashes) - coalesce(own, 0)) >= {percent} * size(hashes)").drop("own"))
    C.discard(ids)
    C.discard(own)
    return out


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("rep"), "component")


def link(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Linked: Jaccard similarity of the shingle sets of at least `percent` hundredths. component_id is the smallest doc_id
    reachable; a row without words (null, empty or blank text), or with a null doc_id, is on its own. Rows of one doc_id
    are one node, whatever their texts. No rows: none. Other columns of docs are not looked at.
    """
    docs = docs.select("doc_id", "text")
    rows = C.materialise(docs.mapInArrow(C.tidy(_sketches(words)), "doc_id long, n long, name binary, id long, bands array<long>"))
    whole = rows.filter("name is not null and doc_id is not null")
    # rows of one name have one set, and so one n and one list of bands
    first = C.materialise(whole.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    classes = first.select("name", "rep")
    buckets = first.select(F.explode("bands").alias("key"), "id", "rep", "n")
    size = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = C.materialise(buckets.join(size, "key"))
    # a hub has the most neighbours, bucket by bucket
    degree = C.materialise(members.groupBy("id", "rep").agg(F.sum("size").alias("degree")))
    several = degree.count()
    wanted = degree.select(F.col("rep").alias("doc_id")).distinct()
    sets = C.materialise(docs.filter("doc_id is not null").join(F.broadcast(wanted) if several <= BROADCAST_ROWS else wanted, "doc_id", "left_semi").mapInArrow(C.tidy(_sets(words)), "id long, rep long, hashes array<long>"))
    # rows of one doc_id are one node
    met = whole.join(classes, "name").select("doc_id", "rep")
    several_texts = met.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    links = met.join(several_texts.select("doc_id", F.col("a").alias("rb")), "doc_id").select(F.col("rep").alias("ra"), "rb")
    at = members.select("key", "id", "rep", "n").join(F.broadcast(degree) if several <= BROADCAST_ROWS else degree, ["id", "rep"]).withColumn("component", F.col("rep"))
    at = C.materialise(at)
    links = C.materialise(links.union(_confirm(_stars(at, "degree", percent), sets, percent)))
    found, turn = _labels(links), 0
    # hubs have met all others of their buckets; of the rest, a bucket in one component is done
    hub = at.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("hub"))
    rest = at.drop("component").join(hub, "key").filter("id <> hub.id").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    left = C.materialise(rest.join(open_, "key").select("id", "rep", "component"))
    more = not left.isEmpty()
    if more:
        able = _linkable(left, sets, percent)
        known = C.materialise(left.groupBy("id").agg(F.min("component").alias("component")))
        parts = C.materialise(left.groupBy("rep").agg(F.min("component").alias("component")))
        of_a, of_b = (_small(parts).select(F.col("rep").alias(f"r{c}"), F.col("component").alias(f"c{c}")) for c in "ab")
        placed = able.select("id", "hashes").dropDuplicates(["id"]).join(_small(known), "id").select("id", "hashes", "component")
        seen = None
    while more:
        turn += 1
        again = C.materialise(placed.mapInArrow(C.tidy(_bandings(turn)), "key long, id long, n long, component long"))
        new = _confirm(_stars(again, f"xxhash64(id, key, {turn})", percent), able, percent)
        links = links.union(new)
        # pairs of components that no banding before has linked
        met = new.join(of_a, "ra").join(of_b, "rb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct()
        met = C.materialise(met if seen is None else met.join(seen, ["x", "y"], "left_anti"))
        more = not met.isEmpty()
        seen = met if seen is None else seen.union(met)
        C.discard(again)
    if turn and not seen.isEmpty():
        found = _labels(C.materialise(links))
    for x in (members, at, degree, sets, left, *((able, known, parts) if turn else ())):
        C.discard(x)
    labelled = rows.join(classes, "name", "left").join(found, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull() & F.col("name").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
