"""Benchmark decontamination by SimHash windows of item size, in DataFrame functions only.

A document's five-word shingles that occur in the benchmark are its hits; no other shingle can add to a similarity. Each
hit lies in the windows, as long as an item with that shingle, that cover it. One aggregation over these gives every
window's number of hits and its SimHash; windows with too few hits for the similarity asked for end there. The others
meet the items of their length through the blocks of a multi-index (the pigeonhole principle: within the radius, some
block differs by one bit at most), and pairs within the radius are verified by exact weighted Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.llm.common import materialise

#: Words of a shingle; Hamming radius; blocks (a block differs by radius // BLOCKS = 1 bit at most in some block).
SHINGLE, RADIUS, BLOCKS = 5, 23, 12
#: Rows up to which the benchmark's shingles and fingerprints are broadcast; above it they are shuffled.
BROADCAST_ROWS = 1_000_000
_BOUNDS = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS) for i in range(BLOCKS)]


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def shingled(df: DataFrame, *keep: str | Column) -> DataFrame:
    """keep, n_words, and position and hash of each shingle."""
    out = df.select(*keep, words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    gram = ", ".join(f"w[i + {j}]" for j in range(SHINGLE))
    return out.select("*", F.expr(f"posexplode(transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({gram})))").alias("pos", "h")).withColumn("n_words", F.size("w")).drop("w")


def _fingerprint(hashes: str) -> Column:
    """Bit b is set where more than half of the hashes have it. One small expression: 64 columns of code are costly to plan and compile."""
    ones = f"size(filter({hashes}, x -> shiftrightunsigned(x, b) & 1L = 1L))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def _blocks(fingerprint: Column, near: bool) -> Column:
    """Block number and value of each block as one number; near: also all values one bit away."""
    keys = []
    for i, (low, high) in enumerate(_BOUNDS):
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        keys.append(value + F.lit(i << 8))
        keys += [value.bitwiseXOR(F.lit(1 << b)) + F.lit(i << 8) for b in range(high - low)] if near else []
    return F.array(*keys)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def search(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, similarity, start and n_windows of every document with a window like an item.

    docs: doc_id, text; benchmark: item_id, text. A window has as many words as the item; the similarity is that of the
    multisets of shingles, at least `percent` hundredths; start is the first word of the first best window. Items and
    documents of fewer than five words, null texts and null ids match nothing. Rows of one id count together.
    """
    items = benchmark.filter("item_id is not null").select("item_id", F.xxhash64("text").alias("item_text"), "text").dropDuplicates(["item_id", "item_text"])
    grams = materialise(shingled(items, "item_id", "item_text").withColumnRenamed("n_words", "size"))
    counts = grams.groupBy("item_id", "item_text", "size", "h").agg(F.count(F.lit(1)).alias("times"))
    total = counts.count()
    sizes = counts.select("h", "size").distinct()
    # the document's side of the first join is by far the larger and is not shuffled while the items' fit a broadcast; texts are
    # cut once: windows and pairs are made of the few shingles that are left
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("part"), "text")
    hits = materialise(shingled(texts, "doc_id", "part").join(_small(sizes.select("h").distinct(), total), "h", "left_semi").select("doc_id", "part", "n_words", "pos", "h")).repartition("doc_id")
    spread = hits.join(_small(sizes, total), "h").filter("size <= n_words").select("doc_id", "part", "size", "h", F.explode(F.expr(f"sequence(greatest(0, pos - size + {SHINGLE}), least(pos, n_words - size))")).alias("start"))
    windows = spread.groupBy("doc_id", "part", "size", "start").agg(F.count(F.lit(1)).alias("hits"), F.collect_list("h").alias("hashes"))
    # similarity s of two multisets of m shingles each needs 2 m s / (1 + s) in common
    enough = windows.filter(F.col("hits") * (100 + percent) >= 2 * percent * (F.col("size") - (SHINGLE - 1)))
    marked = enough.select("doc_id", "part", "size", "start", _fingerprint("hashes").alias("print"))
    known = grams.groupBy("item_id", "item_text", "size").agg(F.collect_list("h").alias("hashes")).select("item_id", "item_text", "size", _fingerprint("hashes").alias("of"))
    blocks = known.select("*", F.explode(_blocks(F.col("of"), True)).alias("block"))
    near = marked.select("*", F.explode(_blocks(F.col("print"), False)).alias("block")).join(_small(blocks, total), ["size", "block"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("of"))) <= RADIUS)
    pairs = near.select("doc_id", "part", "size", "start", "item_id", "item_text").distinct()
    inside = pairs.join(hits, ["doc_id", "part"]).filter(f"pos between start and start + size - {SHINGLE}")
    seen = inside.groupBy("doc_id", "part", "size", "start", "item_id", "item_text", "h").agg(F.count(F.lit(1)).alias("here"))
    common = seen.join(_small(counts, total), ["item_id", "item_text", "size", "h"]).groupBy("doc_id", "part", "size", "start", "item_id", "item_text").agg(F.sum(F.least("here", "times")).alias("common"))
    m = F.col("size") - (SHINGLE - 1)
    alike = common.filter(100 * F.col("common") >= percent * (2 * m - F.col("common"))).withColumn("similarity", F.round(F.col("common") / (2 * m - F.col("common")), 6))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start"))
    return alike.groupBy("doc_id", "item_id").agg((-best["s"]).alias("similarity"), best["start"].cast("long").alias("start"), F.count(F.lit(1)).alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    return docs.join(search(docs, benchmark, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def sql(percent: int = 80) -> str:
    """search() over tables documents and benchmark in DuckDB's SQL, by exact comparison alone."""

    def grams(table, key):
        w = f"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
        return f"""SELECT {key}, len(w) AS n, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos, w FROM (SELECT {key}, {w} AS w FROM {table}) WHERE len(w) >= {SHINGLE}"""

    gram = " || ' ' || ".join(f"w[pos + {j}]" for j in range(1, SHINGLE + 1))
    return f"""
WITH item AS (SELECT item_id, n AS size, {gram} AS h FROM ({grams('benchmark', 'item_id')})),
counts AS (SELECT item_id, size, h, count(*) AS times FROM item GROUP BY ALL),
sizes AS (SELECT DISTINCT h, size FROM item),
hits AS (SELECT doc_id, n, pos, h FROM (SELECT doc_id, n, pos, {gram} AS h FROM ({grams('documents', 'doc_id')})) WHERE h IN (SELECT h FROM item)),
spread AS (SELECT doc_id, size, h, unnest(range(greatest(0, pos - size + {SHINGLE}), least(pos, n - size) + 1)) AS start FROM hits JOIN sizes USING (h) WHERE size <= n),
enough AS (SELECT doc_id, size, start FROM spread GROUP BY ALL HAVING count(*) * {100 + percent} >= {2 * percent} * (size - {SHINGLE - 1})),
seen AS (SELECT doc_id, size, start, h, count(*) AS here FROM spread JOIN enough USING (doc_id, size, start) GROUP BY ALL),
common AS (SELECT doc_id, item_id, size, start, sum(least(here, times)) AS common FROM seen JOIN counts USING (size, h) GROUP BY ALL),
alike AS (SELECT doc_id, item_id, start, round(common / (2 * (size - {SHINGLE - 1}) - common), 6) AS similarity FROM common WHERE 100 * common >= {percent} * (2 * (size - {SHINGLE - 1}) - common)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r, count(*) OVER (PARTITION BY doc_id, item_id) AS n_windows FROM alike)
SELECT doc_id, item_id, similarity, start, n_windows FROM ranked WHERE r = 1"""
