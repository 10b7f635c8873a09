"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as byte n-grams, one of toxic and one of ordinary labelled texts, differ only in their own counts:
both discount them and give the rest to one shared model, a Kneser-Ney model whose lower orders count distinct
continuations in both classes together. So rare expressions score alike in both. A word's log-likelihood ratio is summed
over its bytes, and a document is judged by its ratios per word: their mean, the largest and the share of strong ones,
brought to a probability by logistic regression. Counts and estimates are tables, made by joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

#: Up to so many labelled rows their ids are broadcast to the texts; above it both are shuffled.
BROADCAST_ROWS = 1_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[np.r_[97:123, 128:256]] = True
STRONG = 2.0


#: N-grams up to which a model goes to every task as arrays; beyond it words are met with them by joins, with equal scores.
ENTRIES = 8_000_000


@dataclass
class Model:
    order: int
    grams: DataFrame  # key (a packed n-gram of the full order) and ratio
    contexts: DataFrame  # context (their first bytes) and rest: the ratio of a byte never seen after them
    weights: np.ndarray  # of the features, the intercept last
    prior: float = 0.0  # the share of label 1, which texts without words get

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Both tables, sorted."""
        out = []
        for table, names in ((self.grams, ("key", "ratio")), (self.contexts, ("context", "rest"))):
            held = table.toArrow().sort_by(names[0])
            out += [held.column(names[0]).to_numpy().astype(np.uint64), held.column(names[1]).to_numpy()]
        return tuple(out)


def _words(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of the rows, the number of each token's word, and each row's first token."""
    raw, offsets = C.flat(pc.utf8_lower(column))
    text = np.where(_LETTER[raw], raw, np.uint8(32)).astype(np.uint8)
    starts, ends, first = C.words(text, offsets)
    size = ends - starts
    out = np.append(0, np.cumsum(size))
    data = text[np.repeat(starts - out[:-1], size) + np.arange(out[-1])]
    tokens = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(out.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy(), first


def _keys(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram ending at each byte of each word and at its end, and the word of each."""
    raw, offsets = C.flat(words)
    n = len(offsets) - 1
    size = np.diff(offsets) + 2  # a mark on either side
    out = np.append(0, np.cumsum(size))
    text = np.full(out[-1], 32, dtype=np.uint64)
    inside = np.repeat(out[:-1] + 1 - offsets[:-1], size - 2) + np.arange(len(raw))
    text[inside] = raw
    place = np.arange(out[-1]) - np.repeat(out[:-1], size)
    key = np.zeros(out[-1], dtype=np.uint64)
    for back in range(order):
        shifted = np.zeros_like(text)
        shifted[back:] = text[: max(0, len(text) - back)]
        key |= np.where(place >= back, shifted, 0).astype(np.uint64) << np.uint64(8 * back)
    real = place > 0
    return key[real], np.repeat(np.arange(n), size)[real]


#: Columns of counts: of toxic and ordinary documents, in either half of the labelled rows.
COUNTS = ("toxic0", "ordinary0", "toxic1", "ordinary1")


def _count_words(batches):
    """In how many documents of each kind each word occurs."""
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            words, code, first = _words(part.column("text"))
            n = len(words)
            if not n:
                continue
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pair = np.unique(row * n + code)
            row, code = pair // n, pair % n
            kind = 2 * part.column("half").to_numpy()[row] + 1 - part.column("label").to_numpy()[row]
            counts = np.bincount(kind * n + code, minlength=4 * n).reshape(4, n)
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), *map(pa.array, counts)], ["word", *COUNTS])


def _count_grams(order):
    def run(batches):
        for batch in batches:
            key, word = _keys(batch.column("word"), order)
            distinct, code = np.unique(key, return_inverse=True)
            sums = [np.bincount(code, weights=batch.column(c).to_numpy()[word], minlength=len(distinct)).astype(np.int64) for c in COUNTS]
            if len(distinct):
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, sums)], ["key", *COUNTS])

    return run


def estimate(grams: DataFrame, order: int, discount: float = 0.75, own_discount: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """key and ratio of each n-gram, context and rest: the log ratio of a byte not seen after it.

    grams: key, toxic and ordinary, a row each packed n-gram of the full order; of several models at once with a column
    `model`, which both tables then have too. discount: of the shared model's counts; own_discount: of the counts of each
    class, whose mass goes to the shared model, so that rare expressions are smoothed by what both classes have of them.
    The shared model's lower orders count distinct continuations: each order's keys are those of the next one without
    their first byte. These counts are written, as every order is used by all above it.
    """
    by = ["model"] if "model" in grams.columns else []
    grams = C.materialise(grams.filter("toxic + ordinary > 0").select(*by, "key", F.col("toxic").cast("double").alias("toxic"), F.col("ordinary").cast("double").alias("ordinary")))
    short = lambda o: F.col("key").bitwiseAND(F.lit((1 << 8 * o) - 1))
    context = F.shiftright("key", 8).alias("context")
    levels, keys = {}, grams
    for o in range(order - 1, 0, -1):
        keys = C.materialise(keys.groupBy(*by, short(o).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("kinds")))
        levels[o] = keys
    group = Window.partitionBy(*by, "context")  # a context has as many rows as there are bytes at most
    below = None
    for o in range(1, order):
        own = levels[o].withColumn("context", context).withColumns({"total": F.sum("kinds").over(group), "types": F.count(F.lit(1)).over(group)})
        own = own.withColumn("lower", F.lit(1 / 256)) if below is None else own.withColumn("last", short(o - 1)).join(below.withColumnsRenamed({"key": "last", "p": "lower"}), [*by, "last"])
        below = own.select(*by, "key", ((F.greatest(F.col("kinds") - discount, F.lit(0.0)) + discount * F.col("types") * F.col("lower")) / F.col("total")).alias("p"))
    both = F.col("toxic") + F.col("ordinary")
    given = lambda c: F.sum(F.least(F.col(c), F.lit(own_discount)))
    sums = grams.groupBy(*by, context).agg(F.sum(both).alias("total"), F.count(F.lit(1)).alias("types"), *(F.sum(c).alias(f"all_{c}") for c in ("toxic", "ordinary")), *(given(c).alias(f"given_{c}") for c in ("toxic", "ordinary")))
    for c in ("toxic", "ordinary"):
        sums = sums.withColumn(f"free_{c}", F.when(F.col(f"all_{c}") > 0, F.col(f"given_{c}") / F.greatest(f"all_{c}", F.lit(1.0))).otherwise(1.0))
    sums = C.materialise(sums)
    at = grams.withColumn("context", context).join(sums, [*by, "context"])
    at = at.withColumn("lower", F.lit(1 / 256)) if below is None else at.withColumn("last", short(order - 1)).join(below.withColumnsRenamed({"key": "last", "p": "lower"}), [*by, "last"])
    shared = (F.greatest(both - discount, F.lit(0.0)) + discount * F.col("types") * F.col("lower")) / F.col("total")
    log = lambda c: F.log(F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - own_discount, F.lit(0.0)) / F.greatest(f"all_{c}", F.lit(1.0))).otherwise(0.0) + F.col(f"free_{c}") * shared)
    ratios = C.materialise(at.select(*by, "key", (log("toxic") - log("ordinary")).cast("float").alias("ratio")))
    rests = C.materialise(sums.select(*by, "context", (F.log("free_toxic") - F.log("free_ordinary")).cast("float").alias("rest")))
    for x in (grams, sums, *levels.values()):
        C.discard(x)
    return ratios, rests


def _lookup(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    found = table[at] == keys if len(table) else np.zeros(len(keys), bool)
    return found, np.where(found, values[at] if len(table) else 0, 0)


def word_ratios(words: pa.Array, order: int, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """The log-likelihood ratio of each word: the sum over its bytes."""
    keys, ratios, contexts, rests = arrays
    key, word = _keys(words, order)
    found, ratio = _lookup(keys, ratios, key)
    _, rest = _lookup(contexts, rests, key >> np.uint64(8))
    return np.bincount(word, weights=np.where(found, ratio, rest), minlength=len(words))


#: What a text is judged by, from its words' ratios: their sum, the largest, how many are strong, and how many there are.
SUMS = "total double, most double, strong double, n double"


def _sums(order: int, arrays):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, code, first = _words(part.column("text"))
                ratio = word_ratios(words, order, arrays.value)[code]
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                total = np.bincount(row, weights=np.clip(ratio, -10, 10), minlength=len(n))
                most = np.zeros(len(n))
                full = n > 0
                if full.any():
                    most[full] = np.maximum(np.maximum.reduceat(ratio, first[:-1][full]), 0)
                strong = np.bincount(row, weights=ratio > STRONG, minlength=len(n))
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x.astype(float)) for x in (total, most, strong, n))], [*kept, "total", "most", "strong", "n"])

    return run


def _list_words(batches):
    for batch in batches:
        for part in slices(batch):
            words, code, first = _words(part.column("text"))
            if not len(code):
                continue
            rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pair, times = np.unique(rows * len(words) + code, return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))).cast(pa.binary()), pa.array(times)], ["row", "word", "times"])


def _list_grams(order: int):
    def run(batches):
        for batch in batches:
            key, word = _keys(batch.column("word"), order)
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(word)), pa.array(key.view(np.int64))], ["word", "key"])

    return run


def sums(docs: DataFrame, model: Model, entries: int = ENTRIES) -> DataFrame:
    """docs (text, and columns of other names than SUMS) with SUMS in place of text.

    A model of up to `entries` n-grams goes to every task; a larger one is met by joins: the words of all texts with their
    n-grams, and these with the model.
    """
    order, spark = model.order, docs.sparkSession
    if model.grams.count() <= entries:
        held = spark.sparkContext.broadcast(model.arrays())
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
        return docs.mapInArrow(C.tidy(_sums(order, held)), f"{kinds}, {SUMS}")
    rest = [c for c in docs.columns if c != "text"]
    rows = C.materialise(docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("kept")))
    told = C.materialise(rows.select("row", "text").mapInArrow(C.tidy(_list_words), "row long, word binary, times long"))
    grams = told.select("word").distinct().mapInArrow(C.tidy(_list_grams(order)), "word binary, key long").withColumn("context", F.shiftright("key", 8))
    ratio = F.sum(F.coalesce("ratio", "rest", F.lit(0.0)).cast("double")).alias("ratio")
    scored = grams.join(model.grams, "key", "left").join(model.contexts, "context", "left").groupBy("word").agg(ratio)
    per = told.join(scored, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "ratio"))).alias("total"), F.greatest(F.max("ratio"), F.lit(0.0)).alias("most"),
        F.sum(F.when(F.col("ratio") > STRONG, F.col("times")).otherwise(0)).cast("double").alias("strong"), F.sum("times").cast("double").alias("n"),
    )
    return rows.drop("text").join(per, "row", "left").select("kept.*", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "most", "strong", "n")))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, text, label (0 or 1) and half (0 or 1) of the documents with a label; several labels of one id: the largest.

    The halves split either label evenly, by the order of hashes, so that a rare label is in both.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    known = C.materialise(known.withColumn("slot", F.xxhash64("doc_id")))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # about 1,000 ids a window; a label of fewer is one
    parts = F.coalesce(*(F.when(F.col("label") == k, F.lit(max(1, n // 1_000))) for k, n in counts.items()), F.lit(1)) if counts else F.lit(1)
    place = F.row_number().over(Window.partitionBy("label", F.pmod("slot", parts)).orderBy("slot", "doc_id"))
    known = known.withColumn("half", (place % 2).cast("int")).select("doc_id", "label", "half")
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.filter("text is not null").select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "label", "half")


def fit(rows: DataFrame, order: int = 5, calibration_rows: int = 20_000, entries: int = ENTRIES) -> Model:
    """Counts all rows (doc_id, text, label, half), a word once a document, and estimates both models.

    No n-gram is left out and the order is what it is, however many n-grams there are; their counts and ratios are tables
    in the shared folder, and `entries` only says from where on texts meet them by joins. The final weights are fitted on
    half of `calibration_rows` rows of either label at most, those of the smallest hashes of doc_id, which count for all of
    their label; each half's features come from the other half's counts. Without rows of both labels every score is the
    share of the one there is (0 without rows). Null and empty texts have no words.
    """
    rows = rows.select("text", "label", "half", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).cast("int").alias("slot"))
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    added = [F.sum(c).alias(c) for c in COUNTS]
    words = C.materialise(rows.select("text", "label", "half").mapInArrow(C.tidy(_count_words), f"word binary, {kinds}").groupBy("word").agg(*added))
    grams = C.materialise(words.mapInArrow(C.tidy(_count_grams(order)), f"key long, {kinds}").groupBy("key").agg(*added))
    C.discard(words)

    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of(name: int, *halves: int) -> Column:
        bad, good = (sum((F.col(f"{kind}{h}") for h in halves), F.lit(0)) for kind in ("toxic", "ordinary"))
        return F.struct(F.lit(name).alias("model"), bad.alias("toxic"), good.alias("ordinary"))

    # the model of all rows and those of either half in one set of tables: plans are a third of three
    models = [of(2, 0, 1), *((of(0, 0), of(1, 1)) if len(n) > 1 else ())]
    ratios, rests = estimate(grams.select("key", F.explode(F.array(*models)).alias("of")).select("of.*", "key"), order)
    C.discard(grams)

    def model(name: int) -> Model:
        return Model(order, *(x.filter(F.col("model") == name).drop("model") for x in (ratios, rests)), np.zeros(5))

    whole = model(2)
    whole.prior = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        whole.weights = np.array([0, 0, 0, 0, 30.0 if 1 in n else -30.0])
        return whole
    slots = {k: max(1, min(1 << 16, int((1 << 16) * calibration_rows / 2 / m))) for k, m in n.items()}
    chosen = rows.filter(F.col("slot") < F.when(F.col("label") == 1, slots[1]).otherwise(slots[0]))
    sample = [sums(chosen.filter(F.col("half") == half).select("text", "label"), model(1 - half), entries).toPandas() for half in (0, 1)]
    sample = pd.concat(sample)
    y = sample["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:  # the sample by hash has none of one label
        whole.weights = np.array([0, 0, 0, 0, float(np.log((n[1] + 0.5) / (n[0] + 0.5)))])
        return whole
    share = np.array([slots[0], slots[1]])[y.astype(int)] / (1 << 16)
    whole.weights = _logistic(_matrix(sample), y, 1 / share)
    return whole


def _matrix(sample: pd.DataFrame) -> np.ndarray:
    """Features of the logistic regression: the length-normalised log-likelihood ratio leads; the intercept is last."""
    total, most, strong, n = (sample[c].to_numpy(dtype=float) for c in ("total", "most", "strong", "n"))
    n = np.maximum(n, 1)
    return np.column_stack([100 * (total / n).clip(-0.2, 0.2), np.minimum(most, 12), np.log1p(strong), np.log1p(1000 * strong / n), np.ones(len(n))])


def probability(model: Model) -> Column:
    """The score from SUMS: _matrix() and the weights as an expression; without words it is the prior."""
    n = F.greatest("n", F.lit(1.0))
    x = [100 * F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("total") / n)), F.least("most", F.lit(12.0)), F.log1p("strong"), F.log1p(1000 * F.col("strong") / n), F.lit(1.0)]
    z = sum((float(w) * v for w, v in zip(model.weights, x, strict=True)), F.lit(0.0))
    return F.round(F.when(F.col("n") == 0, float(model.prior)).otherwise(1 / (1 + F.exp(-z))), 6)


def score(docs: DataFrame, model: Model, entries: int = ENTRIES) -> DataFrame:
    """docs (text and any other columns) with `score` in place of text: the probability of label 1, 0 to 1.

    A column that is called `score` already is replaced; other columns may have any names. Null text: as empty; a text
    without words says nothing and has the share of label 1 among the learned rows. Repeated rows score alike. No rows: none.
    """
    rest = [c for c in docs.columns if c not in ("text", "score")]
    held = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("held")) if rest else docs.select(F.coalesce("text", F.lit("")).alias("text"))
    out = sums(held, model, entries).withColumn("score", probability(model))
    return out.select(*(["held.*"] if rest else []), "score")


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learned from the labels outside the held-out quarter."""
    model = fit(labelled(docs, labels.filter(f"not {HELD_OUT}")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
