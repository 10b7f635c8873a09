"""Scores of texts by a hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class given the two words before it, times its own within the class. Both softmaxes
sum hashed feature weights: the word before, the two before, and the one before that alone (a skip). The vocabulary is
in three parts: the most frequent words are members of classes of equal size; other words of a counted table make a class
for each band of frequency and follow their counts in it; words below the table are one class, whose counts, smoothed by
one unknown word, are met by a join. So the sum over all words and the unknown one is 1 after every history.

Training sees every word of every learned document: corpus-wide counts of (history, word), summed by Spark and dealt by
history, are the events. In each round every partition of events takes gradient steps from the common weights, and the
rows of weights that it touched are averaged over partitions by the events behind them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

_BASE = 1 << 11  # over all names of a model
#: Words of the table that goes to every task.
TABLE = 1 << 18
#: Rows of hashed weights, of either softmax.
ROWS = 1 << 15
#: The end of a text, as a word; no word holds a space.
END = b" "
#: Events a partition trains on; histories a gradient step takes.
PARTITION, STEP = 1_000_000, 4096
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Shape:
    """Classes of frequent words and members of each, bands of the words that follow; one class more is for the rest."""

    classes: int = 40
    members: int = 32
    bands: int = 23

    @property
    def short(self) -> int:
        return self.classes * self.members

    @property
    def rest(self) -> int:
        return self.short + self.bands

    @property
    def begin(self) -> int:
        return self.rest + 1

    @property
    def out(self) -> int:
        return self.classes + self.bands + 1

    def classes_of(self, names: np.ndarray) -> np.ndarray:
        return np.where(names < self.short, names // self.members, self.classes + names - self.short)


@dataclass
class Model:
    shape: Shape
    words: pa.Array  # of the table, by falling count
    counts: np.ndarray
    total: int  # training tokens
    distinct: int
    rest: int  # tokens of words below the table
    rest_distinct: int
    weights: list[np.ndarray] = field(default_factory=list)  # class bias, class rows, member bias (by class), member rows
    band: np.ndarray = None
    band_total: np.ndarray = None

    def __post_init__(self):
        s = self.shape
        c = self.counts[s.short :]
        self.band = np.minimum(np.log2(np.maximum(c[0] / np.maximum(c, 1), 1)).astype(np.int64), s.bands - 1) if len(c) else np.zeros(0, np.int64)
        self.band_total = np.bincount(self.band, weights=c, minlength=s.bands)
        if not self.weights:
            own = np.zeros(s.short)
            own[: min(s.short, len(self.counts))] = self.counts[: s.short]
            own = own.reshape(s.classes, s.members)
            # a class without words is never meant; the rest has an unknown word at least
            classes = np.concatenate([own.sum(1), self.band_total, [self.rest + 0.5]])
            with np.errstate(divide="ignore"):
                bias, inner = np.log(classes / classes.sum()), np.log(own / np.maximum(own.sum(1), 1)[:, None])
            self.weights = [np.maximum(bias, -1e4).astype(np.float32), np.zeros((ROWS, s.out), np.float32), np.maximum(inner, -1e4).astype(np.float32), np.zeros((ROWS, s.members), np.float32)]

    def ids(self, words: pa.Array) -> np.ndarray:
        """The row of each word in the table, -1 below it."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def names(self, rows: np.ndarray) -> np.ndarray:
        """What the model calls the words of these rows: a member, a band or the rest."""
        s = self.shape
        later = np.maximum(rows - s.short, 0)
        band = self.band[np.minimum(later, max(len(self.band) - 1, 0))] if len(self.band) else np.zeros(len(rows), np.int64)
        return np.where(rows < 0, s.rest, np.where(rows < s.short, rows, s.short + band))


def tokens(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of the rows and END, the number of each token's word, and each row's first token."""
    raw, offsets = C.flat(column)
    raw = C.lowered(raw)
    starts, ends, first = C.words(raw, offsets)
    size = ends - starts
    upto = np.append(0, np.cumsum(size))
    data = np.append(raw[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])], np.frombuffer(END, np.uint8))
    bounds = np.append(upto, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(size) + 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    code = coded.indices.to_numpy()
    rows = len(first) - 1
    out = np.full(len(size) + rows, code[-1], dtype=np.int64)
    out[np.arange(len(size)) + np.repeat(np.arange(rows), np.diff(first))] = code[:-1]
    return coded.dictionary, out, first + np.arange(rows + 1)


def histories(names: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """The two names before each token, packed; `begin` before a text."""
    one, two = np.empty_like(names), np.empty_like(names)
    one[1:], two[2:] = names[:-1], names[:-2]
    head = first[:-1]
    one[head] = two[head] = begin
    second = head + 1
    second = second[second < first[1:]]
    two[second] = begin
    return two * _BASE + one


def _count_words(batches):
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            words, code, _ = tokens(part.column("text"))
            if len(part):
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(code, minlength=len(words)))], ["word", "n"])


def count(docs: DataFrame) -> DataFrame:
    """word (lower-cased bytes; END once a text) and n, how often it occurs, over all texts."""
    return docs.select("text").mapInArrow(C.tidy(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def table(counts: DataFrame, most: int = TABLE, shape: Shape = Shape()) -> tuple[Model, int]:
    """An untrained model with the table of all words of at least some count, and that count: the least that keeps `most` words."""
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    # how many words share a count is itself counted by powers of 2 first, so that few rows reach the driver
    sizes = [(r.low, r.words, r.tokens) for r in by.groupBy(F.floor(F.log2("n")).alias("low")).agg(F.sum("words").alias("words"), F.sum(F.col("n") * F.col("words")).alias("tokens")).orderBy(F.desc("low")).collect()]
    distinct, total = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    left, least = most, 1
    for low, n, _ in sizes:
        if n > left:
            inside = by.filter((F.floor(F.log2("n")) == low)).orderBy(F.desc("n")).limit(left).collect()
            least = 2 ** (low + 1)
            for r in inside:
                left -= r.words
                if left < 0:
                    break
                least = r.n
            break
        left -= n
    kept = counts.filter(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = kept.column("word").combine_chunks().cast(pa.large_binary()) if kept.num_rows else pa.array([], pa.large_binary())
    own = kept.column("n").to_numpy().astype(np.int64)
    return Model(shape, words if isinstance(words, pa.Array) else words.chunk(0), own, total, distinct, total - int(own.sum()), distinct - len(own)), least


def _count_events(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                words, code, first = tokens(part.column("text"))
                if not len(part):
                    continue
                names = model.names(model.ids(words))[code]
                key, n = np.unique(histories(names, first, model.shape.begin) * _BASE + names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // _BASE), pa.array((key % _BASE).astype(np.int32)), pa.array(n)], ["history", "name", "n"])

    return run


def _rows(kind: int, *parts: np.ndarray) -> np.ndarray:
    key = np.full(1, kind + 1, np.uint64)
    for p in parts:
        key = C.mix(key * C._ROLL + p.astype(np.uint64))
    return (key >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


def features(history: np.ndarray, inner: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of weights of each history: the word before, both words, the skip; within a class their rows are that class's own."""
    one, extra = history % _BASE, [] if inner is None else [inner]
    return [_rows(0, one, *extra), _rows(1, history, *extra), _rows(2, history // _BASE, *extra)]


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Log-probabilities."""
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits


def _logs(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = bias + weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    return _softmax(out)


def _step(bias, weights, squares, rows, shown, rate, ridge):
    """One AdaGrad step: shown[i] counts the outcomes after rows[.][i]."""
    n = shown.sum(1, keepdims=True)
    off = n * np.exp(_logs(bias, weights, rows)) - shown
    for r in rows:
        order = np.argsort(r, kind="stable")
        own = r[order]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at = own[cut]
        g = np.add.reduceat(off[order], cut, axis=0) + ridge * weights[at]
        squares[at] += g * g
        weights[at] -= rate * g / np.sqrt(squares[at] + 1e-6)


def _sums(index: np.ndarray, width: int, column: np.ndarray, n: np.ndarray) -> np.ndarray:
    rows = int(index[-1]) + 1 if len(index) else 0
    return np.bincount(index * width + column, weights=n, minlength=rows * width).reshape(rows, width).astype(np.float32)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a rising array: its values, and the number of each entry's value."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], np.cumsum(new) - 1


def train_part(model: Model, history: np.ndarray, name: np.ndarray, n: np.ndarray, rate: float, passes: int, ridge: float, seed: int):
    """Gradient steps over events sorted by history; changes the model's weights. Returns the events behind each row of either table."""
    s, (bias, weights, inner_bias, inner) = model.shape, model.weights
    mass = [np.zeros(ROWS), np.zeros(ROWS)]
    known, index = _distinct(history)
    short = name < s.short
    with_class = history[short] * s.classes + name[short] // s.members
    order = np.argsort(with_class, kind="stable")
    pair, pair_index = _distinct(with_class[order])
    member, member_n = (name[short] % s.members)[order], n[short][order]
    tables = [
        (bias, weights, known, None, index, s.classes_of(name), n),
        (inner_bias, inner, pair // s.classes, pair % s.classes, pair_index, member, member_n),
    ]
    rng = np.random.default_rng(seed)
    for which, (own_bias, own, key, kind, at, column, own_n) in enumerate(tables):
        if not len(key):
            continue
        squares = np.zeros_like(own)
        bound = np.searchsorted(at, np.arange(len(key) + 1))
        total = np.bincount(at, weights=own_n, minlength=len(key))
        for r in features(key, kind):
            mass[which] += np.bincount(r, weights=total, minlength=ROWS)
        mix = rng.permutation(len(key))
        for _ in range(passes):
            for low in range(0, len(key), STEP):
                chosen = np.sort(mix[low : low + STEP])
                size = bound[chosen + 1] - bound[chosen]
                upto = np.append(0, np.cumsum(size))
                entry = np.repeat(bound[chosen] - upto[:-1], size) + np.arange(upto[-1])
                shown = _sums(np.repeat(np.arange(len(chosen)), size), own.shape[1], column[entry], own_n[entry])
                base = own_bias if kind is None else own_bias[kind[chosen]]
                _step(base, own, squares, features(key[chosen], None if kind is None else kind[chosen]), shown, rate, ridge)
    return mass


def _train(held, rate: float, passes: int, ridge: float, seed: int):
    def run(batches):
        import copy

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        history, name, n = (whole.column(c).to_numpy() for c in ("history", "name", "n"))
        order = np.argsort(history, kind="stable")
        model = copy.copy(held.value)
        start = model.weights
        model.weights = [w.copy() for w in start]
        mass = train_part(model, history[order], name[order].astype(np.int64), n[order], rate, passes, ridge, seed)
        for which in (0, 1):
            touched = np.flatnonzero(mass[which])
            moved = (model.weights[1 + 2 * which][touched] - start[1 + 2 * which][touched]).astype(np.float16)
            for low in range(0, len(touched), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(touched[low : low + 4096] + which * ROWS), pa.array(mass[which][touched[low : low + 4096]]), pa.array([r.tobytes() for r in moved[low : low + 4096]], pa.binary())], ["row", "mass", "moved"])

    return run


def _average(shape: Shape):
    """The mean movement of each row, weighted by mass; batches stream by, the sums have the size of the tables."""

    def run(batches):
        total, sums = np.zeros(2 * ROWS), [np.zeros((ROWS, shape.out), np.float32), np.zeros((ROWS, shape.members), np.float32)]
        for batch in batches:
            row, mass, moved = batch.column("row").to_numpy(), batch.column("mass").to_numpy(), batch.column("moved").to_pylist()
            total += np.bincount(row, weights=mass, minlength=2 * ROWS)
            for which, own in enumerate(sums):
                mine = np.flatnonzero(row // ROWS == which)
                if len(mine):
                    values = np.frombuffer(b"".join(moved[i] for i in mine), np.float16).reshape(len(mine), -1).astype(np.float32)
                    np.add.at(own, row[mine] - which * ROWS, values * mass[mine, None].astype(np.float32))
        for which, own in enumerate(sums):
            touched = np.flatnonzero(total[which * ROWS : (which + 1) * ROWS])
            mean = own[touched] / total[touched + which * ROWS, None].astype(np.float32)
            if len(touched):
                yield pa.RecordBatch.from_arrays([pa.array(touched + which * ROWS), pa.array([r.tobytes() for r in mean], pa.binary())], ["row", "moved"])

    return run


def train(model: Model, docs: DataFrame, rates: tuple[float, ...] = (0.3, 0.2, 0.12, 0.06), passes: int = 3, ridge: float = 1.0) -> Model:
    """The model with weights learned from all texts of docs, a round for each rate."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    events = docs.select("text").mapInArrow(C.tidy(lambda batches: _count_events(held.value)(batches)), "history long, name int, n long").groupBy("history", "name").agg(F.sum("n").alias("n"))
    counted = C.materialise(events)
    parts = max(1, -(-counted.count() // PARTITION))
    # all events of a history meet in a partition: they are as many as there are names at most
    events = C.materialise(counted.repartition(parts, "history"))
    C.discard(counted)
    for i, rate in enumerate(rates):
        now = spark.sparkContext.broadcast(model)
        moved = events.coalesce(parts).mapInArrow(C.tidy(_train(now, rate, passes, ridge, i)), "row long, mass double, moved binary")
        merged = moved.repartition(parts, "row").mapInArrow(C.tidy(_average(model.shape)), "row long, moved binary").toArrow()
        now.destroy()
        weights = [w.copy() for w in model.weights]
        row, values = merged.column("row").to_numpy(), merged.column("moved").to_pylist()
        for which in (0, 1):
            mine = np.flatnonzero(row // ROWS == which)
            if len(mine):
                weights[1 + 2 * which][row[mine] - which * ROWS] += np.frombuffer(b"".join(values[j] for j in mine), np.float32).reshape(len(mine), -1)
        model = Model(model.shape, model.words, model.counts, model.total, model.distinct, model.rest, model.rest_distinct, weights)
    C.discard(events)
    return model


def log_probs(model: Model, history: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Natural log-probability of each name's class after a history, and of a member in it; sorted by history and name."""
    s, (bias, weights, inner_bias, inner) = model.shape, model.weights
    known, index = _distinct(history)
    kind, out = s.classes_of(name), np.empty(len(history))
    for low in range(0, len(known), STEP):
        a, b = np.searchsorted(index, [low, low + STEP])
        out[a:b] = _logs(bias, weights, features(known[low : low + STEP]))[index[a:b] - low, kind[a:b]]
    short = np.flatnonzero(name < s.short)
    pair, index = _distinct(history[short] * s.classes + kind[short])
    for low in range(0, len(pair), STEP):
        a, b = np.searchsorted(index, [low, low + STEP])
        of = pair[low : low + STEP] % s.classes
        out[short[a:b]] += _logs(inner_bias[of], inner, features(pair[low : low + STEP] // s.classes, of))[index[a:b] - low, name[short[a:b]] % s.members]
    return out


def _score(model: Model):
    smooth = np.log10(model.total + 0.5 * (model.distinct + 1))
    shape = model.shape

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                if not len(part):
                    continue
                words, code, first = tokens(part.column("text"))
                of = model.ids(words)
                row = of[code]
                names = model.names(of)[code]
                key, back = np.unique(histories(names, first, model.shape.begin) * _BASE + names, return_inverse=True)
                value = log_probs(model, key // _BASE, key % _BASE)[back] / LOG10
                count = np.where(row >= 0, model.counts[np.maximum(row, 0)] if len(model.counts) else 0, 0)
                banded = (names >= shape.short) & (names < shape.rest)
                value[banded] += np.log10(count[banded] / model.band_total[names[banded] - shape.short])
                inside = row >= 0
                base = np.where(inside, np.log10(count + 0.5), 0.0)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                rest = np.flatnonzero(~inside)
                pair, times = np.unique(owner[rest] * len(words) + code[rest], return_counts=True)
                offsets = pa.array(np.searchsorted(pair // len(words), np.arange(len(n) + 1)).astype(np.int32))
                kind = pa.struct([("word", pa.binary()), ("n", pa.int64())])
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words.take(pa.array(pair % len(words))).cast(pa.binary()), pa.array(times)], fields=list(kind)))
                sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  (every row has its END)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sums(inside.astype(np.int64))), pa.array(sums(base) - n * smooth), pa.array(sums(value)), lists], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, least: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (smoothed unigrams) and score (the model) of each text, both log10.

    counts: of all training words; those below `least` are not in the model's table and are met by a join on the word, a
    row for each word and text. Null and empty texts are one END; a null doc_id stays null and repeated rows are scored
    each; other columns are not read. No rows: none.
    """
    C.lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    own = C.materialise(rows.mapInArrow(C.tidy(lambda batches: _score(held.value)(batches)), f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,n:bigint>>"))
    met = own.select("row", F.explode("rest").alias("w")).select("row", "w.word", F.col("w.n").alias("times")).join(counts.filter(F.col("n") < least), "word", "left")
    rare = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum("times").alias("all"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log")
    )
    within = float(np.log10(model.rest + 0.5 * (model.rest_distinct + 1)))
    return own.drop("rest").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("log", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce(F.col("log") - F.col("all") * F.lit(within), F.lit(0.0))).alias("score"),
    )


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"


def fit(docs: DataFrame, most: int = TABLE, shape: Shape = Shape()) -> tuple[Model, DataFrame, int]:
    """A model of all texts of docs, the counts of all their words, and the least count of its table."""
    counts = C.materialise(count(docs))
    model, least = table(counts, most, shape)
    return train(model, docs), counts, least


def judge(docs: DataFrame, most: int = TABLE, shape: Shape = Shape()) -> DataFrame:
    """Scores of every row of docs by a model of the rows outside the held-out fifth; a null doc_id is learned from."""
    C.lean(docs.sparkSession)
    held_out = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model, counts, least = fit(docs.filter(~held_out), most, shape)
    return score(docs, model, counts, least).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
