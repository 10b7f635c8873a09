"""Linking incidents to comments by TF-IDF, all relational: postings, weights and an inverted-index join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marea.operators import postings
from marea.session import BROADCAST_ROWS, settle, small


def grams(text: Column, bigrams: bool = True, stop: tuple[str, ...] = ()) -> Column:
    """All words of two and more characters of a text, then all pairs of neighbours."""
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    words = F.filter(own, lambda t: ~t.isin(*stop)) if stop else own
    if not bigrams:
        return words
    # bound by a lambda: the words are taken from the text once
    both = lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.get(F.transform(F.array(words), both), F.lit(0))


def counted(terms_: Column) -> Column:
    """The distinct terms of an array with their counts, as term and tf: runs of the sorted array."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        told = lambda b: F.zip_with(b, F.slice(b, 2, F.size(b)), lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(j, F.size(s)) - i).cast("long").alias("tf")))
        return F.get(F.transform(F.array(firsts), told), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(terms_)), runs), F.lit(0))


def repeated(docs: DataFrame, id_: str) -> DataFrame:
    """The ids that several rows have, as _again: mostly none, so they are written and broadcast."""
    return small(settle(docs.groupBy(F.col(id_).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again")))


def row_terms(docs: DataFrame, id_: str, text: str, keep: tuple[str, ...] = (), bigrams: bool = True, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, term and tf of each row by itself, without a shuffle."""
    rows = docs.select(F.col(id_).alias("id"), *keep, F.explode(counted(grams(F.col(text), bigrams, stop))).alias("_t"))
    return rows.select("id", *keep, "_t.term", "_t.tf")


def terms(docs: DataFrame, id_: str, text: str, bigrams: bool = True, stop: tuple[str, ...] = (), several: DataFrame | None = None) -> DataFrame:
    """id, term and tf: words of two and more characters, and pairs of neighbours; rows of one id count together.

    Only rows whose id is among those of `several` (by default `repeated`) are shuffled.
    """
    several = repeated(docs, id_) if several is None else several
    same = F.col(id_).eqNullSafe(F.col("_again"))
    once = row_terms(docs.join(several, same, "left_anti"), id_, text, (), bigrams, stop)
    again = row_terms(docs.join(several, same, "left_semi"), id_, text, (), bigrams, stop)
    return once.unionByName(again.groupBy("id", "term").agg(F.sum("tf").alias("tf")))


def vocabulary(postings: DataFrame, n_docs: int, min_df: int = 2, max_terms: int = 50_000) -> DataFrame:
    """term and idf of the most frequent terms that enough documents have: ln((1 + n) / (1 + df)) + 1."""
    return _chosen(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), n_docs, min_df, max_terms)


def _chosen(stats: DataFrame, n_docs: int, min_df: int, max_terms: int) -> DataFrame:
    stats = stats.filter(F.col("df") >= min_df)
    return stats.orderBy(F.desc("total"), "term").limit(max_terms).select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def text_vocabulary(docs: DataFrame, id_: str, text: str, n_docs: int, min_df: int = 2, max_terms: int = 50_000, bigrams: bool = True, stop: tuple[str, ...] = (), several: DataFrame | None = None) -> DataFrame:
    """vocabulary() straight from the texts: only sums by term are shuffled, no postings."""
    several = repeated(docs, id_) if several is None else several
    words = lambda rows: rows.select(grams(F.col(text), False, stop).alias("words"))
    none = several.isEmpty()
    same = F.col(id_).eqNullSafe(F.col("_again"))
    # each batch tells of a term once; those of repeated ids are distinct by id
    seen = words(docs if none else docs.join(several, same, "left_anti")).mapInArrow(postings.counts(bigrams), "term string, df long, total long")
    if not none:
        again = terms(docs.join(several, same, "left_semi"), id_, text, bigrams, stop, several)
        seen = seen.unionByName(again.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("total")))
    return _chosen(seen.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), n_docs, min_df, max_terms)


def weights(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, term, weight (tf times idf, each document of length 1) and idf."""
    raw = postings.join(small(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    return raw.join(lengths(postings, vocab), "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def lengths(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """id and norm: the length of each document that has a term of the vocabulary."""
    w = F.col("tf") * F.col("idf")
    return postings.join(small(vocab), "term").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def similarities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine of all pairs that share a term, by one equi-join on the term and one aggregation."""
    a, b = left.select(F.col("id").alias("left_id"), "term", F.col("weight").alias("wa")), right.select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").groupBy("left_id", "right_id").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("similarity"))


def prefixes(weighted: DataFrame, threshold: float) -> DataFrame:
    """The rarest terms of each document: without them a document of length 1 can't reach the threshold with any other.

    Terms are taken from the rarest on (equals by name) until the length of those left is under the threshold.
    """
    rest = Window.partitionBy("id").orderBy("idf", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weighted.withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(rest)).filter(F.col("left") >= (threshold - 1e-8) ** 2).drop("left")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Cosine of exactly the pairs that reach the threshold (above 0), from weights with idf.

    The rarest term that such a pair shares is in the prefix of either side, so an equi-join of the prefixes meets every
    pair; its similarity is then summed over all terms.
    """
    met = prefixes(left, threshold).select(F.col("id").alias("left_id"), "term").join(prefixes(right, threshold).select(F.col("id").alias("right_id"), "term"), "term").select("left_id", "right_id").distinct()
    a, b = left.select(F.col("id").alias("left_id"), "term", F.col("weight").alias("wa")), right.select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wb"))
    sums = met.join(a, "left_id").join(b, ["right_id", "term"]).groupBy("left_id", "right_id").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("similarity"))
    return sums.filter(F.col("similarity") >= threshold)


#: Pairs of a task of near_pairs, on average.
TASK_PAIRS = 1_000_000


def near_pairs(left: DataFrame, docs: DataFrame, vocab: DataFrame, n: int, threshold: float, several: DataFrame | None = None) -> DataFrame:
    """Cosine of the pairs of the left weights and of n documents (id, text) that reach the threshold (above 0).

    A document's terms, its length and its products with the left side stay in the batch that has its text, so neither texts
    nor postings nor pairs are shuffled while the left side and the vocabulary can be sent to all tasks. Rows of one id
    count together: those of `several` (by default `repeated`), and all beyond that bound, go through joins.
    """
    weighted = settle(left.select(F.col("id").alias("left_id"), "term", (F.col("weight") * F.col("idf")).alias("wa")))
    held = docs.filter("id is not null")
    if max(f.limit(BROADCAST_ROWS + 1).count() for f in (weighted, vocab)) > BROADCAST_ROWS:
        sums = _joined_pairs(weighted, held, vocab, n)
    else:
        several = repeated(docs, "id") if several is None else several
        none = several.isEmpty()
        same = F.col("id").eqNullSafe(F.col("_again"))
        known = vocab.select("term", "idf").toArrow()
        run = postings.products(known["term"].to_pylist(), known["idf"].to_numpy(), weighted.toArrow(), threshold)
        once = held if none else held.join(several, same, "left_anti")
        sums = once.select("id", grams(F.col("text"), False).alias("words")).mapInArrow(run, "left_id string, right_id string, s double")
        if not none:
            again = held.join(several, same, "left_semi")
            sums = sums.unionByName(_joined_pairs(weighted, again, vocab, again.count()))
    return sums.select("left_id", "right_id", F.round("s", 9).alias("similarity")).filter(F.col("similarity") >= threshold)


def _joined_pairs(weighted: DataFrame, docs: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """left_id, right_id and s of all pairs that share a term: the texts are brought together by id, and stay there."""
    weighted = small(weighted)
    m = weighted.select("left_id").distinct().count()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, n * m // TASK_PAIRS + 1)
    held = docs.repartition(parts, "id")
    met = lambda rows, other, *keep: rows.select("id", *keep, F.explode(grams(F.col("text"))).alias("term")).join(other, "term")
    tf = met(held, small(vocab)).groupBy("id", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    norms = tf.groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"))
    # counted before they meet the left side: frequent terms occur often in a text and in many of the left
    shared = met(held.join(norms.hint("shuffle_hash"), "id"), small(weighted.select("term").distinct()), "norm").groupBy("id", "norm", "term").agg(F.count(F.lit(1)).alias("tf"))
    return shared.join(weighted, "term").groupBy("left_id", F.col("id").alias("right_id")).agg(F.sum(F.col("tf") * F.col("wa") / F.col("norm")).alias("s"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar partners of each left id; ties by partner."""
    w = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _prepared(incidents: DataFrame, comments: DataFrame, min_df: int | None, max_terms: int) -> tuple:
    """What both kinds of links need: comments and ids as documents, their number, repeated ids, vocabulary and the incidents' weights."""
    own = lambda side, id_: F.concat(F.lit(side), F.col(id_).cast("string"))
    right, asked = comments.select(own("c", "comment_id").alias("id"), "text", "topic"), incidents.select(own("i", "incident_id").alias("id"), "text")
    docs = right.select("id", "text").unionByName(asked)
    n = docs.count()
    several = repeated(docs, "id")
    vocab = settle(text_vocabulary(docs, "id", "text", n, min_df or (1 if n < 250 else 2), max_terms, several=several))
    inc = settle(weights(settle(terms(asked.filter("id is not null"), "id", "text", several=several)), vocab))
    ids = incidents.select(own("i", "incident_id").alias("left_id"), "incident_id", F.col("ts").alias("incident_ts"))
    return right, n, several, vocab, inc, ids


def _assignments(right: DataFrame, n: int, several: DataFrame, vocab: DataFrame, inc: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    each = right.filter("id is not null").select("text", "topic")
    if not several.isEmpty():
        # a row of a repeated id brings all terms of the id to its topic
        same = F.col("id").eqNullSafe(F.col("_again"))
        again = right.join(several, same, "left_semi")
        each = right.join(several, same, "left_anti").filter("id is not null").select("text", "topic").unionByName(again.select("id", "text").join(again.select("id", "topic"), "id").select("text", "topic"))
    if vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = vocab.select("term").toArrow()["term"].to_pylist()
        told = each.filter("topic is not null").select(F.col("topic").cast("string"), grams(F.col("text"), False).alias("words"))
        by_topic = told.mapInArrow(postings.topic_counts(known), "id string, term string, tf long").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    else:
        found = each.select(F.col("topic").alias("id"), F.explode(grams(F.col("text"))).alias("term")).join(vocab.select("term"), "term")
        by_topic = found.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # read for the weights and for their lengths
    best = top_k(similarities(inc, weights(settle(by_topic), vocab)), 1).filter(F.col("similarity") >= threshold)
    return best.join(ids, "left_id").select("incident_id", F.col("right_id").alias("topic"), "similarity")


def _links(comments: DataFrame, right: DataFrame, n: int, several: DataFrame, vocab: DataFrame, inc: DataFrame, ids: DataFrame, threshold: float, k: int, max_days: int) -> DataFrame:
    # a pair under the threshold takes no place from one above it, so only those above are ranked
    near = settle(top_k(near_pairs(inc, right.select("id", "text"), vocab, n, threshold, several), k))
    cs = comments.join(small(near.select(F.substring("right_id", 2, 99).alias("_c")).distinct()), F.col("comment_id").cast("string") == F.col("_c"), "left_semi").select(F.concat(F.lit("c"), F.col("comment_id").cast("string")).alias("right_id"), "comment_id", F.col("ts").alias("comment_ts"), "topic")
    links = near.join(ids, "left_id").join(cs, "right_id").filter(F.abs(F.datediff("incident_ts", "comment_ts")) <= max_days)
    return links.select("incident_id", "comment_id", "similarity", "topic", "incident_ts", "comment_ts")


def assign(incidents: DataFrame, comments: DataFrame, threshold: float = 0.25, min_df: int | None = None, max_terms: int = 50_000) -> DataFrame:
    """The assignments of link() alone: no pair of an incident and a comment is made."""
    return _assignments(*_prepared(incidents, comments, min_df, max_terms), threshold)


def evidence_links(incidents: DataFrame, comments: DataFrame, threshold: float = 0.25, k: int = 5, max_days: int = 10, min_df: int | None = None, max_terms: int = 50_000) -> DataFrame:
    """The evidence links of link() alone."""
    return _links(comments, *_prepared(incidents, comments, min_df, max_terms), threshold, k, max_days)


def link(incidents: DataFrame, comments: DataFrame, threshold: float = 0.25, k: int = 5, max_days: int = 10, min_df: int | None = None, max_terms: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Assignments (incident, best topic) and evidence links (incident, comment).

    incidents: incident_id, ts, text; comments: comment_id, ts, topic, text. Rank first, then threshold and days: a
    partner that fails does not make room for the next. A topic's document is the sum of its comments' terms.
    """
    told = _prepared(incidents, comments, min_df, max_terms)
    return _assignments(*told, threshold), _links(comments, *told, threshold, k, max_days)


def contains_terms(docs: DataFrame, id_: str, text: str, wanted: DataFrame) -> DataFrame:
    """Pairs of id and single-word term where the folded text has the term as a word: an equi-join on words."""
    from marea.functions import text as X

    words = docs.select(F.col(id_).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(X.fold(F.col(text)), F.lit("([a-z0-9_]+)"), 1))).alias("term"))
    return words.join(wanted.select("term").distinct(), "term").select("id", "term")


def match_labels(docs: DataFrame, id_: str, text: str, labels: DataFrame, least: float = 0.60) -> DataFrame:
    """The label that fits each text best: its phrase occurs (1.0), or its words do to at least that share (above 0).

    Two equi-joins find the candidates: the first (up to four) characters of a label's phrase meet those places of a text
    that read the same, and the words that count for an axis meet an index of the labels' words. Equal fits: the label of
    the smallest `position`, if there is such a column, then by name.
    """
    from marea.functions import text as X

    place = F.col("position").cast("long") if "position" in labels.columns else F.lit(0).cast("long")
    l = settle(labels.groupBy("label").agg(F.min(place).alias("position")).select("label", "position", X.phrase(F.col("label")).alias("lp"), X.axis_tokens(F.col("label")).alias("lt")).filter("lp <> ''"))  # noqa: E741
    all_ = settle(docs.select(F.col(id_).alias("id"), X.phrase(F.col(text)).alias("p"), X.axis_tokens(F.col(text)).alias("t")).filter("p <> ''"))
    # equal texts have equal labels: each is matched once, under a number that it is written with
    d = settle(all_.groupBy("p").agg(F.first("t").alias("t")).select(F.monotonically_increasing_id().alias("id"), "p", "t"))
    heads = l.select("label", "position", "lp", F.substring("lp", 1, 4).alias("head"))
    sizes = [r[0] for r in heads.select(F.length("head")).distinct().collect()]  # four at most
    at = lambda n: F.transform(F.when(F.length("p") >= n, F.sequence(F.lit(1), F.length("p") - (n - 1))), lambda i: F.substr("p", i, F.lit(n)))
    starts = d.select("id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*(at(n) for n in sizes)))))).alias("head")) if sizes else d.select("id", F.lit("").alias("head"))
    whole = starts.join(small(heads), "head").join(d.select("id", "p"), "id").filter(F.contains("p", "lp"))
    tokens = l.select("label", "position", F.size("lt").alias("n"), F.explode("lt").alias("word"))
    shared = d.select("id", F.explode("t").alias("word")).join(small(tokens), "word").groupBy("id", "label", "position").agg((F.count(F.lit(1)).cast("double") / F.first("n")).alias("fit"))
    pairs = whole.select("id", "label", "position", F.lit(1.0).alias("fit")).unionByName(shared.filter(F.col("fit") >= least))
    w = Window.partitionBy("id").orderBy(F.desc("fit"), "position", "label")
    best = pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "label", "fit")
    told = settle(best.join(d.select("id", "p"), "id").select("p", "label", "fit"))
    # an id of several rows has the best of its texts
    at = all_.select("id", "p").join(small(told), "p").join(small(l.select("label", "position")), "label")
    several = repeated(all_, "id")
    same = F.col("id").eqNullSafe(F.col("_again"))
    again = at.join(several, same, "left_semi").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return at.join(several, same, "left_anti").select("id", "label", "fit").unionByName(again.select("id", "label", "fit"))
