"""Comment topics and broken journeys by clustering, and keyword assignment."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marea.functions import text as X
from marea.operators.chains import confidence_label, impact_label
from marea.operators.linking import grams, text_vocabulary
from marea.session import settle, small

#: Characters that a text needs to be clustered.
SHORTEST = 5


def _vectors(docs: DataFrame, id_: str, text: str, max_terms: int, min_df: int, n: int, stop: tuple[str, ...] = ()):
    """id and features (tf times idf, length 1, sparse) of all n documents, and the terms of their places.

    Only the vocabulary, `max_terms` words at most, passes through the driver; each row is counted, scaled and normed where it is.
    """
    vocab = text_vocabulary(docs, id_, text, n, min_df, max_terms, stop=stop).orderBy("term").collect()
    if not vocab:
        return None, []
    rows = docs.select(F.col(id_).alias("id"), grams(F.col(text), stop=stop).alias("terms"))
    counted = CountVectorizerModel.from_vocabulary([r.term for r in vocab], "terms", "tf").transform(rows)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in vocab]), inputCol="tf", outputCol="scaled").transform(counted)
    return Normalizer(p=2.0, inputCol="scaled", outputCol="features").transform(scaled).select("id", "features"), [r.term for r in vocab]


def _centres(vectors: DataFrame, fitted: DataFrame, words: list[str], name: str) -> DataFrame:
    """cluster, term and the sum of its weights (above 0) in a cluster: one dense sum a cluster, no postings."""
    sums = vectors.join(fitted, "id").groupBy("cluster").agg(Summarizer.sum(F.col("features")).alias("s"))
    listed = vectors.sparkSession.createDataFrame(list(enumerate(words)), "place int, term string")
    return sums.select("cluster", F.posexplode(vector_to_array("s")).alias("place", name)).filter(F.col(name) > 0).join(F.broadcast(listed), "place").select("cluster", "term", name)


def cluster_count(n: int, wanted: int) -> int:
    """Clusters for n texts: one for 50 of them, 2 to `wanted`; for under 100 texts 5 at most."""
    return min(wanted, max(2, n // 50)) if n >= 100 else min(5, n)


def _clusters(vectors: DataFrame, k: int, restarts: int, seed: int = 42) -> DataFrame:
    """id and cluster of the best of several starts."""
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(vectors) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).select("id", F.col("prediction").alias("cluster"))


def extract_topics(comments: DataFrame, id_: str = "comment_id", text: str = "text", wanted: int = 10, max_terms: int = 4000, top_terms: int = 10, examples: int = 5, restarts: int = 3) -> DataFrame:
    """Clusters of comments, largest first: cluster_id, n, their main terms and examples (cleaned texts of the first ids).

    Texts of under SHORTEST characters, and Spanish stop words, don't count; under two texts, or without any term that two
    texts share, there are no topics. cluster_id is the place in the order by size and main terms, so it doesn't depend on
    how the clustering numbers them.
    """
    docs = comments.select(F.col(id_).alias("id"), X.letters(F.col(text)).alias("t")).filter(F.length("t") >= SHORTEST)
    none = comments.sparkSession.createDataFrame([], "cluster_id int, n long, top_terms array<string>, examples array<string>")
    docs = settle(docs)
    n = docs.count()
    k = cluster_count(n, wanted)
    if k < 2:
        return none
    vectors, words = _vectors(docs, "id", "t", max_terms, 2, n, X.TOPIC_STOPWORDS)
    if not words:
        return none
    vectors = settle(vectors)
    fitted = settle(_clusters(vectors, k, restarts))
    centre = _centres(vectors, fitted, words, "w").withColumn("w", F.round("w", 9))
    ranked = centre.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "term"))).filter(F.col("r") <= top_terms)
    told = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("top_terms"))
    first = fitted.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).filter(F.col("r") <= examples).drop("r")
    shown = docs.join(small(first), "id").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id", "t"))).filter(F.col("r") <= examples)
    shown = shown.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("examples"))
    sizes = fitted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(told, "cluster", "left").join(shown, "cluster")
    order = [F.desc("n"), "top_terms", "cluster"]
    return sizes.withColumn("cluster_id", (F.row_number().over(Window.orderBy(*order)) - 1)).select("cluster_id", "n", F.coalesce("top_terms", F.expr("cast(array() as array<string>)")).alias("top_terms"), "examples").orderBy("cluster_id")


def assign_topics(comments: DataFrame, topics: DataFrame, text: str = "text", first: int = 5) -> DataFrame:
    """The first topic, by size, one of whose main terms occurs in the comment; __NO_TEXT__ and __OTHER__ else."""
    t = topics.select(F.row_number().over(Window.orderBy(F.desc("n"), "cluster_id")).alias("pos"), F.slice("top_terms", 1, first).alias("terms"), F.array_join(F.slice("top_terms", 1, 3), ", ").alias("name"))
    ranked = t.agg(F.array_sort(F.collect_list(F.struct("pos", "terms", "name"))).alias("topics"))  # a few rows: one cell
    clean = X.letters(F.col(text))
    hits = F.filter("topics", lambda s: F.exists(s["terms"], lambda w: F.contains(F.col("_clean"), w)))
    out = comments.withColumn("_clean", clean).crossJoin(F.broadcast(ranked))  # one row
    name = F.when(F.col("_clean") == "", "__NO_TEXT__").otherwise(F.coalesce(F.get(hits, F.lit(0))["name"], F.lit("__OTHER__")))
    return out.withColumn("topic", name).drop("_clean", "topics")


def journey_count(n: int, axes: int) -> int:
    if n <= 1:
        return 1
    return 2 if n <= 4 else max(2, min(8, axes, round(math.sqrt(n))))


def broken_journeys(enriched: DataFrame, max_terms: int = 384, dimensions: int = 24) -> DataFrame:
    """Clusters of linked pairs by their texts: labels, counts, cohesion (mean cosine to the centre), impact and confidence."""
    rows = enriched.withColumn("pair", F.concat_ws("|", F.col("incident_id").cast("string"), F.col("comment_id").cast("string")))
    rows = rows.withColumn("t", X.letters(F.concat_ws(" ", "topic", "lever", "sublever", "incident_text", "comment")))
    rows = settle(rows)
    n = rows.count()
    vectors, terms_ = _vectors(rows, "pair", "t", max_terms, 1, n) if n else (None, [])
    width = len(terms_)
    if not width:
        return enriched.sparkSession.createDataFrame([], "journey_id string")
    vectors = settle(vectors)
    axes = max(1, rows.select("sublever").distinct().count())
    k = min(n, journey_count(n, max(2, axes)))
    has = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x) > 0
    low = PCA(k=max(1, min(dimensions, width - 1, n)), inputCol="features", outputCol="p").fit(vectors).transform(vectors).select("id", F.col("p").alias("features"), has.alias("long")) if width > 2 else vectors.withColumn("long", has)
    model = KMeans(k=k, seed=7, distanceMeasure="euclidean").fit(low)
    fitted = settle(model.transform(low).select("id", F.col("prediction").alias("cluster"), "long"))
    found = fitted.select(F.col("id").alias("pair"), "cluster")
    centre = settle(_centres(vectors, fitted.select("id", "cluster"), terms_, "c"))
    norm = centre.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    # the mean cosine of unit vectors to their sum is its length over their number; rows without terms don't count
    cohesion = fitted.groupBy("cluster").agg(F.count_if("long").alias("n")).filter("n > 0").join(norm, "cluster").select("cluster", (F.col("norm") / F.col("n")).alias("semantic_cohesion"))
    words = centre.filter(~F.contains("term", F.lit(" "))).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "term"))).filter("r <= 5").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("keywords"))
    label = lambda c: F.mode(F.when(~X.generic(F.col(c)), F.col(c)), True).alias(c)
    per = rows.join(found, "pair").groupBy("cluster").agg(label("lever"), label("sublever"), F.count_distinct("pair").alias("linked_pairs"), F.count_distinct("incident_id").alias("linked_incidents"), F.count_distinct("comment_id").alias("linked_comments"), F.avg("similarity").alias("avg_similarity"), F.avg("score").alias("avg_nps"))
    out = per.join(cohesion, "cluster").join(words, "cluster")
    out = out.withColumn("impact_label", impact_label(F.col("linked_pairs"), F.col("avg_nps"))).withColumn("confidence_label", confidence_label(F.col("semantic_cohesion"), F.col("avg_similarity")))
    base = out.withColumn("journey_label", F.concat_ws(" / ", "lever", "sublever"))
    slug = base.withColumn("s", X.slug(F.col("journey_label")))
    r = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("linked_pairs"), "cluster"))
    return slug.withColumn("journey_id", F.when(r == 1, F.col("s")).otherwise(F.concat_ws("-", "s", r.cast("string")))).drop("s", "cluster").orderBy(F.desc("linked_pairs"), "journey_id")
