"""Every stage of the pipeline on nulls, empty and repeated rows, an empty table and columns of clashing names."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

CLASHES = ["label", "half", "total", "score", "n_lines", "n_removed", "component_id", "kept", "row", "item_id", "word", "held"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with a benchmark passage, toxic texts, near copies and common lines."""
    root = tmp_path_factory.mktemp("corpus")
    prose = lambda k, n: " ".join(f"w{x}" for x in random.Random(k).choices(range(4000), k=n))
    passage = " ".join(f"item{i} fact{i * i}" for i in range(20))
    docs = [(i, prose(i, 40 + i % 9), "en", "src", 0) for i in range(60)]
    docs += [(100 + i, prose(200 + i, 30) + " gromak vilbis" * 4, "en", "src", 0) for i in range(20)]
    docs += [(130, prose(300, 60) + " " + passage, "en", "src", 0), (131, prose(5, 45) + " end", "en", "src", 0), (132, "shared line of words here now\n" + prose(301, 20), "en", "src", 0), (133, "shared line of words here now\n" + prose(302, 20), "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").withColumn("n_chars", F.length("text")).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(d[0], 1, int("gromak" in d[1])) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return f"file://{root}"


def odd(spark, folder):
    """The corpus with rows that no stage expects, a repeated row and clashing columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = spark.createDataFrame([(None, "no id here but words", None, None, None), (None, None, None, None, None), (900, None, "en", None, 0), (901, "", "en", "src", 0), (902, " \t\n", "en", "src", 3), (903, "long " * 30_000, "en", "src", 150_000)], docs.schema)
    both = docs.unionByName(rows).unionByName(docs.filter("doc_id = 7"))
    return both.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stage_keeps_what_it_does_not_judge(spark, folder, name, stage):
    docs = odd(spark, folder)
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(7) == 2 and {900, 901, 902} <= set(ids) and ids.count(None) == 2
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    clean = {i for i in range(60)}
    assert clean <= set(ids)
    gone = {r.doc_id for r in docs.collect()} - set(ids)
    assert gone == {"toxicity": set(range(100, 120)), "line dedup": {131}, "near-dedup": {131}, "decontamination": {130}}[name]
    if name == "line dedup":
        text = {r.doc_id: r.text for r in rows}
        assert text[132].startswith("shared line") and not text[133].startswith("shared line")
    none = stage(spark, docs.limit(0), folder)
    assert none.columns == docs.columns and none.count() == 0




def test_segmentation_of_odd_rows(spark, folder):
    docs = odd(spark, folder).filter("doc_id is null or doc_id in (7, 900, 901, 902, 903)")
    rows = P.segment(spark, docs, folder).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(7) == 6 and ids.count(903) == 3 and 900 not in ids and 901 not in ids and all(r.round_trip for r in rows)
    assert {tuple(r) for r in rows if r.doc_id == 7} and len({tuple(r) for r in rows if r.doc_id == 7}) == 3  # repeated rows sample alike
    assert P.segment(spark, docs.limit(0), folder).count() == 0


def test_run_against_its_stages(spark, folder):
    """run() applies the stages in order: the rows are those of the documents that none of them rejects."""
    got = P.run(spark, folder)
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert kept == set(range(60)) | {132, 133}
