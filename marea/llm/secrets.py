"""Secret scans with corpus-wide ownership frequency.

Pattern matches give candidate secrets. Each candidate's hash is counted over the corpus by distinct repositories and
distinct owners: a value that many owners hold is an example that was copied around, a value of one owner that looks
random is taken for a live credential. Both verdicts add spans to the pattern spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

#: Verdicts up to which they are broadcast to their uses; beyond it both are shuffled, and a copied value's uses are split as skew.
BROADCAST_ROWS = 1_000_000

KINDS = ("assign", "access", "hex", "live", "example")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # as the runs of [0-9a-f]+ of 24 and more

SCAN = "doc_id long, text_id long, owner string, repository string, base array<struct<kind: int, start: int, end: int>>, hits array<struct<value: string, bits: double, start: int, end: int>>"


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """Kind (index in KINDS), start and end of each match, and those of its value, in code points."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _scan(batches):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    hit = pa.list_(pa.struct([("value", pa.string()), ("bits", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part in slices(batch):
            base, hits = [], []
            for text in part.column("text").to_pylist():
                found = candidates(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e, _, _ in found])
                hits.append([{"value": hashlib.sha256(text[s:e].encode()).hexdigest(), "bits": entropy(text[s:e]), "start": s, "end": e} for s, e in dict.fromkeys((s, e) for _, _, _, s, e in found)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), part.column("owner"), part.column("repository"), pa.array(base, span), pa.array(hits, hit)], ["doc_id", "text_id", "owner", "repository", "base", "hits"])


def ownership(candidates: DataFrame, copied_owners: int = 3, live_owners: int = 1, live_repositories: int = 5, live_bits: float = 2.5) -> DataFrame:
    """value -> owners, repositories and a verdict, over all candidates (value, bits, owner, repository).

    `example`: at least `copied_owners` distinct owners, or too regular to be random (under `live_bits` bits a
    character). `live`: at most `live_owners` owners and `live_repositories` repositories. Between them: no verdict.
    """
    counts = candidates.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.max("bits").alias("bits"), F.count(F.lit(1)).alias("uses"))
    verdict = F.when((F.col("owners") >= copied_owners) | (F.col("bits") < live_bits), "example").when((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories), "live")
    return counts.withColumn("verdict", verdict)


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, **limits) -> DataFrame:
    """One row per row of docs (doc_id, text, source, lang): doc_id, base and added spans (array of kind, start, end).

    Owner defaults to `source` and repository to source/lang; a null owner or repository is one of its own name.
    Null texts have no spans. Repeated rows get the same spans.
    """
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit("?"))
    repository = F.coalesce(repository if repository is not None else F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))), F.lit("?"))
    rows = docs.select("doc_id", F.expr("xxhash64(text)").alias("text_id"), owner.alias("owner"), repository.alias("repository"), "text")
    found = C.materialise(rows.mapInArrow(C.tidy(_scan), SCAN))  # used three times, scanned once
    hits = found.filter(F.size("hits") > 0).select("doc_id", "text_id", "owner", "repository", F.explode("hits").alias("hit")).select("doc_id", "text_id", "owner", "repository", "hit.*")
    judged = ownership(hits, **limits).filter("verdict is not null").select("value", F.when(F.col("verdict") == "live", 3).otherwise(4).alias("kind"))
    judged = C.materialise(judged)
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_ROWS else judged
    added = hits.select("doc_id", "text_id", "value", "start", "end").join(judged, "value").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = added.withColumnsRenamed({"doc_id": "of", "text_id": "of_text"})
    return found.join(added, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text")), "left").select("doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: the numbers of pattern spans, their digest, all spans, and the numbers of added ones."""
    found = scan(docs)
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count("base", i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), *(count("added", i).alias(f"n_{KINDS[i]}") for i in (3, 4)),
    )
