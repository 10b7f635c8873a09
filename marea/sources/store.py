"""Stores: partitioned Parquet, JSON lines, the merge of records, ledgers and caches."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "business_key string, record_fingerprint string, payload string, times_seen int, first_upload string, last_upload string"
UPLOADS = "upload_id string, context string, file_hash string, status string, rows long, inserted long, updated long, duplicates long, at timestamp"
ISSUES = "upload_id string, level string, code string, message string, column string"
EVENTS = "upload_id string, business_key string, status string"


def context_key(origin: str, n1: str, n2: str = "") -> str:
    """One name of a context; the order of n2's tokens doesn't matter."""
    tokens = ",".join(sorted({t.strip() for t in n2.split(",") if t.strip()}))
    return hashlib.sha1(json.dumps([origin.strip(), n1.strip(), tokens], ensure_ascii=False).encode()).hexdigest()[:12]


def write_lines(df: DataFrame, path: str, date: str = "ts") -> DataFrame:
    """JSON lines with sorted columns and ISO dates, as gzip files; returns one row on what was written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.col(date).cast("date")).alias("first_day"), F.max(F.col(date).cast("date")).alias("last_day"))


def read_lines(spark: SparkSession, path: str, schema, columns: list[str] | None = None, start=None, end=None, levers: list[str] | None = None, date: str = "ts") -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return subset(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), columns, start, end, levers, f"cast({date} as date)")


def partition_columns(df: DataFrame, day: str, candidates: list[str], most: int = 50) -> list[str]:
    """The day, and the candidate columns of few values; one pass."""
    if not candidates:
        return [day]
    n = df.agg(*(F.approx_count_distinct(c, 0.02).alias(c) for c in candidates)).first()
    return [day, *(c for c in candidates if 0 < n[c] <= most)]


def write_partitioned(df: DataFrame, path: str, ts: str = "ts", candidates: list[str] | None = None) -> list[str]:
    """Parquet by event day and columns of few values. Rows are dealt by the partition columns first: few files each."""
    df = df.withColumn("event_day", F.col(ts).cast("date"))
    keys = partition_columns(df, "event_day", candidates or [])
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return keys


def subset(df: DataFrame, columns: list[str] | None = None, start=None, end=None, levers: list[str] | None = None, day: str = "event_day") -> DataFrame:
    """Days, levers and columns of a stored set; on a partition column the predicates prune files."""
    if start is not None:
        df = df.filter(F.expr(day) >= F.lit(start))
    if end is not None:
        df = df.filter(F.expr(day) <= F.lit(end))
    if levers:
        df = df.filter(F.col("lever").isin(*levers))
    return df.select(*columns) if columns else df


_hot: dict[str, tuple[tuple, DataFrame]] = {}


def hot_subset(df: DataFrame, name: str, **selection) -> DataFrame:
    """A subset that is kept for the next one who asks for the same of the same data; what was kept by the name before goes.

    The same data: the same session, plan and files. A snapshot that was written anew has other files.
    """
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, df.semanticHash(), tuple(sorted(df.inputFiles())), json.dumps(selection, sort_keys=True, default=str))
    known = _hot.get(name)
    if known and known[0] == key:
        return known[1]
    if known and known[0][0] == key[0]:
        known[1].unpersist()
    _hot[name] = (key, subset(df, **selection).persist())
    return _hot[name][1]


def merge(current: DataFrame, batch: DataFrame, upload_id: str) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of records and an event a row of the batch.

    current: RECORDS; batch: business_key, record_fingerprint, payload, one row a key. A new key is inserted, an equal
    fingerprint only counts as seen, another one replaces the payload.
    """
    b = batch.select("business_key", F.col("record_fingerprint").alias("new_print"), F.col("payload").alias("new_payload"), F.lit(True).alias("in_batch"))
    met = current.withColumn("known", F.lit(True)).join(b, "business_key", "full")
    status = F.when(F.col("in_batch").isNull(), F.lit(None)).when(F.col("known").isNull(), "inserted").when(F.col("record_fingerprint") == F.col("new_print"), "duplicate_historical").otherwise("updated")
    met = met.withColumn("status", status)
    change = F.col("status").isin("inserted", "updated")
    snapshot = met.select(
        "business_key", F.when(change, F.col("new_print")).otherwise(F.col("record_fingerprint")).alias("record_fingerprint"), F.when(change, F.col("new_payload")).otherwise(F.col("payload")).alias("payload"),
        (F.coalesce("times_seen", F.lit(0)) + F.when(F.col("status").isNotNull(), 1).otherwise(0)).alias("times_seen"), F.coalesce("first_upload", F.lit(upload_id)).alias("first_upload"), F.when(F.col("status").isNotNull(), F.lit(upload_id)).otherwise(F.col("last_upload")).alias("last_upload"),
    )
    return snapshot, met.filter("status is not null").select(F.lit(upload_id).alias("upload_id"), "business_key", "status")


def merge_counts(events: DataFrame) -> DataFrame:
    return events.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("inserted", "inserted"), ("updated", "updated"), ("duplicate_historical", "duplicates"))))


@dataclass
class RecordStore:
    """Snapshots of records, uploads, issues and events under one folder; a merge writes a new snapshot, then points to it."""

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def table(self, name: str, schema: str) -> DataFrame:
        folder = "/".join([self.root, name])
        if not self._fs().exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet("/".join([self.root, name]))

    def current(self) -> DataFrame:
        pointers = self.table("pointers", "snapshot string, at timestamp")
        last = pointers.orderBy(F.desc("at"), F.desc("snapshot")).limit(1).collect()
        return self.spark.read.parquet("/".join([self.root, "records", last[0]["snapshot"]])) if last else self.spark.createDataFrame([], RECORDS)

    def seen(self, context: str, file_hash: str) -> bool:
        """Whether a completed upload of the context had this file."""
        return not self.table("uploads", UPLOADS).filter((F.col("context") == context) & (F.col("file_hash") == file_hash) & (F.col("status") == "completed")).isEmpty()

    def upload(self, batch: DataFrame, context: str, file_hash: str, issues: list[tuple] | None = None, upload_id: str | None = None) -> str:
        """Merges one file's rows and returns the status: completed, duplicate_upload (the same file again, which changes
        nothing) or failed.

        The attempt is written as processing before anything else. What goes wrong while it is merged leaves it failed,
        with an issue, and the records as they were: the pointer to the new snapshot is the last step.
        """
        upload_id = upload_id or uuid.uuid4().hex
        if self.seen(context, file_hash):
            self._log(upload_id, context, file_hash, "duplicate_upload", 0, 0, 0, 0)
            return "duplicate_upload"
        self._log(upload_id, context, file_hash, "processing", 0, 0, 0, 0)
        if issues:
            self._issue(*((upload_id, *i) for i in issues))
        try:
            snapshot, events = merge(self.current(), batch, upload_id)
            snapshot.write.parquet("/".join([self.root, "records", upload_id]))
            events.write.parquet("/".join([self.root, "pending", upload_id]))
            told = self.spark.read.schema(EVENTS).parquet("/".join([self.root, "pending", upload_id]))
            c = merge_counts(told).first()
            self._append("events", told)
            self._append("pointers", self.spark.createDataFrame([(upload_id,)], "snapshot string").withColumn("at", F.current_timestamp()))
        except Exception as e:  # whatever the batch's plan or the folder raise
            self._issue((upload_id, "ERROR", "storage_error", str(e).split("\n")[0][:500], None))
            self._log(upload_id, context, file_hash, "failed", 0, 0, 0, 0)
            return "failed"
        self._log(upload_id, context, file_hash, "completed", sum(c), *c)
        return "completed"

    def _issue(self, *rows: tuple) -> None:
        self._append("issues", self.spark.createDataFrame(list(rows), ISSUES))

    def _log(self, upload_id, context, file_hash, status, *counts) -> None:
        row = self.spark.createDataFrame([(upload_id, context, file_hash, status, *counts)], "upload_id string, context string, file_hash string, status string, rows long, inserted long, updated long, duplicates long")
        self._append("uploads", row.withColumn("at", F.current_timestamp()))

    def states(self) -> DataFrame:
        """The last state of each attempt."""
        w = Window.partitionBy("upload_id").orderBy(F.desc("at"), F.when(F.col("status") == "processing", 1).otherwise(0))
        return self.table("uploads", UPLOADS).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    def uploads(self, n: int = 10, context: str | None = None) -> DataFrame:
        """The newest attempts, of a context or of all, each in its last state."""
        last = self.states()
        return (last if context is None else last.filter(F.col("context") == context)).orderBy(F.desc("at"), "upload_id").limit(n)

    def issues(self, upload_id: str | None = None) -> DataFrame:
        """What was noted on an attempt, or on all."""
        told = self.table("issues", ISSUES)
        return told if upload_id is None else told.filter(F.col("upload_id") == upload_id)

    def recover(self) -> int:
        """Marks attempts that stopped while processing as failed, with an issue each; to be called when a store is opened
        and nothing writes to it. Returns how many there were."""
        left = self.states().filter("status = 'processing'").select("upload_id", "context", "file_hash").collect()
        for r in left:
            self._issue((r.upload_id, "ERROR", "interrupted_upload", "the upload stopped before it was complete", None))
            self._log(r.upload_id, r.context, r.file_hash, "failed", 0, 0, 0, 0)
        return len(left)


@dataclass
class ResultCache:
    """Results of costly queries as Parquet under one folder, found by their inputs; the least recently used go first.

    An entry is a folder named by its key; it counts from the moment it is renamed to that name, so a stopped writer leaves
    none. most_bytes: what all entries may take together.
    """

    spark: SparkSession
    root: str
    most_bytes: int = 10 << 30

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def key(self, namespace: str, source: DataFrame | str, **params) -> str:
        """The name of a result: of a source's plan and files (with sizes and times, so that changed files are another
        source), or of a signature that the caller keeps, such as a snapshot's id; and of the parameters."""
        if isinstance(source, str):
            return signature(namespace, source, params)
        stats = [self._path_of(f) for f in sorted(source.inputFiles())]
        return signature(namespace, source.semanticHash(), stats, params)

    def _path_of(self, file: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        s = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
        return (file, s.getLen(), s.getModificationTime())

    def get(self, key: str) -> DataFrame | None:
        """The result of that name, which then counts as used, or None."""
        if not self._fs().exists(self._path(f"{key}/_SUCCESS")):
            return None
        self._touch(key)
        return self.spark.read.parquet(f"{self.root}/{key}")

    def _touch(self, key: str) -> None:
        self._fs().create(self._path(f"{key}/_used"), True).close()

    def put(self, key: str, df: DataFrame) -> DataFrame:
        """Writes a result under its name and returns it as written; older entries make room. One that is there stays."""
        beside = f"_{key}.{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{beside}")
        if not self._fs().rename(self._path(beside), self._path(key)):
            self._fs().delete(self._path(beside), True)
        self._touch(key)
        self.evict(keep=key)
        return self.spark.read.parquet(f"{self.root}/{key}")

    def through(self, key: str, make) -> tuple[DataFrame, bool]:
        """The result of that name, made where it is missing, and whether it was there."""
        known = self.get(key)
        return (known, True) if known is not None else (self.put(key, make()), False)

    def entries(self) -> list[tuple[str, int, int]]:
        """Name, bytes and time of last use of each entry, the least recently used first."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        out = []
        for s in fs.listStatus(self._path()):
            name = s.getPath().getName()
            if not name.startswith("_") and fs.exists(self._path(f"{name}/_used")):
                out.append((name, fs.getContentSummary(s.getPath()).getLength(), fs.getFileStatus(self._path(f"{name}/_used")).getModificationTime()))
        return sorted(out, key=lambda e: (e[2], e[0]))

    def evict(self, keep: str | None = None) -> list[str]:
        """Removes the least recently used entries until the rest fit; `keep` stays whatever its size."""
        known = self.entries()
        total, gone = sum(e[1] for e in known), []
        for name, size, _ in known:
            if total <= self.most_bytes:
                break
            if name != keep:
                self._fs().delete(self._path(name), True)
                gone.append(name)
                total -= size
        return gone


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows of one page in an order, at most 500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(500, limit)))


def serialise(df: DataFrame) -> DataFrame:
    """Each row as a JSON object: times to the second, missing values as null."""
    fields = [F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def write_json(path: str, value) -> None:
    """A small JSON file in one step: written beside, then renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str)
    os.replace(beside, path)


def artifacts(root: str, dataset_id: str, version: str, context: str, kpis: dict, packs: dict[str, dict]) -> str:
    """The folder of a run: KPIs, insight packs and a manifest of them."""
    folder = os.path.join(root, dataset_id, version, context)
    write_json(os.path.join(folder, "kpis.json"), kpis)
    for name, pack in packs.items():
        write_json(os.path.join(folder, "insights", f"{name}__pack.json"), pack)
        with open(os.path.join(folder, "insights", f"{name}__pack.md"), "w", encoding="utf-8") as f:
            f.write(pack_markdown(pack))
    write_json(os.path.join(folder, "manifest.json"), {"dataset_id": dataset_id, "version": version, "context": context, "kpis": "kpis.json", "insights": sorted(packs)})
    return folder


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any folder that Spark writes to, in one step: written beside, then renamed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't write {path}")


def artifact_tree(spark: SparkSession, root: str, dataset_id: str, version: str, context: str, kpis: dict, packs: dict[str, dict]) -> str:
    """artifacts() in a folder that all nodes share; returns it."""
    folder = "/".join([root.rstrip("/"), dataset_id, version, context])
    said = lambda value: json.dumps(value, ensure_ascii=False, indent=1, default=str)
    put_text(spark, f"{folder}/kpis.json", said(kpis))
    for name, pack in packs.items():
        put_text(spark, f"{folder}/insights/{name}__pack.json", said(pack))
        put_text(spark, f"{folder}/insights/{name}__pack.md", pack_markdown(pack))
    put_text(spark, f"{folder}/manifest.json", said({"dataset_id": dataset_id, "version": version, "context": context, "kpis": "kpis.json", "insights": sorted(packs)}))
    return folder


def pack_table(df: DataFrame, dimension: str, context: dict, score: str = "score", comment: str = "comment", verbatims: int = 10) -> DataFrame:
    """The figures and first comments of every value of a dimension in one pass: value, id, n, mean and verbatims. The id
    depends on the context and the value only."""
    name = json.dumps(context, sort_keys=True, ensure_ascii=False)
    per = df.filter(F.col(dimension).isNotNull()).groupBy(F.col(dimension).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    w = Window.partitionBy("value").orderBy("said")
    said = df.filter(F.col(comment).isNotNull()).select(F.col(dimension).cast("string").alias("value"), F.col(comment).alias("said")).distinct()
    first = said.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= verbatims).groupBy("value").agg(F.array_sort(F.collect_list("said")).alias("verbatims"))
    return per.join(first, "value", "left").withColumn("id", F.substring(F.sha1(F.concat_ws("|", F.lit(name), F.lit(dimension), "value")), 1, 12))


def insight_pack(df: DataFrame, title: str, context: dict, score: str = "score", comment: str = "comment", verbatims: int = 10) -> dict:
    """Figures and first comments of a slice, under a stable id."""
    from marea.operators.kpis import score_kpis

    k = score_kpis(df, score).first().asDict()
    texts = [r[0] for r in df.filter(F.col(comment).isNotNull()).select(comment).limit(verbatims).collect()]
    return {"id": signature(context, title), "title": title, "context": context, "evidence": k, "verbatims": texts}


def pack_markdown(pack: dict) -> str:
    lines = [f"# {pack['title']}", "", *(f"- {k}: {v}" for k, v in pack["context"].items()), "", *(f"- {k}: {v}" for k, v in pack["evidence"].items()), "", *(f"> {v}" for v in pack["verbatims"])]
    return "\n".join(lines) + "\n"


def signature(*parts) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def learning_log(spark: SparkSession, path: str) -> DataFrame:
    """What was confirmed and rejected, a JSON line each; bad lines are skipped."""
    return spark.read.schema("ts string, service_origin string, service_origin_n1 string, service_origin_n2 string, topic string, outcome string, note string").option("mode", "DROPMALFORMED").json(path)


def learn(spark: SparkSession, path: str, **entry: str) -> None:
    row = {"ts": "", "service_origin": "", "service_origin_n1": "", "service_origin_n2": "", "topic": "", "outcome": "", "note": ""} | entry
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row)).withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A keyed cache with rows added or replaced."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
