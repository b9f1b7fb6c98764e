"""A store for micro-batches: row-bounded files by key, date and hour, a log that commits them with their checkpoints, and
recovery of what a crash or a bad disk leaves.

A batch is written whole to data/batch=N and then committed: one log table a batch, written aside and renamed, with a row
a file: its place, size, SHA-256, rows, times and last event. What no log lists is no part of the store. The checkpoint
of a key is the last event of its committed files, so files and checkpoints cannot disagree. A batch that is replayed is
skipped if its log is there and overwritten if it is not.

Files of one key are split by the counts of the batch, so a key with most of its rows is written by many tasks, and no
file has more than ``max_rows``. Nothing of a batch goes through the driver but the places of files to be moved."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructType

from ..operators.windows import same
from ..sources.files import staged

LOG = "path string, batch long, bytes long, sha256 string, n_rows long, first_ts timestamp, last_ts timestamp, last_id string, state string, reason string, at long"


class MicroBatchStore:
    """schema: of the rows; keys: its partitioning columns, before date and (``hourly``) hour; t: its event time; ident: its identifier,
    which no row lacks."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...] = ("event_type", "symbol"), t: str = "ts", ident: str = "event_id", max_rows: int = 1_000_000, hourly: bool = True):
        self.spark, self.path, self.keys, self.t, self.ident, self.max_rows = spark, path.rstrip("/"), keys, t, ident, max_rows
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.columns = schema.fieldNames()
        self.layout = [*keys, "date", "hour"] if hourly else [*keys, "date"]
        whole = StructType(list(schema)).add("date", DateType()).add("hour", IntegerType())
        # Columns of folders last, as they are read.
        self.schema = StructType([f for f in schema if f.name not in self.layout] + [whole[c] for c in self.layout])

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        p = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _move(self, name: str, to: str) -> None:
        final = self._at(f"quarantine/{to}-{uuid.uuid4().hex}")
        self.fs.mkdirs(final.getParent())
        if not self.fs.rename(self._at(name), final):
            raise OSError(f"could not move {name}")

    def batches(self) -> tuple[list[int], list[int], list[int]]:
        """Numbers of the batches that are committed; written, but not committed; half written."""
        logged = {int(n[6:]) for n in self._names("log") if n.startswith("batch=") and not n.endswith(".tmp")}
        there = [int(n[6:]) for n in self._names("data") if n.startswith("batch=")]
        ended = {n for n in there if self.fs.exists(self._at(f"data/batch={n}/_SUCCESS"))}
        return sorted(logged), sorted(ended - logged), sorted(set(there) - ended - logged)

    def _log(self, entries: DataFrame, name: str) -> None:
        temp = f"log/{name}.{uuid.uuid4().hex}.tmp"
        entries.write.parquet(f"{self.path}/{temp}")
        if self.fs.exists(self._at(f"log/{name}")) or not self.fs.rename(self._at(temp), self._at(f"log/{name}")):
            self.fs.delete(self._at(temp), True)
            raise RuntimeError(f"{name} was committed by another writer")

    def write(self, batch: DataFrame, number: int) -> bool:
        """Write and commit a batch; False if it was committed before."""
        if number in self.batches()[0]:
            return False
        rows = batch.withColumn("date", F.to_date(self.t)).withColumn("hour", F.hour(self.t)).select(*self.schema.fieldNames()).persist()
        try:
            counts = rows.groupBy(*self.layout).agg(F.ceil(F.count("*") / self.max_rows).alias("__parts"))
            cut = rows.alias("l").join(counts.alias("r"), same("l", "r", self.layout)).select("l.*", F.pmod(F.xxhash64(F.col(f"l.{self.ident}")), "__parts").alias("__part"))
            cut = cut.repartition(*self.layout, "__part").sortWithinPartitions(*self.layout, "__part", self.t, self.ident).drop("__part")
            cut.write.option("maxRecordsPerFile", self.max_rows).mode("overwrite").partitionBy(*self.layout).parquet(f"{self.path}/data/batch={number}")
        finally:
            rows.unpersist()
        self.commit(number)
        return True

    def commit(self, number: int) -> None:
        self._log(self.inspected([f"data/batch={number}"], number), f"batch={number}")

    def _place(self) -> Column:
        return F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), "/data/", -1))

    def _files(self, folders: list[str]) -> DataFrame:
        """The files there, with their bytes; content is read only where it is asked for."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{self.path}/{f}" for f in folders])
        return found.withColumn("path", self._place())

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in folders])

    def inspected(self, folders: list[str], number: int | None) -> DataFrame:
        """Log rows of all files there: valid, or quarantined with the reason (unreadable, or rows without what they need)."""
        data = self._rows(folders).withColumn("__path", self._place())
        lacks = F.col(self.ident).isNull() | F.col(self.t).isNull()
        last = F.max(F.struct(self.t, F.col(self.ident).alias("__id")))
        stats = data.groupBy("__path").agg(F.count("*").alias("n_rows"), F.min(self.t).cast("timestamp").alias("first_ts"), F.max(self.t).cast("timestamp").alias("last_ts"), last["__id"].cast("string").alias("last_id"), F.count_if(lacks).alias("__lacks"))
        files = self._files(folders)
        stats = _tolerant(files.select("path", F.sha2("content", 256).alias("sha256")).join(stats, F.col("path") == F.col("__path")).withColumnRenamed("path", "__read"))
        reason = F.when(F.col("__read").isNull(), "unreadable").when(F.col("__lacks") > 0, "rows without an identifier or a time")
        out = files.select("path", F.col("length").alias("bytes")).join(stats, F.col("path") == F.col("__read"), "left")
        batch = F.regexp_extract("path", r"^data/batch=(\d+)/", 1).cast("long")
        state = F.when(reason.isNull(), "valid").otherwise("quarantined")
        return out.select("path", batch.alias("batch"), "bytes", "sha256", "n_rows", "first_ts", "last_ts", "last_id", state.alias("state"), reason.alias("reason"), F.lit(time.time_ns() // 1000).alias("at"))

    def log(self) -> DataFrame:
        """The newest log row of each file."""
        names = [n for n in self._names("log") if not n.endswith(".tmp")]
        if not names:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/{n}" for n in names])
        rest = [c for c in rows.columns if c != "path"]
        return rows.groupBy("path").agg(F.max_by(F.struct(*rest), "at").alias("x")).select("path", "x.*")

    def read(self) -> DataFrame:
        """Rows of the committed batches."""
        done = self.batches()[0]
        folders = [f"data/batch={n}" for n in done if self.fs.exists(self._at(f"data/batch={n}"))]
        if not folders:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        return self._rows(folders).select(*self.columns)

    def checkpoints(self) -> DataFrame:
        """Per key: files, rows, and the last event of its valid files."""
        part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1)
        rows = self.log().where("state = 'valid'")
        names = [F.when(part(k) != "__HIVE_DEFAULT_PARTITION__", F.url_decode(part(k))).alias(k) for k in self.keys]
        last = F.max(F.struct("last_ts", F.col("last_id"), "batch", "path"))
        return rows.groupBy(*names).agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), last.alias("x")).select(*self.keys, "files", "n_rows", F.col("x.last_ts").alias("last_ts"), F.col("x.last_id").alias("last_id"), F.col("x.batch").alias("batch"), F.col("x.path").alias("path"))

    def recover(self) -> dict[str, int]:
        """Set the store right after a crash, while nothing writes to it.

        Half-written batches and logs are moved to quarantine (a stream writes such a batch again); batches that are
        whole but not committed are committed; of committed ones, files that no longer are what the log says, and
        unreadable ones, are moved to quarantine and logged so, and whole files that no log lists are adopted."""
        found = {"half_written": 0, "adopted_batches": 0, "adopted_files": 0, "quarantined_files": 0, "missing_files": 0}
        for n in self._names("log"):
            if n.endswith(".tmp"):
                self._move(f"log/{n}", "log")
        _, ended, half = self.batches()
        for n in half:
            self._move(f"data/batch={n}", f"batch-{n}")
            found["half_written"] += 1
        for n in ended:
            self.commit(n)
            found["adopted_batches"] += 1
        folders = [f"data/batch={n}" for n in self.batches()[0] if self.fs.exists(self._at(f"data/batch={n}"))]
        if not folders:
            return found
        said = self.log().select("path", F.col("sha256").alias("__said"), F.col("state").alias("__state"))
        now = self.inspected(folders, None)
        both = now.join(said, "path", "full")
        there, listed = F.col("bytes").isNotNull(), F.col("__state").isNotNull()
        changed = F.coalesce(F.col("__said") != F.col("sha256"), F.lit(False))
        gone = ~there & (F.col("__state") == "valid")
        new = there & ~listed
        bad = there & ((F.col("state") != "valid") | changed)
        at = F.lit(time.time_ns() // 1000)
        fixes = both.where(gone | new | bad).select(
            "path", "batch", "bytes", F.coalesce("sha256", "__said").alias("sha256"), "n_rows", "first_ts", "last_ts", "last_id",
            F.when(gone, "missing").when(bad, "quarantined").otherwise("valid").alias("state"), F.when(gone, "missing").when(changed, "changed").otherwise(F.col("reason")).alias("reason"), at.alias("at"),
        )
        name = f"fix-{uuid.uuid4().hex}"
        self._log(fixes, name)
        for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log/{name}").toLocalIterator():
            kind = {"missing": "missing_files", "quarantined": "quarantined_files", "valid": "adopted_files"}[r.state]
            found[kind] += 1
            if r.state == "quarantined":
                self._move(r.path, "file")
        return found

    def start(self, stream: DataFrame, checkpoint: str, seconds: int = 30, once: bool = False):
        """Write a stream: a batch when the last is done and ``seconds`` are over; see admission() for a bound by rows."""
        w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.write(batch, number) and None)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def _tolerant(df: DataFrame) -> DataFrame:
    """df, evaluated with files that cannot be read left out, as a written table of a row a file."""
    spark, key = df.sparkSession, "spark.sql.files.ignoreCorruptFiles"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return staged(df)
    finally:
        spark.conf.set(key, before)


def admission(source: str, rows: int, seconds: int = 30) -> dict[str, str]:
    """Options with which a source ends a micro-batch by rows or seconds, whichever comes first."""
    if source == "kafka":
        return {"maxOffsetsPerTrigger": str(rows), "minOffsetsPerTrigger": str(rows), "maxTriggerDelay": f"{seconds}s"}
    if source in ("rate-micro-batch", "rate"):
        return {"rowsPerBatch" if source == "rate-micro-batch" else "rowsPerSecond": str(rows if source == "rate-micro-batch" else max(1, rows // seconds))}
    if source in ("parquet", "json", "csv", "text", "orc"):
        return {"maxFilesPerTrigger": str(max(1, rows // 1_000_000))}  # files of a store have a million rows at most
    raise ValueError(f"{source} has no bound by rows")
