"""Size-tiered compaction of immutable Parquet shards under a versioned manifest. DataFrame operations only.

An append writes its rows as a run (a folder of small shards) and commits a manifest version that lists it. Compaction
groups runs into tiers by size (powers of ``fanout`` over ``base_bytes``); a tier with ``fanout`` runs or more is
merged into one run of about target-sized files, until no tier is full. A run that stays alone in its tier is rewritten
too if its files are less than half of the target on average and fewer would do. A version is one JSON file, written under a
temporary name and renamed; the rename fails if the version exists, so of two writers one wins and the other retries.
Readers see the runs of one version only; replaced runs stay until vacuum(), which deletes what an older version listed and
the newest does not, and leaves runs that no version lists, which another writer may be about to commit, until they are
older than ``orphan_hours``. A commit fails if its run has gone. A merge moves no rows between executors:
its tasks read neighbouring shards and write one file each. The manifest has one entry a run.

Nulls in any column, empty and long texts, repeated rows and extra columns are kept as they are. Appending no rows,
as one arrival or as batches, commits a run without rows. Shards of different appends may differ in columns; missing ones read as null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "__arrival"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target_bytes, self.fanout, self.base_bytes = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "runs": [{"run", "files", "bytes", "schema"}]}; version 0 is empty."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        stream = self.fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change, made: list[dict], attempts: int = 20) -> dict:
        """Apply change(runs) -> runs to the newest version and commit the next; retried if another writer came first.
        The runs ``made`` for it must be there."""
        for _ in range(attempts):
            lost = [e["run"] for e in made if not self.fs.exists(self._path(f"data/{e['run']}"))]
            if lost:
                raise RuntimeError(f"runs went before their commit: {lost}")
            old = self.manifest()
            new = {"version": old["version"] + 1, "runs": change(old["runs"])}
            temp, final = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/v{new['version']:08d}.json")
            out = self.fs.create(temp)
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
            out.close()
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(temp, final, none)
                return new
            except Exception:  # py4j wraps FileAlreadyExistsException
                self.fs.delete(temp, False)
                if not self.fs.exists(final):
                    raise
        raise RuntimeError("other writers kept committing first")

    def _entry(self, run: str, schema: StructType) -> dict:
        files = [s for s in self.fs.listStatus(self._path(f"data/{run}")) if s.getPath().getName().endswith(".parquet")]
        return {"run": run, "files": len(files), "bytes": sum(s.getLen() for s in files), "schema": json.loads(schema.json())}

    def append(self, rows: DataFrame) -> dict:
        """One arrival: its shards become one run."""
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/data/{run}")
        entry = self._entry(run, rows.schema)
        return self._commit(lambda runs: [*runs, entry], [entry])

    def append_batches(self, rows: DataFrame, batch) -> dict:
        """Many arrivals in one pass over rows: one run for each value of the column ``batch``, one commit."""
        group = f"batch-{uuid.uuid4().hex}"
        rows.withColumn(BATCH, F.coalesce(F.concat(F.lit("b"), batch.cast("string")), F.lit("none"))).write.partitionBy(BATCH).parquet(f"{self.root}/data/{group}")
        folders = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"data/{group}")) if s.isDirectory()]
        entries = [self._entry(f"{group}/{f}", rows.schema) for f in sorted(folders)] or [self._entry(group, rows.schema)]
        return self._commit(lambda runs: [*runs, *entries], entries)

    def _tier(self, entry: dict) -> int:
        tier, size = 0, self.base_bytes
        while entry["bytes"] > size:
            tier, size = tier + 1, size * self.fanout
        return tier

    def _read(self, entries: list[dict]) -> DataFrame:
        """Rows of runs; runs of one schema are one scan."""
        by_schema: dict[str, list[dict]] = {}
        for e in entries:
            by_schema.setdefault(json.dumps(e["schema"]), []).append(e)
        parts = [self.spark.read.schema(StructType.fromJson(json.loads(s))).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/data/{e['run']}" for e in es]) for s, es in by_schema.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _files(self, entries: list[dict]) -> int:
        return max(1, -(-sum(e["bytes"] for e in entries) // self.target_bytes))

    def _loose(self, entry: dict) -> bool:
        return entry["files"] > self._files([entry]) and 2 * entry["bytes"] < entry["files"] * self.target_bytes

    def compact(self) -> dict:
        """Merge full tiers, then the small files of single runs, until there is neither. Each merge is one commit."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for e in self.manifest()["runs"]:
                tiers.setdefault(self._tier(e), []).append(e)
            full = next((es for t, es in sorted(tiers.items()) if len(es) >= self.fanout), None)
            full = full or next(([e] for _, es in sorted(tiers.items()) for e in es if self._loose(e)), None)
            if full is None:
                return self.manifest()
            run, rows = f"run-{uuid.uuid4().hex}", self._read(full)
            rows.coalesce(self._files(full)).write.parquet(f"{self.root}/data/{run}")
            made, gone = self._entry(run, rows.schema), {e["run"] for e in full}

            def change(runs: list[dict], made=made, gone=gone) -> list[dict]:
                if not gone <= {e["run"] for e in runs}:
                    raise RuntimeError("another writer merged these runs")
                return [*(e for e in runs if e["run"] not in gone), made]

            self._commit(change, [made])

    def read(self, version: int | None = None) -> DataFrame:
        runs = self.manifest(version)["runs"]
        if not runs:
            raise ValueError("nothing was appended")
        return self._read(runs)

    def vacuum(self, orphan_hours: float = 168.0) -> None:
        """Delete runs that an older version lists and the newest does not, runs that no version lists and that nobody
        has written to for ``orphan_hours``, and the older versions."""
        now = self.manifest()
        older = [v for v in self.versions() if v < now["version"]]
        live = {e["run"] for e in now["runs"]}
        retired = {e["run"] for v in older for e in self.manifest(v)["runs"]} - live
        for run in sorted(retired):
            self.fs.delete(self._path(f"data/{run}"), True)
        oldest = self.jvm.System.currentTimeMillis() - int(orphan_hours * 3_600_000)
        for top in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else ():
            name = top.getPath().getName()
            inner = [s for s in self.fs.listStatus(top.getPath()) if s.isDirectory()]
            used = name in live or any(f"{name}/{s.getPath().getName()}" in live for s in inner)
            if not used and max([top.getModificationTime(), *(s.getModificationTime() for s in inner)]) < oldest:
                self.fs.delete(top.getPath(), True)
        for v in older:
            self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
