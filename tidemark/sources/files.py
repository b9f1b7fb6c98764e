"""Typed readers and immutable writers."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KLINE_CSV = "open_time, open, high, low, close, volume, close_time, quote_volume, count, taker_buy_volume, taker_buy_quote_volume, ignore"


def read_parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Files with columns united by name."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_bar_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Archive bars, with or without a header line in each file; strict casts raise on bad values. A row is a header if
    it names all columns in their order; other names and rows of another number of fields are an error."""
    names = [c.strip() for c in KLINE_CSV.split(",")]
    raw = spark.read.text(path).where(F.lower(F.regexp_replace("value", r"\s+", "")) != ",".join(names)).select(F.split(F.rtrim("value"), ",").alias("x"))
    whole = F.when(F.size("x") == len(names), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("a bar has 12 fields, not "), F.size("x").cast("string"))))
    raw = raw.select(whole.alias("x")).select(*[F.trim(F.get("x", F.lit(i))).alias(c) for i, c in enumerate(names)])
    number = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")]
    return raw.select(F.lit(symbol).alias("symbol"), F.col("open_time").cast("long").alias("t"), F.col("close_time").cast("long").alias("close_t"), *number, F.col("count").cast("long").alias("trades"))


def bounded(df: DataFrame, symbols: list[str], start: int, end: int, t: str = "t", **equal) -> DataFrame:
    """Rows of the symbols with start <= t <= end and the given equal values: all reach the Parquet scan as filters."""
    out = df.where(F.col("symbol").isin(symbols) & F.col(t).between(start, end))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def stream_views(spark: SparkSession, paths: dict[str, list[str]], prefix: str = "") -> list[str]:
    """A temporary view a stream over its files, by column name; a stream without files loses its view."""
    made = []
    for name, files in paths.items():
        if files:
            read_parquet_union(spark, *files).createOrReplaceTempView(prefix + name)
            made.append(prefix + name)
        else:
            spark.catalog.dropTempView(prefix + name)
    return made


def describe(spark: SparkSession, path: str) -> dict:
    """Schema and number of rows of a Parquet path, from the footers alone."""
    df = spark.read.parquet(path)
    return {"schema": json.loads(df.schema.json()), "n_rows": df.count()}


def write_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """A small file written whole under a temporary name and renamed: True if written, False if the same is there; other
    content is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        stream = fs.open(final)
        try:
            same = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == content
        finally:
            stream.close()
        if not same:
            raise ValueError(f"{path} holds something else")
        return False
    out = fs.create(temp)
    out.write(bytearray(content))
    out.close()
    if not fs.rename(temp, final):
        fs.delete(temp, False)
        raise OSError(f"could not write {path}")
    return True


def persist_dataset(df: DataFrame, path: str, facts: dict) -> dict:
    """Rows under path/data and, written last, path/manifest.json: schema, digest, number of rows and the given facts.
    A dataset without a manifest is unfinished."""
    write_immutable(df, f"{path}/data")
    from ..operators.aggregates import content_digest

    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/data")
    d = content_digest(stored).first()
    manifest = {"schema": json.loads(stored.schema.json()), "n_rows": d.n_rows, "digest": d.digest, **facts}
    write_once(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def extract_archives(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """Lines of zip archives of one flat CSV each: archive, line, and for a refused archive its fault (no line); see
    archives.ArchiveSource, which also checks fields."""
    from .archives import read_archives

    return read_archives(spark, path, 0, (), most_bytes).select("archive", "line", "fault")


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """Wire messages {"stream": "sym@kind", "data": {...}} as typed rows; what fails a rule is kept with its reason."""
    j = raw.withColumn("m", F.from_json(value, "stream string, data struct<E:bigint,s:string,p:string>"))
    parts = F.split("m.stream", "@")
    symbol, price = F.upper(F.get(parts, F.lit(0))), F.col("m.data.p").try_cast("decimal(38,18)")
    reason = (
        F.when(F.col("m").isNull() | F.col("m.stream").isNull() | F.col("m.data").isNull(), "not a message")
        .when(symbol != F.coalesce(F.col("m.data.s"), F.lit("")), "symbol").when(F.col("m.data.E").isNull(), "time").when(price.isNull(), "price")
    )
    return j.select(F.sha2(F.concat_ws("\x1f", "m.stream", value), 256).alias("event_id"), symbol.alias("symbol"), F.get(parts, F.lit(1)).alias("kind"), F.col("m.data.E").alias("t"), price.cast("double").alias("price"), F.col("m.data.p").alias("price_str"), reason.alias("reject_reason"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, in that of spark.checkpoint.dir; where the setting is unset, in local mode, a
    temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, for plans that use it several times: cuts the lineage and
    survives lost executors."""
    path = shared_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_immutable(df: DataFrame, path: str) -> bool:
    """Write once: True if written, False if the same rows are there already; other rows there are an error.

    Rows go to a temporary folder that is renamed when whole, so what is at the path is complete; of two writers one
    wins the rename, and the other compares."""
    from ..operators.aggregates import content_digest

    spark = df.sparkSession
    p, temp = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        df.write.parquet(temp.toString())
        fs.mkdirs(p.getParent())
        if not fs.exists(p) and fs.rename(temp, p):
            return True
        fs.delete(temp, True)
    if content_digest(spark.read.parquet(path)).first() != content_digest(df).first():
        raise ValueError(f"{path} holds other rows")
    return False
