"""Artifact bundles: several tables and a summary that become visible together, or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import content_digest
from .files import write_once

#: The tables of a bundle by how much of a run is kept.
POLICIES = {"summary": (), "full": None}


class InvalidBundle(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str, summary: dict, policy: str = "full", required: dict[str, tuple[str, ...]] | None = None, quarantine: str | None = None) -> dict:
    """Write tables and a summary under path and return the manifest.

    Everything goes to a folder beside it, is read back and checked (each table's digest and rows; the tables and columns
    that ``required`` names), gets its manifest last, and is renamed once. What fails is moved to ``quarantine`` (beside
    the bundle, if not given) with the reason, and is an error. A bundle that is there already stays: the same content
    again is fine, other content an error. Policy "summary" keeps no table, "full" all."""
    kept = {n: df for n, df in tables.items() if POLICIES[policy] is None or n in POLICIES[policy]}
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, staged = _fs(spark, temp)
    said = {}
    try:
        for name, df in kept.items():
            if not name.replace("_", "").isalnum():
                raise InvalidBundle(f"{name} is no name of a table")
            df.write.parquet(f"{temp}/{name}")
            stored = spark.read.schema(df.schema).parquet(f"{temp}/{name}")
            d = content_digest(stored).first()
            said[name] = {"schema": json.loads(stored.schema.json()), "n_rows": d.n_rows, "digest": d.digest}
        if policy == "full":
            for name, columns in (required or {}).items():
                if name not in kept:
                    raise InvalidBundle(f"{name} is missing")
                lost = [c for c in columns if c not in kept[name].columns]
                if lost or not said[name]["n_rows"]:
                    raise InvalidBundle(f"{name} lacks {lost or 'rows'}")
        manifest = {"policy": policy, "tables": said, "summary": summary}
        write_once(spark, f"{temp}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    except Exception as e:
        _put_aside(spark, temp, path, quarantine, str(e))
        raise
    _, final = _fs(spark, path)
    if not fs.exists(final):
        fs.mkdirs(final.getParent())
        if fs.rename(staged, final):
            return manifest
    fs.delete(staged, True)
    there = json.loads(_text(spark, f"{path}/manifest.json"))
    if there != json.loads(json.dumps(manifest)):
        raise InvalidBundle(f"{path} holds another bundle")
    return there


def _put_aside(spark: SparkSession, temp: str, path: str, quarantine: str | None, reason: str) -> None:
    fs, staged = _fs(spark, temp)
    if not fs.exists(staged):
        return
    to = f"{quarantine or path.rsplit('/', 1)[0] + '/quarantine'}/{uuid.uuid4().hex}"
    _, final = _fs(spark, to)
    fs.mkdirs(final.getParent())
    if fs.rename(staged, final):
        write_once(spark, f"{to}/reason.txt", reason.encode())


def bundle_faults(spark: SparkSession, path: str) -> list[str]:
    """What in a bundle is not what its manifest says; nothing, for a sound one. One aggregation a table."""
    fs, p = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        return ["no manifest"]
    try:
        said = json.loads(_text(spark, f"{path}/manifest.json"))["tables"]
    except (ValueError, KeyError):
        return ["the manifest cannot be read"]
    _, top = _fs(spark, path)
    there = {s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()}
    out = [f"{n}: not in the manifest" for n in sorted(there - set(said))]
    for name, facts in sorted(said.items()):
        if name not in there:
            out.append(f"{name}: missing")
            continue
        try:
            stored = spark.read.parquet(f"{path}/{name}")
            d = content_digest(stored).first()
        except Exception as e:
            out.append(f"{name}: cannot be read ({type(e).__name__})")
            continue
        if (d.n_rows, d.digest) != (facts["n_rows"], facts["digest"]):
            out.append(f"{name}: other rows")
    return out


def quarantine_bundle(spark: SparkSession, path: str, quarantine: str | None = None) -> list[str]:
    """Move a bundle that has faults out of the way, with them; returns them."""
    faults = bundle_faults(spark, path)
    if faults:
        _put_aside(spark, path, path, quarantine, "\n".join(faults))
    return faults
