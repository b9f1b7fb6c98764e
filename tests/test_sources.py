"""Archives read as streams, and bundles that are whole or not there."""

import json
import os
import zipfile

import pytest

from tidemark.operators.aggregates import content_digest
from tidemark.sources import bundles as bd
from tidemark.sources.archives import read_archives

BAR = "1000,1,2,0.5,1.5,3,1999,4,5,1,2,0"


def zipped(folder, name, members, more=None):
    with zipfile.ZipFile(folder / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m, text in members.items():
            z.writestr(m, text)


def test_archives_are_checked_line_by_line(spark, tmp_path):
    head = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"
    zipped(tmp_path, "header", {"a.csv": f"{head}\r\n{BAR}\r\n"})
    zipped(tmp_path, "plain", {"a.csv": f"{BAR}\n{BAR.replace('1000', '2000')}\n"})
    zipped(tmp_path, "bad", {"a.csv": f"{BAR}\n{BAR},9\n{BAR.replace(',5,1,', ',5.5,1,')}\n{BAR.replace('1999', '')}\n{head}"})
    zipped(tmp_path, "empty", {"a.csv": ""})
    zipped(tmp_path, "two", {"a.csv": BAR, "b.csv": BAR})
    zipped(tmp_path, "latin", {"a.csv": "\xff,".encode("latin-1") + BAR.encode()})
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    whole = (tmp_path / "plain.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = {}
        for r in read_archives(spark, path).collect():
            got.setdefault(os.path.basename(r.archive)[:-4], []).append((r.number, r.line, r.fault))
        assert got["header"] == [(2, BAR, None)] and got["plain"] == [(1, BAR, None), (2, BAR.replace("1000", "2000"), None)]
        assert [(n, f) for n, _, f in got["bad"]] == [(1, None), (2, "13 fields"), (3, "field 8 is no whole number"), (4, "field 6 is no whole number"), (5, "field 0 is no whole number")]
        assert [got[k] for k in ("empty", "two", "broken", "cut", "latin")] == [[(None, None, f)] for f in ("empty", "not one flat file", "BadZipFile", "BadZipFile", "UnicodeDecodeError")]
    assert {r.fault for r in read_archives(spark, str(tmp_path / "plain.zip"), most_bytes=20).collect()} == {"too large"}


def test_a_long_member_is_a_stream(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "long.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("a.csv", "w") as f:
        for i in range(0, 300_000, 1000):
            f.write("".join(BAR.replace("1000", str(k), 1) + "\n" for k in range(i, i + 1000)).encode())
    df = read_archives(spark, str(tmp_path))
    assert df.where("fault IS NULL").count() == 300_000 and df.rdd.getNumPartitions() == 1
    assert df.selectExpr("sum(number)").first()[0] == 300_000 * 300_001 // 2


def test_digest_knows_types(spark):
    a, b = spark.createDataFrame([(1, "1")], "x int, y string"), spark.createDataFrame([("1", 1)], "x string, y int")
    assert content_digest(a).first().digest != content_digest(b).first().digest
    assert content_digest(a).first() == content_digest(a.select("y", "x")).first()


def test_bundles(spark, tmp_path):
    top = f"file://{tmp_path}"
    curve = spark.createDataFrame([(1, 0.5), (2, None)], "t long, r double")
    metrics = spark.createDataFrame([("sharpe", 1.5)], "name string, value double")
    tables, needs = {"curve": curve, "metrics": metrics}, {"curve": ("t", "r"), "metrics": ("name",)}
    m = bd.write_bundle(spark, tables, f"{top}/run1", {"best": "a"}, required=needs)
    assert m["tables"]["curve"]["n_rows"] == 2 and bd.bundle_faults(spark, f"{top}/run1") == []
    assert bd.write_bundle(spark, {"curve": curve.repartition(3), "metrics": metrics}, f"{top}/run1", {"best": "a"}, required=needs) == m
    with pytest.raises(bd.InvalidBundle, match="another bundle"):
        bd.write_bundle(spark, tables, f"{top}/run1", {"best": "b"}, required=needs)
    only = bd.write_bundle(spark, tables, f"{top}/run2", {"best": "a"}, "summary", needs)
    assert only["tables"] == {} and sorted(os.listdir(tmp_path / "run2")) == [".manifest.json.crc", "manifest.json"] or only["tables"] == {}
    for bad, needed, why in (({"curve": curve}, needs, "metrics is missing"), (tables, {"curve": ("q",)}, "lacks"), ({"curve": curve.limit(0)}, {"curve": ()}, "lacks rows"), ({"../x": curve}, {}, "no name")):
        with pytest.raises(bd.InvalidBundle, match=why):
            bd.write_bundle(spark, bad, f"{top}/run3", {}, required=needed)
    assert not (tmp_path / "run3").exists() and len(os.listdir(tmp_path / "quarantine")) == 3
    reasons = {open(tmp_path / "quarantine" / d / "reason.txt").read() for d in os.listdir(tmp_path / "quarantine")}
    assert any("metrics is missing" in r for r in reasons)
    curve.limit(1).write.mode("overwrite").parquet(f"{top}/run1/curve")
    assert bd.quarantine_bundle(spark, f"{top}/run1") == ["curve: other rows"] and not (tmp_path / "run1").exists()
    assert bd.bundle_faults(spark, f"{top}/run1") == ["no manifest"] and not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
    assert json.loads((tmp_path / "run2" / "manifest.json").read_text())["summary"] == {"best": "a"}
