"""Archives to canonical bars, their quality, and the operators for snapshots and tagged unions."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import joins as jn
from tidemark.sources import files
from tidemark.sources import normalize as nz
from tidemark.sources.archives import read_archives


def bar(t, close=1.5, count=5):
    return f"{t},1,2,0.5,{close},3,{t + 999},4,{count},1,2,0"


def archive(folder, name, lines):
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        z.writestr(f"{name}.csv", "\n".join(lines) + "\n")


def test_canonical_bars(spark, tmp_path):
    archive(tmp_path, "AUSDT-1s-2024-01", [nz.HEADER, bar(1000), bar(3000), bar(2000), bar(1000, 9.0)])
    archive(tmp_path, "AUSDT-1s-2024-02", [bar(3000, 8.0), bar(4000)])  # without a header; repeats a bar of the archive before
    archive(tmp_path, "BUSDT-1s-2024-01", [nz.HEADER, bar(1000, 7.0)])
    typed = nz.typed_lines(read_archives(spark, str(tmp_path), header=nz.HEADER))
    got = {(r.symbol, r.open_time_ms): r for r in nz.canonical_bars(typed, "1s", 77).collect()}
    assert {k: r.close for k, r in got.items()} == {("AUSDT", 1000): 1.5, ("AUSDT", 2000): 1.5, ("AUSDT", 3000): 1.5, ("AUSDT", 4000): 1.5, ("BUSDT", 1000): 7.0}
    r = got["AUSDT", 1000]
    assert (r.interval, r.close_time_ms, r.trade_count, r.is_closed, r.ingested_at_ns, r.source, r.schema_version) == ("1s", 1999, 5, True, 77, "archive", 1)
    for width in (1, 2, 1 << 16):
        q = {r.archive.split("/")[-1][:16]: (r.source_rows, r.duplicate_rows, r.out_of_order) for r in nz.source_quality(typed, width).collect()}
        assert q == {"AUSDT-1s-2024-01": (4, 1, 2), "AUSDT-1s-2024-02": (2, 0, 0), "BUSDT-1s-2024-01": (1, 0, 0)}
    none = typed.where("false")
    assert nz.canonical_bars(none, "1s", 0).count() == 0 == nz.source_quality(none).count()


@pytest.mark.parametrize("lines, why", [
    (["time,o,h,l,c,v,close,q,n,tb,tq,i", bar(1)], "unexpected header"), ([nz.HEADER.replace("close,", "last,"), bar(1)], "unexpected header"),
    ([bar(1), bar(2) + ",9"], "13 fields"), ([bar(1), bar(2, count="5.5")], "field 8"), ([bar(1), bar(2, close="x")], "CAST_INVALID_INPUT"), ([bar(1), ""], "1 fields"), ([bar(1), nz.HEADER], "field 0"),
])
def test_bad_archives_are_errors(spark, tmp_path, lines, why):
    archive(tmp_path, "AUSDT-1s-2024-01", lines)
    with pytest.raises(Exception, match=why):
        nz.canonical_bars(nz.typed_lines(read_archives(spark, str(tmp_path), header=nz.HEADER)), "1s", 0).collect()


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(nz.HEADER.replace(",", ", ").upper() + "\n" + bar(5) + "\n")
    assert [r.t for r in files.read_bar_csv(spark, str(tmp_path / "a.csv"), "S").collect()] == [5]
    (tmp_path / "b.csv").write_text(nz.HEADER.replace("high,low", "low,high") + "\n" + bar(5) + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_bar_csv(spark, str(tmp_path / "b.csv"), "S").collect()


def test_snapshot_as_of(spark):
    rows = [("a", 1, 10, "x"), ("a", 5, 11, None), ("a", 5, 12, "y"), ("a", 9, 13, "z"), ("b", 7, 1, "w"), ("c", None, 1, "v"), (None, 2, 1, "u")]
    df = spark.createDataFrame(rows, "k string, valid_from long, id long, note string")
    of = lambda t: {(r.k, r.id, r.note) for r in br.snapshot_as_of(df, ["k"], "valid_from", F.lit(t), ["id"]).collect()}
    assert of(0) == set() and of(5) == {("a", 12, "y"), (None, 1, "u")} and of(100) == {("a", 13, "z"), ("b", 1, "w"), (None, 1, "u")}


def test_tagged_union(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(1 << 40, 0.5, "s")], "k long, x double, y string")
    u = jn.tagged_union({"a": a, "b": b, "none": b.where("false")})
    assert dict(u.dtypes) == {"tag": "string", "k": "bigint", "x": "double", "y": "string"}
    assert {tuple(r) for r in u.collect()} == {("a", 1, 2.0, None), ("b", 1 << 40, 0.5, "s")}
