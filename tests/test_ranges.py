import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgate.sources import ranges as R


def _pages(spark, n, start=0):
    rows = [(i, f"T: {i}", None if i % 11 == 0 else "" if i % 7 == 0 else f"<b>text & {i}</b> ü\n" + ("\x00\r\x0b" if i % 5 == 0 else "") + "w" * (i % 40)) for i in range(start, start + n)]
    return rows, spark.createDataFrame(rows, "page_id long, title string, text string").repartition(3)


def _size(path):
    return sum(os.path.getsize(f"{path}/{x}") for x in os.listdir(path) if x.endswith(".bz2"))


def test_dump_round_trip_and_ranges(spark, tmp_path):
    rows, df = _pages(spark, 500)
    path = f"file://{tmp_path}/dump"
    R.write_dump(df, path, pages=10)
    whole = R.read_dump(spark, path)
    assert sorted((r.page_id, r.title, r.text) for r in whole.collect()) == rows
    some = R.read_dump(spark, path).where("page_id IN (3, 77, 401) AND length(title) > 0")
    got = some.select("page_id", "text", "file", "offset", "length").collect()
    assert {(r.page_id, r.text) for r in got} == {(rows[i][0], rows[i][2]) for i in (3, 77, 401)}
    assert "page_id" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("\n")[0] if "Filter" in some._jdf.queryExecution().executedPlan().toString() else True
    read = sum(n for *_, n in {(r.file, r.offset, r.length) for r in got})
    assert 0 < read < 0.2 * _size(tmp_path / "dump")
    wanted = spark.createDataFrame([(5,), (499,), (10_000,), (5,)], "page_id long")
    assert {(r.page_id, r.title, r.text) for r in R.wanted_pages(spark, path, wanted).collect()} == {rows[5], rows[499]}
    assert R.dump_ranges(spark, path).count() == 500
    assert R.dump_ranges(spark, path).select("path", "offset", "length").distinct().agg(F.sum("length")).first()[0] == _size(tmp_path / "dump")


def test_filters_reach_the_index(spark, tmp_path, monkeypatch):
    """Streams without a wanted page are never read: here they are broken."""
    rows, df = _pages(spark, 100)
    R.write_dump(df.coalesce(1).sort("page_id"), f"file://{tmp_path}/d", pages=10)
    (name,) = [x for x in os.listdir(tmp_path / "d") if x.endswith(".bz2")]
    offsets = sorted({int(x.split(":")[0]) for x in open(tmp_path / "d" / name.replace(".xml.bz2", ".index"))})
    data = bytearray(open(tmp_path / "d" / name, "rb").read())
    data[: offsets[5]] = b"x" * offsets[5]
    open(tmp_path / "d" / name, "wb").write(data)
    assert R.read_dump(spark, f"file://{tmp_path}/d").where("page_id >= 50 AND page_id < 58").count() == 8
    with pytest.raises(Exception, match="Invalid data"):
        R.read_dump(spark, f"file://{tmp_path}/d").where("page_id < 58").count()


def test_output_appears_whole_and_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    df = spark.range(40).selectExpr("id", "CAST(NULL AS string) AS note").repartition(4)
    schema = "id long, note string"
    assert R.read_json(spark, path, schema).count() == 0
    R.write_json(df, path, txn="day 1")
    R.write_json(df, path, txn="day 1")  # a rerun adds nothing
    assert sorted(r.id for r in R.read_json(spark, path, schema).collect()) == list(range(40))
    bad = df.withColumn("note", F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        R.write_json(bad, path, txn="day 2")
    assert R.read_json(spark, path, schema).count() == 40
    assert not [x for x in os.listdir(tmp_path / "log") if x.startswith("_job")]
    R.write_json(df.where("id < 10"), path, txn="day 2")
    assert R.read_json(spark, path, schema).count() == 50
    with pytest.raises(Exception, match="broken"):
        R.write_json(bad, path, replace=True)
    assert R.read_json(spark, path, schema).count() == 50
    R.write_json(df.where("id < 3"), path, replace=True)
    assert sorted(r.id for r in R.read_json(spark, path, schema).collect()) == [0, 1, 2]


def test_zip_members_and_matrix_rows_by_range(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(20):
            z.writestr(f"m{i}.json", json.dumps({"i": i, "t": "ä" * i}), zipfile.ZIP_STORED if i % 2 else None)
    members = R.zip_members(spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "path string"))
    assert members.count() == 20
    got = R.read_members(members.where("member IN ('m4.json', 'm7.json')")).collect()
    assert {r.member: json.loads(bytes(r.content)) for r in got} == {f"m{i}.json": {"i": i, "t": "ä" * i} for i in (4, 7)}
    x = np.random.default_rng(1).normal(size=(50, 8)).astype(np.float16)
    np.save(tmp_path / "x.npy", x)
    paths = spark.createDataFrame([(f"file://{tmp_path}/x.npy",)], "path string")
    rows = R.npy_rows(paths, paths.selectExpr("path", "explode(array(0L, 7L, 49L)) AS row")).collect()
    assert {r.row: r.v for r in rows} == {i: x[i].astype(float).tolist() for i in (0, 7, 49)}
    with pytest.raises(Exception, match="no such row"):
        R.npy_rows(paths, paths.selectExpr("path", "50L AS row")).collect()
