import gzip
import json
import zipfile

import numpy as np
import pytest

from siftgate.sources import tables as S


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/rows.jsonl", '{"a": 1, "t": "one"}\n\n{"a": 2, "t": "zwei ä"}\n')
        z.writestr("x/other.jsonl", '{"a": 9}\n')
        z.writestr("t.tsv", 'id\tlabel\ttext\n1\tyes\t"quoted\n2\tno\n3\tno\tlast\n')
    path = str(tmp_path / "a.zip")
    assert [tuple(r) for r in S.zip_jsonl(spark, path, "a int, t string", ["x/rows.jsonl"]).collect()] == [(1, "one"), (2, "zwei ä")]
    got = S.zip_tsv(spark, path, ["text", "id"], ["t.tsv"]).collect()
    assert sorted((r.id or "", r.text or "", r.malformed) for r in got) == [("", "", True), ("1", '"quoted', False), ("3", "last", False)]


def test_cell_shards(spark, tmp_path):
    for k in (0, 1):
        with gzip.open(tmp_path / f"shard{k}.json.gz", "wt") as f:
            json.dump({"meta": {"shard": k}, "cells": [{"id": f"{k}-{i}", "cos": i / 10} for i in range(3)]}, f)
    got = S.cell_shards(spark, str(tmp_path), "id string, cos double").collect()
    assert sorted((r.shard, r.id, r.cos) for r in got) == [(f"shard{k}.json.gz", f"{k}-{i}", i / 10) for k in (0, 1) for i in range(3)]


def test_vectors_and_side_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float16)
    np.save(tmp_path / "m__r.npy", x)
    (tmp_path / "m__r.meta.json").write_text(json.dumps({"n_texts": 7}))
    got = sorted(S.npy_vectors(spark, str(tmp_path), 5).collect(), key=lambda r: r.vec_id)
    assert [r.name for r in got] == ["m__r"] * 7 and np.array_equal(np.array([r.v for r in got], np.float16), x)
    (tmp_path / "m__r.meta.json").write_text(json.dumps({"n_texts": 8}))
    with pytest.raises(Exception, match="side file"):
        S.npy_vectors(spark, str(tmp_path), 5).collect()


def test_half_precision_sink(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(50, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(99, [0.0, 1.0, -2.5, 1 / 3])], "vec_id long, v array<float>")
    S.write_vectors(df, str(tmp_path / "v"), config="c", register="r")
    for r in spark.read.parquet(str(tmp_path / "v")).collect():
        want = x[r.vec_id] if r.vec_id < 50 else np.array([0.0, 1.0, -2.5, 1 / 3], np.float32)
        assert np.array_equal(np.array(r.v, np.float32), want.astype(np.float16).astype(np.float32)) and (r.config, r.register) == ("c", "r")


def test_dump_keeps_articles(spark, tmp_path):
    page = lambda t, ns, more="": f"<page><title>{t}</title><ns>{ns}</ns>{more}<revision><text>about {t}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page("A", 0) + page("Talk:A", 1) + page("B", 0, '<redirect title="A"/>') + page("C", 0) + "</mediawiki>")
    assert {(r.title, r.text) for r in S.dump_pages(spark, str(tmp_path / "d.xml")).collect()} == {("A", "about A"), ("C", "about C")}


def test_blocks_are_read_where_wanted(spark, tmp_path, capsys):
    path = str(tmp_path / "blocks")
    S.write_blocks(spark.range(1000).withColumnRenamed("id", "offset").selectExpr("offset", "offset * 2 AS x"), path, "offset", 100)
    got = S.read_blocks(spark, path, spark.createDataFrame([(5,), (7,), (950,), (5000,)], "offset long"), "offset", 100)
    assert {tuple(r) for r in got.collect()} == {(5, 10), (7, 14), (950, 1900)}


def test_log_and_walk(spark, tmp_path):
    df = spark.createDataFrame([(i, i * i) for i in range(10)], "id long, x long")
    path = str(tmp_path / "log")
    assert [S.log_new(df.where("id < 6"), path, "id"), S.log_new(df, path, "id"), S.log_new(df, path, "id")] == [6, 4, 0]
    assert spark.read.parquet(path).count() == 10
    assert [r.id for r in S.first_qualifying(df, df.x > 8, ["id"], 3).collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="exist"):
        S.write_new(df, path)


def test_dead_anchors_fail(spark):
    draw = spark.createDataFrame([(1, "h1"), (1, "h2"), (2, "h2")], "anchor_id long, host_id string")
    pool = lambda *rows: spark.createDataFrame(list(rows), "host_id string, text string")
    assert {(r.anchor_id, r.host_id) for r in S.covered_hosts(draw, pool(("h1", None), ("h2", "t"))).collect()} == {(1, "h2"), (2, "h2")}
    with pytest.raises(Exception, match="no host"):
        S.covered_hosts(draw, pool(("h1", "t"), ("h2", ""))).collect()


def test_delimited_index_and_tsv(spark, tmp_path):
    (tmp_path / "i.txt").write_text("10:1:A: b\n20:2:C\n")
    assert [tuple(r) for r in S.offset_index(spark.read.text(str(tmp_path / "i.txt"))).collect()] == [(10, 1, "A: b"), (20, 2, "C")]
    S.write_tsv(spark.createDataFrame([("a b", 3)], "title string, n int"), str(tmp_path / "o"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).collect()] == [("a b", "3")]
