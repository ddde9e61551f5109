"""Readers and sinks: explicit names in, DataFrames out. Filters and columns reach the files through Catalyst."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """One top-level list; all ``required`` keys must occur."""
    df = spark.read.option("multiLine", True).json(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header; rows that don't fit the schema are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").csv(path, sep="\t", header=True, mode="PERMISSIVE", quote="", columnNameOfCorruptRecord="_corrupt_record")


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of a (possibly bz2) dump, split by Spark."""
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def offset_index(lines: DataFrame, *more: str) -> DataFrame:
    """``offset:page:title`` lines; titles may hold colons. Columns in ``more`` are kept."""
    x = F.split("value", ":", 3)
    return lines.select(*more, x[0].cast("long").alias("offset"), x[1].cast("long").alias("page"), x[2].alias("title"))


def files_with_digest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Refuses to overwrite; a task's output appears whole or not at all."""
    df.write.mode("errorifexists").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


LINES = "path string, member string, line_no long, line string"


def zip_lines(spark: SparkSession, path: str, members: list[str] | None = None) -> DataFrame:
    """``path, member, line_no, line`` of the (named) members of zip files; blank lines are skipped.

    An archive is a task's unit, as zip can't be split; members are inflated line by line."""

    def go(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in members or [i.filename for i in z.infolist() if not i.is_dir()]:
                        held = []
                        with z.open(member) as f:
                            for n, line in enumerate(io.TextIOWrapper(f, "utf-8", newline="\n")):
                                if line.strip():
                                    held.append((name, member, n, line.rstrip("\r\n")))
                                if len(held) == 10_000:
                                    yield _lines(held)
                                    held = []
                        yield _lines(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(go, LINES)


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "member", "line_no", "line"])


def zip_jsonl(spark: SparkSession, path: str, schema: str, members: list[str] | None = None) -> DataFrame:
    """Records of JSON lines in zip members; a broken line fails the read."""
    return zip_lines(spark, path, members).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def zip_tsv(spark: SparkSession, path: str, columns: list[str], members: list[str] | None = None) -> DataFrame:
    """The named columns of tab-separated members with a header, and ``malformed``: a row with fewer fields than its header
    (its columns are null, so that it can be counted)."""
    lines = zip_lines(spark, path, members).withColumn("fields", F.split("line", "\t"))
    heads = lines.where("line_no = 0").select("path", "member", F.col("fields").alias("head"))
    rows = lines.where("line_no > 0").join(F.broadcast(heads), ["path", "member"])  # a row per member
    short = F.size("fields") < F.size("head")
    at = lambda c: F.when(~short, F.get("fields", F.array_position("head", F.lit(c)) - 1)).alias(c)
    return rows.select(*map(at, columns), short.alias("malformed"))


def cell_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows in ``cells`` of JSON shards (possibly gzip), with ``shard``, the file's name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    d = spark.read.schema(f"cells array<struct<{schema}>>").option("multiLine", True).json(path)
    return d.select(name.alias("shard"), F.explode("cells").alias("x")).select("shard", "x.*")


def npy_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """``name, vec_id, v array<float>`` of .npy matrices (any float type) of which a side file ``<name>.meta.json`` states
    ``n_texts``; a matrix of another shape fails the read."""

    def go(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if x.ndim != 2 or x.shape[1] != dims:
                    raise ValueError(f"{name} has shape {x.shape}")
                for i in range(0, len(x), 10_000):
                    part = np.ascontiguousarray(x[i : i + 10_000], np.float32)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dims), pa.array(part.ravel()))
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), v], ["name", "vec_id", "v"])

    stem = lambda ending: F.regexp_extract("path", r"([^/]+)" + ending + "$", 1).alias("name")
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    vectors = found.where(F.col("path").endswith(".npy")).select(stem(r"\.npy"), "content").mapInArrow(go, "name string, vec_id long, v array<float>")
    meta = found.where(F.col("path").endswith(".meta.json")).select(stem(r"\.meta\.json"), F.get_json_object(F.col("content").cast("string"), "$.n_texts").cast("long").alias("n_texts"))
    counted = vectors.groupBy("name").agg(F.count("*").alias("n")).join(meta, "name", "left")
    ok = F.when(F.col("n").eqNullSafe(F.col("n_texts")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows and side file differ: "), F.col("name"))).cast("boolean"))
    return vectors.join(F.broadcast(counted.select("name", ok.alias("ok"))), "name").where("ok").drop("ok")  # a row per file


def half(v: Column) -> Column:
    """Floats rounded to the eleven significant bits of a 16-bit float (numbers in its normal range)."""

    def one(x: Column) -> Column:
        step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x).cast("double"))) - 10)
        return F.when(x == 0, x).otherwise((F.rint(x.cast("double") / step) * step).cast("float"))

    return F.transform(v, one)


def write_vectors(df: DataFrame, path: str, **meta: str) -> None:
    """``df(vec_id, v)`` in 16-bit precision as Parquet, each row with the columns of ``meta``."""
    df.select("vec_id", half(F.col("v")).alias("v"), *[F.lit(x).alias(k) for k, x in meta.items()]).write.parquet(path)


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """``title, text`` of an XML dump's articles: pages of namespace 0 that redirect nowhere."""
    pages = xml(spark, path, "page", "title string, ns int, redirect struct<_title:string>, revision struct<text:string>")
    return pages.where("ns = 0 AND redirect IS NULL").select("title", F.col("revision.text").alias("text"))


def write_blocks(df: DataFrame, path: str, offset: str, size: int) -> None:
    """A table whose folders hold ``size`` offsets each, so that :func:`read_blocks` opens only those it needs."""
    df.withColumn("block", F.floor(F.col(offset) / size).cast("long")).write.partitionBy("block").parquet(path)


def read_blocks(spark: SparkSession, path: str, index: DataFrame, offset: str, size: int) -> DataFrame:
    """The rows at the offsets of ``index``; its blocks prune the scan at run time."""
    wanted = index.select(F.col(offset), F.floor(F.col(offset) / size).cast("long").alias("block")).distinct()
    return spark.read.parquet(path).join(wanted, ["block", offset], "left_semi").drop("block")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", "\u0000").csv(path, sep="\t")


def first_qualifying(df: DataFrame, qualifies: Column, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of an ordered walk that qualify."""
    return df.where(qualifies).orderBy(*order).limit(most)


def log_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the log at ``path`` lacks; how many there were. The log may not exist yet."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df = df.persist()
    n = df.count()
    df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def covered_hosts(draw: DataFrame, pool: DataFrame) -> DataFrame:
    """The drawn hosts that have a text. An anchor left without any fails the query."""
    have = draw.join(pool.where("text IS NOT NULL AND text <> ''").select("host_id", "text"), "host_id")
    dead = draw.select("anchor_id").distinct().join(have.select("anchor_id"), "anchor_id", "left_anti").agg(F.count("*").alias("dead"))
    ok = F.when(F.col("dead") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.col("dead").cast("string"), F.lit(" anchors have no host"))).cast("boolean"))
    return have.crossJoin(F.broadcast(dead)).where(ok).drop("dead")  # one row


def config_text(config: dict) -> str:
    """A configuration as canonical JSON."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"))
