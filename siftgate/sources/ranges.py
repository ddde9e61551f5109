"""Dumps of many compressed streams with an index, read by ranges, and sinks whose output appears whole.

A dump is a folder: data files, each a row of bz2 streams of a few pages; beside each an index file of ``offset:page:title`` lines (the
offset is that of the page's stream); and a manifest that names the files that count. Tasks write into a folder of the job, and the
driver moves what they have finished and replaces the manifest in one step; a job that fails leaves nothing that a reader sees, and
one that is repeated under the same name (``txn``) adds nothing. Manifests have a line for each file, so the driver never holds an index.

Readers open files through pyarrow's file systems (local, object stores, HDFS) and read the ranges they need, never whole files:

- ``spark.read.format("indexed_dump")``: a partition for each data file. Filters on ``page_id`` are pushed down to the index, so
  that only streams with such a page are read.
- :func:`wanted_pages`: the pages of a table of ids. The index is joined with the ids, the ranges are dealt out as rows.
- :func:`zip_members` and :func:`npy_rows`: members of zip archives from their directories, rows of matrices from their headers.
"""

from __future__ import annotations

import base64
import bz2
import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .tables import offset_index

MANIFEST = "_manifest"
PAGE = "page_id long, title string, text string"
#: Pages of a stream, unless another number is asked for.
STREAM = 100
#: What XML can't hold, or would change.
ODD = re.compile("[^\t\n\x20-퟿-�\U00010000-\U0010ffff]")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def manifest(path: str) -> list[str]:
    """Lines ``txn<tab>file`` of a folder's manifest, none if there is none yet."""
    fs, at = opened(f"{path}/{MANIFEST}")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    return fs.open_input_file(at).read().decode().splitlines()


def committed(path: str, ending: str) -> list[str]:
    """Paths of the files with an ending that count."""
    return [f"{path}/{x.split('\t')[1]}" for x in manifest(path) if x.endswith(ending)]


@dataclass
class Wrote(D.WriterCommitMessage):
    files: list[str]


class Committed(D.DataSourceArrowWriter):
    """Files in a folder of the job; commit moves them and replaces the manifest, abort drops them."""

    def __init__(self, path: str, txn: str, overwrite: bool) -> None:
        self.path, self.txn, self.overwrite, self.job = path, txn, overwrite, f"_job-{uuid.uuid4().hex}"
        fs, at = opened(f"{path}/{self.job}")
        fs.create_dir(at, recursive=True)

    def put(self, name: str, data: bytes) -> str:
        fs, at = opened(f"{self.path}/{self.job}/{name}")
        with fs.open_output_stream(at, compression=None) as f:
            f.write(data)
        return name

    def commit(self, messages) -> None:
        before = [] if self.overwrite else manifest(self.path)
        if any(x.split("\t")[0] == self.txn for x in before):
            return self.abort(messages)
        fs, at = opened(self.path)
        lines = list(before)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{at}/{self.job}/{name}", f"{at}/{name}")
                lines.append(f"{self.txn}\t{name}")
        if not messages or lines == before:
            lines.append(f"{self.txn}\t-")
        with fs.open_output_stream(f"{at}/{self.job}/{MANIFEST}") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        fs.move(f"{at}/{self.job}/{MANIFEST}", f"{at}/{MANIFEST}")
        fs.delete_dir(f"{at}/{self.job}")

    def abort(self, messages) -> None:
        fs, at = opened(f"{self.path}/{self.job}")
        fs.delete_dir(at)


class DumpWriter(Committed):
    def __init__(self, path: str, txn: str, overwrite: bool, pages: int) -> None:
        super().__init__(path, txn, overwrite)
        self.pages = pages

    def write(self, iterator) -> Wrote:
        name, out, lines, held = f"part-{uuid.uuid4().hex}", io.BytesIO(), [], []

        def flush() -> None:
            at = out.tell()
            lines.extend(f"{at}:{p}:{t}\n" for p, t, _ in held)
            out.write(bz2.compress("".join(map(page_xml, held)).encode("utf-8")))
            held.clear()

        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "title", "text")), strict=True):
                held.append(row)
                if len(held) == self.pages:
                    flush()
        if held:
            flush()
        # a task's compressed output is held until it is written; deal large tables over more tasks
        return Wrote([self.put(f"{name}.xml.bz2", out.getvalue()), self.put(f"{name}.index", "".join(lines).encode())] if lines else [])


def page_xml(row: tuple) -> str:
    page, title, text = row

    def field(name: str, x: str | None) -> str:
        if x is None:
            return ""
        if ODD.search(x):
            return f'<{name} encoding="base64">{base64.b64encode(x.encode("utf-8", "surrogatepass")).decode()}</{name}>'
        return f"<{name}>{escape(x)}</{name}>"

    return f"<page><id>{page}</id>{field('title', title)}{field('text', text)}</page>"


def pages_of(stream: bytes):
    """``page_id, title, text`` of the pages of a stream."""
    for page in ET.fromstring(b"<s>" + bz2.decompress(stream) + b"</s>"):

        def field(name: str, page=page) -> str | None:
            x = page.find(name)
            if x is None:
                return None
            return base64.b64decode(x.text).decode("utf-8", "surrogatepass") if x.get("encoding") else x.text or ""

        yield int(page.find("id").text), field("title"), field("text")


@dataclass
class DataFile(D.InputPartition):
    path: str


class DumpReader(D.DataSourceReader):
    """``page_id, title, text`` and the range that each page was read from."""

    TESTS = {D.EqualTo: lambda x, v: x == v, D.In: lambda x, v: x in v, D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v, D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v}

    def __init__(self, path: str) -> None:
        self.path, self.pushed = path, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in self.TESTS and f.attribute == ("page_id",):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self):
        return [DataFile(p) for p in committed(self.path, ".xml.bz2")] or [DataFile("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, at = opened(partition.path)
        lines = [x.split(":", 2) for x in fs.open_input_file(at.removesuffix(".xml.bz2") + ".index").read().decode().splitlines()]
        asked = lambda page: all(self.TESTS[type(f)](page, f.value) for f in self.pushed)
        ends = sorted({int(x[0]) for x in lines}) + [fs.get_file_info(at).size]
        wanted = {int(o) for o, page, _ in lines if asked(int(page))}
        with fs.open_input_file(at) as f:
            for offset, end in zip(ends[:-1], ends[1:], strict=True):
                if offset in wanted:
                    f.seek(offset)
                    rows = [(*p, partition.path, offset, end - offset) for p in pages_of(f.read(end - offset)) if asked(p[0])]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "title", "text", "file", "offset", "length"])


class IndexedDump(D.DataSource):
    """Options: ``path``; ``pages`` of a stream and ``txn``, the job's name, for writing."""

    @classmethod
    def name(cls) -> str:
        return "indexed_dump"

    def schema(self) -> str:
        return PAGE + ", file string, offset long, length long"

    def reader(self, schema) -> DumpReader:
        return DumpReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options["path"], self.options.get("txn", uuid.uuid4().hex), overwrite, int(self.options.get("pages", STREAM)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (IndexedDump, CommittedLines):
        spark.dataSource.register(source)


def write_dump(df: DataFrame, path: str, pages: int = STREAM, txn: str | None = None) -> None:
    """Adds ``df(page_id, title, text)`` to a dump, or nothing if a job of that name has done so."""
    register(df.sparkSession)
    w = df.select("page_id", "title", "text").write.format("indexed_dump").mode("append").option("path", path).option("pages", pages)
    (w.option("txn", txn) if txn else w).save()


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("indexed_dump").option("path", path).load()


def dump_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, path, offset, length`` of the stream of each page, from the index files: they are read by Spark, and the length is the
    way to the file's next stream."""
    lines = spark.read.text(committed(path, ".index"))
    index = offset_index(lines.select("value", F.input_file_name().alias("file")), "file").withColumn("path", F.regexp_replace("file", r"\.index$", ".xml.bz2"))
    starts = index.select("path", "offset").distinct()
    files = spark.read.format("binaryFile").load(committed(path, ".xml.bz2")).select("path", F.col("length").alias("size"))  # names and sizes; no content is read
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    after = F.expr("array_min(filter(offsets, o -> o > offset))")
    held = starts.groupBy("path").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))  # the streams of one file
    ends = held.join(files.select(name("path").alias("n"), "size"), F.expr("element_at(split(path, '/'), -1) = n")).select(F.col("path").alias("of"), F.explode("offsets").alias("offset"), "offsets", "size")
    ends = ends.select("of", F.col("offset").alias("start"), (F.coalesce(after, "size") - F.col("offset")).alias("length"))
    return index.join(ends, F.expr("path = of AND offset = start")).select("page", "path", "offset", "length").withColumnRenamed("page", "page_id")


FETCHED = "path string, offset long, length long, data binary"


def fetch(ranges: DataFrame) -> DataFrame:
    """``path, offset, length, data`` of each distinct range, in the order of the files' bytes within a task."""
    r = ranges.select("path", "offset", "length").distinct().sortWithinPartitions("path", "offset")

    def go(batches):
        now, f = None, None
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    fs, at = opened(path)
                    now, f = path, fs.open_input_file(at)
                f.seek(offset)
                yield pa.record_batch([pa.array([path]), pa.array([offset]), pa.array([length]), pa.array([f.read(length)], pa.binary())], ["path", "offset", "length", "data"])

    return r.mapInArrow(go, FETCHED)


def wanted_pages(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``page_id, title, text, length`` of the pages in ``wanted(page_id)``; ``length`` is that of the stream read for it."""
    ids = wanted.select("page_id").distinct()
    ranges = dump_ranges(spark, path).join(ids, "page_id", "left_semi")

    def go(batches):
        for batch in batches:
            for data, length in zip(batch.column("data"), batch.column("length").to_pylist(), strict=True):
                rows = [(*p, length) for p in pages_of(data.as_py())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "title", "text", "length"])

    return fetch(ranges).mapInArrow(go, PAGE + ", length long").join(ids, "page_id", "left_semi")


def zip_members(paths: DataFrame) -> DataFrame:
    """``path, member, offset, length, method`` of the members of the archives in ``paths(path)``: of a file only its directory and
    the members' local heads are read. ``offset`` is that of the packed bytes."""

    def go(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    rows = []
                    for m in z.infolist():
                        f.seek(m.header_offset + 26)
                        name, extra = np.frombuffer(f.read(4), "<u2")
                        rows.append((path, m.filename, m.header_offset + 30 + int(name) + int(extra), m.compress_size, m.compress_type))
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["path", "member", "offset", "length", "method"])

    return paths.select("path").mapInArrow(go, "path string, member string, offset long, length long, method long")


def read_members(members: DataFrame) -> DataFrame:
    """``path, member, content`` of (chosen) rows of :func:`zip_members`, stored or deflated."""

    def inflate(batches):
        for batch in batches:
            data = [zlib.decompress(x, -15) if m == 8 else x for x, m in zip(batch.column("data").to_pylist(), batch.column("method").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("path"), batch.column("member"), pa.array(data, pa.binary())], ["path", "member", "content"])

    both = fetch(members).join(members.select(F.col("path").alias("p"), F.col("offset").alias("o"), "member", "method"), F.expr("path = p AND offset = o"))
    return both.select("path", "member", "method", "data").mapInArrow(inflate, "path string, member string, content binary")


def npy_rows(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, row, v array<double>``: the rows of ``wanted(path, row)`` of .npy matrices, by their place behind the header; a row
    beyond the matrix fails the read."""

    def heads(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    version = np.lib.format.read_magic(f)
                    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                    if len(shape) != 2 or fortran:
                        raise ValueError(f"{path} is no matrix in row order")
                    yield pa.record_batch([pa.array([path]), pa.array([f.tell()]), pa.array([shape[0]]), pa.array([shape[1] * kind.itemsize]), pa.array([kind.str])], ["path", "start", "n", "width", "kind"])

    def decode(batches):
        for batch in batches:
            rows = [np.frombuffer(x, k).astype(float) for x, k in zip(batch.column("data").to_pylist(), batch.column("kind").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("path"), batch.column("row"), pa.array(rows, pa.list_(pa.float64()))], ["path", "row", "v"])

    head = paths.select("path").mapInArrow(heads, "path string, start long, n long, width long, kind string")
    there = F.when(F.col("row").between(0, F.col("n") - 1), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("no such row in "), "path")).cast("long"))
    r = wanted.join(head, "path").select("path", there.alias("row"), "start", "width", "kind").select("path", "row", (F.col("start") + F.col("row") * F.col("width")).alias("offset"), F.col("width").alias("length"), "kind")
    both = fetch(r).join(r.select(F.col("path").alias("p"), F.col("offset").alias("o"), "row", "kind"), F.expr("path = p AND offset = o"))
    return both.select("path", "row", "kind", "data").mapInArrow(decode, "path string, row long, v array<double>")


class LinesWriter(Committed):
    def write(self, iterator) -> Wrote:
        lines = [x for batch in iterator for x in batch.column("line").to_pylist()]
        return Wrote([self.put(f"part-{uuid.uuid4().hex}.jsonl", "".join(x + "\n" for x in lines).encode())] if lines else [])


class CommittedLines(D.DataSource):
    """A sink of one column ``line``; options ``path`` and ``txn``."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], self.options.get("txn", uuid.uuid4().hex), overwrite)


def write_json(df: DataFrame, path: str, txn: str | None = None, replace: bool = False) -> None:
    """Rows as JSON lines that appear together or not at all. A job of the same ``txn`` adds nothing the second time; ``replace``:
    readers see the new rows alone from the moment they are all there."""
    register(df.sparkSession)
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    w = lines.write.format("committed_lines").mode("overwrite" if replace else "append").option("path", path)
    (w.option("txn", txn) if txn else w).save()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows; a broken line fails the read."""
    files = committed(path, ".jsonl")
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(files)
