"""WARC archives: writing, normalising monolithic gzip files, an offset index, reading by it.

The writer puts all records of a task in one gzip stream, as many crawlers do. The normaliser inflates such a file
once, as a stream, writes every record as a gzip member of its own and beside it an index of offsets. The reader
goes through the index and inflates one member at a time, so any record can be had alone.

Files lie in the shared folder, opened through ``pyarrow.fs``. A task writes under a name of its own attempt and
reports it with its rows, which go to a table: a lost executor's half-written files are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """A stream that isn't a sequence of WARC records."""


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page}|{sha1}')}>"


def make_record(page, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response, or a revisit of page ``refers_to`` without the payload."""
    sha1 = hashlib.sha1(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, sha1.hexdigest())), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1.digest()).decode()), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    block = HTTP + payload
    if refers_to is not None:
        block = HTTP
        head += [("WARC-Profile", PROFILE), ("WARC-Truncated", "length"), ("WARC-Refers-To", record_id(refers_to, sha1.hexdigest())), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one whole record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise BrokenArchive("no WARC header")
    fields = {k.decode().strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise BrokenArchive("record length")
    return fields, rest[:n]


def inflate(stream, piece: int = 1 << 20):
    """Bytes of a gzip file of any number of members, piece by piece."""
    z, got = zlib.decompressobj(31), False
    while data := stream.read(piece):
        while data:
            got = True
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
                got = False
    if got:
        raise BrokenArchive("cut off")


def split_records(pieces):
    """Whole records from a stream of bytes; holds one record and one piece."""
    held, need = bytearray(), -1
    for piece in pieces:
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = [x for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not held.startswith(b"WARC/") or not length:
                    raise BrokenArchive("no WARC header")
                need = end + 4 + int(length[0].split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise BrokenArchive("cut off")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(fs, source: str, target: str) -> int:
    """Rewrites a file record by record, with ``target``.idx: a JSON line of offset, length and record id each."""
    n = at = 0
    with fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(target + ".idx", compression=None) as index:
        for record in split_records(inflate(f)):
            member = gzip_member(record)
            out.write(member)
            index.write(json.dumps([at, len(member), parse_record(record)[0]["warc-record-id"]]).encode() + b"\n")
            at += len(member)
            n += 1
    return n


def read_members(fs, path: str):
    """Headers and block of each record of a normalised file, by its index."""
    with fs.open_input_stream(path + ".idx", compression=None) as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    with fs.open_input_file(path) as f:
        for at, n, name in index:
            f.seek(at)
            fields, block = parse_record(zlib.decompress(f.read(n), 31))
            if fields["warc-record-id"] != name:
                raise BrokenArchive("index")
            yield fields, block


def _attempt() -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _write(folder: str):
    def go(batches):
        fs, root = open_fs(folder)
        n, out, z, path = 0, None, None, ""
        for batch in batches:
            pages, urls, texts, refers = (batch.column(i) for i in range(4))
            texts = texts.cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{_attempt()}.warc.gz"
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(z.compress(make_record(pages[i].as_py(), urls[i].as_py(), texts[i].as_py() or b"", refers[i].as_py())))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return go


def _normalise(folder: str):
    def go(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs.create_dir(root, recursive=True)
                target = f"{root}/{_attempt()}.warc.gz"
                yield pa.record_batch([pa.array([target]), pa.array([normalise(fs, path, target)], pa.int64())], ["path", "records"])

    return go


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _read(folder: str):
    def go(batches):
        fs, _ = open_fs(folder)
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for f, block in read_members(fs, path):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    n = int(f["x-payload-length"])
                    if f["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise BrokenArchive("payload digest")
                    rows.append((whole(f.get("x-page-id")), f.get("warc-target-uri"), f["warc-type"], payload, n, digest, whole(f.get("x-refers-to-page"))))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    return go


NAMES = [x.split()[0] for x in READ.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of ``least`` bytes or more the largest page_id is the response."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html"))
    # short payloads take no part in the join: they stay where they are
    short = p.where(F.col("n") < least).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    long = p.where(F.col("n") >= least).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    heads = long.groupBy("sha1", "n").agg(F.max("page_id").alias("head"), F.count("*").alias("c")).where("c > 1").select("sha1", "n", "head")
    long = long.join(heads, ["sha1", "n"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))
    return long.unionByName(short)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """``path, records`` of the monolithic archives written from ``page_id, url, html, refers_to``."""
    return C.table(records.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), "path string, records long"), "written")


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    n = max(1, files.count())
    return C.table(files.select("path").repartition(n).mapInArrow(_normalise(folder), "path string, records long"), "normalised")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    return files.select("path").repartition(max(1, files.count())).mapInArrow(_read(folder), READ)


def warc_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as archives, normalises them and reads them back: one row per record.

    Null html is an empty payload; null urls and ids leave their header out; repeated rows are records of their
    own (of equal rows each is a response); columns besides these are ignored; an empty table gives no rows.
    Memory: one record and a piece of the file.
    """
    spark = pages.sparkSession
    folder = C.new_path(spark, "warc")
    raw = write_archives(with_revisits(pages, least), f"{folder}/raw")
    clean = normalise_archives(raw, f"{folder}/records")
    return read_archives(clean, f"{folder}/records")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    r = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
FROM k
"""
