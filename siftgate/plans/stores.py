"""Queries that write tables in other formats to the shared folder and read them back: what is read is what counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ranges as R
from ..sources import tables as S
from ..sources.shared import shared_path
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def dump(spark: SparkSession, d: str) -> str:
    """``pages`` as a dump of many streams with an index."""
    path = shared_path(spark, "dump")
    R.write_dump(table(spark, d, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("text")), path)
    return path


@query("SELECT page_id, url AS title, md5(html) AS digest FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def dump_wanted_pages(spark, d):
    """Pages of a table of ids, through the dump's index: only streams that hold one are read."""
    wanted = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return R.wanted_pages(spark, dump(spark, d), wanted).select("page_id", "title", F.md5("text").alias("digest"))


@query("SELECT page_id, url AS title, md5(html) AS digest FROM pages WHERE page_id >= 40 AND page_id < 90")
def dump_page_range(spark, d):
    """A range of pages; the bounds are pushed down to the index."""
    return R.read_dump(spark, dump(spark, d)).where("page_id >= 40 AND page_id < 90").select("page_id", "title", F.md5("text").alias("digest"))


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang")
def committed_log(spark, d):
    """A log of selected documents, written in two jobs of which the first runs twice: a job's rows appear together, and once."""
    picked = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang")
    path = shared_path(spark, "log")
    for txn, part in (("even", "doc_id % 2 = 0"), ("even", "doc_id % 2 = 0"), ("odd", "doc_id % 2 <> 0")):
        R.write_json(picked.where(part), path, txn=txn)
    return R.read_json(spark, path, "doc_id long, lang string").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


def told(df: DataFrame, form: str, key: Column, text: Column) -> DataFrame:
    """A row for a format: rows, and a sum of digests that tells them apart in any order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), text)), 1, 8), 16, 10).cast("long")
    return df.agg(F.lit(form).alias("format"), F.count("*").alias("n"), F.sum(h).alias("digest"))


def _sum(key: str, text: str) -> str:
    return f"count(*) AS n, sum(('0x' || substr(md5({key} || '|' || {text}), 1, 8))::BIGINT)::BIGINT AS digest"


@query(f"""SELECT unnest(['json lines', 'json arrays', 'xml']) AS format, n, digest FROM (SELECT {_sum('page_id', 'hex(html)')} FROM pages)
UNION ALL SELECT 'text files', {_sum("''", "trim(text)")} FROM benchmark UNION ALL SELECT 'tsv', {_sum('page_id', 'url')} FROM pages""")
def format_round_trips(spark, d):
    """Tables written as JSON lines, arrays in JSON files, XML elements, one text file a row and tab-separated lines, and read back."""
    pages = table(spark, d, "pages").select("page_id", F.hex(F.col("html").cast("binary")).alias("body"), "url")
    at = lambda form: shared_path(spark, form)
    lines, arrays, xml, texts, tsv = map(at, ("jsonl", "arrays", "xml", "texts", "tsv"))
    S.write_new(pages.select("page_id", "body"), lines)
    S.append(pages.select("page_id", "body").where("false"), lines)
    whole = pages.groupBy(F.floor(F.col("page_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct("page_id", "body"))).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(arrays)
    pages.select("page_id", "body").write.option("rowTag", "page").option("rootTag", "pages").format("xml").save(xml)
    table(spark, d, "benchmark").select(F.trim("text").alias("value")).write.option("maxRecordsPerFile", 1).text(texts)
    S.write_tsv(pages.select("page_id", "url"), tsv)
    out = told(S.jsonl(spark, lines, "page_id long, body string"), "json lines", F.col("page_id"), F.col("body"))
    for r in (
        told(S.json_array(spark, arrays, ["page_id", "body"]), "json arrays", F.col("page_id"), F.col("body")),
        told(S.xml(spark, xml, "page", "page_id long, body string"), "xml", F.col("page_id"), F.col("body")),
        told(S.whole_texts(spark, texts), "text files", F.lit(""), F.trim(F.regexp_replace("text", "\n$", ""))),
        told(S.tsv(spark, tsv, "page_id long, url string").where("_corrupt_record IS NULL"), "tsv", F.col("page_id"), F.col("url")),
    ):
        out = out.unionByName(r)
    return out
