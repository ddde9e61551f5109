"""What the training-data operators share: keys, words, tables in the shared folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based contract: blank and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset a new local one
    (tests: the master must be local, so that there is one machine only)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftgate-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps (its cleaner follows the garbage collector)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._siftgate_path = path
    return back


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int):
    """Jobs within hand at most so many rows at once to Python: for large rows, as a batch is held twice on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`table` that no later step reads."""
    for df in tables:
        path = getattr(df, "_siftgate_path", None)
        if path:
            with contextlib.suppress(Exception):  # tidying up only; a file that stays does no harm
                jvm = df.sparkSession.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``rid, doc_id, text`` (and ``more``): ``rid`` tells rows apart.

    It is doc_id where that is unique and never null (checked on that column alone); otherwise the rows are
    numbered once in a table, so that repeated or missing ids are each a document of their own.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    odd = base.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if odd:
        return table(base.withColumn("rid", F.monotonically_increasing_id()), "keyed").select("rid", *base.columns)
    return base.select(F.col("doc_id").alias("rid"), *base.columns)


def carried(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``doc_id, text`` and the caller's other columns under names of ours, and the expressions that bring all of them back.

    No name of the caller can clash with one that an operator uses, whatever it is."""
    base = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rest = {c: f"carried{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(rest.get(c, c)).alias(c) for c in docs.columns]
    return docs.select(*base, *[F.col(f"`{c}`").alias(x) for c, x in rest.items()]), back


def others(docs: DataFrame) -> list[str]:
    """Names of the columns that :func:`carried` has given to the caller's own."""
    return [c for c in docs.columns if c.startswith("carried")]


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
