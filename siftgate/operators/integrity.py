"""Checks of tables against each other and against their own keys. Each returns rows of findings; none means clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_digest(*parts: Column) -> Column:
    """SHA-256 of named values as JSON, whatever order they are given in (the caller names them by ``alias``)."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, status`` of ``manifest(path, sha256, external)`` against ``files(path, sha256)``: OK, CORRUPT, MISSING, EXTERN."""
    j = manifest.join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    status = F.when(F.col("external"), "EXTERN").when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("sha256"), "OK").otherwise("CORRUPT")
    return j.select("path", status.alias("status"))


def incomplete_groups(df: DataFrame, keys: list[str], member: str, wanted: list[str]) -> DataFrame:
    """``keys, members, n``: groups that don't hold each wanted member exactly once."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("n"))
    return g.where((F.col("members") != F.array_sort(F.array(*map(F.lit, wanted)))) | (F.col("n") != len(wanted)))


def fan_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of keys that a join would multiply."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """``keys, field, ours, theirs`` of cells that differ by more than the tolerance, or that one side lacks."""
    l = left.select(*keys, *[F.col(v).cast("double").alias(f"l_{v}") for v in values], F.lit(True).alias("in_l"))
    r = right.select(*keys, *[F.col(v).cast("double").alias(f"r_{v}") for v in values], F.lit(True).alias("in_r"))
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"l_{v}").alias("ours"), F.col(f"r_{v}").alias("theirs")) for v in values])).alias("x")
    j = l.join(r, keys, "full_outer").select(*keys, "in_l", "in_r", cells).select(*keys, "in_l", "in_r", "x.*")
    apart = F.col("in_l").isNull() | F.col("in_r").isNull() | (F.col("ours").isNull() != F.col("theirs").isNull()) | (F.abs(F.col("ours") - F.col("theirs")) > tolerance)
    return j.where(apart).select(*keys, "field", "ours", "theirs")


def assembled(shards: dict[int, DataFrame], shard_of: Column, config: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows of the shards, and the findings of their assembly as ``problem, n``: rows in another shard than their key
    says, keys in several rows, more than one configuration."""
    rows = None
    for label, part in shards.items():
        part = part.withColumn("shard", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    wrong = rows.where(shard_of != F.col("shard")).agg(F.count("*").alias("n")).select(F.lit("wrong shard").alias("problem"), "n")
    twice = fan_out(rows, keys).agg(F.count("*").alias("n")).select(F.lit("repeated key").alias("problem"), "n")
    mixed = rows.agg(F.count_distinct(config).alias("n")).select(F.lit("further configurations").alias("problem"), F.greatest(F.col("n") - 1, F.lit(0)).alias("n"))
    return rows, wrong.unionByName(twice).unionByName(mixed)


def resume(todo: DataFrame, done: DataFrame, key: str, config: str) -> DataFrame:
    """Rows of ``todo`` whose key ``done`` lacks. A ``done`` of another configuration fails the query: its numbers don't compare."""
    other = done.select(F.col(config).alias("c")).distinct().join(todo.select(F.col(config).alias("c")).distinct(), "c", "left_anti").agg(F.count("*").alias("other"))
    rest = todo.join(done.select(key), key, "left_anti").crossJoin(F.broadcast(other))  # one row
    return rest.where(F.when(F.col("other") > 0, F.raise_error(F.lit("the finished part has another configuration")).cast("boolean")).otherwise(F.lit(True))).drop("other")
