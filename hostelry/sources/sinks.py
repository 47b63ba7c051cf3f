"""Append-only stores of versions: insert if absent, and the newest version of each key."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.operators.snapshots import newest


class Conflict(Exception):
    """Another writer has committed the version that was to follow the expected one."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where.getFileSystem(conf)


def version(spark: SparkSession, path: str) -> int:
    """The number of commits to a store."""
    jvm, _, files = _files(spark, path)
    commits = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    if not files.exists(commits):
        return 0
    names = [entry.getPath().getName() for entry in files.listStatus(commits)]
    return max((int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith(".")), default=0)


def _folders(spark: SparkSession, path: str, at: int) -> list[str]:
    return [row.folder for row in spark.read.schema("folder string").json(f"{path}/_commits/{at:012d}.json").collect()] if at else []


def stored(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """What the store holds, in its newest version or another, or None before its first commit."""
    folders = _folders(spark, path, version(spark, path) if at is None else at)
    return spark.read.parquet(*(f"{path}/{folder}" for folder in folders)) if folders else None


def commit(rows: DataFrame, path: str, expected: int, replace: bool = False) -> int:
    """Add rows to a store (or ``replace`` what it holds) as the version after ``expected``; the new version.

    Rows are written to a folder of their own, which nobody reads before a manifest names it. The manifest is
    put in place by one rename that fails where there is one, so of two writers one gets ``Conflict``, its rows are
    removed, and readers see all of a commit or nothing.
    """
    spark = rows.sparkSession
    jvm, conf, files = _files(spark, path)
    to = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    folder, mark = f"commit={uuid.uuid4().hex}", uuid.uuid4().hex
    rows.write.parquet(f"{path}/{folder}")
    folders = ([] if replace else _folders(spark, path, expected)) + [folder]
    temporary = to(f"_commits/.{mark}")
    out = files.create(temporary, False)
    out.write(bytearray("".join(json.dumps({"folder": name}) + "\n" for name in folders).encode()))
    out.close()
    final = to(f"_commits/{expected + 1:012d}.json")
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf).rename(files.makeQualified(temporary), files.makeQualified(final), option)
    except Py4JJavaError as error:
        files.delete(temporary, False)
        files.delete(to(folder), True)
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or files.exists(final):
            raise Conflict(f"{path} has a version {expected + 1} already") from None
        raise
    return expected + 1


def insert_if_absent(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the store lacks; how many there were."""
    at = version(rows.sparkSession, path)
    held = stored(rows.sparkSession, path, at)
    new = rows.dropDuplicates(keys) if held is None else rows.dropDuplicates(keys).join(held.select(*keys).distinct(), keys, "left_anti")
    # Cut off from the store before it is written to.
    new = cut(new)
    n = new.count()
    if n:
        commit(new, path, at)
    return n


def write_versions(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Store changed rows (by fingerprint) as the next revision of their key; the outcome of every row.

    CONFLICT: one key with two contents in the same batch; then nothing is written. Another writer that commits
    meanwhile makes this one fail (``Conflict``), so no revision is given twice.
    """
    twice = rows.groupBy(*keys).agg(F.countDistinct("fingerprint").alias("n")).where("n > 1")
    if not twice.isEmpty():
        return twice.select(*keys, F.lit("CONFLICT").alias("outcome"), F.lit(None).cast("int").alias("revision"))
    at = version(rows.sparkSession, path)
    rows, held = rows.dropDuplicates(keys), stored(rows.sparkSession, path, at)
    if held is None:
        out = rows.withColumns({"outcome": F.lit("CREATED"), "revision": F.lit(1)})
    else:
        last = newest(held, keys, F.col("revision").desc()).select(*keys, F.col("fingerprint").alias("_fp"), F.col("revision").alias("_rev"))
        outcome = F.when(F.col("_rev").isNull(), "CREATED").when(F.col("_fp") == F.col("fingerprint"), "UNCHANGED").otherwise("UPDATED")
        out = rows.join(last, keys, "left").withColumns({"outcome": outcome, "revision": F.when(outcome == "UNCHANGED", F.col("_rev")).otherwise(F.coalesce("_rev", F.lit(0)) + 1)}).drop("_fp", "_rev")
    out = cut(out)
    changed = out.where("outcome <> 'UNCHANGED'").drop("outcome")
    if not changed.isEmpty():
        commit(changed, path, at)
    return out.select(*keys, "outcome", "revision")
