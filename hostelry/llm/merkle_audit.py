"""Merkle fixity audit of web archive files.

Every record is hashed together with its offset and length in its file. Runs of
``FAN`` nodes in order of offset are hashed into nodes of the next level, up to
one root for each file. Two replicas compare roots and descend only below nodes
that differ; the leaves reached locate the damage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut

#: Records of a file, children of a node.
FILE_RECORDS, FAN = 1024, 16


def records(pages: DataFrame) -> DataFrame:
    """WARC response records: file, record, start, size, hash and page_id of every row.

    Rows go to files by page_id (null: file -1), a bounded run of ids each, and
    lie in order of page_id, url and html; offsets are bytes. A null url or html
    is empty. Repeated rows are records of their own; other columns are ignored.
    """
    empty = F.lit("")
    url, html = F.coalesce("url", empty), F.coalesce("html", empty)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), F.lit(-1)).alias("file"),
        "page_id",
        F.sha2(record, 256).alias("content"),
        F.octet_length(record).cast("long").alias("size"),
    )
    in_file = Window.partitionBy("file").orderBy("page_id", "content")
    start = F.coalesce(F.sum("size").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"record": F.row_number().over(in_file) - 1, "start": start})
    return rows.withColumn("hash", F.sha2(F.concat_ws(":", "start", "size", "content"), 256))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file, node, first, last, hash) of every level, leaves first; first to last are offsets in bytes."""
    nodes = leaves.select(
        "file", F.col("record").alias("node"), F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last"), "hash"
    )
    out = [cut(nodes)]
    for _ in range(levels):
        below = out[-1].withColumn("parent", F.floor(F.col("node") / FAN).cast("int"))
        # At most FAN children meet in a group.
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = below.groupBy("file", "parent").agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ","), 256).alias("hash"),
        )
        out.append(cut(up.withColumnRenamed("parent", "node")))
    return out


def levels_of(leaves: DataFrame) -> int:
    """Levels above the leaves, so that the largest file has one root."""
    most = leaves.agg(F.max("record")).first()[0] or 0
    levels = 0
    while most:
        most, levels = most // FAN, levels + 1
    return levels


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records at which two replicas' ``records`` differ: file, record, offsets, both hashes and page ids.

    A record that one replica lacks has nulls on its side. Equal replicas give no rows.
    """
    # Hashes and offsets are computed once; the levels and the result read them.
    one, two = cut(one), cut(two)
    levels = max(levels_of(one), levels_of(two))
    first, second = tree(one, levels), tree(two, levels)
    suspects = None
    for a, b in zip(reversed(first), reversed(second)):
        if suspects is not None:
            key = F.floor(F.col("node") / FAN).cast("int")
            a, b = (x.withColumn("parent", key).join(suspects, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        left, right = a.alias("a"), b.alias("b")
        met = left.join(right, (F.col("a.file") == F.col("b.file")) & (F.col("a.node") == F.col("b.node")), "full_outer")
        differ = met.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        suspects = cut(
            differ.select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.node", "b.node").alias("parent"))
        )
    found = suspects.withColumnRenamed("parent", "record")
    sides = [
        found.join(x, ["file", "record"], "left").select(
            "file", "record", *(F.col(c).alias(f"{c}_{name}") for c in ("page_id", "start", "size", "hash"))
        )
        for x, name in ((one, "a"), (two, "b"))
    ]
    return reduce(lambda x, y: x.join(y, ["file", "record"]), sides)
