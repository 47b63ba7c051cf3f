"""Records that a complete register no longer holds: an append-only log of removals and restores, and what is valid by it.

Nothing is flagged or deleted. A record is valid unless its last entry in the log removes it; what a
new register would remove or restore is told by the same expressions before and when it is done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REMOVED, RESTORED = "REMOVED", "RESTORED"


def with_state(records: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """``records`` with valid and last_entry: the log's last word on each (key, entry, action), valid where there is none."""
    last = log.groupBy(key).agg(F.max_by("action", "entry").alias("_action"), F.max("entry").alias("last_entry"))
    joined = records.join(last, key, "left")
    return joined.withColumn("valid", F.coalesce(F.col("_action") != REMOVED, F.lit(True))).drop("_action")


def entries(records: DataFrame, log: DataFrame, registers: DataFrame, held: DataFrame, key: str = "key") -> DataFrame:
    """register, key, entry, action: what the log gains by complete registers.

    records: register, key, day; registers: register, first_day, last_day; held: register and key of what they hold. A valid
    record of a register's days that it does not hold is REMOVED, a removed one that it holds is RESTORED; records
    of other registers or days are left alone.
    """
    told = with_state(records, log, key).join(registers, "register").where("day BETWEEN first_day AND last_day")
    met = told.join(held.select("register", key).distinct().withColumn("_held", F.lit(True)), ["register", key], "left")
    action = F.when(F.col("valid") & F.col("_held").isNull(), REMOVED).when(~F.col("valid") & F.col("_held").isNotNull(), RESTORED)
    entry = F.coalesce("last_entry", F.lit(0)) + 1
    return met.select("register", key, entry.cast("long").alias("entry"), action.alias("action")).where("action IS NOT NULL")


def preview(records: DataFrame, gained: DataFrame, most: int, key: str = "key") -> DataFrame:
    """The first ``most`` records that each register would remove, the newest days first, and how many there are."""
    removed = records.join(gained.where(F.col("action") == REMOVED).select("register", key), ["register", key])
    by = Window.partitionBy("register").orderBy(F.col("day").desc(), key)
    whole = removed.groupBy("register").agg(F.count("*").alias("removed"))
    # Only the first rows of each register leave their partition's window.
    first = removed.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    return first.join(whole, "register")


def placed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Each incoming record's place among stored ones of its fingerprint: KEPT, RECLASSIFIED, RESTORED or NEW, and the key it takes.

    incoming: id, fingerprint, category; stored: key, fingerprint, category, valid. Equal records are facts of their own.
    The n-th of a category takes the n-th valid one of it (KEPT); what is left over takes valid ones of other
    categories (RECLASSIFIED), then removed ones (RESTORED), then none (NEW). Every step is one equi-join on numbers.
    """

    def numbered(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    same = ["fingerprint", "category"]
    left = numbered(incoming, same, F.col("id"))
    right = numbered(stored.where("valid"), same, F.col("key")).select(*same, "n", "key")
    first = left.join(right, [*same, "n"], "left")
    kept = first.where("key IS NOT NULL").select("id", "key", F.lit("KEPT").alias("place"))
    rest = numbered(first.where("key IS NULL").select("id", "fingerprint", "category"), ["fingerprint"], F.col("category"), F.col("id"))
    free = stored.join(kept.select("key"), "key", "left_anti")
    free = numbered(free, ["fingerprint"], F.col("valid").desc(), F.col("category"), F.col("key")).select("fingerprint", "n", "key", "valid")
    second = rest.join(free, ["fingerprint", "n"], "left")
    place = F.when(F.col("key").isNull(), "NEW").when(F.col("valid"), "RECLASSIFIED").otherwise(RESTORED)
    return reduce(DataFrame.unionByName, [kept, second.select("id", "key", place.alias("place"))])
