"""Queries on registers that no longer hold a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.operators import removals as op
from hostelry.plans.registry import query
from hostelry.plans.views import table

# Orders are records of the register of their customer's number modulo 20. Every seventh has been removed, of these every third
# restored, of these every second removed again. Even registers are read anew for some years and hold four records of five.
RECORDS_SQL = """
    r AS (SELECT o_orderkey AS k, o_custkey % 20 AS register, CAST(o_orderdate AS DATE) AS day FROM orders),
    state AS (
        SELECT *, NOT (k % 7 = 0 AND (k % 21 <> 0 OR k % 42 = 0)) AS valid, register % 2 = 0 AND year(day) BETWEEN 1993 AND 1996 AS read, k % 5 <> 0 AS held,
               CASE WHEN k % 42 = 0 THEN 3 WHEN k % 21 = 0 THEN 2 WHEN k % 7 = 0 THEN 1 ELSE 0 END AS last_entry FROM r
    ),
    gained AS (SELECT *, CASE WHEN read AND valid AND NOT held THEN 'REMOVED' WHEN read AND NOT valid AND held THEN 'RESTORED' END AS action FROM state)"""


def _registers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("key")
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 20).alias("register"), F.to_date("o_orderdate").alias("day"))
    steps = [F.when(k % m == 0, F.struct(F.lit(i).cast("long").alias("entry"), F.lit(a).alias("action"))) for i, (m, a) in enumerate(((7, op.REMOVED), (21, op.RESTORED), (42, op.REMOVED)), 1)]
    log = records.select("key", F.inline(F.array_compact(F.array(*steps))))
    even = records.where("register % 2 = 0")
    registers = even.select("register", F.lit("1993-01-01").cast("date").alias("first_day"), F.lit("1996-12-31").cast("date").alias("last_day")).distinct()
    return records, log, registers, even.where("key % 5 <> 0").select("register", "key")


@query(f"WITH {RECORDS_SQL} SELECT register, k AS key, CAST(last_entry + 1 AS BIGINT) AS entry, action FROM gained WHERE action IS NOT NULL")
def removal_entries(spark, sf_dir):
    """What the log gains by registers that are read anew."""
    return op.entries(*_registers(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT k AS key, valid AS before, CASE action WHEN 'REMOVED' THEN false WHEN 'RESTORED' THEN true ELSE valid END AS after FROM gained")
def removal_effect(spark, sf_dir):
    """Which records are valid before and after the entries are appended."""
    records, log, registers, held = _registers(spark, sf_dir)
    gained = cut(op.entries(records, log, registers, held))
    before = op.with_state(records, log).select("key", F.col("valid").alias("before"))
    after = op.with_state(records, log.unionByName(gained.select("key", "entry", "action"))).select("key", F.col("valid").alias("after"))
    return before.join(after, "key")


@query(f"""WITH {RECORDS_SQL} SELECT register, k AS key, day, row_number() OVER w AS place, count(*) OVER (PARTITION BY register) AS removed FROM gained WHERE action = 'REMOVED'
    WINDOW w AS (PARTITION BY register ORDER BY day DESC, k) QUALIFY place <= 5""")
def removal_preview(spark, sf_dir):
    """The newest records that each register would remove."""
    records, log, registers, held = _registers(spark, sf_dir)
    return op.preview(records, op.entries(records, log, registers, held), 5).select("register", "key", "day", "place", "removed")


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS id, l_suppkey AS fp, l_linenumber % 3 AS cat FROM lineitem WHERE l_orderkey % 4 = 0),
    s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS key, l_suppkey AS fp, l_linenumber % 3 AS cat, l_orderkey % 3 > 0 AS valid FROM lineitem WHERE l_orderkey % 5 = 0),
    a AS (SELECT *, row_number() OVER (PARTITION BY fp, cat ORDER BY id) AS n FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY fp, cat ORDER BY key) AS n FROM s WHERE valid),
    kept AS (SELECT id, key, a.fp, a.cat FROM a JOIN b ON a.fp = b.fp AND a.cat = b.cat AND a.n = b.n),
    rest AS (SELECT id, fp, row_number() OVER (PARTITION BY fp ORDER BY cat, id) AS n FROM i WHERE id NOT IN (SELECT id FROM kept)),
    free AS (SELECT key, fp, valid, row_number() OVER (PARTITION BY fp ORDER BY valid DESC, cat, key) AS n FROM s WHERE key NOT IN (SELECT key FROM kept)),
    placed AS (SELECT fp, 'KEPT' AS place FROM kept UNION ALL
        SELECT rest.fp, CASE WHEN free.key IS NULL THEN 'NEW' WHEN free.valid THEN 'RECLASSIFIED' ELSE 'RESTORED' END FROM rest LEFT JOIN free ON rest.fp = free.fp AND rest.n = free.n)
    SELECT fp AS fingerprint, place, count(*) AS n FROM placed GROUP BY ALL""")
def record_placement(spark, sf_dir):
    """Where records of a new file go among stored ones of the same fingerprint; how many of each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("fingerprint"), (F.col("l_linenumber") % 3).alias("category"))
    numbered = lines.withColumn("id", F.monotonically_increasing_id())
    incoming = cut(numbered.where("l_orderkey % 4 = 0").select("id", "fingerprint", "category"))
    stored = cut(numbered.where("l_orderkey % 5 = 0").select(F.col("id").alias("key"), "fingerprint", "category", (F.col("l_orderkey") % 3 > 0).alias("valid")))
    found = op.placed(incoming, stored).join(incoming.select("id", "fingerprint"), "id")
    return found.groupBy("fingerprint", "place").agg(F.count("*").alias("n"))
