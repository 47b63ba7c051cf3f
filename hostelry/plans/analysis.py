"""One analysis run: the five detectors over the same books, ranked, and what each decision is known by."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hostelry.functions import hashing
from hostelry.functions.storage import cut
from hostelry.plans import costs, distribution, expected, labor
from hostelry.plans.records import fingerprint_sql
from hostelry.plans.registry import ORACLE_SQL, query
from hostelry.plans.snapshots import nightly
from hostelry.plans.views import AS_OF

#: Each detector's decision type and the columns that name its target.
DETECTORS = {
    "pickup_low": ("REV_PICKUP_LOW", "stay_date"),
    "occupancy_risk": ("REV_OCCUPANCY_RISK", "stay_date"),
    "ota_dependency": ("REV_OTA_DEPENDENCY", f"'{AS_OF}'"),
    "cpor_anomaly": ("COST_CPOR_ANOMALY", "concat_ws('/', currency, category)"),
    "labor_overstaffing": ("LABOR_OVERSTAFFING", "concat_ws('/', CAST(work_date AS {text}), category)"),
}


def evaluations(spark, sf_dir):
    """Outcomes of all detectors: decision_type, property_id, target, status, reason and confidence.

    Revenue detectors and the demand that labor is judged by read the same books, computed once.
    """
    books = expected.Books(spark, sf_dir)
    risk = cut(expected.risk_of(books, spark, sf_dir))
    found = {
        "pickup_low": expected.pickup_of(books, spark, sf_dir),
        "occupancy_risk": expected.occupancy_of(risk),
        "ota_dependency": distribution.ota_dependency(spark, sf_dir),
        "cpor_anomaly": costs.cpor_anomaly(spark, sf_dir),
        "labor_overstaffing": labor.overstaffing(labor.day_cells(spark, sf_dir), expected.forecast(risk), nightly(spark, sf_dir)),
    }
    out = None
    for name, (kind, target) in DETECTORS.items():
        own = found[name].select(
            F.lit(kind).alias("decision_type"), F.col("property_id").cast("int").alias("property_id"), F.expr(target.format(text="STRING")).cast("string").alias("target"),
            F.split_part("outcome", F.lit(":"), F.lit(1)).alias("status"), F.split_part("outcome", F.lit(":"), F.lit(2)).alias("reason"), F.col("confidence").cast("long").alias("confidence"),
        )
        out = own if out is None else out.unionByName(own)
    return out


_ALL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS decision_type, CAST(property_id AS INTEGER) AS property_id, CAST({target.format(text="VARCHAR")} AS VARCHAR) AS target,
        split_part(outcome, ':', 1) AS status, split_part(outcome, ':', 2) AS reason, CAST(confidence AS BIGINT) AS confidence FROM ({ORACLE_SQL[name]})"""
    for name, (kind, target) in DETECTORS.items()
)
_IDENTITY = fingerprint_sql({"decision_type": "decision_type", "property": "property_id", "target": "target"})


@query(f"""WITH evaluations AS ({_ALL})
    SELECT *, {_IDENTITY} AS identity, CASE WHEN status = 'TRIGGERED' THEN row_number() OVER (PARTITION BY property_id, status ORDER BY confidence DESC, decision_type, target) END AS place FROM evaluations""")
def analysis_run(spark, sf_dir):
    """All evaluations of a run with the identity that memory keeps them by, and the place of what is triggered among its property's."""
    identity = hashing.fingerprint(decision_type=F.col("decision_type"), property=F.col("property_id"), target=F.col("target"))
    order = Window.partitionBy("property_id", "status").orderBy(F.col("confidence").desc_nulls_last(), "decision_type", "target")
    place = F.when(F.col("status") == "TRIGGERED", F.row_number().over(order))
    return evaluations(spark, sf_dir).withColumns({"identity": identity, "place": place})


@query(f"""WITH evaluations AS ({_ALL})
    SELECT decision_type, property_id, count(*) AS evaluated, count(*) FILTER (status = 'TRIGGERED') AS triggered, count(*) FILTER (status = 'INSUFFICIENT_DATA') AS insufficient,
        CASE WHEN count(*) FILTER (status = 'TRIGGERED') > 0 THEN 'ATTENTION' WHEN count(*) = count(*) FILTER (status = 'INSUFFICIENT_DATA') THEN 'NO_DATA' ELSE 'CLEAR' END AS state FROM evaluations GROUP BY decision_type, property_id""")
def domain_states(spark, sf_dir):
    """Per property and detector: how much could be judged, and the state that it is shown in."""
    status = F.col("status")
    counts = evaluations(spark, sf_dir).groupBy("decision_type", "property_id").agg(
        F.count("*").alias("evaluated"), F.count_if(status == "TRIGGERED").alias("triggered"), F.count_if(status == "INSUFFICIENT_DATA").alias("insufficient")
    )
    state = F.when(F.col("triggered") > 0, "ATTENTION").when(F.col("evaluated") == F.col("insufficient"), "NO_DATA").otherwise("CLEAR")
    return counts.withColumn("state", state)
