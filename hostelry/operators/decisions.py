"""Priority of what detectors raise, and the memory of each problem across days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.money import threshold_progress

#: How far each type can be acted on, and its place among ties.
ACTIONABILITY = {"REV_PICKUP_LOW": 90, "REV_OCCUPANCY_RISK": 85, "REV_OTA_DEPENDENCY": 60, "COST_CPOR_ANOMALY": 70, "LABOR_OVERSTAFFING": 90}
TIE_ORDER = ("REV_OCCUPANCY_RISK", "REV_PICKUP_LOW", "LABOR_OVERSTAFFING", "COST_CPOR_ANOMALY", "REV_OTA_DEPENDENCY")
#: Threshold and saturation of each type's two measures, and whether both are needed.
IMPACT = {
    "REV_PICKUP_LOW": ((20, 40), (2, 4), "least"),
    "REV_OCCUPANCY_RISK": ((10, 20), (3, 6), "greatest"),
    "LABOR_OVERSTAFFING": ((20, 40), (4, 8), "least"),
    "COST_CPOR_ANOMALY": ((20, 40), (1, 1.5), "least"),
    "REV_OTA_DEPENDENCY": ((55, 100), (15, 30), "least"),
}
#: Days ahead up to which an urgency holds; days since a month's end.
FORWARD = ((1, 100), (3, 90), (7, 80), (14, 65), (30, 50), (60, 35))
SINCE = ((7, 70), (30, 55), (60, 40), (90, 25))


def ladder(value: Column, steps: tuple, last: int) -> Column:
    out = F.when(value <= steps[0][0], steps[0][1])
    for most, score in steps[1:]:
        out = out.when(value <= most, score)
    return out.otherwise(last)


def forward_urgency(days: Column) -> Column:
    return ladder(days, FORWARD, 20)


def cost_urgency(days: Column) -> Column:
    return ladder(days, SINCE, 10)


def by_type(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def impact(kind: Column, one: Column, two: Column) -> Column:
    """The least of two progresses where a detector needs both, the greatest where either will do."""
    parts = {}
    for name, (first, second, how) in IMPACT.items():
        parts[name] = getattr(F, how)(threshold_progress(one, *first), threshold_progress(two, *second))
    return by_type(kind, parts)


def priority(impact_: Column, urgency: Column, confidence: Column, actionability: Column) -> Column:
    """The exact weighted sum, which alone decides the order."""
    weighted = lambda c, w: c.cast("decimal(20,6)") * F.lit(w).cast("decimal(3,2)")
    parts = zip((impact_, urgency, confidence, actionability), ("0.40", "0.25", "0.20", "0.15"))
    return sum((weighted(c, w) for c, w in parts), F.lit(0).cast("decimal(20,8)")).cast("decimal(20,8)")


def ranked(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Unique ranks 1..n within ``keys`` by score, its parts, the type's place, target and fingerprint."""
    place = F.array_position(F.array(*map(F.lit, TIE_ORDER)), F.col("decision_type"))
    order = [F.col(c).desc() for c in ("score", "impact", "urgency", "confidence", "actionability")]
    by = Window.partitionBy(*keys).orderBy(*order, place, "target", "fingerprint")
    return candidates.withColumn("rank", F.row_number().over(by))


def deduplicated(signals: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, how many equal ones it stands for, and whether others under the key contradict it."""
    return signals.groupBy(*keys).agg(
        F.min("fingerprint").alias("fingerprint"), (F.count("*") - 1).alias("duplicates"), (F.countDistinct("fingerprint") > 1).alias("conflict")
    )


def transitions(runs: DataFrame) -> DataFrame:
    """Each run's lifecycle step for its identity, in order of run.

    Before the first trigger nothing is remembered. A trigger opens, a clear result
    resolves what is open, a trigger reopens what is resolved; all else leaves the
    state. Only triggers and clear results move it, so the state before a run is
    the last of those: no fold is needed.
    """
    by = Window.partitionBy("identity").orderBy("run_sequence").rowsBetween(Window.unboundedPreceding, -1)
    moves = F.when(F.col("status").isin("TRIGGERED", "CLEAR"), F.col("status"))
    ever = F.coalesce(F.max(F.col("status") == "TRIGGERED").over(by), F.lit(False))
    is_open = F.last(moves, ignorenulls=True).over(by) == "TRIGGERED"
    trigger = F.col("status") == "TRIGGERED"
    step = (
        F.when(~ever & trigger, "OPENED")
        .when(~ever, F.lit(None))
        .when(is_open & trigger, "OBSERVED")
        .when(is_open & (F.col("status") == "CLEAR"), "RESOLVED")
        .when(trigger, "REOPENED")
        .otherwise("NO_STATE_CHANGE")
    )
    return runs.withColumn("transition", step)


def states(steps: DataFrame) -> DataFrame:
    """What is remembered of each identity after its last run."""
    at = lambda *kinds: F.col("transition").isin(*kinds)
    last = F.max_by(F.when(at("OPENED", "OBSERVED", "REOPENED"), "OPEN").otherwise("RESOLVED"), F.when(at("OPENED", "OBSERVED", "REOPENED", "RESOLVED"), F.col("run_sequence")))
    seen = steps.where(F.col("transition").isNotNull())
    out = seen.groupBy("identity").agg(
        last.alias("state"),
        F.min("as_of").alias("first_seen"),
        F.max(F.when(F.col("status") == "TRIGGERED", F.col("as_of"))).alias("last_seen"),
        F.max("as_of").alias("last_evaluated"),
        F.max_by("as_of", F.when(at("RESOLVED"), F.col("run_sequence"))).alias("last_resolved"),
        F.count_if(at("OPENED", "REOPENED")).alias("episodes"),
        F.count_if(F.col("status") == "TRIGGERED").alias("triggered"),
    )
    return out.withColumn("resolved", F.when(F.col("state") == "RESOLVED", F.col("last_resolved"))).drop("last_resolved")


def seek(fields: list[tuple[Column, bool, object]]) -> Column:
    """Rows after a cursor in a mixed-direction order: (column, descending, value) by weight."""
    out, equal = F.lit(False), F.lit(True)
    for column, descending, value in fields:
        ahead = column < F.lit(value) if descending else column > F.lit(value)
        out, equal = out | (equal & ahead), equal & (column == F.lit(value))
    return out
