"""Queries on labor plans, hours and their cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, money
from hostelry.operators import labor as op
from hostelry.operators import samples
from hostelry.plans import views
from hostelry.plans.expected import CONFIDENCE_SQL, OBSERVED_DAYS, RISK_SQL, SCORE_SQL, capped_sql, forecast, risk, season_sql, summary_sql
from hostelry.plans.registry import query
from hostelry.plans.snapshots import NIGHTLY, TOTALS_SQL, nightly
from hostelry.plans.views import AS_OF, LABOR_SQL

CELL_SQL = "property_id, work_date, category"


@query(f"""WITH {LABOR_SQL}, files AS (SELECT property_id, file_no, file_scope, min(work_date) AS a, max(work_date) AS b FROM labor GROUP BY ALL),
    told AS (SELECT {CELL_SQL}, file_no, count(planned_minutes) AS valued, CAST(sum(planned_minutes) AS BIGINT) AS amount FROM labor GROUP BY ALL),
    cells AS (SELECT DISTINCT {CELL_SQL} FROM labor),
    events AS (SELECT {CELL_SQL}, file_no, CASE WHEN valued > 0 THEN 'WIN' ELSE 'SILENT' END AS kind, amount FROM told
        UNION ALL SELECT c.property_id, c.work_date, c.category, f.file_no, 'CLEAR', NULL FROM cells c JOIN files f ON f.property_id = c.property_id AND f.file_scope = 'FULL'
            AND c.work_date BETWEEN f.a AND f.b WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.property_id = c.property_id AND t.work_date = c.work_date
            AND t.category = c.category AND t.file_no = f.file_no)),
    decided AS (SELECT * FROM events WHERE kind <> 'SILENT' QUALIFY row_number() OVER (PARTITION BY {CELL_SQL} ORDER BY file_no DESC) = 1),
    silent AS (SELECT {CELL_SQL}, max(file_no) AS file_no FROM events WHERE kind = 'SILENT' GROUP BY ALL)
    SELECT c.property_id, c.work_date, c.category, coalesce(d.file_no, s.file_no) AS file_no, coalesce(d.kind, 'FALLBACK') AS outcome, d.amount AS minutes
    FROM cells c LEFT JOIN decided d ON d.property_id = c.property_id AND d.work_date = c.work_date AND d.category = c.category
    LEFT JOIN silent s ON s.property_id = c.property_id AND s.work_date = c.work_date AND s.category = c.category""")
def labor_current_plan(spark, sf_dir):
    return op.current_plan(views.labor(spark, sf_dir), "planned_minutes")


WORKED_SQL = f"""day_cells AS (SELECT {CELL_SQL}, count(*) AS rows_, CASE WHEN count(actual_minutes) = count(*) THEN CAST(sum(actual_minutes) AS BIGINT) END AS actual,
    CASE WHEN count(planned_minutes) = count(*) THEN CAST(sum(planned_minutes) AS BIGINT) END AS planned FROM labor GROUP BY ALL)"""


def day_cells(spark, sf_dir):
    return op.all_or_nothing(views.labor(spark, sf_dir), {"actual": "actual_minutes", "planned": "planned_minutes"})


@query(f"""WITH {LABOR_SQL}, {WORKED_SQL} SELECT {CELL_SQL}, coalesce(actual, planned) AS minutes,
    CASE WHEN actual IS NOT NULL THEN 'ACTUAL' WHEN planned IS NOT NULL THEN 'PLANNED' ELSE 'REJECTED' END AS basis FROM day_cells""")
def worked_else_planned(spark, sf_dir):
    basis = F.when(F.col("actual").isNotNull(), "ACTUAL").when(F.col("planned").isNotNull(), "PLANNED").otherwise("REJECTED")
    return day_cells(spark, sf_dir).select(*op.CELL, F.coalesce("actual", "planned").alias("minutes"), basis.alias("basis"))


@query(f"""WITH {LABOR_SQL} SELECT property_id, file_no, category, min(work_date) AS first_day, max(work_date) AS last_day,
    bool_or(planned_minutes IS NOT NULL) AS has_planned, bool_or(actual_minutes IS NOT NULL) AS has_actual FROM labor GROUP BY ALL""")
def labor_coverage(spark, sf_dir):
    return views.labor(spark, sf_dir).groupBy("property_id", "file_no", "category").agg(
        F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day"),
        F.bool_or(F.col("planned_minutes").isNotNull()).alias("has_planned"), F.bool_or(F.col("actual_minutes").isNotNull()).alias("has_actual"),
    )


@query(f"""WITH {LABOR_SQL}, m AS (SELECT property_id, CAST(date_trunc('month', work_date) AS DATE) AS month, coalesce(actual_minutes, planned_minutes) AS minutes, category,
        CASE WHEN category = 'NOT SPECIFIED' THEN 0 WHEN confidence_class = 0 THEN 100 WHEN confidence_class = 1 THEN 95 ELSE 80 END AS confidence FROM labor)
    SELECT property_id, month, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(CASE WHEN category <> 'NOT SPECIFIED' THEN minutes ELSE 0 END) AS BIGINT) AS classified,
        CASE WHEN sum(minutes) > 0 THEN CAST(sum(minutes * confidence) * 100 // sum(minutes) AS BIGINT) END AS confidence_h FROM m WHERE minutes IS NOT NULL GROUP BY property_id, month""")
def labor_quality(spark, sf_dir):
    other = F.col("category") == "NOT SPECIFIED"
    sure = F.when(other, 0).when(F.col("confidence_class") == 0, 100).when(F.col("confidence_class") == 1, 95).otherwise(80)
    rows = views.labor(spark, sf_dir).withColumn("m", F.coalesce("actual_minutes", "planned_minutes")).where(F.col("m").isNotNull())
    sums = rows.groupBy("property_id", dates.month_start(F.col("work_date")).alias("month")).agg(
        F.sum("m").alias("minutes"), F.sum(F.when(other, 0).otherwise(F.col("m"))).cast("long").alias("classified"), F.sum(F.col("m") * sure).alias("w")
    )
    return sums.select("property_id", "month", "minutes", "classified", F.when(F.col("minutes") > 0, F.expr("w * 100 div minutes")).alias("confidence_h"))


@query(f"""{NIGHTLY}, {LABOR_SQL}, m AS (SELECT property_id, CAST(date_trunc('month', work_date) AS DATE) AS month, CAST(sum(actual_minutes) AS BIGINT) AS minutes,
        CAST(sum(actual_cents) AS BIGINT) AS cents, count(*) FILTER (actual_minutes IS NULL) AS gaps FROM labor GROUP BY ALL),
    r AS (SELECT property_id, CAST(date_trunc('month', stay_date) AS DATE) AS month, CAST(sum(revenue_cents) AS BIGINT) AS revenue FROM nightly GROUP BY ALL)
    SELECT m.property_id, m.month, minutes, cents, CASE WHEN minutes > 0 THEN (2 * cents * 60 + minutes) // (2 * minutes) END AS hourly_cents,
        CASE WHEN revenue > 0 THEN (2 * cents * 10000 + revenue) // (2 * revenue) END AS cost_share_h,
        CASE WHEN minutes IS NULL THEN 'NO_HOURS' WHEN gaps > 0 THEN 'INCOMPLETE' WHEN coalesce(revenue, 0) = 0 THEN 'NO_REVENUE' ELSE 'COMPLETE' END AS state
    FROM m LEFT JOIN r ON r.property_id = m.property_id AND r.month = m.month""")
def labor_economics(spark, sf_dir):
    worked = views.labor(spark, sf_dir).groupBy("property_id", dates.month_start(F.col("work_date")).alias("month")).agg(
        F.sum("actual_minutes").alias("minutes"), F.sum("actual_cents").alias("cents"), F.count_if(F.col("actual_minutes").isNull()).alias("gaps")
    )
    revenue = nightly(spark, sf_dir).groupBy("property_id", dates.month_start(F.col("stay_date")).alias("month")).agg(F.sum("revenue_cents").alias("revenue"))
    rows = worked.join(revenue, ["property_id", "month"], "left")
    state = (
        F.when(F.col("minutes").isNull(), "NO_HOURS").when(F.col("gaps") > 0, "INCOMPLETE")
        .when(F.coalesce("revenue", F.lit(0)) == 0, "NO_REVENUE").otherwise("COMPLETE")
    )
    return rows.select(
        "property_id", "month", "minutes", "cents",
        money.half_up(F.col("cents") * 60, F.col("minutes")).alias("hourly_cents"),
        money.half_up(F.col("cents") * 10000, F.col("revenue")).alias("cost_share_h"),
        state.alias("state"),
    )


COMPARED_SQL = f"""{RISK_SQL}, {TOTALS_SQL}, {LABOR_SQL}, {WORKED_SQL},
    demand AS (SELECT property_id, stay_date, CASE WHEN stay_date = DATE '{AS_OF}' THEN 4 * rooms WHEN coalesce(pn, 0) >= 5 THEN forecast4 END AS demand4 FROM joined),
    plan_days AS (SELECT property_id, work_date, CAST(sum(planned) AS BIGINT) AS day_minutes,
        CAST(sum(CASE WHEN category <> 'NOT SPECIFIED' THEN planned ELSE 0 END) AS BIGINT) AS classified FROM day_cells GROUP BY ALL),
    kinds AS (SELECT DISTINCT property_id, category FROM day_cells),
    wanted AS (SELECT k.property_id, k.category, d.stay_date AS work_date, d.demand4, p.work_date IS NOT NULL AS covered, p.day_minutes, p.classified, c.rows_ IS NOT NULL AS scheduled, c.planned
        FROM kinds k JOIN demand d ON d.property_id = k.property_id AND d.stay_date <= DATE '{AS_OF}' + 29
        LEFT JOIN plan_days p ON p.property_id = k.property_id AND p.work_date = d.stay_date
        LEFT JOIN day_cells c ON c.property_id = k.property_id AND c.work_date = d.stay_date AND c.category = k.category),
    cases AS (
        SELECT t.property_id, t.work_date, t.category, h.work_date AS d, coalesce(h.actual, h.planned) AS minutes, h.work_date >= DATE '{AS_OF}' - {OBSERVED_DAYS} AS is_observed
        FROM wanted t JOIN day_cells h ON h.property_id = t.property_id AND h.category = t.category AND h.work_date < DATE '{AS_OF}'
            AND h.work_date BETWEEN t.work_date - 728 AND t.work_date - 7 AND isodow(h.work_date) = isodow(t.work_date)
        JOIN nightly n ON n.property_id = h.property_id AND n.stay_date = h.work_date
        WHERE {season_sql('h.work_date', 't.work_date')} <= 42 AND coalesce(h.actual, h.planned) IS NOT NULL
            AND 20 * abs(4 * n.rooms - t.demand4) <= greatest(240, 4 * greatest(t.demand4, 4))
    ),
    {capped_sql('capped', 'cases', 'property_id, work_date, category', 'd DESC')},
    sums AS (SELECT property_id, work_date, category, count(*) AS n, count(*) FILTER (is_observed) AS observed, count(*) FILTER (NOT is_observed) AS approximate,
        list_sort(list(minutes)) AS l FROM capped GROUP BY ALL),
    figures AS (SELECT * EXCLUDE (l), {summary_sql('l')} FROM sums),
    scored AS (SELECT *, {CONFIDENCE_SQL} AS confidence FROM (SELECT *, {SCORE_SQL} AS score FROM (SELECT *, greatest(abs(median4), 4) AS floor4 FROM figures)))"""


@query(f"""{COMPARED_SQL} SELECT t.property_id, t.work_date, t.category, planned, demand4, n, median4, confidence,
    CASE WHEN t.category = 'NOT SPECIFIED' THEN 'NOT_APPLICABLE:CATEGORY_OTHER' WHEN demand4 IS NULL THEN 'INSUFFICIENT_DATA:DEMAND_FORECAST_INSUFFICIENT'
        WHEN NOT covered THEN 'INSUFFICIENT_DATA:PLAN_MISSING' WHEN NOT scheduled THEN 'NOT_APPLICABLE:NOT_SCHEDULED' WHEN planned IS NULL THEN 'INSUFFICIENT_DATA:PLAN_INCOMPLETE'
        WHEN 100 * classified < 70 * day_minutes THEN 'INSUFFICIENT_DATA:CLASSIFICATION_COVERAGE_LOW' WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT'
        WHEN median4 <= 0 THEN 'NOT_APPLICABLE:EXPECTED_NON_POSITIVE'
        WHEN NOT (4 * planned > median4 AND 100 * (4 * planned - median4) >= 20 * median4 AND 4 * planned - median4 >= 960 AND 8 * planned >= 2 * p75_4 + 3 * iqr4)
            THEN 'CLEAR:CLEAR_WITHIN_EXPECTED_RANGE'
        WHEN confidence < 5500 THEN 'SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE' ELSE 'TRIGGERED:TRIGGER_OVERSTAFFING' END AS outcome
    FROM wanted t LEFT JOIN scored s ON s.property_id = t.property_id AND s.work_date = t.work_date AND s.category = t.category""")
def labor_overstaffing(spark, sf_dir):
    """Every category and day of the next 30: planned minutes against days of like demand, with demand as forecast on the day of report."""
    return overstaffing(day_cells(spark, sf_dir), forecast(risk(spark, sf_dir)), nightly(spark, sf_dir))


def overstaffing(cells, demand, nights):
    demand = demand.where(F.col("stay_date") <= F.date_add(views.as_of_day(), 29)).select(
        "property_id", F.col("stay_date").alias("work_date"), F.when(F.col("basis") != "INSUFFICIENT", F.col("forecast4")).alias("demand4")
    )
    own = F.when(F.col("category") != "NOT SPECIFIED", F.col("planned")).otherwise(0)
    days = cells.groupBy("property_id", "work_date").agg(F.sum("planned").alias("day_minutes"), F.sum(own).alias("classified"), F.lit(True).alias("has_plan"))
    target = cells.select("property_id", "category").distinct().join(demand, "property_id").join(days, ["property_id", "work_date"], "left")
    target = target.join(cells.select(*op.CELL, "planned", F.lit(True).alias("has_rows")), op.CELL, "left")
    target = target.withColumns({"covered": F.col("has_plan").isNotNull(), "scheduled": F.col("has_rows").isNotNull()})
    wanted = target.select(*op.CELL, "demand4", F.explode(dates.same_weekday_before(F.col("work_date"))).alias("d"))
    wanted = wanted.where(F.col("d") < views.as_of_day())
    past = cells.select("property_id", F.col("work_date").alias("d"), "category", F.coalesce("actual", "planned").alias("minutes"))
    past = past.join(nights.select("property_id", F.col("stay_date").alias("d"), "rooms"), ["property_id", "d"])
    cases = wanted.join(past.where(F.col("minutes").isNotNull()), ["property_id", "category", "d"])
    cases = cases.where(20 * F.abs(4 * F.col("rooms") - F.col("demand4")) <= op.tolerance(F.col("demand4")))
    cases = cases.withColumn("is_observed", F.col("d") >= F.date_sub(views.as_of_day(), OBSERVED_DAYS))
    kept = samples.capped(cases, op.CELL, F.col("d").desc(), least=op.LEAST, most=op.MOST)
    figures = samples.sampled(kept, op.CELL, "minutes").withColumn("confidence", samples.confidence()).select(*op.CELL, "confidence", "s.*")
    judged = target.join(figures, op.CELL, "left").withColumn("forecast4", F.col("demand4"))
    names = ("category", "forecast4", "covered", "scheduled", "planned", "classified", "day_minutes", "n", "median4", "p75_4", "iqr4", "confidence")
    outcome = op.overstaffing({c: F.col(c) for c in names})
    return judged.select(*op.CELL, "planned", "demand4", "n", "median4", "confidence", outcome.alias("outcome"))
