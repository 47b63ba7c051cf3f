"""Queries on invoices, monthly costs and cost per occupied room."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, money, stats
from hostelry.functions.text import latin_key
from hostelry.operators import costs as op
from hostelry.operators import samples
from hostelry.operators.snapshots import newest
from hostelry.plans import views
from hostelry.plans.expected import OBSERVED_DAYS, summary_sql
from hostelry.plans.expected import capped_sql
from hostelry.plans.registry import query
from hostelry.plans.snapshots import NIGHTLY, nightly
from hostelry.plans.views import AS_OF, LINES_SQL

MONTHLY_SQL = f"""{LINES_SQL},
    monthly AS (
        SELECT property_id, CAST(date_trunc('month', invoice_date) AS DATE) AS month, currency, category, CAST(sum(cents) AS BIGINT) AS cents,
               CAST(sum(abs(cents)) AS BIGINT) AS abs_cents, CAST(sum(abs(cents) * confidence) AS BIGINT) AS weighted,
               count(DISTINCT invoice_id) AS invoices, count(*) AS lines, count(*) FILTER (kind = 'CREDIT_NOTE') AS credit_lines,
               CAST(coalesce(sum(cents) FILTER (kind = 'CREDIT_NOTE'), 0) AS BIGINT) AS credit_cents
        FROM cost_lines GROUP BY ALL
    ),
    covered AS (
        SELECT *, CASE WHEN abs_cents > 0 THEN CAST(floor(weighted * 100 / abs_cents + 0.5) AS BIGINT) END AS confidence_h,
               CASE WHEN month_abs_cents > 0 THEN CAST(floor((known * 10000) / month_abs_cents + 0.5) AS BIGINT) END AS coverage_h
        FROM (SELECT *, CAST(sum(abs_cents) OVER w AS BIGINT) AS month_abs_cents,
                     CAST(sum(CASE WHEN category <> 'OTHER' THEN abs_cents ELSE 0 END) OVER w AS BIGINT) AS known
              FROM monthly WINDOW w AS (PARTITION BY property_id, month, currency))
    )"""
MONTHLY_COLUMNS = "property_id, month, currency, category, cents, abs_cents, weighted, invoices, lines, credit_lines, credit_cents"


@query(f"WITH {MONTHLY_SQL} SELECT {MONTHLY_COLUMNS} FROM monthly")
def monthly_costs(spark, sf_dir):
    return op.monthly(views.cost_lines(spark, sf_dir))


@query(f"WITH {MONTHLY_SQL} SELECT property_id, month, currency, category, month_abs_cents, coverage_h, confidence_h FROM covered")
def cost_coverage(spark, sf_dir):
    covered = op.with_coverage(op.monthly(views.cost_lines(spark, sf_dir)))
    return covered.select("property_id", "month", "currency", "category", "month_abs_cents", "coverage_h", "confidence_h")


@query(f"""WITH {MONTHLY_SQL} SELECT a.property_id, a.month, a.currency, a.category, a.cents, b.cents AS prior_cents, a.cents - b.cents AS delta_cents
    FROM monthly a LEFT JOIN monthly b ON b.property_id = a.property_id AND b.currency = a.currency AND b.category = a.category
        AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)""")
def cost_overview(spark, sf_dir):
    rows = op.monthly(views.cost_lines(spark, sf_dir)).select("property_id", "month", "currency", "category", "cents")
    prior = rows.select("property_id", F.add_months("month", 1).alias("month"), "currency", "category", F.col("cents").alias("prior_cents"))
    out = rows.join(prior, ["property_id", "month", "currency", "category"], "left")
    return out.withColumn("delta_cents", F.col("cents") - F.col("prior_cents"))


@query(f"""WITH {LINES_SQL}, m AS (SELECT DISTINCT property_id, CAST(date_trunc('month', invoice_date) AS DATE) AS month FROM cost_lines WHERE invoice_date < DATE '{AS_OF}')
    SELECT property_id, month FROM m QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY month DESC) <= 12""")
def months_touched(spark, sf_dir):
    lines = views.cost_lines(spark, sf_dir).where(F.col("invoice_date") < views.as_of_day())
    months = lines.select("property_id", dates.month_start(F.col("invoice_date")).alias("month")).distinct()
    by = samples.Window.partitionBy("property_id").orderBy(F.col("month").desc())
    return months.withColumn("n", F.row_number().over(by)).where("n <= 12").drop("n")


@query("""WITH d AS (SELECT l_orderkey AS invoice_id, CASE WHEN l_returnflag = 'R' THEN 'CREDIT_NOTE' ELSE 'INVOICE' END AS kind,
        CAST(sum(round((l_extendedprice - 1000 * (l_linenumber % 2) * l_quantity) * 100)) AS BIGINT) AS net, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT invoice_id, kind, net, CASE WHEN kind = 'CREDIT_NOTE' AND net > 0 THEN -1 ELSE 1 END AS sign FROM d""")
def credit_note_sign(spark, sf_dir):
    amount = F.round((F.col("l_extendedprice") - 1000 * (F.col("l_linenumber") % 2) * F.col("l_quantity")) * 100)
    kind = F.when(F.col("l_returnflag") == "R", "CREDIT_NOTE").otherwise("INVOICE")
    docs = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id"), kind.alias("kind")).agg(F.sum(amount).cast("long").alias("net"))
    none = F.lit(None).cast("long")
    return docs.withColumn("sign", money.document_sign(F.col("kind"), none, F.col("net"), F.col("net")))


CURRENT_SQL = """versions AS (SELECT o_custkey AS supplier_id, o_orderpriority AS record_key, o_orderkey AS revision, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
        o_orderstatus AS mark FROM orders)"""


def versions(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("supplier_id"),
        F.col("o_orderpriority").alias("record_key"),
        F.col("o_orderkey").alias("revision"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderstatus").alias("mark"),
    )


@query(f"""WITH {CURRENT_SQL}, removed AS (SELECT DISTINCT o_orderkey AS revision FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)
    SELECT v.* FROM versions v WHERE NOT EXISTS (SELECT 1 FROM versions w WHERE w.supplier_id = v.supplier_id AND w.record_key = v.record_key AND w.revision > v.revision)
        AND NOT EXISTS (SELECT 1 FROM removed r WHERE r.revision = v.revision)""")
def invoice_current(spark, sf_dir):
    """The latest revision of each invoice that no removal record names."""
    rows = versions(spark, sf_dir)
    removed = rows.where((F.col("mark") == "F") & (F.col("revision") % 3 == 0)).select("revision").distinct()
    return newest(rows, ["supplier_id", "record_key"], F.col("revision").desc()).join(removed, "revision", "left_anti")


PHRASE_SQL = " ".join(
    f"WHEN hits = ['{c}'] THEN '{c}'" for c in op.PHRASES
)
HITS_SQL = "list_filter([{}], lambda x: x IS NOT NULL)".format(
    ", ".join(f"""CASE WHEN {' OR '.join(f"contains(k, ' {p} ')" for p in words)} THEN '{c}' END""" for c, words in op.PHRASES.items())
)


@query(f"""WITH keyed AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS k,
        CASE WHEN p_partkey % 11 = 0 THEN 'SOFTWARE' END AS explicit, CASE WHEN p_partkey % 7 = 0 THEN 'MARKETING' END AS usual FROM part),
    hit AS (SELECT *, {HITS_SQL} AS hits FROM keyed)
    SELECT p_partkey, coalesce(explicit, usual, CASE {PHRASE_SQL} ELSE 'OTHER' END) AS category,
        CASE WHEN explicit IS NOT NULL THEN 100 WHEN usual IS NOT NULL THEN 90 WHEN len(hits) = 1 THEN 80 ELSE 0 END AS confidence,
        CASE WHEN explicit IS NOT NULL THEN 'EXPLICIT_SOURCE' WHEN usual IS NOT NULL THEN 'SUPPLIER_DEFAULT' WHEN len(hits) = 1 THEN 'DETERMINISTIC_RULE' ELSE 'UNCLASSIFIED' END AS method FROM hit""")
def line_classify(spark, sf_dir):
    key = F.col("p_partkey")
    found = op.classified(latin_key(F.col("p_name")), F.when(key % 11 == 0, "SOFTWARE"), F.when(key % 7 == 0, "MARKETING"))
    return views.table(spark, sf_dir, "part").select("p_partkey", found.alias("c")).select("p_partkey", "c.*")


OCCUPIED_SQL = """occupied AS (SELECT property_id, CAST(date_trunc('month', stay_date) AS DATE) AS month, CAST(sum(rooms) AS BIGINT) AS room_nights,
    count(*) AS days, count(*) FILTER (rooms_available IS NULL) AS unknown_days FROM nightly GROUP BY ALL)"""


def occupied(spark, sf_dir):
    return nightly(spark, sf_dir).groupBy("property_id", dates.month_start(F.col("stay_date")).alias("month")).agg(
        F.sum("rooms").alias("room_nights"), F.count("*").alias("days"), F.count_if(F.col("rooms_available").isNull()).alias("unknown_days")
    )


@query(f"{NIGHTLY}, {OCCUPIED_SQL} SELECT property_id, month, room_nights, days, unknown_days, days = day(last_day(month)) AS complete FROM occupied")
def occupied_nights(spark, sf_dir):
    return occupied(spark, sf_dir).withColumn("complete", F.col("days") == F.day(F.last_day("month")))


MICRO_SQL = "CAST(cents AS HUGEINT) * 1000000 // room_nights"
CPOR_SQL = f"""{NIGHTLY}, {OCCUPIED_SQL}, {MONTHLY_SQL},
    metrics AS (SELECT c.*, room_nights, CASE WHEN room_nights > 0 THEN CAST(CASE WHEN cents >= 0 THEN {MICRO_SQL}
            ELSE -((-CAST(cents AS HUGEINT)) * 1000000 // room_nights) END AS BIGINT) END AS cpor
        FROM covered c LEFT JOIN occupied o ON o.property_id = c.property_id AND o.month = c.month)"""


def metrics(spark, sf_dir):
    """Monthly costs with room nights and cost per room in millionths of a cent (towards zero)."""
    rows = op.with_coverage(op.monthly(views.cost_lines(spark, sf_dir)))
    rows = rows.join(occupied(spark, sf_dir).select("property_id", "month", "room_nights"), ["property_id", "month"], "left")
    micro = F.expr("(cast(cents as decimal(20,0)) * 1000000) div room_nights")
    return rows.withColumn("cpor", F.when(F.col("room_nights") > 0, micro))


@query(f"{CPOR_SQL} SELECT property_id, month, currency, category, cents, room_nights, cpor FROM metrics")
def cpor(spark, sf_dir):
    return metrics(spark, sf_dir).select("property_id", "month", "currency", "category", "cents", "room_nights", "cpor")


TARGET_MONTH = "1999-05-01"


@query(f"""{CPOR_SQL},
    cases AS (
        SELECT t.property_id, t.currency, t.category, m.month AS m, m.cpor, m.weighted, m.abs_cents, m.month >= DATE '{AS_OF}' - {OBSERVED_DAYS} AS is_observed
        FROM metrics t JOIN metrics m ON m.property_id = t.property_id AND m.currency = t.currency AND m.category = t.category
        WHERE t.month = DATE '{TARGET_MONTH}' AND m.month < t.month AND m.month >= CAST(t.month - INTERVAL 36 MONTH AS DATE)
            AND least(abs(month(m.month) - month(t.month)), 12 - abs(month(m.month) - month(t.month))) <= 2
            AND m.cpor IS NOT NULL AND m.coverage_h >= 7000
    ),
    {capped_sql('capped', 'cases', 'property_id, currency, category', 'm DESC', 5, 12)},
    sums AS (SELECT property_id, currency, category, count(*) AS n, count(*) FILTER (is_observed) AS observed, count(*) FILTER (NOT is_observed) AS approximate,
            CAST(sum(weighted) AS BIGINT) AS weighted_sum, CAST(sum(abs_cents) AS BIGINT) AS exposure, list_sort(list(cpor)) AS l FROM capped GROUP BY ALL),
    figures AS (SELECT * EXCLUDE (l), {summary_sql('l')} FROM sums),
    scored AS (SELECT *, CAST(floor((0.35::DOUBLE * least(100.0::DOUBLE, n * 100.0::DOUBLE / 8) + 0.25::DOUBLE * ((observed * 100.0::DOUBLE + approximate * 60.0::DOUBLE) / n)
            + 0.2::DOUBLE * (weighted_sum / exposure)
            + 0.2::DOUBLE * least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE - 50.0::DOUBLE * (iqr4 / greatest(abs(median4), 4000000.0::DOUBLE))))) * 100 + 0.5) AS BIGINT) AS score FROM figures),
    judged AS (
        SELECT t.property_id, t.currency, t.category, t.cpor, t.room_nights, t.coverage_h, t.confidence_h, n, median4, p75_4, iqr4,
               least(CASE WHEN observed = 0 THEN least(score, 6500) WHEN approximate > 0 THEN least(score, 8500) ELSE score END,
                     CAST(floor((10000 + coalesce(confidence_h, 0)) / 2 + 0.5) AS BIGINT)) AS confidence
        FROM metrics t LEFT JOIN scored s ON s.property_id = t.property_id AND s.currency = t.currency AND s.category = t.category
        WHERE t.month = DATE '{TARGET_MONTH}'
    )
    SELECT property_id, currency, category, cpor, median4, confidence, CASE WHEN category = 'OTHER' THEN 'NOT_APPLICABLE:CATEGORY_OTHER'
        WHEN room_nights IS NULL THEN 'INSUFFICIENT_DATA:OCCUPANCY_INCOMPLETE' WHEN room_nights = 0 THEN 'NOT_APPLICABLE:ZERO_OCCUPIED_ROOM_NIGHTS'
        WHEN coverage_h < 7000 THEN 'INSUFFICIENT_DATA:CLASSIFICATION_COVERAGE_LOW' WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT_DATA:COMPARABLES_INSUFFICIENT'
        WHEN median4 <= 0 THEN 'NOT_APPLICABLE:EXPECTED_NON_POSITIVE'
        WHEN NOT (4 * cpor > median4 AND 100 * (4 * cpor - median4) >= 20 * median4 AND 8 * cpor >= 2 * p75_4 + 3 * iqr4
            AND CAST(4 * cpor - median4 AS HUGEINT) * CAST(room_nights AS HUGEINT) >= 40000000000) THEN 'CLEAR:CLEAR_WITHIN_EXPECTED_RANGE'
        WHEN confidence < 5500 THEN 'SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE' ELSE 'TRIGGERED:TRIGGER_CPOR_ANOMALY' END AS outcome FROM judged""")
def cpor_anomaly(spark, sf_dir):
    rows = metrics(spark, sf_dir)
    keys = ["property_id", "currency", "category"]
    target = rows.where(F.col("month") == F.to_date(F.lit(TARGET_MONTH)))
    wanted = target.select(*keys, F.explode(op.candidate_months(F.col("month"))).alias("month"))
    cases = wanted.join(rows, [*keys, "month"]).where(F.col("cpor").isNotNull() & (F.col("coverage_h") >= 100 * op.COVERAGE))
    cases = cases.withColumn("is_observed", F.col("month") >= F.date_sub(views.as_of_day(), OBSERVED_DAYS))
    kept = samples.capped(cases, keys, F.col("month").desc(), least=op.LEAST, most=op.MOST)
    figures = kept.groupBy(*keys).agg(
        F.count_if("is_observed").alias("observed"), F.count_if(~F.col("is_observed")).alias("approximate"), F.sum("weighted").alias("weighted"),
        F.sum("abs_cents").alias("exposure"), stats.summary(F.collect_list("cpor")).alias("s"),
    )
    scored = figures.select("*", "s.*").withColumn("score", op.exposure_confidence(8, (0.35, 0.25, 0.2, 0.2), 4_000_000.0))
    scored = scored.select(*keys, "n", "median4", "p75_4", "iqr4", "score")
    quality = F.floor((10000 + F.coalesce("confidence_h", F.lit(0))) / 2 + 0.5).cast("long")
    judged = target.join(scored, keys, "left").withColumn("confidence", F.least("score", quality))
    names = ("category", "room_nights", "coverage_h", "n", "median4", "p75_4", "iqr4", "cpor", "confidence")
    outcome = op.cpor_anomaly({c: F.col(c) for c in names})
    return judged.select(*keys, "cpor", "median4", "confidence", outcome.alias("outcome"))
