"""Queries on comparable nights, expected baselines, curve pairs and the revenue detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, stats
from hostelry.functions.storage import cut
from hostelry.operators import revenue, samples
from hostelry.operators import snapshots as op
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.snapshots import BASE, CERTAINTY, stays_within
from hostelry.plans.views import AS_OF, NIGHTS

#: Days before the report for which snapshots were observed as they happened.
OBSERVED_DAYS = 400

SEASON = """CASE WHEN strftime({a}, '%m%d') = '0229' OR strftime({b}, '%m%d') = '0229' THEN {leap} ELSE least({leap}, {plain}) END"""
_ON = "dayofyear(make_date({year}, month({d}), least(day({d}), CASE WHEN {year} = 2001 AND month({d}) = 2 THEN 28 ELSE 31 END)))"


def _circle(a: str, b: str, year: int, length: int) -> str:
    apart = f"abs({_ON.format(year=year, d=a)} - {_ON.format(year=year, d=b)})"
    return f"least({apart}, {length} - {apart})"


def season_sql(a: str, b: str) -> str:
    return SEASON.format(a=a, b=b, leap=_circle(a, b, 2000, 366), plain=_circle(a, b, 2001, 365))


def quartile_sql(array: str, q: int) -> str:
    place = f"((len({array}) - 1) * {q})"
    return f"(4 * {array}[{place} // 4 + 1] + ({place} % 4) * ({array}[least({place} // 4 + 2, len({array}))] - {array}[{place} // 4 + 1]))"


def summary_sql(array: str) -> str:
    return (
        f"{quartile_sql(array, 2)} AS median4, {quartile_sql(array, 1)} AS p25_4, {quartile_sql(array, 3)} AS p75_4, "
        f"{quartile_sql(array, 3)} - {quartile_sql(array, 1)} AS iqr4"
    )


CONFIDENCE_SQL = """CASE WHEN observed = 0 THEN least(score, 6500) WHEN approximate > 0 THEN least(score, 8500) ELSE score END"""
SCORE_SQL = """(2 * (least(12, n) * 4000 * n * floor4 + (observed * 100 + approximate * 60) * 420 * floor4
    + greatest(0, least(100 * floor4, 100 * floor4 - 50 * iqr4)) * 300 * n) + 12 * n * floor4) // (24 * n * floor4)"""

TARGETS_SQL = f"""
    targets AS (
        SELECT n_nationkey AS property_id, DATE '{AS_OF}' AS as_of, CAST(d AS DATE) AS stay_date
        FROM nation, (SELECT unnest(generate_series(DATE '{AS_OF}', DATE '{AS_OF}' + {NIGHTS - 1}, INTERVAL 1 DAY)) AS d)
    ),
    candidates AS (
        SELECT * FROM (
            SELECT t.*, t.stay_date - CAST(7 * k AS INTEGER) AS candidate_stay,
                   t.stay_date - CAST(7 * k AS INTEGER) - CAST(t.stay_date - t.as_of AS INTEGER) AS candidate_snapshot
            FROM targets t, (SELECT unnest(range(1, 105)) AS k)
        ) WHERE candidate_snapshot < as_of AND {season_sql('candidate_stay', 'stay_date')} <= 42
    )"""


def books_sql(name: str, cells: str) -> str:
    return f"""
    {name} AS (
        SELECT property_id, snapshot_day, stay_date,
               CAST(coalesce(sum(rooms) FILTER (state = 'CERTAIN'), 0) AS BIGINT) AS rooms,
               CAST(coalesce(sum(rooms) FILTER (state = 'UNCERTAIN'), 0) AS BIGINT) AS uncertain_rooms
        FROM (SELECT c.*, n.rooms, CASE WHEN n.booked_on IS NOT NULL THEN {CERTAINTY.format(day='c.snapshot_day')} END AS state
              FROM ({cells}) c LEFT JOIN stay_nights n ON n.property_id = c.property_id AND n.night = c.stay_date)
        GROUP BY ALL
    )"""


def capped_sql(name: str, source: str, keys: str, order: str, least: int = 5, most: int = 24) -> str:
    return f"""
    {name} AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY is_observed DESC, {order}) AS recency FROM (
                SELECT *, count(*) FILTER (is_observed) OVER (PARTITION BY {keys}) AS n_observed FROM {source})
            WHERE is_observed OR n_observed < {least})
        WHERE recency <= {most}
    )"""


CELLS_SQL = """SELECT DISTINCT property_id, candidate_snapshot AS snapshot_day, candidate_stay AS stay_date FROM candidates
    UNION SELECT DISTINCT property_id, candidate_snapshot - 7, candidate_stay FROM candidates
    UNION SELECT DISTINCT property_id, candidate_stay, candidate_stay FROM candidates
    UNION SELECT property_id, as_of, stay_date FROM targets UNION SELECT property_id, as_of - 7, stay_date FROM targets"""
PREFIX = f"{BASE}, {TARGETS_SQL}, {books_sql('books', CELLS_SQL)}"


def sample_sql(name: str, join: str, value: str, where: str) -> str:
    """Per target: counts, summary and confidence of one sample of the candidates."""
    return f"""
    {name}_rows AS (
        SELECT c.property_id, c.stay_date, c.candidate_stay, {value} AS v,
               c.candidate_snapshot >= DATE '{AS_OF}' - {OBSERVED_DAYS} AS is_observed
        FROM candidates c JOIN books a ON a.property_id = c.property_id AND a.snapshot_day = c.candidate_snapshot AND a.stay_date = c.candidate_stay
        {join} WHERE a.uncertain_rooms = 0 {where}
    ),
    {capped_sql(f'{name}_capped', f'{name}_rows', 'property_id, stay_date', 'candidate_stay DESC')},
    {name}_sums AS (
        SELECT property_id, stay_date, count(*) AS n, count(*) FILTER (is_observed) AS observed, count(*) FILTER (NOT is_observed) AS approximate,
               list_sort(list(v)) AS l FROM {name}_capped GROUP BY property_id, stay_date
    ),
    {name}_figures AS (SELECT *, {summary_sql('l')} FROM {name}_sums),
    {name} AS (
        SELECT *, {CONFIDENCE_SQL} AS confidence FROM (SELECT *, {SCORE_SQL} AS score FROM (SELECT *, greatest(abs(median4), 4) AS floor4 FROM {name}_figures))
    )"""


BASELINE_SQL = sample_sql("baseline", "", "a.rooms", "")
PICKUP_SQL = sample_sql(
    "pickups",
    "JOIN books b ON b.property_id = c.property_id AND b.snapshot_day = c.candidate_snapshot - 7 AND b.stay_date = c.candidate_stay",
    "a.rooms - b.rooms",
    "AND b.uncertain_rooms = 0",
)
FINAL_JOIN = "JOIN books b ON b.property_id = c.property_id AND b.snapshot_day = c.candidate_stay AND b.stay_date = c.candidate_stay"
FINAL_WHERE = f"AND b.uncertain_rooms = 0 AND c.candidate_stay < DATE '{AS_OF}'"
REMAINING_SQL = sample_sql("remaining", FINAL_JOIN, "b.rooms - a.rooms", FINAL_WHERE)
FINALS_SQL = sample_sql("finals", FINAL_JOIN, "b.rooms", FINAL_WHERE)


def targets(spark, sf_dir):
    day = views.as_of_day()
    stay = F.explode(F.sequence(day, F.date_add(day, NIGHTS - 1))).alias("stay_date")
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("property_id"), day.alias("as_of"), stay)


class Books:
    """Targets, candidates, and the books at every cell that any of them needs."""

    def __init__(self, spark, sf_dir):
        self.targets = targets(spark, sf_dir)
        self.candidates = samples.candidates(self.targets)
        c = self.candidates
        at = lambda df, snapshot, stay: df.select("property_id", snapshot.alias("snapshot_day"), F.col(stay).alias("stay_date"))
        cells = (
            at(c, F.col("candidate_snapshot"), "candidate_stay")
            .union(at(c, F.date_sub("candidate_snapshot", 7), "candidate_stay"))
            .union(at(c, F.col("candidate_stay"), "candidate_stay"))
            .union(at(self.targets, F.col("as_of"), "stay_date"))
            .union(at(self.targets, F.date_sub("as_of", 7), "stay_date"))
            .distinct()
        )
        # Every sample below reads them; one row for a cell, whatever the number of stays.
        self.books = cut(
            op.on_books(op.nights(stays_within(spark, sf_dir, F.date_sub(views.as_of_day(), dates.HORIZON_DAYS), F.date_add(views.as_of_day(), NIGHTS - 1))), cells).select(
                "property_id", "snapshot_day", "stay_date", "rooms", "uncertain_rooms"
            )
        )
        day = F.date_sub(views.as_of_day(), OBSERVED_DAYS)
        anchors = self.at(c, F.col("candidate_snapshot"), "candidate_stay", "a")
        self.anchored = anchors.withColumn("is_observed", F.col("candidate_snapshot") >= day)

    def at(self, rows, snapshot, stay, name):
        """``rows`` with the books at (snapshot, stay) as name_rooms and name_uncertain."""
        b = self.books.toDF("_p", "_s", "_d", f"{name}_rooms", f"{name}_uncertain")
        same = (F.col("property_id") == F.col("_p")) & (snapshot == F.col("_s")) & (F.col(stay) == F.col("_d"))
        return rows.join(b, same).drop("_p", "_s", "_d")

    def sample(self, rows, value):
        rows = rows.withColumn("v", value)
        kept = samples.capped(rows, ["property_id", "stay_date"], F.col("candidate_stay").desc())
        return samples.sampled(kept, ["property_id", "stay_date"], "v").withColumn("confidence", samples.confidence())

    def baseline(self):
        return self.sample(self.anchored.where("a_uncertain = 0"), F.col("a_rooms"))

    def pickups(self):
        pairs = self.at(self.anchored, F.date_sub("candidate_snapshot", 7), "candidate_stay", "b")
        return self.sample(pairs.where("a_uncertain = 0 AND b_uncertain = 0"), F.col("a_rooms") - F.col("b_rooms"))

    def final_pairs(self):
        pairs = self.at(self.anchored, F.col("candidate_stay"), "candidate_stay", "b")
        return pairs.where((F.col("a_uncertain") == 0) & (F.col("b_uncertain") == 0) & (F.col("candidate_stay") < F.col("as_of")))


@query(f"WITH {TARGETS_SQL} SELECT property_id, stay_date, candidate_stay, candidate_snapshot FROM candidates")
def eligible_dates(spark, sf_dir):
    return samples.candidates(targets(spark, sf_dir)).select("property_id", "stay_date", "candidate_stay", "candidate_snapshot")


@query(f"""WITH raw AS (SELECT CAST(o_orderdate AS DATE) AS candidate_stay, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 40 AS INTEGER) AS candidate_snapshot,
        DATE '{AS_OF}' + CAST(o_custkey % 60 AS INTEGER) AS stay_date, CAST(o_orderkey % 40 AS INTEGER) AS lead_c, CAST(o_custkey % 60 AS INTEGER) AS lead FROM orders)
    SELECT coalesce(CASE WHEN candidate_stay >= stay_date THEN 'STAY_DATE_NOT_BEFORE_TARGET' WHEN candidate_snapshot >= DATE '{AS_OF}' THEN 'SNAPSHOT_NOT_BEFORE_TARGET'
        WHEN lead_c <> lead THEN 'LEAD_TIME_MISMATCH' WHEN candidate_stay NOT BETWEEN stay_date - 730 AND stay_date - 1 THEN 'OUTSIDE_HORIZON'
        WHEN isodow(candidate_stay) <> isodow(stay_date) THEN 'WEEKDAY_MISMATCH' WHEN {season_sql('candidate_stay', 'stay_date')} > 42 THEN 'OUTSIDE_SEASONAL_WINDOW' END,
        'COMPARABLE') AS exclusion, count(*) AS n FROM raw GROUP BY ALL""")
def exclusion_reasons(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    lead_c, lead = ((F.col(k) % m).cast("int") for k, m in (("o_orderkey", 40), ("o_custkey", 60)))
    stay, candidate = F.date_add(views.as_of_day(), lead), F.to_date("o_orderdate")
    reason = samples.calendar_exclusion(stay, views.as_of_day(), lead, candidate, F.date_sub(candidate, lead_c))
    return orders.select(F.coalesce(reason, F.lit("COMPARABLE")).alias("exclusion")).groupBy("exclusion").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, {season_sql('day', f"DATE '{AS_OF}'")} AS distance, {season_sql('day', "DATE '2000-02-29'")} AS from_leap_day FROM d""")
def seasonal_distance(spark, sf_dir):
    days = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    distance = lambda to: dates.season_distance(F.col("day"), F.to_date(F.lit(to)))
    return days.select("day", distance(AS_OF).alias("distance"), distance("2000-02-29").alias("from_leap_day"))


FIGURES = ("median4", "p25_4", "p75_4", "iqr4")


def _sample_query(sample):
    return sample.select(
        "property_id", "stay_date", "observed", "approximate", *(F.col(f"s.{f}").cast("long").alias(f) for f in FIGURES), "confidence"
    )


@query(f"{PREFIX}, {BASELINE_SQL} SELECT property_id, stay_date, observed, approximate, median4, p25_4, p75_4, iqr4, confidence FROM baseline")
def expected_baseline(spark, sf_dir):
    return _sample_query(Books(spark, sf_dir).baseline())


@query(f"{PREFIX}, {PICKUP_SQL} SELECT property_id, stay_date, observed, approximate, median4, p25_4, p75_4, iqr4, confidence FROM pickups")
def pair_selection(spark, sf_dir):
    return _sample_query(Books(spark, sf_dir).pickups())


NOW_SQL = """now AS (SELECT t.*, n.rooms, n.uncertain_rooms, CASE WHEN p.uncertain_rooms = 0 THEN p.rooms END AS prior, i.rooms_available AS available
    FROM targets t JOIN books n ON n.property_id = t.property_id AND n.snapshot_day = t.as_of AND n.stay_date = t.stay_date
    JOIN books p ON p.property_id = t.property_id AND p.snapshot_day = t.as_of - 7 AND p.stay_date = t.stay_date
    LEFT JOIN inventory i ON i.property_id = t.property_id AND i.stay_date = t.stay_date)"""


def now(b: Books, spark, sf_dir):
    rows = b.at(b.at(b.targets, F.col("as_of"), "stay_date", "n"), F.date_sub("as_of", 7), "stay_date", "p")
    rows = rows.join(views.inventory(spark, sf_dir).withColumnRenamed("rooms_available", "available"), ["property_id", "stay_date"], "left")
    return rows.withColumn("rooms", F.col("n_rooms")).withColumn("prior", F.when(F.col("p_uncertain") == 0, F.col("p_rooms")))


def named(sample, name):
    return sample.select(
        "property_id",
        "stay_date",
        (F.col("observed") + F.col("approximate")).alias(f"{name}_n"),
        F.col("s.median4").alias(f"{name}4"),
        F.col("confidence").alias(f"{name}_confidence"),
    )


@query(f"""{PREFIX}, {BASELINE_SQL}, {PICKUP_SQL}, {NOW_SQL},
    joined AS (SELECT now.*, b.n AS bn, p.n AS pn, p.median4 AS e4, 4 * (rooms - prior) AS a4, least(b.confidence, p.confidence) AS conf FROM now
        LEFT JOIN baseline b ON b.property_id = now.property_id AND b.stay_date = now.stay_date
        LEFT JOIN pickups p ON p.property_id = now.property_id AND p.stay_date = now.stay_date)
    SELECT property_id, stay_date, rooms, prior, e4 AS expected4, conf AS confidence,
        CASE WHEN available = 0 THEN 'NOT_APPLICABLE:PROPERTY_CLOSED_FOR_STAY_DATE' WHEN available - rooms <= 1 THEN 'NOT_APPLICABLE:PICKUP_NEAR_SOLD_OUT'
        WHEN coalesce(bn, 0) < 5 THEN 'INSUFFICIENT_DATA:EXPECTED_BASELINE_INSUFFICIENT' WHEN prior IS NULL THEN 'INSUFFICIENT_DATA:PICKUP_PRIOR_OBSERVATION_MISSING'
        WHEN coalesce(pn, 0) < 5 THEN 'INSUFFICIENT_DATA:PAIR_SAMPLE_INSUFFICIENT' WHEN e4 <= 0 THEN 'NOT_APPLICABLE:PICKUP_EXPECTATION_NON_POSITIVE'
        WHEN NOT (100 * (a4 - e4) <= -20 * e4 AND e4 - a4 >= 8) THEN 'CLEAR:CLEAR_WITHIN_EXPECTED_RANGE'
        WHEN conf < 5000 THEN 'SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE' ELSE 'TRIGGERED:TRIGGER_PICKUP_SHORTFALL' END AS outcome FROM joined""")
def pickup_low(spark, sf_dir):
    return pickup_of(Books(spark, sf_dir), spark, sf_dir)


def pickup_of(b: Books, spark, sf_dir):
    keys = ["property_id", "stay_date"]
    rows = now(b, spark, sf_dir).join(named(b.baseline(), "baseline"), keys, "left").join(named(b.pickups(), "expected"), keys, "left")
    rows = rows.withColumn("confidence", F.when(F.col("expected_n").isNotNull() & F.col("baseline_n").isNotNull(), F.least("baseline_confidence", "expected_confidence")).otherwise(F.coalesce("baseline_confidence", "expected_confidence")))
    c = {k: F.col(v) for k, v in {"rooms": "rooms", "available": "available", "baseline_n": "baseline_n", "prior": "prior", "pairs": "expected_n", "expected4": "expected4", "confidence": "confidence"}.items()}
    return rows.select(*keys, "rooms", "prior", "expected4", "confidence", revenue.pickup_low(c).alias("outcome"))


RISK_SQL = f"""{PREFIX}, {BASELINE_SQL}, {REMAINING_SQL}, {FINALS_SQL}, {NOW_SQL},
    joined AS (SELECT now.*, b.n AS bn, r.n AS pn, r.median4 AS r4, f.median4 AS f4, greatest(0, 4 * rooms + r.median4) AS forecast4,
            greatest(0, f.median4 - greatest(0, 4 * rooms + r.median4)) AS short4, least(b.confidence, r.confidence) AS conf FROM now
        LEFT JOIN baseline b ON b.property_id = now.property_id AND b.stay_date = now.stay_date
        LEFT JOIN remaining r ON r.property_id = now.property_id AND r.stay_date = now.stay_date
        LEFT JOIN finals f ON f.property_id = now.property_id AND f.stay_date = now.stay_date)"""


def risk(spark, sf_dir):
    return risk_of(Books(spark, sf_dir), spark, sf_dir)


def risk_of(b: Books, spark, sf_dir):
    keys = ["property_id", "stay_date"]
    pairs = b.final_pairs()
    rows = now(b, spark, sf_dir).join(named(b.baseline(), "baseline"), keys, "left")
    rows = rows.join(named(b.sample(pairs, F.col("b_rooms") - F.col("a_rooms")), "remaining"), keys, "left")
    return rows.join(named(b.sample(pairs, F.col("b_rooms")), "final"), keys, "left").withColumn(
        "confidence", F.least("baseline_confidence", "remaining_confidence")
    )


@query(f"""{RISK_SQL} SELECT property_id, stay_date, rooms, available, f4 AS final4, r4 AS remaining4, conf AS confidence,
    CASE WHEN available IS NULL THEN 'INSUFFICIENT_DATA:ROOM_INVENTORY_UNKNOWN' WHEN available = 0 THEN 'NOT_APPLICABLE:PROPERTY_CLOSED_FOR_STAY_DATE'
        WHEN rooms >= available THEN 'NOT_APPLICABLE:OCCUPANCY_SOLD_OUT' WHEN coalesce(bn, 0) < 5 THEN 'INSUFFICIENT_DATA:EXPECTED_BASELINE_INSUFFICIENT'
        WHEN coalesce(pn, 0) < 5 THEN 'INSUFFICIENT_DATA:PAIR_SAMPLE_INSUFFICIENT'
        WHEN NOT (100 * short4 >= 40 * available OR short4 >= 12) THEN 'CLEAR:CLEAR_WITHIN_EXPECTED_RANGE'
        WHEN conf < 5500 THEN 'SUPPRESSED_LOW_CONFIDENCE:LOW_CONFIDENCE'
        WHEN 100 * short4 >= 40 * available AND short4 >= 12 THEN 'TRIGGERED:TRIGGER_OCCUPANCY_AND_ROOM_SHORTFALL'
        WHEN 100 * short4 >= 40 * available THEN 'TRIGGERED:TRIGGER_OCCUPANCY_GAP' ELSE 'TRIGGERED:TRIGGER_ROOM_SHORTFALL' END AS outcome FROM joined""")
def occupancy_risk(spark, sf_dir):
    return occupancy_of(risk(spark, sf_dir))


def occupancy_of(rows):
    c = {k: F.col(v) for k, v in {"rooms": "rooms", "available": "available", "baseline_n": "baseline_n", "pairs": "remaining_n", "final4": "final4", "remaining4": "remaining4", "confidence": "confidence"}.items()}
    return rows.select(
        "property_id", "stay_date", "rooms", "available", "final4", "remaining4", "confidence", revenue.occupancy_risk(c).alias("outcome")
    )


@query(f"""{RISK_SQL} SELECT property_id, stay_date, CASE WHEN stay_date = DATE '{AS_OF}' THEN 4 * rooms ELSE forecast4 END AS forecast4,
    CASE WHEN stay_date = DATE '{AS_OF}' THEN 'OBSERVED' WHEN coalesce(pn, 0) < 5 THEN 'INSUFFICIENT' ELSE 'FORECAST' END AS basis FROM joined""")
def demand_forecast(spark, sf_dir):
    """Final rooms in quarters: today's are observed, later nights add the expected rest."""
    return forecast(risk(spark, sf_dir))


def forecast(rows):
    today = F.col("stay_date") == F.col("as_of")
    rooms4 = F.when(today, 4 * F.col("rooms")).when(F.col("remaining4").isNull(), F.greatest(F.lit(0), F.col("remaining4") * 0))
    rooms4 = rooms4.otherwise(revenue.forecast4(F.col("rooms"), F.col("remaining4")))
    basis = F.when(today, "OBSERVED").when(F.coalesce("remaining_n", F.lit(0)) < 5, "INSUFFICIENT").otherwise("FORECAST")
    return rows.select("property_id", "stay_date", rooms4.alias("forecast4"), basis.alias("basis"))


@query(f"""WITH l AS (SELECT l_orderkey AS key, list_sort(list(CAST(l_quantity AS BIGINT))) AS v FROM lineitem GROUP BY ALL)
    SELECT key, len(v) AS n, {summary_sql('v')} FROM l""")
def percentile_macro(spark, sf_dir):
    sample = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        stats.summary(F.collect_list(F.col("l_quantity").cast("long"))).alias("s")
    )
    return sample.select("key", F.col("s.n").cast("long").alias("n"), *(F.col(f"s.{f}").alias(f) for f in FIGURES))
