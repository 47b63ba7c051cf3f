"""Queries on imported rows: dates and amounts as written, row checks, documents, registers and memory keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, hashing, money, text
from hostelry.operators import records as op
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.views import AS_OF, LABOR_SQL, LINES_SQL, STAYS_SQL, table


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, dayofyear(make_date(2000, month(day), day(day))) AS position, CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS concluded FROM d""")
def season_positions(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", dates.season_position(F.col("day")).cast("long").alias("position"), dates.last_concluded_month(F.col("day")).alias("concluded"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 AS form FROM orders)
    SELECT o_orderkey, CASE WHEN form IN (0, 1, 2, 3, 4) THEN day END AS parsed,
        CASE form WHEN 1 THEN isodow(day) - 1 WHEN 5 THEN isodow(day) % 7 END AS weekday FROM d""")
def date_texts(spark, sf_dir):
    """Dates as people write them: Italian names, a weekday before an English one, day first, ISO; a wrong weekday and no date are refused."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    months = F.array(*(F.lit(m) for m in ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")))
    italian = F.concat_ws(" ", F.day(day), F.get(months, F.month(day) - 1), F.year(day))
    english = F.date_format(day, "d-MMM-yyyy")
    wrong = F.concat(F.date_format(F.date_add(day, 1), "EEEE"), F.lit(" "), english)
    form = (
        F.when(key % 7 == 0, italian).when(key % 7 == 1, F.concat(F.date_format(day, "EEE"), F.lit(", "), english)).when(key % 7 == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 7 == 3, F.date_format(day, "yyyy-MM-dd")).when(key % 7 == 4, F.date_format(day, "MMM d, yyyy")).when(key % 7 == 5, wrong).otherwise("31 febbraio 1999")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", form.alias("v"))
    return rows.select("o_orderkey", dates.parsed_date(F.col("v"), "dd/MM/yyyy").alias("parsed"), dates.leading_weekday(F.col("v")).cast("long").alias("weekday"))


@query("""WITH d AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), s AS (SELECT y, unnest([3, 10, 6]) AS m FROM d),
    e AS (SELECT y, m, CAST(last_day(make_date(y, m, 1)) - CAST(isodow(last_day(make_date(y, m, 1))) % 7 AS INTEGER) AS DATE) AS sunday FROM s),
    t AS (SELECT sunday, unnest([1, 2, 3]) AS h, m FROM e WHERE y >= 1996)
    SELECT sunday + to_hours(h) + to_minutes(30) AS moment, CASE WHEN m = 3 AND h = 2 THEN 'GAP' WHEN m = 10 AND h = 2 THEN 'OVERLAP' ELSE 'VALID' END AS state FROM t""")
def local_time_states(spark, sf_dir):
    """Half past one, two and three on the Sundays on which clocks change in Rome, and on one on which they do not."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct().where("y >= 1996")
    months = years.select("y", F.explode(F.array(F.lit(3), F.lit(10), F.lit(6))).alias("m"))
    ends = months.select(F.last_day(F.make_date("y", "m", F.lit(1))).alias("last"))
    sunday = F.date_sub("last", ((F.weekday("last") + 1) % 7).cast("int"))
    moments = ends.select(F.explode(F.array(*(sunday.cast("timestamp") + F.expr(f"INTERVAL '{h}:30' HOUR TO MINUTE") for h in (1, 2, 3)))).alias("moment"))
    return moments.select("moment", dates.local_time_state(F.col("moment"), "Europe/Rome").alias("state"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS form FROM orders)
    SELECT o_orderkey, CASE form WHEN 0 THEN day WHEN 1 THEN CAST(date_trunc('month', day) AS DATE) END AS first_day,
        CASE form WHEN 0 THEN day + 6 WHEN 1 THEN last_day(day) END AS last_day FROM d""")
def title_periods(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    told = lambda d: F.date_format(d, "dd/MM/yyyy")
    title = (
        F.when(key % 4 == 0, F.concat(F.lit("Turni dal "), told(day), F.lit(" al "), told(F.date_add(day, 6))))
        .when(key % 4 == 1, F.concat(F.lit("Schedule for "), F.date_format(day, "MMMM yyyy")))
        .when(key % 4 == 2, F.concat(F.lit("Dal "), told(day), F.lit(" al "), told(F.date_sub(day, 1)))).otherwise("Room 2024")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.title_period(title).alias("p")).select("o_orderkey", "p.first_day", "p.last_day")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 1000) AS BIGINT) + l_linenumber AS k, l_orderkey % 5 AS f FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST((CASE WHEN f = 4 THEN -1 ELSE 1 END) * ((k + 5) // 10) AS BIGINT) AS cents,
        CASE WHEN f = 4 THEN 'NEGATIVE' WHEN k % 10 <> 0 THEN 'TOO_PRECISE' END AS issue FROM t""")
def booking_amounts(spark, sf_dir):
    """Amounts of three decimals to the cent, half away from zero, and what their strict reading says."""
    key = F.col("l_orderkey")
    thousandths = F.round(F.col("l_extendedprice") * 1000).cast("long") + F.col("l_linenumber")
    amount = F.when(key % 5 == 4, -1).otherwise(1) * thousandths.cast("decimal(18,0)") / F.lit(1000).cast("decimal(5,0)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amount.cast("decimal(20,3)").alias("a"))
    return rows.select("l_orderkey", "l_linenumber", (money.to_money(F.col("a")) * 100).cast("long").alias("cents"), money.amount_issue(F.col("a"), 2).alias("issue"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size END AS parsed,
    CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size * 10 AS VARCHAR) WHEN 2 THEN p_size || '.5' ELSE '0' END AS canonical FROM part""")
def plain_numbers(spark, sf_dir):
    """Whole numbers as written ("3", "3,00", "3.0", "3.5") and decimals as plain text."""
    size, form = F.col("p_size"), F.col("p_partkey") % 4
    written = F.concat(size, F.when(form == 0, "").when(form == 1, ",00").when(form == 2, ".0").otherwise(".5"))
    amount = F.when(form == 0, size).when(form == 1, size * 10).when(form == 2, size + F.lit("0.5").cast("decimal(2,1)")).otherwise(0)
    exact = amount.cast("decimal(20,4)") * F.when(form == 3, -1).otherwise(1)
    return table(spark, sf_dir, "part").select("p_partkey", money.parsed_integer(written).alias("parsed"), money.canonical_text(exact.cast("decimal(20,4)")).alias("canonical"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey % 4 AS rooms, CASE WHEN c_custkey % 5 > 1 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS own FROM customer),
    m AS (SELECT c_nationkey % 4 AS rooms, CAST(floor(median(CAST(round(c_acctbal * 100) AS BIGINT)) * 2 + 0.5) AS BIGINT) AS twice FROM customer WHERE c_acctbal > 0 AND c_nationkey % 4 <> 3 GROUP BY ALL)
    SELECT c_custkey, CASE WHEN own > 0 THEN 'OWN' WHEN twice IS NOT NULL THEN 'COMPARABLE_MEDIAN' END AS basis,
        CASE WHEN own > 0 THEN 2 * own * r.rooms ELSE twice * r.rooms END AS twice_gap_cents FROM r LEFT JOIN m ON m.rooms = r.rooms""")
def gap_proxies(spark, sf_dir):
    """Rooms at risk at the night's own rate, else at the median of its comparables' positive rates, else unknown."""
    key, rooms = F.col("c_custkey"), (F.col("c_nationkey") % 4).alias("rooms")
    rate = F.round(F.col("c_acctbal") * 100).cast("long")
    rows = table(spark, sf_dir, "customer").select("c_custkey", rooms, F.when(key % 5 > 1, rate).alias("own"), rate.alias("rate"))
    known = rows.where("rate > 0 AND rooms <> 3").groupBy("rooms").agg(F.floor(F.percentile("rate", 0.5) * 2 + 0.5).cast("long").alias("twice"))
    rows = rows.join(F.broadcast(known), "rooms", "left")
    own = F.col("own") > 0
    basis = F.when(own, "OWN").when(F.col("twice").isNotNull(), "COMPARABLE_MEDIAN")
    twice = F.when(own, 2 * F.col("own")).otherwise(F.col("twice"))
    return rows.select("c_custkey", basis.alias("basis"), money.gap_proxy(F.col("rooms"), twice).cast("long").alias("twice_gap_cents"))


@query("""SELECT page_id, upper(trim(regexp_replace(url, '\\s+', ' ', 'g'))) AS number, substr(regexp_extract(url, '([^/\\\\]*)$', 1), 1, 255) AS file FROM pages""")
def document_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.document_number(url).alias("number"), text.safe_file_name(url).alias("file"))


BOOKING_CHECK_SQL = f"""WITH {STAYS_SQL}, r AS (SELECT property_id, booking_id, l_partkey, booked_on, check_in, CASE WHEN l_partkey % 17 = 0 THEN check_in ELSE check_in + nights END AS check_out,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE status END AS status, l_partkey % 13 = 0 AS odd_status, CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE rooms END AS rooms,
        CASE WHEN l_partkey % 19 = 0 THEN -1 ELSE 1 END * revenue_cents AS cents, cancelled_on, l_partkey % 23 = 0 AS undated FROM stays),
    i AS (SELECT *, list_filter([CASE WHEN undated THEN 'booked_at:REQUIRED_VALUE_MISSING' END, CASE WHEN odd_status THEN 'status:UNKNOWN_STATUS' END,
        CASE WHEN rooms <= 0 THEN 'rooms:NOT_POSITIVE' END, CASE WHEN cents < 0 THEN 'room_revenue:NEGATIVE' END, CASE WHEN check_out <= check_in THEN 'check_out:CHECK_OUT_NOT_AFTER_CHECK_IN' END,
        CASE WHEN cancelled_on IS NOT NULL AND status <> 'CANCELLED' THEN 'cancelled_at:CANCELLED_AT_WITHOUT_CANCELLATION' END,
        CASE WHEN NOT undated AND cancelled_on < booked_on THEN 'cancelled_at:CANCELLED_BEFORE_BOOKED' END], lambda x: x IS NOT NULL) AS issues FROM r)"""


@query(f"""{BOOKING_CHECK_SQL} SELECT property_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS valid, count(*) AS n FROM i GROUP BY ALL""")
def booking_rows(spark, sf_dir):
    """Bookings as texts, read and checked field by field: all problems of a row at once."""
    s, part = views.stays(spark, sf_dir), F.col("l_partkey")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    out = F.when(part % 17 == 0, F.col("check_in")).otherwise(F.expr("date_add(check_in, nights)"))
    cents = F.when(part % 19 == 0, -F.col("revenue_cents")).otherwise(F.col("revenue_cents"))
    rows = s.select(
        "property_id", F.concat_ws("-", "booking_id", "l_partkey").alias("source_record_id"), F.when(part % 23 == 0, " ").otherwise(day("booked_on")).alias("booked_at_text"),
        day("check_in").alias("check_in_text"), day(out).alias("check_out_text"), F.when(part % 13 == 0, "maybe").otherwise(F.col("status")).alias("status_text"),
        F.when(part % 11 == 0, "0").otherwise(F.concat("rooms", F.lit(",0"))).alias("rooms_text"), (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("string").alias("room_revenue_text"), "cancelled_on",
    )
    c = {f"{f}_text": F.col(f"{f}_text") for f in ("booked_at", "check_in", "check_out", "status", "rooms", "room_revenue")}
    c |= {f: dates.parsed_date(F.col(f"{f}_text"), "dd/MM/yyyy") for f in ("booked_at", "check_in", "check_out")}
    c |= {
        "source_record_id": F.col("source_record_id"), "rooms": money.parsed_integer(F.col("rooms_text")), "room_revenue": text.parse_number(F.col("room_revenue_text"), ".", ","),
        "status": F.when(F.col("status_text").isin("CONFIRMED", "CHECKED_IN", "CHECKED_OUT", "CANCELLED", "NO_SHOW"), F.col("status_text")), "cancelled_at": F.col("cancelled_on"),
    }
    # Each text is read once for all checks that look at it.
    read = rows.select("property_id", *(v.alias(name) for name, v in c.items()))
    found = read.select("property_id", op.booking_issues({name: F.col(name) for name in c}).alias("issues"))
    found = found.select("property_id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("valid"))
    return found.groupBy("property_id", "issues", "valid").agg(F.count("*").alias("n"))


def _told(name: str, sql: str) -> str:
    return f"'{name}=' || coalesce(length(CAST({sql} AS VARCHAR)) || ':' || CAST({sql} AS VARCHAR), '~')"


def fingerprint_sql(fields: dict[str, str]) -> str:
    """SQL of a fingerprint of named expressions."""
    return f"sha256({" || '|' || ".join(_told(n, fields[n]) for n in sorted(fields))})"


@query(f"""WITH {STAYS_SQL} SELECT booking_id, l_partkey, {fingerprint_sql({"booked_at": "booked_on", "cancelled_at": "cancelled_on", "channel_key": "lower(priority)",
    "check_in": "check_in", "rooms": "rooms", "room_revenue": "revenue_cents", "status": "status"})} AS fingerprint FROM stays""")
def booking_fingerprint(spark, sf_dir):
    rows = views.stays(spark, sf_dir).select(
        "booking_id", "l_partkey", F.col("booked_on").alias("booked_at"), F.col("cancelled_on").alias("cancelled_at"), F.lower("priority").alias("channel_key"),
        "check_in", "rooms", F.col("revenue_cents").alias("room_revenue"), "status", "property_id",
    )
    return op.content_fingerprint(rows, op.BOOKING_FIELDS).select("booking_id", "l_partkey", "fingerprint")


def set_sql(fingerprint: str) -> str:
    """SQL of the fingerprint of a multiset of fingerprints."""
    part = lambda at: f"CAST(sum(CAST(('0x' || substr({fingerprint}, {at}, 15)) AS HUGEINT)) AS VARCHAR)"
    return f"sha256(count({fingerprint}) || ':' || {part(1)} || ':' || {part(16)})"


@query(f"""WITH {LINES_SQL}, l AS (SELECT *, {fingerprint_sql({"line_number": "line_number", "cents": "cents", "kind": "kind"})} AS f FROM cost_lines),
    g AS (SELECT invoice_id, min(struct_pack(o := line_number, v := invoice_date)).v AS invoice_date, min(struct_pack(o := line_number, v := currency)).v AS currency,
        array_to_string(list_filter([CASE WHEN min(invoice_date) <> max(invoice_date) THEN 'invoice_date' END, CASE WHEN min(currency) <> max(currency) THEN 'currency' END], lambda x: x IS NOT NULL), ',') AS conflicts,
        count(*) AS lines, {set_sql('f')} AS s FROM l GROUP BY ALL)
    SELECT invoice_id, conflicts, lines, {fingerprint_sql({"invoice_id": "invoice_id", "invoice_date": "invoice_date", "currency": "currency", "_lines": "s"})} AS fingerprint FROM g""")
def invoice_documents(spark, sf_dir):
    """Lines grouped into documents: header fields that do not agree, and a fingerprint that the category plays no part in."""
    found = op.documents(views.cost_lines(spark, sf_dir), ["invoice_id"], ["invoice_date", "currency"], ["cents", "kind"], "line_number")
    return found.select("invoice_id", F.array_join("conflicts", ",").alias("conflicts"), "lines", "fingerprint")


@query(f"""WITH {LABOR_SQL}, e AS (SELECT property_id, file_no, {fingerprint_sql({"work_date": "work_date", "category": "category", "planned": "planned_minutes", "actual": "actual_minutes", "cost": "actual_cents"})} AS f FROM labor)
    SELECT property_id, file_no, count(*) AS entries, {set_sql('f')} AS fingerprint FROM e GROUP BY property_id, file_no""")
def labor_fingerprint(spark, sf_dir):
    """A file's entries as a multiset: two files with the same entries in another order are the same."""
    own = hashing.fingerprint(work_date=F.col("work_date"), category=F.col("category"), planned=F.col("planned_minutes"), actual=F.col("actual_minutes"), cost=F.col("actual_cents"))
    rows = views.labor(spark, sf_dir).select("property_id", "file_no", own.alias("f"))
    return rows.groupBy("property_id", "file_no").agg(F.count("*").alias("entries"), hashing.set_fingerprint(F.col("f")).alias("fingerprint"))


_SEAL = {"decision_type": "event_type", "property": "user_id % 50", "target": "event_id % 97"}
_IDENTITY = fingerprint_sql(_SEAL)


@query(f"""WITH e AS (SELECT event_id, event_type, {_IDENTITY} AS identity, CAST(ts AS DATE) AS as_of, CASE WHEN value > 50 THEN 'TRIGGERED' ELSE 'CLEAR' END AS status FROM events)
    SELECT event_id, identity, {fingerprint_sql({"identity": "identity", "as_of": "as_of", "status": "status"})} AS observation,
        {fingerprint_sql({"version": "'v1'", "identity": "identity", "actions": "CASE WHEN status = 'TRIGGERED' THEN event_type || ':review' END"})} AS recommendation FROM e""")
def decision_keys(spark, sf_dir):
    """A decision's identity (never the day of report), what one observation of it says, and what is recommended on it."""
    identity = hashing.fingerprint(decision_type=F.col("event_type"), property=F.col("user_id") % 50, target=F.col("event_id") % 97)
    status = F.when(F.col("value") > 50, "TRIGGERED").otherwise("CLEAR")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", identity.alias("identity"), F.to_date("ts").alias("as_of"), status.alias("status"))
    actions = F.when(F.col("status") == "TRIGGERED", F.concat("event_type", F.lit(":review")))
    return rows.select(
        "event_id", "identity", hashing.fingerprint(identity=F.col("identity"), as_of=F.col("as_of"), status=F.col("status")).alias("observation"),
        hashing.fingerprint(version=F.lit("v1"), identity=F.col("identity"), actions=actions).alias("recommendation"),
    )


REGISTRY_SQL = """registry AS (SELECT 'VAT' AS kind, 'V' || s_suppkey AS value, s_suppkey AS supplier FROM supplier UNION ALL SELECT 'TAX', 'T' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'IBAN', 'I' || s_suppkey, s_suppkey FROM supplier),
    evidence AS (SELECT o_orderkey AS document, 'VAT' AS kind, 'V' || (o_custkey % 300) AS value FROM orders WHERE o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 'IBAN', 'I' || (CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END % 300) FROM orders
        UNION ALL SELECT o_orderkey, 'TAX', 'T' || (CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey % 300 END) FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"""WITH {REGISTRY_SQL}, n AS (SELECT document, min(supplier) AS a, max(supplier) AS b FROM evidence LEFT JOIN registry USING (kind, value) GROUP BY ALL),
    c AS (SELECT DISTINCT e.document FROM evidence e JOIN n ON n.document = e.document AND a = b WHERE e.kind <> 'IBAN' AND EXISTS (SELECT 1 FROM registry r WHERE r.supplier = a AND r.kind = e.kind)
        AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.supplier = a AND r.kind = e.kind AND r.value = e.value))
    SELECT n.document, CASE WHEN a IS NULL THEN 'NONE' WHEN a <> b OR c.document IS NOT NULL THEN 'CONFLICT' ELSE 'MATCH' END AS outcome,
        CASE WHEN a = b AND c.document IS NULL THEN a END AS supplier FROM n LEFT JOIN c ON c.document = n.document""")
def supplier_plan(spark, sf_dir):
    """Documents' identifiers against the register of suppliers: a match, nothing, or a conflict that is never merged."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    known = lambda kind, mark: s.select(F.lit(kind).alias("kind"), F.concat(F.lit(mark), "s_suppkey").alias("value"), F.col("s_suppkey").alias("supplier"))
    registry = known("VAT", "V").union(known("TAX", "T").where("supplier % 2 = 0")).union(known("IBAN", "I"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    told = lambda kind, mark, v: orders.select(o.alias("document"), F.lit(kind).alias("kind"), F.concat(F.lit(mark), v).alias("value"))
    evidence = told("VAT", "V", c % 300).where("document % 3 <> 0").union(told("IBAN", "I", F.when(o % 5 == 0, c + 1).otherwise(c) % 300))
    evidence = evidence.union(told("TAX", "T", F.when(o % 7 == 0, -1).otherwise(c % 300)).where("document % 2 = 0"))
    return op.supplier_plan(evidence, registry)


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey % 40 AS f, o_orderstatus AS c FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT o_orderkey AS id, o_custkey % 40 AS f, o_orderstatus AS c FROM orders WHERE o_orderkey % 3 = 1),
    i1 AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY id) AS n FROM i), s1 AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY id) AS n FROM s),
    k AS (SELECT i1.id, s1.id AS stored_id FROM i1 JOIN s1 USING (f, c, n)),
    i2 AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS n FROM i WHERE id NOT IN (SELECT id FROM k)), s2 AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS n FROM s WHERE id NOT IN (SELECT stored_id FROM k))
    SELECT id, stored_id, 'KEEP' AS outcome FROM k UNION ALL SELECT i2.id, s2.id, CASE WHEN s2.id IS NULL THEN 'NEW' ELSE 'RECLASSIFY' END FROM i2 LEFT JOIN s2 ON s2.f = i2.f AND s2.n = i2.n""")
def multiset_placement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("f"), F.col("o_orderstatus").alias("c"))
    return op.placed(rows.where("id % 3 = 0"), rows.where("id % 3 = 1"), "f", "c")


@query(f"""WITH {LABOR_SQL}, plan AS (SELECT property_id, work_date, category, file_no, CAST(sum(planned_minutes) AS BIGINT) AS minutes FROM labor WHERE planned_minutes IS NOT NULL GROUP BY ALL),
    w AS (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY property_id, work_date, category ORDER BY file_no DESC) = 1),
    o AS (SELECT * FROM plan WHERE file_no < 3 QUALIFY row_number() OVER (PARTITION BY property_id, work_date, category ORDER BY file_no DESC) = 1)
    SELECT property_id, count(*) AS cells FROM (SELECT property_id, work_date, category, minutes FROM o EXCEPT ALL SELECT property_id, work_date, category, minutes FROM w) GROUP BY ALL""")
def effect_preview(spark, sf_dir):
    """Cells of the plan that the newest file would clear or change, by property."""
    rows = views.labor(spark, sf_dir).where("planned_minutes IS NOT NULL")
    plan = rows.groupBy("property_id", "work_date", "category", "file_no").agg(F.sum("planned_minutes").alias("minutes"))
    keys = ["property_id", "work_date", "category"]
    newest = lambda df: df.groupBy(*keys).agg(F.max_by("minutes", "file_no").alias("minutes"))
    return op.cleared(newest(plan.where("file_no < 3")), newest(plan)).groupBy("property_id").agg(F.count("*").alias("cells"))


@query("""WITH f AS (SELECT o_orderkey AS file_id, o_custkey % 20 AS source, sha256(CAST(o_custkey % 90 AS VARCHAR)) AS content, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS state, o_orderdate AS at FROM orders)
    SELECT source, content, max(file_id) AS latest, count(*) AS files FROM f WHERE state = 'SUCCEEDED' GROUP BY ALL""")
def duplicate_files(spark, sf_dir):
    """The latest file of each content that a source has imported with success."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 20).alias("source"), F.sha2((F.col("o_custkey") % 90).cast("string"), 256).alias("content")
    )
    return rows.groupBy("source", "content").agg(F.max("file_id").alias("latest"), F.count("*").alias("files"))


@query(f"""WITH m AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '{AS_OF}' - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month),
    days AS (SELECT n_nationkey AS property_id, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day FROM m, nation),
    held AS (SELECT DISTINCT s_nationkey AS property_id, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT d.property_id, CAST(date_trunc('month', d.day) AS DATE) AS month, count(*) AS missing FROM days d LEFT JOIN held h ON h.property_id = d.property_id AND h.day = d.day WHERE h.day IS NULL GROUP BY ALL""")
def history_backfill(spark, sf_dir):
    """Days of concluded months that no snapshot is stored for, by property and month."""
    last = F.last_day(dates.last_concluded_month(views.as_of_day()))
    day = F.explode(F.sequence(F.to_date(F.lit("1997-01-01")), last)).alias("day")
    spine = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("property_id"), day)
    held = views.stays(spark, sf_dir).select("property_id", F.col("check_in").alias("day")).distinct()
    missing = spine.join(held, ["property_id", "day"], "left_anti")
    return missing.groupBy("property_id", dates.month_start(F.col("day")).alias("month")).agg(F.count("*").alias("missing"))


@query("""WITH s AS (SELECT c_nationkey AS property_id, c_custkey AS source_id FROM customer WHERE c_custkey % 6 = 0), ok AS (SELECT DISTINCT o_custkey AS source_id FROM orders WHERE o_orderstatus = 'F'),
    p AS (SELECT n_nationkey AS property_id FROM nation WHERE n_nationkey % 7 = 0), r AS (SELECT * FROM s WHERE source_id IN (SELECT source_id FROM ok) AND property_id NOT IN (SELECT property_id FROM p))
    SELECT property_id, count(*) AS sources, CASE WHEN count(*) = 1 THEN min(source_id) END AS enrolled FROM r GROUP BY ALL""")
def enrolment(spark, sf_dir):
    """Properties without a policy whose sources have imported with success; one source alone is enrolled."""
    sources = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.col("c_nationkey").alias("property_id"), F.col("c_custkey").alias("source_id"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source_id"))
    policies = table(spark, sf_dir, "nation").where("n_nationkey % 7 = 0").select(F.col("n_nationkey").alias("property_id"))
    ready = sources.join(done, "source_id", "left_semi").join(policies, "property_id", "left_anti")
    return ready.groupBy("property_id").agg(F.count("*").alias("sources"), F.when(F.count("*") == 1, F.min("source_id")).alias("enrolled"))


@query("""WITH r AS (SELECT user_id % 40 AS property_id, count(*) FILTER (event_type = 'error' OR value < 20) AS failed, max(ts) FILTER (event_type = 'error' OR value < 20) AS last_failed, max(ts) AS last_at FROM events GROUP BY ALL)
    SELECT property_id, failed, CASE WHEN hour(last_at) < 5 THEN 'NOT_DUE_YET' WHEN failed >= 30 THEN 'ATTEMPTS_EXHAUSTED' WHEN last_at - last_failed < INTERVAL 2 HOUR THEN 'RETRY_NOT_DUE_YET' END AS skip_reason FROM r""")
def due_properties(spark, sf_dir):
    """Properties at their last instant: due, too early in the day, tried too often, or tried just now."""
    bad = (F.col("event_type") == "error") | (F.col("value") < 20)
    runs = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("property_id")).agg(
        F.count_if(bad).alias("failed"), F.max(F.when(bad, F.col("ts"))).alias("last_failed"), F.max("ts").alias("at")
    )
    recent = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("last_failed").cast("timestamp")) < 2 * 3600 * 1_000_000
    reason = F.when(F.hour("at") < 5, "NOT_DUE_YET").when(F.col("failed") >= 30, "ATTEMPTS_EXHAUSTED").when(recent, "RETRY_NOT_DUE_YET")
    return runs.select("property_id", "failed", reason.alias("skip_reason"))
