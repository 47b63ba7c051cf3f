"""Queries on imported rows: checks, profiles, keys, merges and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions import dates, text
from hostelry.operators import quality as op
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.views import AS_OF, STAYS_SQL, table


@query(f"""WITH {STAYS_SQL}, checked AS (SELECT property_id, list_filter([CASE WHEN booked_on > check_in THEN 'BOOKED_AFTER_ARRIVAL' END,
        CASE WHEN nights < 2 THEN 'SHORT_STAY' END, CASE WHEN revenue_cents <= 100000 THEN 'LOW_AMOUNT' END,
        CASE WHEN status = 'CANCELLED' AND cancelled_on IS NULL THEN 'CANCELLATION_UNDATED' END, CASE WHEN cancelled_on > check_in THEN 'CANCELLED_AFTER_ARRIVAL' END],
        lambda x: x IS NOT NULL) AS issues FROM stays)
    SELECT property_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS valid, count(*) AS n FROM checked GROUP BY ALL""")
def row_validation(spark, sf_dir):
    rules = {
        "BOOKED_AFTER_ARRIVAL": F.col("booked_on") > F.col("check_in"),
        "SHORT_STAY": F.col("nights") < 2,
        "LOW_AMOUNT": F.col("revenue_cents") <= 100000,
        "CANCELLATION_UNDATED": (F.col("status") == "CANCELLED") & F.col("cancelled_on").isNull(),
        "CANCELLED_AFTER_ARRIVAL": F.col("cancelled_on") > F.col("check_in"),
    }
    rows = views.stays(spark, sf_dir).select("property_id", op.issues(rules).alias("issues"))
    rows = rows.select("property_id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("valid"))
    return rows.groupBy("property_id", "issues", "valid").agg(F.count("*").alias("n"))


DATE_TEXTS = """texts AS (SELECT o_orderpriority AS col, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '4-NOT SPECIFIED' THEN '01/02/1999' ELSE 'soon' END AS v FROM orders)"""


@query(f"""WITH {DATE_TEXTS}, parts AS (SELECT col, v, try_cast(regexp_extract(v, '^(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-]\\d{{4}}$', 1) AS INTEGER) AS a,
        try_cast(regexp_extract(v, '^(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-]\\d{{4}}$', 2) AS INTEGER) AS b FROM texts),
    counts AS (SELECT col, count(*) FILTER (regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) AS iso, count(*) FILTER (a > 12) AS day_first, count(*) FILTER (b > 12) AS month_first,
        count(*) FILTER (a <= 12 AND b <= 12) AS either FROM parts GROUP BY ALL)
    SELECT *, CASE WHEN day_first > 0 AND month_first > 0 THEN 'CONFLICT' WHEN day_first > 0 THEN 'DMY' WHEN month_first > 0 THEN 'MDY' WHEN either > 0 THEN 'AMBIGUOUS'
        WHEN iso > 0 THEN 'ISO' ELSE 'UNKNOWN' END AS date_order FROM counts""")
def date_order(spark, sf_dir):
    p, day = F.col("o_orderpriority"), F.col("o_orderdate")
    value = (
        F.when(p == "1-URGENT", F.date_format(day, "dd/MM/yyyy")).when(p == "2-HIGH", F.date_format(day, "MM/dd/yyyy"))
        .when(p == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd")).when(p == "4-NOT SPECIFIED", "01/02/1999").otherwise("soon")
    )
    rows = table(spark, sf_dir, "orders").select(p.alias("col"), value.alias("v"))
    counts = rows.groupBy("col").agg(*(c.alias(n) for n, c in op.date_order(F.col("v")).items()))
    return counts.withColumn("date_order", op.order_name())


@query("""WITH texts AS (SELECT o_orderstatus AS col, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 900) || ',' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
        WHEN o_orderstatus = 'O' THEN (o_orderkey % 900) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders)
    SELECT col, count(*) FILTER (regexp_matches(v, '^-?\\d{1,3}(\\.\\d{3})*,\\d{1,2}$|^-?\\d+,\\d{1,2}$')) AS comma,
        count(*) FILTER (regexp_matches(v, '^-?\\d{1,3}(,\\d{3})*\\.\\d{1,2}$|^-?\\d+\\.\\d{1,2}$')) AS dot, count(*) FILTER (regexp_matches(v, '^-?\\d+$')) AS plain FROM texts GROUP BY ALL""")
def number_style(spark, sf_dir):
    key, s = F.col("o_orderkey"), F.col("o_orderstatus")
    cents = F.lpad((key % 100).cast("string"), 2, "0")
    whole = (key % 900).cast("string")
    value = F.when(s == "F", F.concat_ws(",", whole, cents)).when(s == "O", F.concat_ws(".", whole, cents)).otherwise(key.cast("string"))
    rows = table(spark, sf_dir, "orders").select(s.alias("col"), value.alias("v"))
    return rows.groupBy("col").agg(*(c.alias(n) for n, c in op.number_style(F.col("v")).items()))


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey % 900 + 1) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS v FROM orders)
    SELECT o_orderkey, CAST(((o_orderkey % 900 + 1) * 1000 + o_orderkey % 1000) * 100 + o_orderkey % 100 AS BIGINT) AS cents, NULL::BIGINT AS refused FROM t""")
def locale_numbers(spark, sf_dir):
    key = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    value = F.concat(key % 900 + 1, F.lit("."), pad(key % 1000, 3), F.lit(","), pad(key % 100, 2))
    parsed = text.parse_number(value, ",", ".")
    refused = text.parse_number(value, ".", ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", (parsed * 100).cast("long").alias("cents"), refused.cast("long").alias("refused"))


PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (v IS NULL OR trim(v) = '') AS empty, count(DISTINCT v) AS distinct_values,
    count(*) FILTER (try_cast(v AS DOUBLE) IS NOT NULL) AS numbers, count(*) FILTER (regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS dates, max(length(v)) AS longest
    FROM (SELECT CAST({c} AS VARCHAR) AS v FROM customer)""" for c in PROFILED))
def column_profile(spark, sf_dir):
    return op.profile(table(spark, sf_dir, "customer"), list(PROFILED))


@query("""SELECT lang, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS email,
    count(*) FILTER (regexp_matches(text, '\\+?[0-9][0-9 ().-]{7,}[0-9]')) AS phone, count(*) FILTER (regexp_matches(text, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')) AS iban,
    count(*) FILTER (regexp_matches(text, '[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]')) AS tax_code FROM documents GROUP BY ALL""")
def pii_shapes(spark, sf_dir):
    counts = (F.count_if(F.col("text").rlike(shape)).alias(name) for name, shape in text.SHAPES.items())
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*counts)


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '***', 'g'),
    '\\+?[0-9][0-9 ().-]{7,}[0-9]', '***', 'g'), '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}', '***', 'g'), '[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]', '***', 'g')) AS masked FROM documents""")
def pii_masked(spark, sf_dir):
    masked = text.masked(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("masked"))


@query("""SELECT page_id, trim(regexp_replace(replace(translate(lower(url), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages""")
def text_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.latin_key(F.col("url")).alias("key"))


@query()
def similarity(spark, sf_dir):
    """Ratio and edit distance between neighbouring part names; both are checked in tests."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = parts.join(after, "p_partkey")
    return pairs.select("p_partkey", text.similarity("p_name", "other").alias("ratio"), text.transposing_distance("p_name", "other").alias("distance"))


@query()
def normal_keys(spark, sf_dir):
    """Comparison keys of all part and customer names."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name"))
    return names.distinct().select("name", text.normal_key("name").alias("key"))


@query("""SELECT p_name AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""")
def header_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH stored AS (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS fp, c_custkey % 13 = 0 AS removed FROM customer WHERE c_custkey % 4 <> 0),
    incoming AS (SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS fp FROM customer WHERE c_custkey % 7 <> 0)
    SELECT coalesce(o.k, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN 'ABSENT' WHEN o.k IS NULL THEN 'CREATED' WHEN o.fp <> n.fp OR o.removed THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome
    FROM stored o FULL JOIN incoming n ON o.k = n.k""")
def upsert_outcome(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer")
    stored = rows.where(key % 4 != 0).select("c_custkey", nation.cast("string").alias("fingerprint"), (key % 13 == 0).alias("removed"))
    changed = F.when(key % 5 == 0, nation + 1).otherwise(nation)
    incoming = rows.where(key % 7 != 0).select("c_custkey", changed.cast("string").alias("fingerprint"))
    return op.upsert(stored, incoming, "c_custkey")


@query(f"""WITH {STAYS_SQL}, span AS (SELECT min(check_in) AS a, max(check_in) AS b FROM stays WHERE booking_id % 2 = 0 AND check_in >= DATE '{AS_OF}'),
    held AS (SELECT DISTINCT booking_id FROM stays WHERE booking_id % 2 = 0 AND check_in >= DATE '{AS_OF}')
    SELECT DISTINCT s.booking_id FROM stays s, span WHERE s.check_in BETWEEN a AND b AND s.booking_id NOT IN (SELECT booking_id FROM held)""")
def mark_absent(spark, sf_dir):
    """Stored bookings within the span of a full file that the file does not hold."""
    stays = views.stays(spark, sf_dir).select("booking_id", "check_in")
    file = stays.where((F.col("booking_id") % 2 == 0) & (F.col("check_in") >= views.as_of_day()))
    span = file.agg(F.min("check_in").alias("a"), F.max("check_in").alias("b"))
    inside = stays.join(F.broadcast(span), F.col("check_in").between(F.col("a"), F.col("b")))
    return inside.select("booking_id").distinct().join(file.select("booking_id").distinct(), "booking_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, count(*) AS sharing FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("sharing"))
    return rows.where("sharing > 1")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), z AS (SELECT unnest(['Europe/Rome', 'America/Sao_Paulo', 'Asia/Tokyo', 'America/New_York']) AS zone)
    SELECT day, zone, epoch_us(timezone(zone, CAST(day AS TIMESTAMP))) // 1000000 AS first_second, epoch_us(timezone(zone, CAST(day + 1 AS TIMESTAMP))) // 1000000 AS end_second FROM d, z""")
def local_day_bounds(spark, sf_dir):
    zones = F.explode(F.array(*map(F.lit, ("Europe/Rome", "America/Sao_Paulo", "Asia/Tokyo", "America/New_York")))).alias("zone")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", zones)
    seconds = lambda c: F.unix_timestamp(c)
    return days.select(
        "day", "zone", seconds(dates.local_day_start(F.col("day"), F.col("zone"))).alias("first_second"),
        seconds(dates.local_day_end(F.col("day"), F.col("zone"))).alias("end_second"),
    )


@query("""WITH m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT month, last_day(month) AS last_day, day(last_day(month)) AS days, CAST(month - INTERVAL 1 MONTH AS DATE) AS prior_month,
        least(abs(month(month) - 5), 12 - abs(month(month) - 5)) AS distance FROM m""")
def month_spine(spark, sf_dir):
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-12-01")), F.expr("interval 1 month"))).alias("month"))
    may = F.to_date(F.lit("1999-05-01"))
    return months.select(
        "month", F.last_day("month").alias("last_day"), F.day(F.last_day("month")).alias("days"), F.add_months("month", -1).alias("prior_month"),
        dates.month_distance(F.col("month"), may).alias("distance"),
    )


SEARCHED = ("the", "idiot", "tion", "and", "erst")


@query(f"""WITH words AS (SELECT DISTINCT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents),
    hits AS (SELECT * FROM words WHERE word IN {SEARCHED}), df AS (SELECT word, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS w FROM hits GROUP BY ALL)
    SELECT id, round(sum(w), 6) AS score FROM hits JOIN df USING (word) GROUP BY ALL ORDER BY score DESC, id LIMIT 25""")
def knowledge_search(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return op.idf_search(entries, list(SEARCHED), 25)


@query("""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS found FROM documents)
    SELECT doc_id, len(found) AS numbers, len(list_filter(found, lambda x: NOT list_contains(['1', '2', '3', '10', '100'], x))) AS ungrounded FROM n""")
def number_grounding(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    known = F.array(*map(F.lit, ("1", "2", "3", "10", "100")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found).cast("long").alias("numbers"), F.size(F.array_except(found, known)).cast("long").alias("ungrounded")
    )


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 6 = 0 AS is_total, CAST(round(o_totalprice * 100) AS BIGINT) % CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 1000 END AS cents FROM orders),
    p AS (SELECT *, coalesce(sum(CAST(is_total AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM r),
    s AS (SELECT *, CAST(sum(CASE WHEN NOT is_total THEN cents ELSE 0 END) OVER (PARTITION BY o_custkey, part) AS BIGINT) AS summed FROM p)
    SELECT o_custkey, o_orderkey, cents, summed, CASE WHEN summed = cents THEN 'MATCH' ELSE 'MISMATCH' END AS "check" FROM s WHERE is_total""")
def total_check(spark, sf_dir):
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % F.when(key % 12 == 0, 1).otherwise(1000)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (key % 6 == 0).alias("is_total"), cents.alias("cents"))
    return op.running_check(rows, ["o_custkey"], "o_orderkey", "is_total", "cents").drop("is_total")


@query("""SELECT s_suppkey, s_nationkey, d AS day, (s_suppkey * 7 + i) % 5 * 60 AS minutes FROM supplier, (SELECT unnest(['mon', 'tue', 'wed', 'thu', 'fri']) AS d, unnest([0, 1, 2, 3, 4]) AS i)
    WHERE (s_suppkey * 7 + i) % 5 <> 0""")
def grid_unpivot(spark, sf_dir):
    days = ("mon", "tue", "wed", "thu", "fri")
    grid = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", *(((F.col("s_suppkey") * 7 + i) % 5 * 60).alias(d) for i, d in enumerate(days)))
    return op.unpivoted(grid, ["s_suppkey", "s_nationkey"], list(days))


@query("""SELECT s_suppkey, 'IT' || lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS vat, true AS iban_ok, false AS iban_bad FROM supplier""")
def supplier_identifiers(spark, sf_dir):
    """VAT numbers in one form, and account numbers whose check digits hold or do not."""
    padded = F.lpad(F.col("s_suppkey").cast("string"), 11, "0")
    good, bad = F.lit("IT60 X054 2811 1010 0000 0123 456"), F.lit("IT61X0542811101000000123456")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.vat_number(F.concat_ws(".", padded)).alias("vat"), text.iban_valid(good).alias("iban_ok"), text.iban_valid(bad).alias("iban_bad")
    )


@query("""WITH e AS (SELECT l_suppkey AS supplier, l_partkey % 40 AS vat, l_orderkey % 60 AS name, l_orderkey FROM lineitem)
    SELECT vat, count(DISTINCT name) AS names, count(*) AS n, count(DISTINCT supplier) > 1 AS conflict, min(supplier) AS supplier FROM e GROUP BY ALL""")
def supplier_dedupe(spark, sf_dir):
    """Evidence by identifier: one that names several suppliers is a conflict, not a pick."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 40).alias("vat"), (F.col("l_orderkey") % 60).alias("name")
    )
    return rows.groupBy("vat").agg(
        F.countDistinct("name").alias("names"), F.count("*").alias("n"), (F.countDistinct("supplier") > 1).alias("conflict"), F.min("supplier").alias("supplier")
    )
