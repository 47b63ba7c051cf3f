"""Queries on columns of files: headers in many spellings, related columns, and the choice of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.cells import stemmed
from hostelry.functions.ranks import row_numbers
from hostelry.functions.storage import cut
from hostelry.operators import days
from hostelry.operators import fields as op
from hostelry.plans.registry import query
from hostelry.plans.views import table

#: Files are customers' numbers modulo 40; each of five ways to write headers serves eight of them.
FILES = 40
#: The fields of bookings in order, the share their values fit by, and phrases that name them.
FIELDS = {
    "source_record_id": ("distinct", ("booking id", "reservation number", "booking code", "codice prenotazione")),
    "booked_at": ("dates", ("booked on", "booking date", "created at", "data prenotazione")),
    "check_in": ("dates", ("check in", "arrival date", "check in date", "data arrivo")),
    "check_out": ("dates", ("check out", "departure date", "check out date", "data partenza")),
    "channel": ("texts", ("booking channel", "sales channel", "canale vendita", "provenienza")),
    "room_revenue": ("numbers", ("room revenue", "room amount", "importo camera", "ricavo camera")),
}
#: Phrases that look like a field and mean something else.
OTHERS = {"room_revenue": ("room rate per night", "tariffa camera notte"), "channel": ("channel commission",)}
CONTEXT = ("booking", "bookings", "reservation", "reservations", "prenotazione", "prenotazioni")
#: Five ways to write the headers: as they are, in another order or case, with typing errors, with a word that names the
#: file, and without a name for the booking date (its values tell). The last is a rate, which is no revenue.
WRITTEN = (
    ("Booking ID", "Booked on", "Check in", "Check out", "Sales channel", "Room revenue", "Room rate per night"),
    ("number_reservation", "DateBooking", "CheckInDate", "checkoutdate", "CANALE-VENDITA", "Revenue (EUR) room", "Rate per night, room"),
    ("Reservatoin number", "Data prenotazzione", "Arival date", "Departur date", "Provenienza", "Importo cammera", "Tarifa camera notte"),
    ("Codice prenotazione", "Reservations created at", "Booking arrival date", "Departure date booking", "Prenotazioni provenienza", "Room amount *", "Channel commission"),
    ("Booking code", "Colonna 7", "Data arrivo", "Data partenza", "Canale vendita", "Ricavo camera", "Room rate per night"),
)

FILES_SQL = f"SELECT DISTINCT o_custkey % {FILES} AS f FROM orders"


def booking_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(columns: file, col, header; cells: file, row, col, value): columns turn by the file's number, some rows are broken."""
    orders = table(spark, sf_dir, "orders").withColumn("f", F.col("o_custkey") % FILES)
    k, f = F.col("o_orderkey"), F.col("f")
    day = F.to_date("o_orderdate")
    arrival = F.date_add(day, (k % 60).cast("int"))
    broken = F.when(f % 5 == 0, k % 10 == 3).otherwise(k % 50 == 3)
    departure = F.date_add(arrival, F.when(broken, -3).otherwise(1 + k % 7).cast("int"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    money = F.concat(F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 100"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    slashed = lambda d: F.when(f % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(d.cast("string"))
    channel = F.when(k % 3 == 0, "Booking.com").when(k % 3 == 1, "Direct").otherwise("Agency")
    values = [F.concat(F.lit("B"), k), slashed(day), slashed(arrival), slashed(departure), channel, money, (50 + k % 90).cast("string")]
    turned = lambda i: (i + f) % len(values)
    listed = F.array(*(F.struct(turned(i).cast("int").alias("col"), v.alias("value")) for i, v in enumerate(values)))
    file = F.concat(F.lit("file_"), f)
    cells = orders.select(file.alias("file"), k.alias("row"), F.inline(listed))
    names = F.get(F.array(*(F.array(*map(F.lit, row)) for row in WRITTEN)), (f % len(WRITTEN)).cast("int"))
    headers = F.array(*(F.struct(turned(i).cast("int").alias("col"), F.get(names, i).alias("header")) for i in range(len(values))))
    return orders.select("f").distinct().select(file.alias("file"), F.inline(headers)), cells


def phrases(spark) -> DataFrame:
    rows = [(f, p, False) for f, (_, told) in FIELDS.items() for p in told] + [(f, p, True) for f, told in OTHERS.items() for p in told]
    return spark.createDataFrame(rows, "field string, phrase string, excluded boolean")


@query(f"""WITH files AS ({FILES_SQL}), names AS (SELECT unnest({list(FIELDS)}) AS field, unnest(range({len(FIELDS)})) AS i)
    SELECT 'file_' || f AS file, CAST((i + f) % 7 AS BIGINT) AS col, field FROM files, names WHERE NOT (f % 5 = 4 AND field = 'booked_at')
    UNION ALL SELECT 'file_' || f, CAST((1 + f) % 7 AS BIGINT), 'booked_at' FROM files WHERE f % 5 = 4""")
def column_fields(spark, sf_dir):
    """The field of each column of every file: each column and each field once, one column named by its values alone."""
    columns, cells = booking_files(spark, sf_dir)
    columns, cells = cut(columns), cut(cells)
    profiles = cut(op.column_profiles(cells))
    relations = cut(op.booking_dates(cells, profiles))
    readings = op.read_headers(columns, phrases(spark), CONTEXT)
    found = op.candidates(columns, readings, profiles, {f: share for f, (share, _) in FIELDS.items()}, relations)
    return op.assigned(found, list(FIELDS)).select("file", F.col("col").cast("long").alias("col"), "field")


_DATES_SQL = f"""
    o AS (SELECT o_custkey % {FILES} AS f, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS arrival FROM orders),
    d AS (
        SELECT f, k, day AS v, (1 + f) % 7 AS col FROM o UNION ALL SELECT f, k, arrival, (2 + f) % 7 FROM o
        UNION ALL SELECT f, k, arrival + CAST(CASE WHEN (f % 5 = 0 AND k % 10 = 3) OR (f % 5 <> 0 AND k % 50 = 3) THEN -3 ELSE 1 + k % 7 END AS INTEGER), (3 + f) % 7 FROM o
    ),
    t AS (
        SELECT a.f, a.col AS a, b.col AS b, c.col AS c, count(*) AS checked,
               count(*) FILTER (c.v - b.v BETWEEN 1 AND {op.LONGEST_STAY} AND b.v - a.v BETWEEN 0 AND {op.LONGEST_LEAD}) AS good
        FROM d a JOIN d b ON a.f = b.f AND a.k = b.k AND a.col <> b.col JOIN d c ON a.f = c.f AND a.k = c.k AND c.col <> a.col AND c.col <> b.col GROUP BY ALL
    ),
    held AS (SELECT * FROM t WHERE checked >= {op.LEAST_ROWS} AND 100 * good >= {op.HOLDS} * checked),
    one AS (SELECT f, min(a) AS a, min(b) AS b, min(c) AS c FROM held GROUP BY f HAVING count(*) = 1)"""


@query(f"""WITH {_DATES_SQL}
    SELECT 'file_' || f AS file, a AS col, 'booked_at' AS field, true AS proves FROM one UNION ALL SELECT 'file_' || f, b, 'check_in', true FROM one
    UNION ALL SELECT 'file_' || f, c, 'check_out', true FROM one""")
def related_dates(spark, sf_dir):
    """Columns of dates told apart by their order on nearly all rows; files with many broken rows tell nothing."""
    _, cells = booking_files(spark, sf_dir)
    cells = cut(cells)
    found = op.booking_dates(cells, cut(op.column_profiles(cells, distinct=False).select("file", "col", "n", "dates")))
    return found.select("file", F.col("col").cast("long").alias("col"), "field", "proves")


_AMOUNTS_SQL = f"""
    l AS (
        SELECT l_suppkey % 30 AS f, CAST(round(l_extendedprice * 100) AS BIGINT) AS net, CAST(l_quantity AS BIGINT) * 100 AS qty,
               row_number() OVER (PARTITION BY l_suppkey % 30 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS row FROM lineitem
    ),
    b AS (SELECT *, net * 22 // 100 AS tax, net + net * 22 // 100 + CASE WHEN (f % 6 = 0 AND row % 12 = 1) OR row % 40 = 1 THEN 500 ELSE 0 END AS gross FROM l),
    d AS (
        SELECT f, row, net AS v, f % 4 AS col FROM b UNION ALL SELECT f, row, tax, (1 + f) % 4 FROM b UNION ALL SELECT f, row, gross, (2 + f) % 4 FROM b
        UNION ALL SELECT f, row, qty, (3 + f) % 4 FROM b
    ),
    t AS (
        SELECT a.f, a.col AS a, b.col AS b, c.col AS c, count(*) AS checked, count(*) FILTER (a.v > 0 AND b.v >= 0 AND 100 * b.v <= {op.TAX_RATE} * a.v AND abs(a.v + b.v - c.v) <= 2) AS good
        FROM d a JOIN d b ON a.f = b.f AND a.row = b.row AND a.col <> b.col JOIN d c ON a.f = c.f AND a.row = c.row AND c.col <> a.col AND c.col <> b.col GROUP BY ALL
    ),
    held AS (SELECT * FROM t WHERE checked >= {op.LEAST_ROWS} AND 100 * good >= {op.HOLDS} * checked),
    one AS (SELECT f, min(a) AS a, min(b) AS b, min(c) AS c FROM held GROUP BY f HAVING count(*) = 1)"""


@query(f"""WITH {_AMOUNTS_SQL}
    SELECT 'file_' || f AS file, a AS col, 'invoice_net_amount' AS field FROM one UNION ALL SELECT 'file_' || f, b, 'invoice_tax_amount' FROM one
    UNION ALL SELECT 'file_' || f, c, 'invoice_gross_amount' FROM one""")
def related_amounts(spark, sf_dir):
    """The three columns of a register with net + tax = total on nearly all rows."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    lines = row_numbers(lines.select((F.col("l_suppkey") % 30).alias("f"), *order), ["f"], order, "row")
    rows = lines.select("f", F.round(F.col("l_extendedprice") * 100).cast("long").alias("net"), F.col("l_quantity").cast("long").alias("qty"), "row")
    rows = rows.withColumn("tax", F.expr("net * 22 div 100"))
    broken = ((F.col("f") % 6 == 0) & (F.col("row") % 12 == 1)) | (F.col("row") % 40 == 1)
    rows = rows.withColumn("gross", F.col("net") + F.col("tax") + F.when(broken, 500).otherwise(0))
    two = lambda c: F.concat(F.expr(f"{c} div 100"), F.lit(","), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    values = [two("net"), two("tax"), two("gross"), F.col("qty").cast("string")]
    listed = F.array(*(F.struct(((i + F.col("f")) % 4).cast("int").alias("col"), v.alias("value")) for i, v in enumerate(values)))
    cells = cut(rows.select(F.concat(F.lit("file_"), "f").alias("file"), "row", F.inline(listed)))
    found = op.invoice_amounts(cells, cut(op.column_profiles(cells, distinct=False).select("file", "col", "n", "numbers")))
    return found.select("file", F.col("col").cast("long").alias("col"), "field")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS start FROM orders)
    SELECT 'week_' || k AS file, CAST(i AS BIGINT) AS col, start + CAST(i AS INTEGER) AS day, CASE k % 6 WHEN 0 THEN 'HEADERS' WHEN 5 THEN 'PERSON' ELSE 'TITLE' END AS source
    FROM o, (SELECT unnest(range(7)) AS i) WHERE k % 6 <> 4""")
def day_grids(spark, sf_dir):
    """Dates of the columns of weeks: dates, weekdays after a title, weekdays with days, days and months, days that do not fit, a day that a person names."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    names = F.array(*(F.lit(x) for x in ("Lun", "Martedì", "mer", "Thursday", "Ven.", "sab", "Domenica")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("week_"), k).alias("file"), (k % 6).alias("form"), start.alias("start"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("col"))
    day = F.date_add("start", F.col("col"))
    name = F.get(names, F.weekday(day))
    label = (
        F.when(F.col("form") == 0, day.cast("string")).when(F.col("form").isin(1, 5), name).when(F.col("form") == 2, F.concat(name, F.lit(" "), F.dayofmonth(day).cast("string")))
        .when(F.col("form") == 3, F.date_format(day, "dd/MM")).otherwise(F.concat(name, F.lit(" "), F.dayofmonth(F.date_add(day, 1)).cast("string")))
    )
    anchors = rows.where("col = 0").select("file", F.when(F.col("form").between(1, 4), F.col("start")).alias("title_start"), F.when(F.col("form") == 5, F.date_add("start", (F.col("k") % 7).cast("int"))).alias("person_start"))
    found = days.resolved_days(rows.select("file", "col", label.alias("label")), anchors)
    return found.select("file", F.col("col").cast("long").alias("col"), F.col("on").alias("day"), "source")


#: Groups of fields that each kind of data needs, and words of titles that name it.
DOMAINS = {
    "BOOKINGS": ((("check_in",), ("check_out", "nights"), ("room_revenue",)), "prenotazioni bookings urgent"),
    "COSTS": ((("supplier",), ("invoice_number", "invoice_date"), ("line_total",), ("description",)), "fatture invoices high"),
    "LABOR": ((("work_date",), ("planned_hours", "actual_hours")), "turni ore low"),
}
_DOMAIN_FIELDS = [(d, g, f) for d, (groups, _) in DOMAINS.items() for g, fields in enumerate(groups) for f in fields]
_THRESHOLDS = (op.FLOOR, op.HIGH, op.MEDIUM)


@query(f"""WITH names AS (SELECT unnest({[d for d, _, _ in _DOMAIN_FIELDS]}) AS domain, unnest({[g for _, g, _ in _DOMAIN_FIELDS]}) AS grp, unnest({[f for _, _, f in _DOMAIN_FIELDS]}) AS field, unnest(range({len(_DOMAIN_FIELDS)})) AS j),
    kinds AS (SELECT domain, count(DISTINCT grp) AS n, greatest(4, count(DISTINCT grp)) AS least FROM names GROUP BY ALL),
    chosen AS (SELECT o_orderkey AS k, domain, grp, (o_orderkey // (j + 1)) % 3 + 1 AS level FROM orders, names WHERE (o_orderkey // 7 + 3 * j) % 5 < 3),
    met AS (SELECT k, domain, count(DISTINCT CASE WHEN level >= 2 THEN grp END) AS met, count(*) AS fields FROM chosen GROUP BY ALL),
    titles AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'BOOKINGS' WHEN '2-HIGH' THEN 'COSTS' WHEN '5-LOW' THEN 'LABOR' END AS hit FROM orders),
    raw AS (
        SELECT t.k, x.domain, 58 * coalesce(met, 0) * least + 24 * least(coalesce(fields, 0), least) * n + 18 * (CASE WHEN hit = x.domain THEN 1 ELSE 0 END) * n * least AS above, n * least AS below
        FROM titles t CROSS JOIN kinds x LEFT JOIN met m ON m.k = t.k AND m.domain = x.domain
    ),
    scored AS (SELECT k, domain, (200 * above + below) // (2 * below) AS score FROM raw),
    ranked AS (SELECT k, domain, score, coalesce(lead(score) OVER w, 0) AS next, row_number() OVER w AS place FROM scored WINDOW w AS (PARTITION BY k ORDER BY score DESC, domain)),
    told AS (SELECT *, CASE WHEN score < {_THRESHOLDS[0]} THEN 'LOW' WHEN score >= {_THRESHOLDS[1][0]} AND score - next >= {_THRESHOLDS[1][1]} THEN 'HIGH'
        WHEN score >= {_THRESHOLDS[2][0]} AND score - next >= {_THRESHOLDS[2][1]} THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ranked WHERE place = 1)
    SELECT k AS file, CASE WHEN level <> 'LOW' THEN domain END AS domain, level, CAST(score AS BIGINT) AS score, CAST(score - next AS BIGINT) AS lead FROM told""")
def file_domains(spark, sf_dir):
    """The kind of data of each file, by the fields that were found, their breadth and the title, where it leads far enough."""
    orders = table(spark, sf_dir, "orders")
    names = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(f).alias("field"), F.lit(j).alias("j")) for j, (d, _, f) in enumerate(_DOMAIN_FIELDS)))
    every = orders.select(F.col("o_orderkey").alias("file"), F.inline(names))
    chosen = every.where("(file div 7 + 3 * j) % 5 < 3").select("file", "domain", "field", F.expr("(file div (j + 1)) % 3 + 1").alias("level"))
    groups = spark.createDataFrame(
        [(d, g, list(fields), stemmed(told.split())) for d, (parts, told) in DOMAINS.items() for g, fields in enumerate(parts)], "domain string, group int, fields array<string>, title_words array<string>"
    )
    files = orders.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("Elenco: "), "o_orderpriority").alias("title"))
    found = op.domain_verdicts(op.domain_scores(chosen, files, groups), *_THRESHOLDS)
    return found.select("file", "domain", "level", "score", "lead")
