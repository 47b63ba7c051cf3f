"""Tables in sheets: where they are, what each row is, and whether totals add up.

Cells come as rows (file, sheet, row, col, value), so a sheet is never one value. Headers
are looked for near a sheet's top only; what the rows of a table are is decided over
stretches of rows with a few neighbours at both ends, as no rule looks further, so that
a sheet of any length is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions import cells as words
from hostelry.functions.bound import bound
from hostelry.functions.storage import cut

SHEET = ["file", "sheet"]
#: Rows in which headers are looked for, filled rows that a table is judged by, tables of a sheet.
HEADER_ROWS, HEAD, TABLES = 150, 400, 3
#: Filled rows of a stretch, neighbours that it sees at each end, and rows that a rule looks ahead.
STRETCH, MARGIN, AHEAD = 4096, 12, 5


def row_features(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row for each filled row of a sheet, with what its cells say.

    ``merged`` has the widest merged block of rows: file, sheet, row, width.
    """
    value = F.trim(F.regexp_replace("value", r"\s+", " "))
    told = cells.where(~words.is_empty(F.col("value"))).select(*SHEET, "row", "col", value.alias("text"), words.kind(F.col("value")).alias("kind"))
    is_text = F.col("kind") == "TEXT"
    # Only texts are looked at for words of headers.
    stems = bound(F.col("text"), words.tokens)
    lexical = F.when(is_text, F.arrays_overlap(stems, F.array(*map(F.lit, words.stemmed(words.HEADER_WORDS))))).otherwise(False)
    told = told.withColumn("key", words.folded(F.col("text"))).withColumn("lexical", lexical)
    count = lambda condition: F.sum(condition.cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("col", "kind", "text", "key")))
    rows = told.groupBy(*SHEET, "row").agg(
        F.count("*").cast("int").alias("n"), count(is_text).alias("n_text"), count(F.col("kind").isin("NUMBER", "TIME")).alias("n_value"),
        count(F.col("kind") == "DATE").alias("n_date"), count(is_text & F.col("lexical")).alias("n_lexical"), listed.alias("cells"),
    )
    texts = F.filter("cells", lambda c: c["kind"] == "TEXT")
    first = F.get(texts, 0)
    days = F.transform(F.filter("cells", lambda c: c["text"].rlike(r"^\d{4}-\d{2}-\d{2}$")), lambda c: c["text"].try_cast("date"))
    steps = lambda days: F.transform(F.sequence(F.lit(1), F.size(days) - 1), lambda i: F.date_diff(F.get(days, i), F.get(days, i - 1)))
    # Dates are labels where they are the days of a grid.
    grid = bound(days, lambda days: F.when(F.size(days) >= 3, (2 * F.size(days) >= F.col("n")) & F.forall(steps(days), lambda d: d.between(1, 3))).otherwise(False))
    # Three days have the kind of a date.
    grid = F.when(F.col("n_date") >= 3, grid).otherwise(False)
    single = (F.col("n") == 1) & (F.col("n_text") == 1)
    rows = rows.withColumns(
        {
            "first_text": F.coalesce(first["text"], F.lit("")), "first_key": F.coalesce(first["key"], F.lit("")), "keys": F.transform(texts, lambda c: c["key"]),
            "single": single, "label": (F.col("n") >= 2) & (F.col("n_text") >= 1) & (4 * (F.col("n_text") + F.when(grid, F.col("n_date")).otherwise(0)) >= 3 * F.col("n")),
        }
    )
    if merged is None:
        rows = rows.withColumn("merged", F.lit(0))
    else:
        rows = rows.join(merged.select(*SHEET, "row", F.col("width").alias("merged")), [*SHEET, "row"], "left").fillna(0, "merged")
    text, key = F.col("first_text"), F.col("first_key")
    return rows.withColumns(
        {
            "total": words.is_total(key) & ((F.col("n_value") > 0) | (F.col("n") <= 2)),
            "break": single & words.is_page_break(text, key),
            "note": single & (words.is_note(key) | words.is_page_break(text, key) | (F.length(text) > 80)),
            "valued": (F.col("n") >= 2) & (F.col("n_value") + F.col("n_date") > 0),
        }
    )


def counted_before(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """``name``: how many rows of the same keys that come earlier have ``flag``.

    Rows are numbered within stretches of ``order`` and the stretches summed, so no window holds all rows of a key.
    """
    stretch = F.floor(F.col(order) / STRETCH).alias("_stretch")
    rows = rows.withColumn("_flag", flag.cast("long")).withColumn("_stretch", stretch)
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("_flag").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, [*keys, "_stretch"])
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_flag").over(own), F.lit(0))).drop("_flag", "_stretch", "_before")


def numbered(rows: DataFrame) -> DataFrame:
    """``place`` of each filled row within its sheet, from 0; the rows are computed once, as they are counted and read."""
    return counted_before(cut(rows), SHEET, "row", F.lit(True), "place")


def _ahead(by: Window, value: Column) -> Column:
    return F.collect_list(value).over(by.rowsBetween(1, AHEAD))


def _walked(batches: Iterator[pa.Table]) -> pa.Table:
    """Kinds of the rows of one stretch of a table, in order, by the state that the rows before leave."""
    table = batches.sort_by("place")
    kinds, ends = [], []
    after, after_row, on_new_page, ended = "RECORD", None, False, False
    names = ("row", "kind", "repeated", "resumes", "single", "header_row")
    for row, kind, repeated, resumes, single, header_row in zip(*(table[c].to_pylist() for c in names)):
        after_row = header_row if after_row is None else after_row
        end = False
        if ended:
            kind = "NOTE"
        elif repeated and (after == "BREAK" or row == after_row + 1):
            kind, after = "HEADER", "BREAK"
        elif kind == "DATA" and on_new_page and single:
            kind = "NOTE"  # the running title of a page
        elif kind == "NOTE" and resumes:
            after, on_new_page = "BREAK", True
        elif kind == "NOTE":
            ended = end = True
        else:
            after, after_row, on_new_page = "RECORD", row, False
        kinds.append(kind)
        ends.append(end)
    table = table.drop_columns(["kind"]).append_column("kind", pa.array(kinds, pa.string()))
    return table.append_column("ends", pa.array(ends, pa.bool_())).select(["file", "sheet", "header_row", "place", "row", "kind", "ends", "dense", "core"])


def _body(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """file, sheet, header_row, row, kind of all rows below the headers in ``tables``.

    ``rows``: features with place. ``tables``: file, sheet, header_row, stop (the first row that is not the table's,
    null: none), width and labels.
    """
    met = rows.join(F.broadcast(tables) if _few(tables) else tables, SHEET).where("row > header_row AND (stop IS NULL OR row < stop)")
    size = lambda share: F.greatest(F.lit(2), F.ceil(share).cast("int"))
    same = F.size(F.filter("keys", lambda k: F.array_contains("labels", k)))
    met = met.withColumns(
        {
            "repeated": (F.col("n") >= 2) & (F.col("n_text") == F.col("n")) & (same >= size(F.col("n") * 0.6)),
            "dense": F.col("n") >= size(F.col("width") * 0.5),
            "wide": F.col("merged") >= F.greatest(F.lit(3), F.ceil(F.col("width") * 0.5).cast("int")),
        }
    )
    record = F.col("dense") & ~F.col("label") & ~F.col("total") & ~F.col("note")
    met = met.withColumn("self", F.struct("repeated", "single", "valued", record.alias("record")))
    # Rows near a stretch's ends go to its neighbour too.
    part, within = F.expr(f"place div {STRETCH}"), F.col("place") % STRETCH
    parts = F.array_compact(F.array(part, F.when(within < MARGIN, part - 1), F.when(within >= STRETCH - MARGIN, part + 1)))
    dealt = met.withColumn("part", F.explode(parts)).withColumn("core", part == F.col("part"))
    by = Window.partitionBy(*SHEET, "header_row", "part").orderBy("place")
    dealt = dealt.withColumn("next", _ahead(by, F.col("self")))
    section = F.col("single") & F.exists("next", lambda f: f["valued"]) & words.is_section(F.col("first_text"), F.col("first_key"), F.col("wide"))
    follower = F.get(F.filter("next", lambda f: ~(F.col("break") & (f["repeated"] | f["single"]))), 0)
    told = dealt.select(
        *SHEET, "header_row", "part", "place", "row", "repeated", "single", "dense", "core",
        F.when(F.col("total"), "TOTAL").when(F.col("note"), "NOTE").when(section, "SECTION").otherwise("DATA").alias("kind"),
        F.coalesce(follower["record"], F.lit(False)).alias("resumes"),
    )
    schema = "file string, sheet string, header_row int, place long, row int, kind string, ends boolean, dense boolean, core boolean"
    walked = told.groupBy(*SHEET, "header_row", "part").applyInArrow(_walked, schema).where("core")
    table = [*SHEET, "header_row"]
    walked = cut(walked)
    end = walked.groupBy(*table).agg(F.min(F.when(F.col("ends"), F.col("row"))).alias("end"))
    kept = walked.join(end, table).withColumn("kind", F.when(F.col("row") > F.col("end"), "NOTE").otherwise(F.col("kind")))
    last = kept.groupBy(*table).agg(F.max(F.when((F.col("kind") == "DATA") & F.col("dense"), F.col("row"))).alias("last_dense"))
    # Thin rows behind the last full one are a footer.
    footer = (F.col("kind") == "DATA") & (F.col("row") > F.col("last_dense"))
    return kept.join(last, table).select(*table, "place", "row", F.when(footer, "NOTE").otherwise(F.col("kind")).alias("kind"))


def _few(tables: DataFrame, most: int = 100_000) -> bool:
    return tables.limit(most + 1).count() <= most


def _candidates(head: DataFrame) -> DataFrame:
    """Rows that may be headers, with their labels, those of a group row above, and the next row that begins a table."""
    by = Window.partitionBy(*SHEET).orderBy("place")
    near = head.withColumn("under", F.collect_list("valued").over(by.rowsBetween(1, 3))).withColumn(
        "above", F.lag(F.struct("row", "n", "n_value", "n_date", "label", "cells")).over(by)
    )
    near = near.withColumn("above", F.when(F.col("above")["row"] == F.col("row") - 1, F.col("above")))
    before = near.withColumn("chain", F.collect_list(F.struct("row", "break", "single")).over(by.rowsBetween(-3, -1)))
    headers = before.where(f"label AND row <= {HEADER_ROWS}").select(
        *SHEET, F.col("row").alias("header_row"), F.col("n").alias("header_n"), F.col("n_text").alias("header_text"), "n_lexical",
        F.col("cells").alias("header_cells"), F.array_distinct(F.transform("cells", lambda c: c["key"])).alias("header_keys"), "above",
    )
    starts = before.where("label AND n >= 3 AND n_text > 0 AND 2 * n_lexical >= n_text").where(F.exists("under", lambda v: v))
    page = lambda chain: F.exists(  # noqa: E731  a page break, then single lines only
        F.sequence(F.lit(0), F.size(chain) - 1),
        lambda i: F.get(chain, i)["break"] & F.forall(F.slice(chain, i + 2, 3), lambda c: c["single"]),
    )
    starts = starts.select(
        *SHEET, F.col("row").alias("start"), F.col("n").alias("start_n"), "n_value", "n_date", F.col("n_text").alias("start_text"), F.col("keys").alias("start_keys"),
        F.col("cells").alias("start_cells"), F.coalesce(F.col("above")["label"], F.lit(False)).alias("group_above"),
        (F.col("above").isNotNull() & (F.col("above")["n"] >= 2) & ~F.col("above")["label"]).alias("after_record"),
        F.when(F.size("chain") > 0, page(F.col("chain"))).otherwise(False).alias("after_break"),
    )
    pairs = headers.select(*SHEET, "header_row", "header_n", "header_keys").join(starts, SHEET)
    same = F.size(F.filter("start_keys", lambda k: F.array_contains("header_keys", k)))
    again = (F.col("start_text") == F.col("start_n")) & (same >= F.greatest(F.lit(2), F.ceil(F.col("start_n") * 0.6).cast("int"))) & (F.col("after_record") | F.col("after_break"))
    pairs = pairs.where("start > header_row").where(F.col("start_n") >= F.greatest(F.lit(3), F.ceil(F.col("header_n") * 0.5).cast("int"))).where(~again)
    # A row with values in the places where the record above has them is a record, whatever its words.
    records = head.where("n >= 2 AND NOT label").select(*SHEET, F.col("row").alias("record"), F.col("cells").alias("record_cells"))
    valued = pairs.where("n_value + n_date > 0").select(*SHEET, "header_row", "start", "start_cells").join(records, SHEET).where("record > header_row AND record < start")
    nearest = valued.groupBy(*SHEET, "header_row", "start").agg(F.max_by("record_cells", "record").alias("record_cells"), F.first("start_cells").alias("start_cells"))
    place = lambda c: F.struct(c["col"], c["kind"])
    both = F.size(F.array_intersect(F.transform("record_cells", place), F.transform("start_cells", place)))
    either = F.size(F.array_union(F.transform("record_cells", lambda c: c["col"]), F.transform("start_cells", lambda c: c["col"])))
    alike = nearest.where(10 * both >= 8 * either).select(*SHEET, "header_row", "start")
    stops = pairs.join(alike, [*SHEET, "header_row", "start"], "left_anti").groupBy(*SHEET, "header_row").agg(
        F.min(F.col("start") - F.col("group_above").cast("int")).alias("next_start")
    )
    return headers.join(stops, [*SHEET, "header_row"], "left")


def _group_labels(merged_width: Column | None = None) -> Column:
    """Whether the row above is the upper line of a two-line header: texts only, at least two, over labels that repeat or written over each column."""
    above = F.col("above")
    keys = F.transform("header_cells", lambda c: c["key"])
    doubled = F.size(F.array_distinct(keys)) < F.size(keys)
    width = F.element_at("header_cells", -1)["col"] + 1
    texts = F.transform(above["cells"], lambda c: c["text"])
    neighbours = F.exists(F.sequence(F.lit(1), F.size(texts) - 1), lambda i: F.get(texts, i) == F.get(texts, i - 1))
    written = F.when(F.size(texts) > 1, neighbours).otherwise(False) & (10 * above["n"] >= 6 * width)
    return F.coalesce((above["n"] >= 2) & (above["n_value"] == 0) & (above["n_date"] == 0) & (doubled | written), F.lit(False))


def find_tables(features: DataFrame, *, most: int = TABLES) -> DataFrame:
    """file, sheet, header_row, group_row (null: none), stop, width, labels and score of each sheet's tables, the best first.

    ``features``: ``row_features`` with ``place``. A header is judged by its words, the rows below it and its width; a
    found table is set aside and the next one looked for, ``most`` times. Only rows near the top are judged by.
    """
    head = cut(features.where(F.col("place") < HEAD))
    widest = head.where(f"row <= {HEADER_ROWS}").groupBy(*SHEET).agg(F.max("n").alias("widest"))
    found = cut(_candidates(head).join(widest, SHEET).withColumn("grouped", _group_labels()))
    group_keys = F.when(F.col("grouped"), F.transform(F.col("above")["cells"], lambda c: c["key"])).otherwise(F.array().cast("array<string>"))
    found = found.withColumns({"labels": F.array_union("header_keys", group_keys), "width": F.element_at("header_cells", -1)["col"] + 1})
    tables = None
    for _ in range(most):
        left = found
        if tables is not None:
            taken = tables.select(*SHEET, F.col("first").alias("taken_first"), F.col("last").alias("taken_last"))
            inside = found.select(*SHEET, "header_row").join(taken, SHEET).where("header_row BETWEEN taken_first AND taken_last")
            later = found.select(*SHEET, "header_row").join(taken, SHEET).where("taken_first > header_row").groupBy(*SHEET, "header_row").agg(F.min("taken_first").alias("taken"))
            left = found.join(inside.select(*SHEET, "header_row"), [*SHEET, "header_row"], "left_anti").join(later, [*SHEET, "header_row"], "left")
        else:
            left = left.withColumn("taken", F.lit(None).cast("int"))
        left = left.withColumn("stop", F.least("next_start", "taken"))
        body = _body(head, left.select(*SHEET, "header_row", "stop", "width", "labels"))
        data = F.col("kind") == "DATA"
        sums = body.groupBy(*SHEET, "header_row").agg(
            F.sum(data.cast("int")).alias("data_rows"), F.max(F.when(F.col("kind").isin("DATA", "TOTAL", "SECTION"), F.col("row"))).alias("last_row")
        )
        judged = left.join(sums.where("data_rows > 0"), [*SHEET, "header_row"])
        distinct = F.when(F.size(F.array_distinct(F.transform("header_cells", lambda c: c["key"]))) >= F.col("header_n"), 20).otherwise(10)
        # In 1/200: 0.35 words of headers, 0.25 rows, 0.15 width, 0.15 texts, 0.10 labels that differ.
        score = 70 * F.col("n_lexical") / F.col("header_text") + 50 * F.least(F.lit(8), "data_rows") / 8 + 30 * F.col("header_n") / F.col("widest") + 30 * F.col("header_text") / F.col("header_n") + distinct
        value = F.col("data_rows") * F.col("width")
        share = value / F.max(value).over(Window.partitionBy(*SHEET))
        judged = judged.withColumn("score", F.round(score / 200, 6)).withColumn("weight", 0.6 * F.col("score") + 0.4 * share)
        first = F.row_number().over(Window.partitionBy(*SHEET).orderBy(F.col("weight").desc(), "header_row"))
        best = judged.withColumn("_place", first).where("_place = 1").select(
            *SHEET, "header_row", F.when(F.col("grouped"), F.col("header_row") - 1).alias("group_row"), "stop", "width", "labels", "score", "data_rows",
            (F.col("header_row") - F.col("grouped").cast("int")).alias("first"), F.greatest("header_row", "last_row").alias("last"),
        )
        best = cut(best)
        tables = best if tables is None else tables.unionByName(best)
    return tables.drop("first", "last", "data_rows")


def classified(features: DataFrame, tables: DataFrame) -> DataFrame:
    """file, sheet, header_row, row and kind (DATA, TOTAL, SECTION, NOTE, HEADER) of every filled row below each table's header."""
    return _body(features, tables.select(*SHEET, "header_row", "stop", "width", "labels"))


def checked_totals(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """file, sheet, header_row, row, checked, matched and state of every total row.

    A total is compared, column by column, with the sum of the data rows since the total or
    section before it: MATCH, PARTIAL, MISMATCH, or UNVERIFIED where there is nothing to compare.
    """
    table = [*SHEET, "header_row"]
    cuts = F.col("kind").isin("TOTAL", "SECTION")
    parts = counted_before(kinds, table, "row", cuts, "segment")
    amounts = cells.select(*SHEET, "row", "col", words.kind(F.col("value")).alias("cell"), words.amount(F.col("value")).alias("amount")).where("amount IS NOT NULL")
    met = parts.where("kind IN ('DATA', 'TOTAL')").join(amounts, [*SHEET, "row"])
    sums = met.where("kind = 'DATA'").groupBy(*table, "segment", "col").agg(F.sum("amount").alias("sum"))
    totals = met.where("kind = 'TOTAL' AND cell = 'NUMBER'").join(sums, [*table, "segment", "col"])
    agrees = F.abs(F.col("sum") - F.col("amount")) <= F.lit("0.011").cast("decimal(4,3)")
    counts = totals.groupBy(*table, "row").agg(F.count("*").alias("checked"), F.sum(agrees.cast("long")).alias("matched"))
    every = kinds.where("kind = 'TOTAL'").select(*table, "row").join(counts, [*table, "row"], "left").fillna(0, ["checked", "matched"])
    state = F.when(F.col("checked") == 0, "UNVERIFIED").when(F.col("matched") == F.col("checked"), "MATCH").when(F.col("matched") > 0, "PARTIAL").otherwise("MISMATCH")
    return every.withColumn("state", state)


def column_labels(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """file, sheet, header_row, col, label, renamed: labels that are unique and never empty.

    Two lines of a header are joined; an empty label is ``Colonna`` and the column's letters, the n-th of equal ones gets its number.
    """
    # Only the rows of headers are read, as soon as the cells are.
    wanted = tables.select(*SHEET, F.explode(F.array_compact(F.array("header_row", "group_row"))).alias("row")).distinct()
    head = cells.join(F.broadcast(wanted) if _few(tables) else wanted, [*SHEET, "row"], "left_semi")
    line = cut(head.select(*SHEET, "row", "col", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text")).where("text <> ''"))
    every = tables.select(*SHEET, "header_row", "group_row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    own = every.join(line.withColumnRenamed("row", "header_row").withColumnRenamed("text", "own"), [*SHEET, "header_row", "col"], "left")
    upper = own.join(line.withColumnRenamed("row", "group_row").withColumnRenamed("text", "upper"), [*SHEET, "group_row", "col"], "left")
    # A group holds for the columns up to the next one.
    by = Window.partitionBy(*SHEET, "header_row").orderBy("col")
    group = F.last("upper", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    told = upper.withColumn("group", group).withColumn("group", F.when(words.folded(F.col("group")) != words.folded(F.coalesce("own", F.lit(""))), F.col("group")))
    letter = F.expr("concat(CASE WHEN col >= 26 THEN char(64 + col div 26) ELSE '' END, char(65 + col % 26))")
    label = F.coalesce(F.concat_ws(" - ", F.col("group"), F.col("own")), F.lit(""))
    named = told.withColumn("missing", label == "").withColumn("label", F.when(label == "", F.concat(F.lit("Colonna "), letter)).otherwise(label))
    number = F.row_number().over(Window.partitionBy(*SHEET, "header_row", words.folded(F.col("label"))).orderBy("col"))
    again = named.withColumn("number", number)
    unique = F.when(F.col("number") > 1, F.concat("label", F.lit(" ("), "number", F.lit(")"))).otherwise(F.col("label"))
    return again.select(*SHEET, "header_row", "col", unique.alias("label"), (F.col("missing") | (F.col("number") > 1)).alias("renamed"))
