"""Which column of a file is which field: names read with typos, evidence of values and of other columns, and a choice.

All files are read at once. Headers repeat from file to file, so each distinct header is
read once. Words that may be misspelt meet the vocabulary through what is left of both when
letters are taken out, so no word is compared with all others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.functions import cells as words
from hostelry.functions.dates import parsed_date
from hostelry.functions.storage import cut

# Likeness of a misspelt word in per cent, its least length, spellings of a word and readings of a header.
LIKENESS, LEAST_LETTERS, SPELLINGS, READINGS = 85, 4, 3, 128
SCORES = {"EXACT": 1.0, "REORDERED": 0.97, "IN_CONTEXT": 0.95}
#: Words that make a header its opposite.
OPPOSITES = (
    ("in", "out"), ("arrival", "departure"), ("arrivo", "partenza"), ("arr", "dep"), ("entrata", "uscita"), ("ingresso", "uscita"), ("start", "end"),
    ("inizio", "fine"), ("from", "to"), ("dal", "al"), ("planned", "actual"), ("previste", "effettive"),
)
# Rows and share of rows on which a relation must hold, and the relations' bounds.
LEAST_ROWS, HOLDS = 5, 95
LONGEST_STAY, TYPICAL_STAY, LONGEST_LEAD, DATE_COLUMNS, AMOUNT_COLUMNS, TAX_RATE, PENNY = 90, 21, 540, 4, 6, 30, 200
#: Ten-thousandths from which a hundred amounts may pass 64 bits.
WIDE = 90_000_000_000_000_000
BONUS, NAME_FLOOR, NAME_SCALE, NEUTRAL, VALUES_ALONE = 0.15, 0.55, 0.45, 0.85, 0.62
#: Letters of a word up to which its shortened forms are listed; longer ones are compared with words of like length.
LISTED_LETTERS = 20


def header_words(raw: Column) -> Column:
    """The comparable words of a header: parts in brackets apart, camel case split, numbers and totals one word each."""
    core = F.regexp_replace(raw, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    core = F.when(core.rlike(r"\p{L}"), core).otherwise(raw)
    core = F.regexp_replace(F.trim(core), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    core = F.regexp_replace(core, r"[\s*:#?!]+$", "")
    key = words.folded(F.replace(F.replace(core, F.lit("%"), F.lit(" perc ")), F.lit("#"), F.lit(" number ")))
    for apart, whole in (("q ta", "qta"), ("u o", "uo"), ("p u", "pu")):
        key = F.regexp_replace(key, rf"\b{apart}\b", whole)
    kept = F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin(*words.STOP_WORDS))
    return F.transform(kept, lambda w: F.when(w.isin(*words.NUMBER_WORDS), "number").when(w.isin(*words.SUM_WORDS), "total").otherwise(w))


def shortened(word: Column, letters: Column) -> Column:
    """``word`` and all that is left of it when up to ``letters`` (at most 4) of its letters are taken out."""

    def without_one(texts: Column) -> Column:
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        return F.array_distinct(F.flatten(F.transform(texts, cut)))

    levels = [F.array(word)]
    for taken in range(1, 5):
        levels.append(F.when(letters >= taken, F.transform(F.array(levels[-1]), without_one)[0]).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*levels)))


@F.pandas_udf(T.IntegerType())
def common_letters(left: pd.Series, right: pd.Series) -> pd.Series:
    """Letters of the longest common subsequence."""

    def longest(a: str, b: str) -> int:
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
            last = row
        return last[-1]

    return pd.Series([longest(a, b) for a, b in zip(left, right)])


def near_words(written: DataFrame, known: DataFrame, *, likeness: int = LIKENESS, most: int = SPELLINGS) -> DataFrame:
    """word, known, likeness (in ten-thousandths): for each ``word`` of ``written`` the ``most`` alike words of ``known``.

    Likeness is twice the letters in common over both lengths, at least ``likeness`` per cent, lengths at most
    two apart. Alike words share what is left of them without the letters not in common, so only words that
    share that meet; ones too long for that meet by length.
    """
    written, known = written.select("word").distinct(), known.select("known").distinct()
    # Without more letters than this a word of n letters cannot be alike enough to one of n - 2.
    spare = lambda w: F.floor((F.length(w) * (100 - likeness) + likeness) / F.lit(100)).cast("int")
    fits = lambda w: (F.length(w) >= LEAST_LETTERS) & (F.length(w) <= LISTED_LETTERS)
    left = written.where(fits(F.col("word"))).select("word", F.explode(shortened(F.col("word"), spare(F.col("word")))).alias("rest"))
    right = known.where(fits(F.col("known"))).select("known", F.explode(shortened(F.col("known"), spare(F.col("known")))).alias("rest"))
    pairs = left.join(right, "rest").select("word", "known").distinct()
    long_left, long_right = (t.where(F.length(c) > LISTED_LETTERS - 2).withColumn("n", F.length(c)) for t, c in ((written, "word"), (known, "known")))
    by_length = long_left.withColumn("m", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2))).join(long_right.withColumnRenamed("n", "m"), "m").select("word", "known")
    both = pairs.unionByName(by_length.where(F.greatest(F.length("word"), F.length("known")) > LISTED_LETTERS)).where(F.abs(F.length("word") - F.length("known")) <= 2)
    total = F.length("word") + F.length("known")
    scored = both.withColumn("common", common_letters("word", "known")).where(200 * F.col("common") >= likeness * total)
    scored = scored.withColumn("likeness", F.round(20000 * F.col("common") / total).cast("int"))
    by = Window.partitionBy("word").orderBy(F.col("likeness").desc(), "known")
    return scored.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= most).select("word", "known", "likeness")


def read_headers(headers: DataFrame, phrases: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """header, field, kind, score of every reading of each distinct ``header``.

    ``phrases``: field, phrase and excluded (a phrase that looks like the field and means another thing).
    EXACT, REORDERED, IN_CONTEXT (with a word that names the kind of file) or TYPO; the best for each field.
    """
    joined = lambda c: F.concat_ws(" ", c)
    known = phrases.withColumn("seq", header_words(F.col("phrase"))).where(F.size("seq") > 0).withColumn("sorted", joined(F.array_sort("seq")))
    read = headers.select("header").distinct().withColumn("seq", header_words(F.col("header"))).where(F.size("seq") > 0)
    bare = F.filter("seq", lambda w: ~w.isin(*(context or ("",))))
    without = read.withColumn("seq0", bare).where((F.size("seq0") > 0) & (F.size("seq0") < F.size("seq"))).select("header", F.col("seq0").alias("seq"), F.lit(True).alias("dropped"))
    attempts = read.withColumn("dropped", F.lit(False)).unionByName(without)
    vocabulary = known.select(F.explode("seq").alias("known")).distinct()
    told = attempts.select("header", "dropped", "seq", F.posexplode("seq").alias("place", "word"))
    near = near_words(told.select("word").join(vocabulary, F.col("word") == F.col("known"), "left_anti"), vocabulary)
    options = vocabulary.select(F.col("known").alias("word"), "known", F.lit(10_000).alias("likeness")).unionByName(near)
    listed = options.groupBy("word").agg(F.collect_list(F.struct("known", "likeness")).alias("options"))
    spelt = told.join(listed, "word").groupBy("header", "dropped", "seq").agg(F.array_sort(F.collect_list(F.struct("place", "options"))).alias("by_place"))
    readings = F.aggregate("by_place", F.lit(1).cast("long"), lambda n, p: n * F.size(p["options"]))
    spelt = spelt.where(F.size("by_place") == F.size("seq")).where(readings <= READINGS)
    start = F.array(F.struct(F.array().cast("array<string>").alias("seq"), F.lit(0).alias("sum")))
    grown = lambda all_, p: F.flatten(
        F.transform(all_, lambda r: F.transform(p["options"], lambda o: F.struct(F.concat(r["seq"], F.array(o["known"])).alias("seq"), (r["sum"] + o["likeness"]).alias("sum"))))
    )
    variants = spelt.select("header", "dropped", F.col("seq").alias("own"), F.inline(F.aggregate("by_place", start, grown))).where("seq <> own")
    for a, b in OPPOSITES:
        turned = lambda x, y: F.array_contains(F.array_except("own", "seq"), x) & F.array_contains(F.array_except("seq", "own"), y)
        variants = variants.where(~(turned(a, b) | turned(b, a)))
    likeness = F.round(F.col("sum") / F.size("seq") / 10_000 - F.when(F.col("dropped"), 0.02).otherwise(0.0), 4)
    own = attempts.withColumn("kind", F.when(F.col("dropped"), "IN_CONTEXT").otherwise("REORDERED"))
    tried = own.withColumn("score", F.when(F.col("dropped"), SCORES["IN_CONTEXT"]).otherwise(SCORES["REORDERED"]))
    tried = tried.unionByName(variants.select("header", "dropped", "seq", F.lit("TYPO").alias("kind"), likeness.alias("score")))
    met = tried.withColumn("sorted", joined(F.array_sort("seq"))).join(known.select("field", "excluded", "sorted", F.col("seq").alias("phrase_seq")), "sorted")
    exact = (F.col("kind") == "REORDERED") & (F.col("seq") == F.col("phrase_seq"))
    met = met.withColumns({"score": F.when(exact, SCORES["EXACT"]).otherwise(F.col("score")), "kind": F.when(exact, "EXACT").otherwise(F.col("kind"))})
    # A header written without spaces may be a whole phrase.
    glued = read.where((F.size("seq") == 1) & (F.length(F.get("seq", 0)) >= 6)).withColumn("glued", F.get("seq", 0))
    whole = known.where(F.size("seq") > 1).select("field", "excluded", F.concat_ws("", "seq").alias("glued"))
    met = met.select("header", "field", "excluded", "kind", "score").unionByName(
        glued.join(whole, "glued").select("header", "field", "excluded", F.lit("EXACT").alias("kind"), F.lit(SCORES["EXACT"]).alias("score"))
    )
    blocked = met.where("excluded").select("header", "field").distinct()
    best = met.where("NOT excluded").groupBy("header", "field").agg(F.max(F.struct("score", "kind")).alias("best"))
    return best.join(blocked, ["header", "field"], "left_anti").select("header", "field", "best.kind", "best.score")


def column_profiles(cells: DataFrame, distinct: bool = True) -> DataFrame:
    """file, col, n, and shares in thousandths of dates, numbers, texts and distinct values among filled cells (file, row, col, value).

    Without ``distinct`` that share is left out, and equal values need not meet. With it they do, and each is told once.
    """
    # The test is pushed below the kind, so it must not be the kind itself, which would be told twice.
    rows = cells.where(~words.is_empty(F.col("value"))).select("file", "col", "value")
    rows = rows.groupBy("file", "col", "value").agg(F.count("*").alias("times")) if distinct else rows.withColumn("times", F.lit(1).cast("long"))
    rows = rows.select("file", "col", "times", words.kind(F.col("value")).alias("kind"))
    share = lambda c: F.expr(f"{c} * 1000 div n").alias
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("times"))), F.lit(0).cast("long"))
    counts = rows.groupBy("file", "col").agg(F.sum("times").alias("n"), *(of(k).alias(k.lower()) for k in ("DATE", "NUMBER", "TEXT")), F.count("*").alias("distinct"))
    shares = [share("date")("dates"), share("number")("numbers"), share("text")("texts"), *([share("distinct")("distinct")] if distinct else [])]
    return counts.select("file", "col", "n", *shares)


def _permuted(values: Column, size: int) -> Column:
    """All ordered choices of ``size`` different elements of an array of structs with ``col``."""
    out = F.transform(values, lambda v: F.array(v))
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda chosen: F.transform(F.filter(values, lambda v: ~F.exists(chosen, lambda c: c["col"] == v["col"])), lambda v: F.concat(chosen, F.array(v)))))
    return out


def _counts(cells: DataFrame, columns: DataFrame, value: Column, least: int, most: int, size: int, tests: Callable[..., dict[str, Column]], narrow: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """file, cols, checked and a count for each of ``tests``: on how many rows they hold of ``size`` columns in some order.

    Of files with ``least`` to ``most`` such columns. A row's values stand side by side and meet the orders of as
    many columns, so that orders are counted where they are made; values stand there as ``narrow`` makes them (of
    which ``tests`` must say the same). Rows that have a column twice or a value that it makes null are counted apart.
    """
    files = columns.groupBy("file").agg(F.array_sort(F.collect_list("col")).alias("held")).where(F.size("held").between(least, most))
    slots = cut(files.select("file", F.size("held").alias("k"), F.posexplode("held").alias("slot", "col")))
    told = cells.join(slots, ["file", "col"]).select("file", "row", "k", "slot", "col", value.alias("v"))
    told = told.withColumn("u", narrow(F.col("v")))
    names = [f"v{i}" for i in range(most)]
    rows = told.groupBy("file", "row").agg(F.max("k").alias("k"), F.count("v").alias("n"), *(F.max(F.when(F.col("slot") == i, F.col("u"))).alias(v) for i, v in enumerate(names)))
    filled = reduce(lambda a, b: a + b, (F.col(v).isNotNull().cast("int") for v in names))
    rows = rows.select("file", "row", "k", F.array(*names).alias("values"), (F.col("n") > filled).alias("apart"))
    places = [f"p{i}" for i in range(size)]
    orders = [(k, False, *p) for k in range(least, most + 1) for p in permutations(range(k), size)] + [(k, True, *(-1 for _ in places)) for k in range(least, most + 1)]
    orders = cells.sparkSession.createDataFrame(orders, ", ".join(["k int", "apart boolean", *(f"{p} int" for p in places)]))
    met = rows.join(F.broadcast(orders), ["k", "apart"]).select("file", "apart", *places, *(F.get("values", F.col(p)).alias(f"c{p}") for p in places))
    there = reduce(lambda a, b: a & b, (F.col(f"c{p}").isNotNull() for p in places))
    counted = lambda **good: [F.count("*").alias("checked"), *(F.count(F.when(g, 1)).alias(n) for n, g in good.items())]
    counts = cut(met.where(F.col("apart") | there).groupBy("file", "apart", *places).agg(*counted(**tests(*(F.col(f"c{p}") for p in places)))))
    held = slots.groupBy("file").agg(F.array_sort(F.collect_list("col")).alias("held"))
    found = counts.where("NOT apart").join(held, "file").select("file", F.array(*(F.get("held", F.col(p)) for p in places)).alias("cols"), "checked", *tests(*(F.lit(None),) * size))
    if counts.where("apart").isEmpty():
        return found
    again = rows.where("apart").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    listed = told.join(again, (F.col("file") == F.col("_file")) & F.col("row").eqNullSafe(F.col("_row")), "left_semi").where("v IS NOT NULL")
    listed = listed.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("values"))
    chosen = listed.select("file", F.explode(_permuted(F.col("values"), size)).alias("chosen"))
    more = chosen.groupBy("file", F.transform("chosen", lambda c: c["col"]).alias("cols")).agg(*counted(**tests(*(F.get("chosen", i)["v"] for i in range(size)))))
    return found.unionByName(more).groupBy("file", "cols").agg(*(F.sum(c).alias(c) for c in found.columns[2:]))


def _unique(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """file, col, field where exactly one order of columns is ``good`` on enough rows."""
    held = counts.where((F.col("checked") >= LEAST_ROWS) & (100 * F.col("good") >= HOLDS * F.col("checked")))
    one = held.groupBy("file").agg(F.count("*").alias("k"), F.first("cols").alias("cols")).where("k = 1")
    return one.select("file", F.explode(F.arrays_zip("cols", F.array(*map(F.lit, names)).alias("field"))).alias("z")).select("file", F.col("z.cols").alias("col"), F.col("z.field").alias("field"))


def booking_dates(cells: DataFrame, profiles: DataFrame, pattern: str = "dd/MM/yyyy") -> DataFrame:
    """file, col, field, proves: columns of dates told apart by booked <= arrival < departure on nearly all rows.

    Three columns of up to four must have one order only; that proves them. Two columns are a stay
    where the second is always a few days later, which only adds to a name.
    """
    dated = profiles.where(f"dates >= 900 AND n >= {LEAST_ROWS}")
    value = parsed_date(F.col("value"), pattern)
    told = lambda booked, arrival, departure: {"good": F.date_diff(departure, arrival).between(1, LONGEST_STAY) & F.date_diff(arrival, booked).between(0, LONGEST_LEAD)}
    found = _unique(_counts(cells, dated, value, 3, DATE_COLUMNS, 3, told), ("booked_at", "check_in", "check_out"))
    stay = lambda a, b: {"good": F.date_diff(b, a).between(1, LONGEST_STAY), "short": F.date_diff(b, a) <= TYPICAL_STAY}
    counts = _counts(cells, dated, value, 2, 2, 2, stay)
    # The gap in the middle is short where more than half of them are.
    held = counts.where(f"checked >= {LEAST_ROWS} AND good = checked AND short >= checked div 2 + 1")
    roles = held.select("file", F.get("cols", 0).alias("check_in"), F.get("cols", 1).alias("check_out")).unpivot("file", ["check_in", "check_out"], "field", "col")
    return found.withColumn("proves", F.lit(True)).unionByName(roles.select("file", "col", "field").withColumn("proves", F.lit(False)))


def invoice_amounts(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """file, col, field, proves: the columns with net + tax = total on nearly all rows, where there is one choice of them."""
    money = profiles.where(f"numbers >= 950 AND n >= {LEAST_ROWS}")
    # In ten-thousandths, which are whole; as 64-bit numbers up to where 100 of them still are.
    value = (words.amount(F.col("value")) * F.lit(10_000).cast("decimal(5,0)")).cast("decimal(24,0)")
    narrow = lambda v: F.when(F.abs(v) < WIDE, v.cast("long"))
    good = lambda net, tax, gross: {"good": (net > 0) & (tax >= 0) & (100 * tax <= TAX_RATE * net) & (F.abs(net + tax - gross) <= PENNY)}
    return _unique(_counts(cells, money, value, 3, AMOUNT_COLUMNS, 3, good, narrow), ("invoice_net_amount", "invoice_tax_amount", "invoice_gross_amount")).withColumn("proves", F.lit(False))


def candidates(columns: DataFrame, readings: DataFrame, profiles: DataFrame, kinds: dict[str, str | None], relations: DataFrame) -> DataFrame:
    """file, col, field, level, total, kind, score: every column (file, col, header) that may be a field.

    ``kinds`` names for each field the share that its values fit by (dates, numbers, texts, distinct; None: they
    say nothing). Values that contradict a name veto it; related columns add to it, and what proves a field
    names a column that has no reading.
    """
    fit = F.coalesce(*(F.when(F.col("field") == f, F.col(k)) for f, k in kinds.items() if k), F.lit(None).cast("long"))
    named = columns.join(readings, "header").join(profiles, ["file", "col"], "left").join(relations.select("file", "col", "field", "proves"), ["file", "col", "field"], "left")
    enough = F.coalesce(F.col("n") >= LEAST_ROWS, F.lit(False))
    named = named.withColumns({"fit": fit / 1000, "enough": enough})
    named = named.where(~F.coalesce((F.col("fit") < 0.2) & F.col("enough"), F.lit(False)))
    bonus = F.when(F.col("proves").isNotNull(), BONUS).otherwise(0.0)
    total = F.least(F.lit(1.0), F.col("score") * (NAME_FLOOR + NAME_SCALE * F.coalesce("fit", F.lit(NEUTRAL))) + bonus)
    values = F.coalesce("fit", F.lit(0.75))
    sure = F.col("enough") & F.when(F.col("fit").isNull(), (F.col("kind") == "EXACT") | (F.col("score") >= 0.88)).otherwise(F.col("fit") >= 0.85)
    typo = F.when((F.col("score") >= 0.88) & (values >= 0.85) & F.col("enough"), 2).otherwise(1)
    level = F.when(F.col("kind") == "TYPO", typo).otherwise(F.when(sure, 3).when(values >= 0.5, 2).otherwise(1))
    by_name = named.select("file", "col", "field", level.alias("level"), F.round(total, 6).alias("total"), "kind", "score")
    proven = relations.where("proves").join(by_name.select("file", "col").distinct(), ["file", "col"], "left_anti").join(by_name.select("file", "field").distinct(), ["file", "field"], "left_anti")
    alone = proven.select("file", "col", "field", F.lit(2).alias("level"), F.lit(round(VALUES_ALONE * 0.9 + BONUS, 6)).alias("total"), F.lit("VALUES").alias("kind"), F.lit(0.5).alias("score"))
    return by_name.unionByName(alone)


def assigned(found: DataFrame, order: list[str]) -> DataFrame:
    """The candidates that are chosen: per file the best first, each column and each field once.

    Best is the surer level, then the better name, then the field's place in ``order``, then the column. A file has
    at most as many candidates as columns times fields, so its choice is made in one row.
    """
    place = F.coalesce(*(F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(order)), F.lit(len(order)))
    entry = F.struct((-F.col("level")).alias("a"), (-F.col("score")).alias("b"), place.alias("place"), "col", "field", "level", "total", "kind", "score")
    listed = found.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    none = F.filter("entries", lambda e: F.lit(False))
    clash = lambda chosen, e: F.exists(chosen, lambda c: (c["col"] == e["col"]) | (c["field"] == e["field"]))
    chosen = F.aggregate("entries", none, lambda chosen, e: F.when(clash(chosen, e), chosen).otherwise(F.concat(chosen, F.array(e))))
    return listed.select("file", F.inline(chosen)).select("file", "col", "field", "level", "total", "kind", "score")


# Weights of a kind of data in hundredths, and the scores and leads (in ten-thousandths) that make it sure.
COVERAGE, BREADTH, TITLE = 58, 24, 18
FLOOR, HIGH, MEDIUM = 2500, (6200, 2000), (4000, 800)


def domain_scores(chosen: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """file, domain, score, coverage (both in ten-thousandths) of every kind of data for each file.

    chosen: file, domain, field, level (1 to 3); files: file, title (its lines); groups: domain, group, fields (any
    of them will do) and title_words (stems, the same in all groups of a domain). Groups with a field that is at
    least fairly sure count for coverage, all fields for breadth, a word of the title for the rest.
    """
    domains = groups.groupBy("domain").agg(F.count("*").alias("groups"), F.first("title_words").alias("title_words"))
    stems = files.select("file", words.tokens(F.coalesce("title", F.lit(""))).alias("stems"))
    # Kinds of data are few and fixed, so every file meets all of them.
    kinds = F.broadcast(domains.agg(F.collect_list(F.struct("domain", "groups", "title_words")).alias("kinds")))
    every = stems.join(kinds, F.lit(True)).select("file", "stems", F.inline("kinds"))
    sure = chosen.where("level >= 2").join(groups.select("domain", "group", F.explode("fields").alias("field")), ["domain", "field"])
    met = sure.groupBy("file", "domain").agg(F.countDistinct("group").alias("met"))
    broad = chosen.groupBy("file", "domain").agg(F.countDistinct("field").alias("fields"))
    told = every.join(met, ["file", "domain"], "left").join(broad, ["file", "domain"], "left").fillna(0, ["met", "fields"])
    least = F.greatest(F.lit(4), F.col("groups")).cast("long")
    hit = F.arrays_overlap("stems", "title_words").cast("long")
    # Over one denominator, so that the rounding is exact.
    below = F.col("groups") * least
    above = COVERAGE * F.col("met") * least + BREADTH * F.least(F.col("fields"), least) * F.col("groups") + TITLE * hit * below
    rounded = lambda a, b: ((2 * a + b - (2 * a + b) % (2 * b)) / (2 * b)).cast("long")
    return told.select("file", "domain", rounded(100 * above, below).alias("score"), rounded(10_000 * F.col("met"), F.col("groups")).alias("coverage"))


def domain_verdicts(scores: DataFrame, floor: int = FLOOR, high: tuple[int, int] = HIGH, medium: tuple[int, int] = MEDIUM) -> DataFrame:
    """file, domain and level: the best kind of data where its score and its lead over the next suffice, else null and LOW."""
    by = Window.partitionBy("file").orderBy(F.col("score").desc(), "domain")
    ranked = scores.withColumns({"place": F.row_number().over(by), "next": F.coalesce(F.lead("score").over(by), F.lit(0))}).where("place = 1")
    reaches = lambda need: (F.col("score") >= need[0]) & (F.col("score") - F.col("next") >= need[1])
    level = F.when(F.col("score") < floor, "LOW").when(reaches(high), "HIGH").when(reaches(medium), "MEDIUM").otherwise("LOW")
    return ranked.select("file", F.when(level != "LOW", F.col("domain")).alias("domain"), level.alias("level"), "score", (F.col("score") - F.col("next")).alias("lead"))
