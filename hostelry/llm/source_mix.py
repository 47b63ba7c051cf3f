"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash, so a source's blocks are in random order
and a run of them is a random draw. A source's target gives its number of whole
passes and the documents of a last, partial one, found by prefix sums in two
levels, again over what still fits after each block that crosses the target.
The quotas of drawn blocks are then shared among output shards by a tree: each
node splits its exact block counts between its halves by draws from the
hypergeometric distribution, source after source. Shards take disjoint runs of
each source's blocks, and each shard's documents are shuffled on their own. Only
DataFrame functions are used, and the same input gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of source, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has SHARE of all words; no source or document gives more than REPEATS times its own.
SHARE_HALVES, REPEATS = 3, 2
BLOCK_DOCS = 64
#: Blocks summed at a time in the second level of the prefix sums.
GROUP = 256
SHARD_WORDS = 2_000_000
#: Up to so many sources their states are broadcast (a few KB each); a join by source alone deals a large one to one task.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """For each source of ``sizes`` (source, size): its rank, documents, size, weight and target in words.

    Sources by code point, null last. A target above REPEATS times its source's
    size stops there and the excess goes to the others by weight, until none is
    above: in the order of the ratio of limit to weight those that stop come first.
    """
    total = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    # One row for each source in these windows.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    total = total.withColumn("weight", weight.cast("long")).withColumn("limit", REPEATS * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = (
        total.withColumn("halves", SHARE_HALVES * F.sum("source_size").over(everything))
        .withColumn("left", F.col("halves") - 2 * F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", 2 * F.col("limit") * F.col("weights") <= F.col("weight") * F.col("left"))
    )
    free = lambda value: F.when(F.col("stops"), 0).otherwise(value)
    stopped = F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0)).over(everything)
    share = (F.col("halves") / 2 - stopped) / F.sum(free(F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * share)
    return total.select("source", "rank", "docs", "source_size", "weight", target.alias("target"))


def uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``whole`` are in ``drawn`` of them, at the uniform number ``u``.

    Inverts the distribution outwards from its mode by the ratios of successive
    probabilities; beyond twelve standard deviations nothing is left in a double.
    """
    real = lambda c: c.cast("double")
    least = F.greatest(F.lit(0), drawn - (whole - marked))
    most = F.least(marked, drawn)
    mode = F.least(most, F.greatest(least, F.floor(real(marked + 1) * real(drawn + 1) / real(whole + 2)).cast("long")))
    share = real(marked) / F.greatest(whole, F.lit(1))
    spread = F.sqrt(real(drawn) * share * (1 - share))
    reach = (F.ceil(12 * spread) + 30).cast("long")
    top, bottom = F.least(most, mode + reach), F.greatest(least, mode - reach)
    none = F.array().cast("array<bigint>")
    up = F.when(top > mode, F.sequence(mode + 1, top)).otherwise(none)
    down = F.when(bottom < mode, F.sequence(mode - 1, bottom, F.lit(-1).cast("long"))).otherwise(none)

    def rise(k: Column) -> Column:  # probability of k over that of k - 1
        return real(marked - k + 1) * real(drawn - k + 1) / (real(k) * real(whole - marked - drawn + k))

    def fall(k: Column) -> Column:  # probability of k over that of k + 1
        return real(k + 1) * real(whole - marked - drawn + k + 1) / (real(marked - k) * real(drawn - k))

    def summed(steps: Column, ratio) -> Column:
        begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            steps,
            begin,
            lambda s, k: F.struct((s["p"] * ratio(k)).alias("p"), (s["sum"] + s["p"] * ratio(k)).alias("sum")),
        )["sum"]

    def walked(steps: Column, ratio, target: Column) -> Column:
        begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * ratio(k)
            here = s["at"].isNull() & (s["sum"] + p > target)
            return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.when(here, k).otherwise(s["at"]).alias("at"))

        return F.aggregate(steps, begin, step)["at"]

    above, below = summed(up, rise), summed(down, fall)
    point = u * (1 + above + below)
    return F.when(point < 1, mode).otherwise(
        F.coalesce(walked(up, rise, point - 1), walked(down, fall, point - 1 - above), mode)
    )


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shard, blocks) from ``quotas`` (one row: counts, an array by rank): a leaf of the tree for each shard."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), total.alias("total"), "counts")
    edge = lambda at: F.expr(f"total * {at} div {shards}")
    while shards > 1:
        middle = F.expr("(lo + hi) div 2").cast("int")
        room = F.expr(f"total * ((lo + hi) div 2) div {shards}") - edge("lo")
        begin = F.struct(
            (edge("hi") - edge("lo")).alias("whole"),
            room.alias("room"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def step(s: Column, c: Column) -> Column:
            u = uniform(seed, F.col("lo"), F.col("hi"), F.size(s["left"]))
            take = hypergeometric(s["whole"], c, s["room"], u)
            return F.struct(
                (s["whole"] - c).alias("whole"), (s["room"] - take).alias("room"), F.concat(s["left"], F.array(take)).alias("left")
            )

        halved = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("counts", begin, step)["left"]))
        left = F.struct(F.col("lo"), middle.alias("hi"), F.col("left").alias("counts"))
        right = F.struct(
            middle.alias("lo"), F.col("hi"), F.zip_with("counts", "left", lambda c, t: c - t).alias("counts")
        )
        whole = F.struct("lo", "hi", "counts")
        children = F.when(F.col("left").isNull(), F.array(whole)).otherwise(F.array(left, right))
        nodes = cut(halved.select("total", F.explode(children).alias("n")).select("total", "n.lo", "n.hi", "n.counts"))
        if nodes.where(F.col("hi") - F.col("lo") > 1).isEmpty():
            break
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("rank", "blocks"))


def draws(docs: DataFrame, *, seed: int = 1, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each distinct (doc_id, source, size): source_size, target and draws, an array of (pass, shard).

    A null text has no words; rows equal in doc_id, source and size are drawn
    together. Each draw gives the whole document once. A source's partial pass
    takes documents in random order where they still fit, until less than the
    smallest one left out is missing, and that one if it brings the words nearer
    to the target.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    units = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    goal = cut(targets(units.select("source", F.explode(F.array_repeat("size", F.col("copies").cast("int"))).alias("size"))))
    goal = goal.withColumns(
        {
            "n_blocks": F.ceil(F.col("docs") / BLOCK_DOCS),
            "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        }
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    placed = units.join(goal, units["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    placed = placed.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = cut(placed.withColumn("block", F.pmod("key", "n_blocks")))

    placed = _partial(placed, goal)
    blocks = placed.groupBy("rank", "block").agg(F.max("taken").alias("taken"), F.first("passes").alias("passes"), F.first("n_blocks").alias("n_blocks"))
    drawn = F.col("passes") + F.col("taken").cast("int")
    none = F.array().cast("array<bigint>")
    passes = F.when(drawn > 0, F.sequence(F.lit(0).cast("long"), drawn - 1)).otherwise(none)
    # Whole passes number all blocks; the partial one those of which it takes a document.
    drawn_blocks = cut(blocks.withColumn("pass", F.explode_outer(passes)).withColumn("turn", F.col("pass") * F.col("n_blocks") + F.col("block")))

    quota = drawn_blocks.groupBy("rank").agg(F.count("pass").alias("quota"))
    quota = goal.select("rank").join(quota, "rank", "left")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("quota", F.lit(0)).alias("q")))), lambda s: s["q"])
    counts = cut(quota.agg(in_order.alias("counts")))
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    leaves = split(counts, max(1, int(total // shard_words)), seed)
    # A shard's run of a source's turns, turn by turn; empty blocks leave gaps, so turns are ranked in two levels too.
    first = F.coalesce(F.sum("blocks").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = leaves.withColumn("first", first).where(F.col("blocks") > 0)
    runs = runs.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("place"))
    turns = drawn_blocks.select("rank", "block", "pass", "turn")
    turns = turns.where(F.col("pass").isNotNull()).withColumn("span", F.floor(F.col("turn") / GROUP))
    spans = turns.groupBy("rank", "span").agg(F.count("*").alias("words"))
    spans = spans.select("rank", "span", _before(Window.partitionBy("rank").orderBy("span")).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("rank", "span").orderBy("turn")) - 1
    turns = turns.join(spans, ["rank", "span"]).withColumn("place", place)
    dealt = turns.join(runs, ["rank", "place"])
    given = dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    out = placed.join(given, ["rank", "block"], "left")
    empty = F.array().cast("array<struct<pass:bigint,shard:int>>")
    whole = F.filter("draws", lambda d: d["pass"] < F.col("passes"))
    given = F.coalesce(F.when(F.col("taken"), F.col("draws")).otherwise(whole), empty)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "key", given.alias("draws"))


def _before(w) -> Column:
    return F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _partial(placed: DataFrame, goal: DataFrame) -> DataFrame:
    """``placed`` with taken: whether the partial pass of its source has the document.

    Blocks are taken in order while they fit whole, then the documents of the one
    that crosses, by key, where they fit. What no longer fits never will, so the
    next round goes on behind that block with the smaller documents only, until
    none is left that fits. Last comes the smallest one not taken, if that is nearer.
    """
    need = F.col("size") * F.col("copies")
    left = placed.select("rank", "block", "key", need.alias("need"), F.col("rest").alias("room")).where("need > 0 AND need <= room")
    # One row for each source; the rounds tell which documents were taken.
    shape = "array<struct<after:bigint,until:bigint,least:bigint,most:double,keys:array<bigint>>>"
    state = goal.select("rank", F.col("rest").alias("room"), F.lit(-1).cast("long").alias("after"), F.array().cast(shape).alias("rounds"))
    end, least = F.lit((1 << 63) - 1), 0
    small = F.broadcast if goal.count() <= BROADCAST_SOURCES else lambda states: states
    while not left.isEmpty():
        blocks = left.groupBy("rank", "block").agg(F.sum("need").alias("words"), F.first("room").alias("limit"))
        blocks = cut(blocks.withColumn("group", F.floor(F.col("block") / GROUP)))
        groups = blocks.groupBy("rank", "group").agg(F.sum("words").alias("words"))
        groups = groups.select("rank", "group", _before(Window.partitionBy("rank").orderBy("group")).alias("base"))
        blocks = blocks.join(groups, ["rank", "group"])
        blocks = blocks.withColumn("start", F.col("base") + _before(Window.partitionBy("rank", "group").orderBy("block")))
        # At most one block of each source is crossed.
        crossed = blocks.where("start <= limit AND start + words > limit").select("rank", "block", (F.col("limit") - F.col("start")).alias("free"))
        listed = left.join(crossed, ["rank", "block"]).groupBy("rank", "block", "free")
        listed = listed.agg(F.sort_array(F.collect_list(F.struct("key", "need"))).alias("units"))
        begin = F.struct(F.col("free").alias("room"), F.array().cast("array<bigint>").alias("keys"))

        def fit(s: Column, x: Column) -> Column:
            more = F.struct((s["room"] - x["need"]).alias("room"), F.concat(s["keys"], F.array(x["key"])).alias("keys"))
            return F.when(x["need"] <= s["room"], more).otherwise(s)

        listed = listed.select("rank", F.col("block").alias("until"), F.aggregate("units", begin, fit).alias("fit"))
        sums = blocks.groupBy("rank").agg(F.sum("words").alias("words"))
        until = F.coalesce("until", end)
        none = F.array().cast("array<bigint>")
        this = F.struct(
            F.col("after"), until.alias("until"), F.lit(least).cast("long").alias("least"), F.col("room").alias("most"), F.coalesce("fit.keys", none).alias("keys")
        )
        state = cut(
            state.join(sums, "rank", "left")
            .join(listed, "rank", "left")
            .select(
                "rank",
                F.coalesce("fit.room", F.col("room") - F.coalesce("words", F.lit(0))).alias("room"),
                F.when(F.col("words").isNull(), F.col("after")).otherwise(until).alias("after"),
                F.when(F.col("words").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(this))).alias("rounds"),
            )
        )
        left = left.drop("room").join(small(state.select("rank", "room", "after")), "rank").where("need <= room AND block > after")
        left, least = cut(left.drop("after")), 1

    def has(x: Column) -> Column:
        inside = (F.col("block") < x["until"]) & need.between(x["least"], x["most"])
        return (F.col("block") > x["after"]) & (inside | ((F.col("block") == x["until"]) & F.array_contains(x["keys"], F.col("key"))))

    taken = F.exists("rounds", has)
    skipped = placed.join(small(state), "rank").where((need > 0) & (need < 2 * F.col("room")) & ~taken)
    more = skipped.groupBy("rank").agg(F.min(F.struct(need.alias("need"), "key"))["key"].alias("more"))
    state = cut(state.select("rank", "rounds").join(more, "rank", "left"))
    marked = placed.join(small(state), "rank").withColumn("taken", taken | F.col("key").eqNullSafe(F.col("more")))
    return cut(marked.drop("rounds", "more", "rest"))


def mixed(docs: DataFrame, *, seed: int = 1, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix: every column of ``docs`` with shard and turn, one row for each draw of each row.

    Rows of a shard follow each other in a random order, which ``turn`` gives.
    A column of ``docs`` named shard or turn is kept as shard_in or turn_in.
    """
    plan = draws(docs, seed=seed, shard_words=shard_words).select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("draws").alias("_draws")
    )
    rows = docs.withColumn("_words", words(F.col("text")))
    same = (
        rows["doc_id"].eqNullSafe(plan["_doc"])
        & rows["source"].cast("string").eqNullSafe(plan["_source"])
        & (rows["_words"] == plan["_size"])
    )
    out = rows.join(plan, same).select(*(rows[c] for c in docs.columns), F.explode("_draws").alias("_draw"))
    order = F.xxhash64(F.lit(seed + 1), "_draw.shard", "_draw.pass", "doc_id")
    named = [F.col(c).alias(f"{c}_in" if c in ("shard", "turn") else c) for c in docs.columns]
    return out.select(*named, F.col("_draw.shard").alias("shard"), order.alias("turn"))
