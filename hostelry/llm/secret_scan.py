"""Secret scans over a ledger of content-addressed blobs.

Every version of a text is a blob under its SHA-256. A scan takes the pairs of
blob and rule version that the ledger has not seen, reads each such blob once,
records the findings, and joins them back to every path that holds the blob.
Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions.storage import shared_folder

#: The base rules. kind: (pattern, pattern of the part whose length counts, least length).
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run shorter than the least length cannot match these, as its longest match fails the length.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Named with each finding; a change to a rule needs a new name, which makes every blob unseen for it.
VERSIONS = {kind: f"{kind}-1" for kind in RULES}

FINDINGS = "array<struct<start:int,place:int,kind:string,end:int>>"
LEDGER = {"blob": "string", "rule": "string", "spans": FINDINGS}


def found(text: Column, kind: str, place: int) -> Column:
    """The leftmost non-overlapping matches of one kind that are long enough, as (start, place, kind, end)."""
    pattern, group, least = RULES[kind]
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(between.alias("gap"), matches.alias("hit"), values.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(FINDINGS).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.length(piece["value"]) >= least
        spans = F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    spans = F.aggregate(pieces, begin, step)["spans"]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(FINDINGS))


def blobs_of(docs: DataFrame) -> DataFrame:
    """doc_id, blob and text of every row; null is the empty text. Other columns are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan(paths: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """blob, rule and spans (ordered) for each pair of blob and rule version not in ``ledger`` (blob, rule).

    Each unseen blob's text is read once, from the path with the smallest doc_id;
    copies meet only as hashes and ids, aggregated in each task first.
    """
    rules = F.array(*(F.lit(v) for v in VERSIONS.values()))
    held = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        unseen = held.withColumn("rules", rules)
    else:
        pairs = held.select("blob", "doc_id", F.explode(rules).alias("rule"))
        unseen = pairs.join(ledger.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
        unseen = unseen.groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("rules"))
    # The ids are unique here, so no key of this join is hot. A blob whose smallest doc_id is null matches null.
    left, right = paths.alias("p"), unseen.alias("u")
    same = F.col("p.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("p.blob") == F.col("u.blob"))
    texts = left.join(right, same).select("u.blob", "u.rules", "p.text")
    results = F.array(
        *(
            F.struct(
                F.lit(VERSIONS[kind]).alias("rule"),
                F.when(F.array_contains("rules", VERSIONS[kind]), found(F.col("text"), kind, place)).alias("spans"),
            )
            for place, kind in enumerate(RULES)
        )
    )
    scanned = texts.select("blob", F.inline(results)).where(F.col("spans").isNotNull())
    return scanned.dropDuplicates(["blob", "rule"])


def joined_back(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """paths with ``spans``, all findings of its blob by start, then kind as listed; none: an empty array.

    Only blobs with findings take part, and a blob's copies are split by adaptive
    execution where they are many.
    """
    by_blob = (
        findings.where(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    out = paths.join(by_blob, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(FINDINGS)))


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ledger(session: SparkSession, folder: str) -> DataFrame:
    """blob, rule and spans of every pair that the ledger in ``folder`` has, each once; a new folder is an empty ledger."""
    none = session.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in LEDGER.items()))
    none.write.mode("append").parquet(folder)
    rows = session.read.schema(", ".join(f"{name} {kind}" for name, kind in LEDGER.items())).parquet(folder)
    # A scan that was recorded twice, as after a failure, counts once.
    return rows.groupBy("blob", "rule").agg(F.min("spans").alias("spans"))


def secrets(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and spans for every row of ``docs``, by the ledger in ``folder`` (none: a new one).

    A path may have any number of rows, one for each version of its text. Only pairs
    of blob and rule version that the ledger lacks are scanned; they are appended to
    it, and its findings, old and new, are joined back to all paths. Findings of
    rule versions that are no longer in force stay in the ledger and out of the result.
    """
    session = docs.sparkSession
    paths = blobs_of(docs)
    known = None if folder is None else ledger(session, folder)
    folder = folder or f"{shared_folder(session)}/cut-{uuid.uuid4().hex}"
    scan(paths, known).select(*LEDGER).write.mode("append").parquet(folder)
    now = ledger(session, folder).where(F.col("rule").isin(*VERSIONS.values()))
    return joined_back(paths.select("doc_id", "blob"), now)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with the characters of all spans masked by an asterisk each, lengths unchanged."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        end = F.greatest(span["end"], state["at"])
        kept = F.substring(text, state["at"] + 1, start - state["at"])
        return F.struct(end.alias("at"), F.concat(state["text"], kept, F.repeat(F.lit("*"), end - start)).alias("text"))

    done = F.aggregate(spans, begin, step)
    tail = F.substring(text, done["at"] + 1, F.length(text) - done["at"])
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["text"], tail))
