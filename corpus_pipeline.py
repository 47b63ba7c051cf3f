"""A corpus from raw documents: judged, deduplicated, cleared of secrets, mixed and encoded."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions.storage import cut, table
from hostelry.llm import byte_bpe, jaccard_join, quality_rules, secret_scan, source_mix


def apart(stage):
    """``stage`` over columns whose names cannot clash with those that operators add."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_column{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in names.items()})

    return run


@apart
def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality(docs, docs.columns).where("kept").select(*docs.columns)


@apart
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Rows that share a doc_id are told apart by their groups: one row stays for each
    group in which that doc_id is the smallest.
    """
    grouped = cut(jaccard_join.grouped(docs))
    stays = F.col("doc_id") == F.col("component_id")
    others = grouped.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("NOT stays").select("doc_id")
    kept = jaccard_join.within(docs, cut(others), "left_anti")
    repeated = cut(grouped.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    chosen = jaccard_join.within(grouped.where(stays), repeated, "left_semi").groupBy("doc_id", "component")
    chosen = chosen.agg(F.min("set_id").alias("set_id")).select(F.col("doc_id").alias("_doc"), F.col("set_id").alias("_set"))
    rows = jaccard_join.with_sets(jaccard_join.within(kept, repeated, "left_semi")).dropDuplicates(["doc_id", "set_id"])
    once = rows.join(chosen, (F.col("doc_id") == F.col("_doc")) & F.col("set_id").eqNullSafe(F.col("_set")), "left_semi")
    return jaccard_join.within(kept, repeated, "left_anti").unionByName(once.drop("set_id")).select(*docs.columns)


@apart
def clear_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked, character for character."""
    paths = docs.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = secret_scan.joined_back(paths, secret_scan.scan(secret_scan.blobs_of(docs)))
    return found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans"))).select(*docs.columns)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded_sha256 of every document.

    The last is of the bytes that the ids decode to, which are those of the text.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decoded.select("doc_id", n_tokens, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", judge),
    ("near duplicates", deduplicate),
    ("secrets", clear_secrets),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

#: SQL cannot express the estimates of the first stage nor the ids of the last; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each computed once into shared storage before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
