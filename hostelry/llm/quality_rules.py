"""Quality rules combined by weak supervision.

Each rule votes good, votes bad or abstains on a document. Expectation-
maximisation over the counts of vote patterns of all documents estimates, for
good and for bad documents, how often each rule casts each vote; the posterior
probability of good quality then replaces the test that every rule must pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import SPACE, freed, in_batches, in_slices, mixed, powers, sums, text_bytes, word_hashes, word_spans

WINDOW = 8
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_upper long, n_letters long, n_marks long"
)

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xF5)]] = True
MARK = np.zeros(256, bool)
MARK[[ord("!"), ord("?")]] = True


def repeated_words(text_of: np.ndarray, words: np.ndarray, texts: int) -> np.ndarray:
    """For each text, its words in windows of eight that occur twice or more in it."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    factors = powers(0xD6E8FEB86659FD93, WINDOW)
    window = mixed(text_of[:n].astype(np.uint64))
    for k in range(WINDOW):
        window += words[k : k + n] * factors[k]
    window = mixed(window)
    inside = text_of[:n] == text_of[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, np.int64)
    starts = order[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(text_of[covered], minlength=texts)


def duplicate_lines(text: str | None) -> tuple[int, int]:
    """(lines with a word, those among them equal to an earlier line)."""
    if not text:
        return 0, 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _featured(names: list[str]):
    @freed
    def run(batches):
        for big in batches:
            for batch in in_slices(big, "text"):
                data, offsets = text_bytes(batch["text"])
                n = batch.num_rows
                text_of, start, end = word_spans(data, offsets)
                words = word_hashes(data, start, end, lower=False)
                lines = [duplicate_lines(t) for t in batch["text"].to_pylist()]
                columns = (
                    np.bincount(text_of, minlength=n),
                    sums(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
                    sums(SYMBOL[data], offsets),
                    np.array([a for a, _ in lines]),
                    np.array([b for _, b in lines]),
                    repeated_words(text_of, words, n),
                    sums(UPPER[data], offsets),
                    sums(LETTER[data], offsets),
                    sums(MARK[data], offsets),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in names), *(pa.array(c, pa.int64()) for c in columns)],
                    [*names, *(f.split()[0] for f in FEATURES.split(", "))],
                )

    return run


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text may be among them) with each text's counts; null is empty.

    A kept column whose name a result has too is given as name_in.
    """
    in_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    texts = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    out = texts.mapInArrow(_featured(names), f"{schema}, {FEATURES}")
    taken = {f.split()[0] for f in FEATURES.split(", ")} | {"base_failed", "p_good", "kept", *votes()}
    return out.withColumnsRenamed({n: f"{c}_in" if c in taken else c for c, n in zip(keep, names)})


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains.

    A rule votes bad on one clear defect and otherwise abstains; the last votes
    good where every measure lies well within that of ordinary prose.
    """
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    bad = lambda condition: F.when(condition, -1).otherwise(0)
    mean = share("word_chars", "n_words")
    ordinary = (
        mean.between(2.5, 12)
        & (share("n_symbols", "n_words") < 0.05)
        & (share("n_dup_lines", "n_lines") <= 0.5)
        & (share("n_repeat_words", "n_words") <= 0.3)
        & (share("n_upper", "n_letters") < 0.2)
        & (share("n_marks", "n_words") < 0.1)
    )
    return {
        "v_word_size": bad((mean < 2) | (mean > 14)),
        "v_symbols": bad(share("n_symbols", "n_words") > 0.1),
        "v_lines": bad((F.col("n_dup_lines") >= 4) & (share("n_dup_lines", "n_lines") > 0.5)),
        "v_repeats": bad(share("n_repeat_words", "n_words") > 0.3),
        "v_capitals": bad(share("n_upper", "n_letters") > 0.4),
        "v_marks": bad(share("n_marks", "n_words") > 0.3),
        "v_prose": F.when(ordinary, 1).otherwise(0),
    }


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Log-likelihood ratios (rule, vote + 1) of good against bad, and the prior's log odds, by EM.

    Begins near the all-must-pass verdict, so that class 1 is the one without bad
    votes; rules whose bad votes fall on documents otherwise like good ones lose
    their force. Counts are smoothed, so a rule that never votes tells nothing.
    """
    rules = patterns.shape[1]
    total = counts.sum()
    if not total:
        return np.zeros((rules, 3)), 0.0
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = np.clip((mass[1].sum() + 1) / (total + 2), 0.01, 0.99)
        logs = np.zeros((2, rules, 3))
        for v in (-1, 0, 1):
            logs[:, :, v + 1] = mass @ (patterns == v) + 1
        logs = np.log(logs / logs.sum(axis=2, keepdims=True))
        ratio = logs[1] - logs[0]
        odds = math.log(prior / (1 - prior))
        score = odds + ratio[np.arange(rules), patterns + 1].sum(axis=1)
        now = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    # A good vote never speaks against a document, nor a bad one for it.
    ratio[:, 2] = np.maximum(ratio[:, 2], 0)
    ratio[:, 0] = np.minimum(ratio[:, 0], 0)
    return ratio, odds


def judged(featured: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``featured`` with base_failed, p_good (the posterior) and kept.

    EM reads the counts of vote patterns over all rows: at most 3**rules of them,
    whatever the input. The base rules only enter the verdict. No rows: no
    estimates are needed.
    """
    rules = votes()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    with_votes = featured.withColumns(rules).withColumn("base_failed", failed)
    counted = with_votes.groupBy(*rules).count().collect()
    patterns = np.array([[r[c] for c in rules] for r in counted], int).reshape(-1, len(rules))
    ratio, odds = estimated(patterns, np.array([r["count"] for r in counted], float))
    score = F.lit(float(odds))
    for i, c in enumerate(rules):
        bad, none, good = map(float, ratio[i])
        score = score + F.when(F.col(c) == -1, bad).when(F.col(c) == 1, good).otherwise(none)
    return (
        with_votes.withColumn("p_good", 1 / (1 + F.exp(-score)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
        .drop(*rules)
    )


def quality(docs: DataFrame, keep: list[str], *, threshold: float = 0.5) -> DataFrame:
    """``docs`` (columns ``keep``) with features, base_failed, p_good and kept, a row for a row.

    A null or empty text has no words and fails the base rules. Repeated rows are
    judged alike; other columns are left out, so their names cannot clash.
    """
    return judged(cut(features(docs, keep)), threshold=threshold)
