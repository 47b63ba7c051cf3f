"""Phrase collocations: count-min sketches choose what is counted exactly, then scores, then subsumption.

Each task of the first pass adds the hashes of all words and pairs of words to a
sketch, each task of the second those of longer phrases whose pairs are all frequent.
A sketch has one row, so wide that it tells a corpus' phrases apart, and is held by
the cells that are not empty; the tasks' sketches are summed shard by shard. A sketch
never counts too little, so a phrase whose estimate is below the bound is not frequent,
and neither is any phrase that holds it. The last pass counts only what survives, by
its words; false survivors are dropped by their exact counts. Wider sketches have fewer
of them: ``width_bits`` sets what a pass costs, never what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from hostelry.functions.storage import cut
from hostelry.llm.arrays import LOWER, freed, gathered, in_slices, mixed, packed, text_bytes, unpacked, word_hashes

#: Longest phrase in words, least count, result rows of a language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Length of the phrases that are counted whatever they hold.
SHORT = 2
#: Bits of a cell's number in a sketch, and of its number within a shard; shards are summed apart.
WIDTH_BITS, SHARD_BITS = 32, 22
#: Where a task's cells stop, and their sums; ``least`` must be below.
FULL, MOST = 1 << 15, 1 << 30
#: Cells that are sorted at a time, and those that a task holds before it hands them on.
SORTED, CELLS = 1 << 19, 1 << 21
#: Rows of the bit map of frequent cells, and its bits for each of them at least.
ROWS, SPARSE = 2, 4
#: Words hashed at a time, and phrases that a task counts before it hands them on.
AT_A_TIME, HELD = 1 << 17, 1 << 19
#: Phrases of a range of hashes, whose counts meet in one task.
RANGE = 1 << 15
GROW, ADD = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True


class Words:
    """The words of a slice of texts: hashes, the piece each is in, and their bytes with single spaces between."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch["text"])
        inside = ~BREAK[data]
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        start = np.flatnonzero(inside & (~before | border[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        end = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.text = np.searchsorted(offsets, start, "right") - 1
        self.piece = np.cumsum(PIECE[data])[start] + self.text
        self.hashes = word_hashes(data, start, end, True)
        langs, lang_offsets = text_bytes(batch["lang"])
        self.lang = word_hashes(langs, lang_offsets[:-1], lang_offsets[1:], False)
        # The byte behind each word is kept as its space; words of one piece always have one between them.
        kept = inside.copy()
        kept[end[end < len(data)]] = True
        place = np.concatenate([[0], np.cumsum(kept)])
        self.data = np.where(inside, LOWER[data], 0x20).astype(np.uint8)[kept]
        self.start, self.end = place[start], place[end]

    def phrases(self, passes, at: int, to: int, words: int, known: int):
        """(length, first word, hash) of phrases that begin from word ``at`` up to ``to``, by rising length.

        ``passes`` tells by hashes which phrases of up to ``known`` words are frequent enough;
        only those whose two shorter ones are both so come further. None takes all.
        """
        first = np.arange(at, min(to + words - 1, len(self.hashes)))
        hashes = mixed(self.hashes[first] ^ self.lang[self.text[first]])
        for length in range(1, words + 1):
            if length > 1:
                # A phrase goes on where the next word is in its piece and the phrase without the first word is left too.
                last = first + length - 1
                on = last < len(self.hashes)
                on[on] = self.piece[last[on]] == self.piece[first[on]]
                if passes is not None:
                    on[:-1] &= first[1:] == first[:-1] + 1
                    on[-1:] = False
                first, hashes = first[on], hashes[on]
                hashes = mixed(hashes * GROW + self.hashes[first + length - 1] * ADD)
            if passes is not None and length <= known:
                yes = passes(hashes)
                first, hashes = first[yes], hashes[yes]
            own = first < to
            yield length, first[own], hashes[own]

    def strings(self, first: np.ndarray, length: np.ndarray) -> pa.Array:
        a, b = self.start[first], self.end[first + length - 1]
        borders = np.empty(2 * len(a), np.int64)
        borders[::2], borders[1::2] = a, b
        flat, sizes = gathered(self.data, borders, np.arange(0, len(borders), 2))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat)))


class Sketch:
    """Counts of the cells that a task's hashes fall into; the other cells are empty."""

    def __init__(self, width_bits: int):
        self.width_bits, self.waiting, self.size = width_bits, [], 0
        kind = np.uint32 if width_bits <= 32 else np.uint64
        self.cells, self.counts = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append((hashes >> np.uint64(64 - self.width_bits)).astype(self.cells.dtype))
        self.size += len(hashes)
        if self.size >= SORTED:
            self.merge()

    def merge(self) -> None:
        both = [np.sort(np.concatenate([self.cells[:0], *self.waiting]))]
        new = np.flatnonzero(np.diff(both[0], prepend=both[0][:1] + self.cells.dtype.type(1)))
        counts = np.concatenate([self.counts, np.diff(np.append(new, len(both[0])))])
        cells = np.concatenate([self.cells, both[0][new]])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + cells.dtype.type(1)))
        self.cells = cells[first]
        self.counts = np.minimum(np.add.reduceat(counts, first), FULL - 1) if len(first) else counts
        self.waiting, self.size = [], 0

    def batches(self):
        """A row for each shard that has cells: the steps from cell to cell, and the counts."""
        self.merge()
        shard_bits = min(SHARD_BITS, self.width_bits)
        shard = (self.cells >> self.cells.dtype.type(shard_bits)).astype(np.int32)
        begins = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(shard)]):
            cells = self.cells[begin:end].astype(np.int64) - (int(shard[begin]) << shard_bits)
            rows.append((int(shard[begin]), packed(np.diff(cells, prepend=0)), packed(self.counts[begin:end])))
            if len(rows) == 64:
                yield _sketch_rows(rows)
                rows = []
        if rows:
            yield _sketch_rows(rows)


def _sketched(width_bits: int, words: int, known: int = 0, bits=None):
    """Sketches of phrases of up to ``words`` words; with ``bits`` only of those of more than ``known`` whose parts are frequent."""

    @freed
    def run(batches):
        sketch, passes = Sketch(width_bits), None if bits is None else _passes(bits.value, width_bits)
        totals: dict[str, int] = {}
        for big in batches:
            for batch in in_slices(big, "text"):
                found = Words(batch)
                counts = np.bincount(found.text, minlength=batch.num_rows)
                for lang, n in zip(batch["lang"].to_pylist(), counts.tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                for at in range(0, len(found.hashes), AT_A_TIME):
                    for length, _, hashes in found.phrases(passes, at, min(at + AT_A_TIME, len(found.hashes)), words, known):
                        if length > known:
                            sketch.add(hashes)
                if len(sketch.cells) > CELLS:
                    yield from sketch.batches()
                    sketch = Sketch(width_bits)
        if bits is None:
            for lang, n in totals.items():
                yield _sketch_rows([(None, None, None)], lang, n)
        yield from sketch.batches()

    return run


SKETCH = "shard int, cells binary, counts binary, lang string, words long"


def _sketch_rows(rows: list[tuple], lang: str | None = None, words: int | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
    columns += [pa.array([lang] * len(rows), pa.string()), pa.array([words] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "cells", "counts", "lang", "words"])


def _summed(shard_bits: int, least: int):
    """One shard's cells of all sketches added up: those that reach ``least``. Numbers of words pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard = None, None
        for batch in batches:
            if batch["shard"].null_count:
                yield batch
                continue
            if total is None:
                total = np.zeros(1 << shard_bits, np.uint32)
            for shard, cells, counts in zip(*(batch[c].to_pylist() for c in ("shard", "cells", "counts"))):
                own = np.cumsum(unpacked(cells).astype(np.int64))
                total[own] = np.minimum(total[own] + unpacked(counts), MOST)
        if total is not None:
            found = np.flatnonzero(total >= least)
            if len(found):
                yield _sketch_rows([(shard, packed(np.diff(found, prepend=0)), None)])

    return run


def frequent_cells(
    docs: DataFrame, *, width_bits: int = WIDTH_BITS, words: int = WORDS, least: int = LEAST, known: int = 0, cells: np.ndarray | None = None
) -> tuple[np.ndarray, DataFrame]:
    """The numbers of the merged sketch's cells that reach ``least``, and (lang, n) of all words.

    ``docs`` has lang and text. ``cells``: the frequent ones of phrases of up to ``known`` words, which
    are then not counted again, nor is n. Frequent cells pass through the driver.
    """
    bits = None if cells is None else docs.sparkSession.sparkContext.broadcast(bit_map(cells, width_bits))
    shard_bits = min(SHARD_BITS, width_bits)
    made = docs.mapInArrow(_sketched(width_bits, words, known, bits), SKETCH)
    made = cut(made.groupBy("shard").applyInArrow(_summed(shard_bits, least), SKETCH))
    found = [
        np.cumsum(unpacked(row.cells).astype(np.int64)) + (row.shard << shard_bits)
        for row in made.where("shard IS NOT NULL").select("shard", "cells").collect()
    ]
    return np.concatenate([np.zeros(0, np.int64), *found]), made.where("shard IS NULL").groupBy("lang").agg(F.sum("words").alias("n"))


def bit_map(cells: np.ndarray, width_bits: int) -> np.ndarray:
    """Rows of bits by the last and by the first bits of frequent cells' numbers, ``SPARSE`` bits or more for each cell."""
    own = min(width_bits, max(3, int(SPARSE * len(cells)).bit_length()))
    out = np.zeros((ROWS, max(1, (1 << own) // 8)), np.uint8)
    for row, shift in zip(out, (0, width_bits - own)):
        bits = np.zeros(8 * len(row), bool)
        bits[(cells >> shift) & ((1 << own) - 1)] = True
        row[:] = np.packbits(bits, bitorder="little")
    return out


def _passes(bits: np.ndarray, width_bits: int):
    """Tells by their hashes which phrases may be in frequent cells."""
    own = min(width_bits, (8 * bits.shape[1]).bit_length() - 1)

    def passes(hashes: np.ndarray) -> np.ndarray:
        cell, yes = (hashes >> np.uint64(64 - width_bits)).astype(np.int64), np.ones(len(hashes), bool)
        for row, shift in zip(bits, (0, width_bits - own)):
            at = (cell >> shift) & ((1 << own) - 1)
            yes &= (row[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return yes

    return passes


class Survivors:
    """Counts of a task's surviving phrases; their words are kept once."""

    def __init__(self):
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.parts = np.zeros(0, np.int64), []

    def add(self, words: Words, langs: pa.Array, first: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> None:
        found, index, number = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(number, minlength=len(found))
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        self.counts[self.rows[at[known]]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            picks = index[new]
            lang = langs.take(pa.array(words.text[first[picks]]))
            self.parts.append((lang, pa.array(length[picks], pa.int32()), words.strings(first[picks], length[picks])))
            rows = np.arange(len(self.counts), len(self.counts) + len(new))
            self.counts = np.concatenate([self.counts, counts[new]])
            self.hashes, self.rows = np.insert(self.hashes, at[new], found[new]), np.insert(self.rows, at[new], rows)

    def batches(self, ranges: int):
        """A row for each range of hashes that has phrases, with lists of them."""
        if not len(self.counts):
            return
        hashes = np.empty(len(self.rows), np.uint64)
        hashes[self.rows] = self.hashes
        number = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(number, kind="stable")
        found, begin = np.unique(number[order], return_index=True)
        offsets = pa.array(np.append(begin, len(order)), pa.int32())
        columns = [pa.concat_arrays([part[i] for part in self.parts]) for i in range(3)] + [pa.array(self.counts)]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order)).cast(kind)) for c, kind in zip(columns, kinds)]
        batch = pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *lists], ["range", *COUNTED.names])
        for at in range(0, batch.num_rows, 16):
            yield batch.slice(at, 16)


COUNTED = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])


def _added(least: int):
    """Exact counts of one range's phrases from all tasks, those of ``least`` and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = COUNTED.empty_table()
        for batch in batches:
            own = pa.Table.from_arrays([batch[name].flatten() for name in COUNTED.names], schema=COUNTED)
            both = pa.concat_tables([total, own]).group_by(["lang", "n_words", "phrase"]).aggregate([("a", "sum")])
            total = both.rename_columns({"a_sum": "a"}).select(COUNTED.names).cast(COUNTED)
        yield from total.filter(pa.compute.field("a") >= least).to_batches(max_chunksize=1 << 16)

    return run


def _counted(bits, width_bits: int, words: int, ranges: int):
    @freed
    def run(batches):
        passes = _passes(bits.value, width_bits)
        held = Survivors()
        for big in batches:
            for batch in in_slices(big, "text"):
                found = Words(batch)
                for at in range(0, len(found.hashes), AT_A_TIME):
                    got = list(found.phrases(passes, at, min(at + AT_A_TIME, len(found.hashes)), words, words))
                    first, hashes = (np.concatenate([g[i] for g in got]) for i in (1, 2))
                    length = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
                    held.add(found, batch["lang"], first, length, hashes)
                if len(held.counts) > HELD:
                    yield from held.batches(ranges)
                    held = Survivors()
        yield from held.batches(ranges)

    return run


def phrase_counts(docs: DataFrame, *, width_bits: int = WIDTH_BITS, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, a) of every phrase of up to ``words`` words that occurs ``least`` times in its language, and (lang, n)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    cells, totals = frequent_cells(rows, width_bits=width_bits, words=min(words, SHORT), least=least)
    if words > SHORT:
        longer, _ = frequent_cells(rows, width_bits=width_bits, words=words, least=least, known=SHORT, cells=cells)
        cells = np.union1d(cells, longer)
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(cells, width_bits))
    counter = _counted(bits, width_bits, words, len(cells) // RANGE + 1)
    found = rows.mapInArrow(counter, "range int, lang array<string>, n_words array<int>, phrase array<string>, a array<long>")
    counts = found.groupBy("range").applyInArrow(_added(least), "lang string, n_words int, phrase string, a long")
    return cut(counts), totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words and more with l, r, n and score of the cut that scores lowest, ties to the first cut."""
    wide = DecimalType(18, 0)
    words, at = F.split("phrase", " "), F.col("cut")
    phrases = counts.where("n_words > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    sides = phrases.select(
        "*", F.array_join(F.slice(words, F.lit(1), at), " ").alias("left"), F.array_join(F.slice(words, at + 1, F.col("n_words")), " ").alias("right")
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    joined = sides.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    exact = {c: F.col(c).cast(wide) for c in ("a", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast(DecimalType(4, 0)) * (exact["a"] * exact["n"]), exact["l"] * exact["r"])
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return joined.groupBy("lang", "n_words", "phrase", "a", "n").agg(best).select("lang", "n_words", "phrase", "a", "best.l", "best.r", "n", "best.score")


def subsumed(counts: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of phrases that lie within a longer one with at least ``share`` per cent of their count."""
    words = F.split("phrase", " ")
    longer = counts.where("n_words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return counts.join(most, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("a")).select("lang", "phrase")


def collocations(
    docs: DataFrame, *, words: int = WORDS, least: int = LEAST, share: int = 100, top: int = TOP, width_bits: int = WIDTH_BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to ``words`` words.

    A null language is ``und``, a null or empty text has no words, repeated rows count
    each, other columns are ignored. Phrases never cross a mark or a line's end. Scores
    are exact: products are decimals of 38 digits, so counts may have 17.
    """
    if least >= FULL:
        raise ValueError(f"least must be below {FULL}")
    counts, totals = phrase_counts(docs, width_bits=width_bits, words=words, least=least)
    kept = scored(counts, totals).join(subsumed(counts, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
