"""Alignment of two tokenizers: groups of tokens with the same bytes, links between overlapping tokens.

Python gives tokens and where they end, no more. Both tokenizers end a token before
each word, so a block of texts comes as its distinct words, each with its two lists of
ids and ends, and every text as numbers of words. The rest is Spark's higher-order
functions: ends in both lists cut a word into groups, ends in either list are its
links, and a text is its words end to end. No list is searched once for each of its
elements, so a very long word costs what its sorting costs.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import SLICE, gathered, in_slices, per_process, text_bytes
from hostelry.llm.units import Kept, Pieces, byte_level, distinct, space_cuts, units

#: UTF-8 bytes of text with which a block ends. Larger blocks repeat fewer words.
BLOCK_BYTES = 3 << 20
#: Distinct words of each side that a worker keeps.
KEPT = 1 << 17
#: Tokens of a word up to which its groups are put together one by one.
SHORT = 64
#: Id pairs up to which their counts are broadcast whole; beyond it the most frequent ones are, and the others are shuffled.
BROADCAST_ROWS = 2_000_000
_SIDE = 1 << 31


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


class Side:
    """One tokenizer: ids of distinct units, their ends within the unit, and whether they give the unit's bytes."""

    def __init__(self, encode):
        self.encode = encode
        self.kept = Kept(self._flagged, KEPT)
        self.bytes = np.frombuffer(b"".join(encode.token_bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in encode.token_bytes])])
        self.sizes = np.diff(self.offsets)

    def _flagged(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids with one more in front of each unit's: 1 where its tokens do not give its bytes."""
        flat, counts = self.encode(names)
        flat = flat.astype(np.int64)
        made = np.add.reduceat(np.append(self.sizes[flat], 0), np.cumsum(counts) - counts)
        want = np.fromiter(map(len, names), np.int64, len(names))
        wrong = (made != want) | (counts == 0)
        if not wrong.any():
            # All lengths agree, so all bytes can be compared as they lie.
            joined, laid = gathered(self.bytes, self.offsets, flat)[0], np.frombuffer(b"".join(names), np.uint8)
            wrong = np.add.reduceat(joined != laid, np.cumsum(want) - want) > 0
        else:
            tokens = self.encode.token_bytes
            begin = np.cumsum(counts) - counts
            wrong = np.array([b"".join(tokens[i] for i in flat[x : x + n]) != name for x, n, name in zip(begin, counts, names)])
        return np.insert(flat, np.cumsum(counts) - counts, wrong), counts + 1

    def __call__(self, data, begins, hashes, first):
        rows = self.kept.rows(data, begins, hashes, first)
        flat, counts = gathered(self.kept.flat, self.kept.ends, rows)
        flags = np.cumsum(counts) - counts
        good = flat[flags] == 0
        flat, counts = np.delete(flat, flags).astype(np.int64), counts - 1
        total = np.cumsum(self.sizes[flat])
        last = np.cumsum(counts)
        before = np.concatenate([[0], total[last[:-1] - 1]]) if len(total) else np.zeros(0, np.int64)
        return flat, total - np.repeat(before, counts), counts, good


class Block:
    """Texts as numbers of words, and the words' tokens, gathered slice by slice."""

    def __init__(self, a: Side, b: Side):
        self.sides, self.bytes = (a, b), 0
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tokens: list[list[np.ndarray]] = [[] for _ in range(6)]
        self.good, self.sizes = np.zeros(0, bool), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.texts: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = text_bytes(batch["text"])
        self.bytes += len(data)
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        begins = units(data, offsets, space_cuts)
        hashes, first, place = distinct(data, begins)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        numbers = np.empty(len(hashes), np.int64)
        numbers[known], numbers[new] = self.number[at[known]], np.arange(len(self.good), len(self.good) + len(new))
        self.hashes, self.number = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.number, at[new], numbers[new])
        found = [side(data, begins, hashes[new], first[new]) for side in self.sides]
        for i, (ids, ends, counts, _) in enumerate(found):
            for j, values in enumerate((ids, ends, counts)):
                self.tokens[3 * i + j].append(values.astype(np.int32))
        self.good = np.concatenate([self.good, found[0][3] & found[1][3]])
        self.sizes = tuple(np.concatenate([known_n, n]) for known_n, (_, _, n, _) in zip(self.sizes, found))
        words = numbers[place]
        at = np.searchsorted(begins, offsets)
        bad = np.concatenate([[0], np.cumsum(~self.good[words])])
        good = bad[at[1:]] == bad[at[:-1]]
        sums = [np.concatenate([[0], np.cumsum(n[words])]) for n in self.sizes]
        n_a, n_b = (np.where(good, s[at[1:]] - s[at[:-1]], 0) for s in sums)
        self.texts.append((batch["doc_id"], words[np.repeat(good, np.diff(at))].astype(np.int32), np.where(good, np.diff(at), 0), n_a, n_b))

    def row(self) -> pa.RecordBatch:
        a, a_ends, a_n, b, b_ends, b_n = (np.concatenate(values) for values in self.tokens)
        table = pa.StructArray.from_arrays([_lists(a, a_n), _lists(a_ends, a_n), _lists(b, b_n), _lists(b_ends, b_n)], ["a", "a_ends", "b", "b_ends"])
        words, sizes, n_a, n_b = (np.concatenate([t[i] for t in self.texts]) for i in range(1, 5))
        doc_ids = pa.concat_arrays([t[0] for t in self.texts])
        texts = pa.StructArray.from_arrays([doc_ids, _lists(words, sizes), pa.array(n_a), pa.array(n_b)], ["doc_id", "words", "n_a", "n_b"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([one(table), one(texts)], ["words", "texts"])


def _tokenized(byte_path: str, pattern: str, piece_path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a = per_process(("side", byte_path, pattern), lambda: Side(byte_level(byte_path, pattern, True)))
        b = per_process(("side", piece_path), lambda: Side(Pieces(piece_path)))
        block = Block(a, b)
        for big in batches:
            for batch in in_slices(big, "text", SLICE):
                block.add(batch)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row()
                    block = Block(a, b)
        if block.texts:
            yield block.row()

    return run


def let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once."""
    return F.transform(F.array(value), then)[0]


def up_to(ends: Column, cuts: Column) -> Column:
    """For each of the rising ``cuts``, how many of the rising ``ends`` are not behind it.

    Both are sorted together; before the k-th cut stand k cuts and the ends asked for.
    """
    marked = F.concat(F.transform(ends, lambda e: e.cast("long") * 2), F.transform(cuts, lambda c: c.cast("long") * 2 + 1))
    places = lambda s: F.filter(F.transform(s, lambda x, p: F.when(x % 2 == 1, p)), F.isnotnull)
    return F.transform(let(F.sort_array(marked), places), lambda p, k: p - k)


def _mark(side: int):
    return lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long") if side == 0 else i.cast("long").bitwiseOR(F.lit(_SIDE)))


def merged(a_ends: Column, b_ends: Column) -> Column:
    """All ends in order as ``end << 32 | side | number``; where both sides end, the first side comes first."""
    return F.sort_array(F.concat(F.transform(a_ends, _mark(0)), F.transform(b_ends, _mark(1))))


def groups(ends: Column, a: Column, a_ends: Column, b: Column, b_ends: Column) -> Column:
    """``a1,a2|b1;a3|b2``: the ids of groups, which end where tokens of both sides do (``ends``: ``merged``)."""

    def few(cuts: Column) -> Column:
        """Ends are walked in order, and the cuts with them."""
        number = lambda x: x.bitwiseAND(_SIDE - 1).cast("int")
        of = lambda ids, x: F.concat(F.lit(","), F.get(ids, number(x)).cast("string"))
        state = lambda done, x, y, k: F.struct(done.alias("done"), x.alias("x"), y.alias("y"), k.alias("k"))

        def step(acc: Column, x: Column) -> Column:
            behind = F.concat(acc["y"], of(b, x))
            closed = F.concat(acc["done"], F.lit(";"), F.substring(acc["x"], 2, _SIDE - 1), F.lit("|"), F.substring(behind, 2, _SIDE - 1))
            return (
                F.when(x.bitwiseAND(_SIDE) == 0, state(acc["done"], F.concat(acc["x"], of(a, x)), acc["y"], acc["k"]))
                .when(F.get(cuts, acc["k"]) == F.shiftright(x, 32), state(closed, F.lit(""), F.lit(""), acc["k"] + 1))
                .otherwise(state(acc["done"], acc["x"], behind, acc["k"]))
            )

        return F.aggregate(ends, state(F.lit(""), F.lit(""), F.lit(""), F.lit(0)), step, lambda acc: F.substring(acc["done"], 2, _SIDE - 1))

    def many(cuts: Column) -> Column:
        """The cuts are sorted in among the ends."""

        def each(i: Column, j: Column) -> Column:
            def part(ids: Column, n: Column, k: Column) -> Column:
                before = F.coalesce(F.get(n, k - 2), F.lit(0))
                return F.array_join(F.slice(ids, before + 1, F.get(n, k - 1) - before), ",")

            texts = lambda x, y: F.transform(F.sequence(F.lit(1), F.size(cuts)), lambda k: F.concat(part(x, i, k), F.lit("|"), part(y, j, k)))
            return F.array_join(let(a.cast("array<string>"), lambda x: let(b.cast("array<string>"), lambda y: texts(x, y))), ";")

        return let(up_to(a_ends, cuts), lambda i: let(up_to(b_ends, cuts), lambda j: each(i, j)))

    return let(F.array_intersect(a_ends, b_ends), lambda cuts: F.when(F.size(ends) <= SHORT, few(cuts)).otherwise(many(cuts)))


def _pair(x: Column, y: Column) -> Column:
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long"))


def links(ends: Column, a: Column, b: Column) -> Column:
    """Pairs ``a << 32 | b`` of all tokens whose bytes overlap, in order (``ends``: ``merged``).

    Between two neighbouring ends, of either side, lies what one pair shares. An end of
    one side at place p with number i there has p - i ends of the other side before it;
    where both sides end, the first of the two stands for them.
    """

    def link(x: Column, p: Column) -> Column:
        number = x.bitwiseAND(_SIDE - 1).cast("int")
        again = (p > 0) & (F.shiftright(F.get(ends, p - 1), 32) == F.shiftright(x, 32))
        of_a = _pair(F.get(a, number), F.get(b, p - number))
        return F.when(x.bitwiseAND(_SIDE) == 0, of_a).when(~F.coalesce(again, F.lit(False)), _pair(F.get(a, p - number), F.get(b, number)))

    return F.filter(F.transform(ends, link), F.isnotnull)


def word(a: Column, a_ends: Column, b: Column, b_ends: Column) -> Column:
    """groups and links of one word. Where all ends are the same, ids are paired as they stand."""
    both = lambda texts, pairs: F.struct(texts.alias("groups"), pairs.alias("links"))
    paired = F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), ";")
    apart = let(merged(a_ends, b_ends), lambda ends: both(groups(ends, a, a_ends, b, b_ends), links(ends, a, b)))
    return F.when(a_ends == b_ends, both(paired, F.zip_with(a, b, _pair))).otherwise(apart)


def aligned(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, groups and links of every row of ``docs``.

    ``groups`` lists them as text, ``a1,a2|b1;a3|b2``; ``links`` holds ``a << 32 | b`` in
    order. A text that is null, empty or not given back byte for byte has neither.
    Repeated rows stay; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        "words array<struct<a: array<int>, a_ends: array<int>, b: array<int>, b_ends: array<int>>>, "
        f"texts array<struct<doc_id: {id_type}, words: array<int>, n_a: bigint, n_b: bigint>>"
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(_tokenized(byte_path, pattern, piece_path), schema)
    each = lambda w: word(w["a"], w["a_ends"], w["b"], w["b_ends"])

    def text(known: Column):
        own = lambda t, part: F.transform(t["words"], lambda k: F.get(known, k)[part])
        return lambda t: F.struct(
            t["doc_id"].alias("doc_id"), t["n_a"].alias("n_a"), t["n_b"].alias("n_b"),
            F.array_join(own(t, "groups"), ";").alias("groups"), F.flatten(own(t, "links")).alias("links"),
        )

    return blocks.select(F.inline(let(F.transform("words", each), lambda known: F.transform("texts", text(known)))))


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether no pair with the same first id has more)."""
    counts = cut(linked.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    first = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(first).agg(F.max("count").alias("most"))
    # One row for each id of the first vocabulary, whose size bounds it.
    return cut(counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def rated(linked: DataFrame, counts: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row, n_best and count_sum of every row of ``linked`` that has links.

    Where there are more pairs than may be broadcast, those with the most documents are,
    so that what is shuffled has no pair with very many rows.
    """
    rows = linked.select("row", F.explode("links").alias("pair"))
    value = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")]
    n = counts.count()
    if n <= broadcast_rows:
        return rows.join(F.broadcast(counts), "pair").groupBy("row").agg(*value)
    bound = counts.approxQuantile("count", [1 - broadcast_rows / n / 2], broadcast_rows / n / 4)[0]
    often, seldom = counts.where(F.col("count") > bound), counts.where(F.col("count") <= bound)
    there = rows.join(F.broadcast(often), "pair").groupBy("row").agg(*value)
    others = rows.join(F.broadcast(often), "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
    others = others.join(seldom, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum")
    )
    return there.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(found: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``found`` (what ``aligned`` gives, or with columns derived from it in place of ``groups``) with the links' counts.

    Adds n_groups, n_links, n_best (links whose pair has the most documents among those
    of its first id) and count_sum (documents of each link's pair, summed); ``links`` goes.
    """
    linked = cut(found.withColumn("row", F.monotonically_increasing_id()))
    counts = rated(linked, pair_counts(linked), broadcast_rows=broadcast_rows)
    zero = F.lit(0).cast("long")
    n_links = F.size("links").cast("long")
    rows = linked.withColumn("n_links", n_links).withColumn("n_groups", F.col("n_a") + F.col("n_b") - F.col("n_links")).drop("links")
    filled = {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}
    return rows.join(counts, "row", "left").withColumns(filled).drop("row")
