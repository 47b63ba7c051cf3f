"""Language-model scores from an Elias-Fano n-gram trie.

Texts are taken in blocks. A block lists its distinct words by hash, below each its
distinct successors, and below each of those pairs the successors of the pair, with
their counts in training texts (order 2 leaves the last out). Lists are dealt out by ranges of the first word's
hash, as many as the input's bytes ask for. Where they meet, counts of all blocks
are summed and a trie of three levels is built. Every level is an Elias-Fano coded
monotone sequence, as are the pointers from a node to its children; children are
named by their rank in the part's vocabulary and held relative to their parent, as
prefix sums, so a child is found by a successor search in its parent's run.
Smoothed probabilities are quantised to codebooks of 255. The levels are files that
queries map into memory and read as they are coded. Each distinct n-gram is asked
for once, and each block gets the answers to its lists back.

The model is interpolated (Witten-Bell) over the add-one unigram:
p(w | h) = (count(h, w) + distinct(h) * p(w | h')) / (count(h) + distinct(h)),
where h is the last words before w, one fewer than the model's order, or what the
text has of them after its begin, and h' is h without its first word.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import in_slices, packed, sums, text_bytes, unpacked, word_hashes, word_spans

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bytes kept of a successor's hash, told apart only within its parent's children.
SUCCESSOR_BYTES = 5
BLOCK_BYTES = 4 << 20
#: Bytes of text for each range of first words.
PART_BYTES = 5 << 20
ONE = np.uint64(1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as little-endian 64-bit words, with a word to spare."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros(len(raw) // 8 * 8 + 16, np.uint8)
    out[: len(raw)] = raw
    return out.view("<u8")


class EliasFano:
    """A sorted list of distinct integers: low bits packed, high bits in unary, with a count of zeros every four words."""

    PARTS = ("size", "low", "high", "zeros")

    @staticmethod
    def coded(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        width = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        high = (values >> np.uint64(width)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, bool)
        unary[high + np.arange(n)] = True
        low = np.zeros(n * width, bool)
        for bit in range(width):
            low[bit::width] = (values >> np.uint64(bit)) & ONE
        words = _words(unary)
        words = np.concatenate([words, np.zeros(-len(words) % 4, "<u8")])
        zeros = np.cumsum(256 - np.bitwise_count(words).reshape(-1, 4).sum(axis=1, dtype=np.int64))
        return {
            "size": np.array([n, width, int(high[-1]) + 1 if n else 0], np.int64),
            "low": _words(low),
            "high": words,
            "zeros": np.concatenate([[0], zeros]),
        }

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width, self.buckets = map(int, parts["size"])
        self.low, self.high, self.zeros = parts["low"], parts["high"], parts["zeros"]
        self.mask = np.uint64((1 << self.width) - 1)

    def lows(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | spill) & self.mask

    def starts(self, bucket: np.ndarray) -> np.ndarray:
        """How many values lie in buckets of high bits before each of these."""
        out = np.zeros(len(bucket), np.int64)
        some = np.flatnonzero(bucket > 0)
        rank = bucket[some] - 1  # values before the zero of this rank
        out[some] = self.selected(rank, self.zeros, self.high, True) - rank
        return out

    @staticmethod
    def selected(rank: np.ndarray, counts: np.ndarray, words: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Places of the bits of these ranks among the ones (or the zeros), of which ``counts`` stand before every fourth word."""
        turned = (lambda at: ~words[at]) if zeros else (lambda at: words[at])
        group = np.searchsorted(counts, rank, "right") - 1
        left = rank - counts[group]
        word = group * 4
        for _ in range(3):
            here = np.bitwise_count(turned(word)).astype(np.int64)
            on = left >= here
            left = np.where(on, left - here, left)
            word = word + on
            if not on.any():
                break
        # Within the word, halve: the lower half has so many of them.
        bits, place = turned(word), np.zeros(len(word), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count((bits >> place) & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= lower
            left = np.where(on, left - lower, left)
            place = place + on.astype(np.uint64) * np.uint64(width)
        return word * 64 + place.astype(np.int64)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at these ranks."""
        place = self.selected(np.asarray(index, np.int64), np.arange(len(self.zeros)) * 256 - self.zeros, self.high)
        return ((place - index).astype(np.uint64) << np.uint64(self.width)) | self.lows(index)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The rank of each value, or -1: successor search within the bucket of its high bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        there = np.flatnonzero(high < self.buckets)
        low, high = values[there] & self.mask, high[there]
        at, end = self.starts(high), self.starts(high + 1)
        last = end.copy()
        while (going := np.flatnonzero(at < end)).size:
            middle = (at[going] + end[going]) >> 1
            less = self.lows(middle) < low[going]
            at[going[less]] = middle[less] + 1
            end[going[~less]] = middle[~less]
        held = np.flatnonzero(at < last)
        same = held[self.lows(at[held]) == low[held]]
        out[there[same]] = at[same]
        return out


def quantised(values: np.ndarray, codes: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value from 1, codebook) in even steps of the logarithm; code 0 stands for an absent value, 0.0."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    logs = np.log(values)
    book = np.linspace(logs.min(), logs.max(), codes)
    step = (book[-1] - book[0]) / (codes - 1) or 1.0
    code = np.rint((logs - book[0]) / step).astype(np.int64) + 1
    return code.astype(np.uint8), np.concatenate([[0.0], np.exp(book)])


class Level:
    """Children of the nodes of the level above: pointers to their runs, and their names, relative to the parent."""

    PARTS = tuple(f"{part}.{p}" for part in ("pointers", "names") for p in EliasFano.PARTS)

    @staticmethod
    def coded(parent: np.ndarray, name: np.ndarray, parents: int) -> dict[str, np.ndarray]:
        """``parent`` and ``name`` of each child, sorted by both."""
        sizes = np.bincount(parent, minlength=parents)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        # A run's numbers go on where the last run's ended.
        tops = np.zeros(parents, np.int64)
        filled = np.flatnonzero(sizes)
        tops[filled] = name[begins[filled + 1] - 1] + 1
        run = np.cumsum(tops) - tops
        numbers = name + run[parent]
        # Pointers repeat where a node has no children; each one's place makes them distinct.
        pointers = EliasFano.coded(begins + np.arange(parents + 1), len(name) + parents + 1)
        names = EliasFano.coded(numbers, int(tops.sum()) + 1)
        return {f"pointers.{k}": v for k, v in pointers.items()} | {f"names.{k}": v for k, v in names.items()}

    def __init__(self, parts: dict[str, np.ndarray]):
        part = lambda name: EliasFano({p: parts[f"{name}.{p}"] for p in EliasFano.PARTS})
        self.pointers, self.names = part("pointers"), part("names")

    def find(self, parent: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The rank of the child of that name, or -1; parents and names below 0 have none. Parents come in order."""
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero((parent >= 0) & (name >= 0))
        if not len(some) or not self.names.n:
            return out
        nodes, own = np.unique(parent[some], return_inverse=True)
        begin = self.pointers.at(nodes).astype(np.int64) - nodes
        end = self.pointers.at(nodes + 1).astype(np.int64) - nodes - 1
        base = np.zeros(len(nodes), np.int64)
        after = np.flatnonzero(begin > 0)
        base[after] = self.names.at(begin[after] - 1).astype(np.int64) + 1
        found = self.names.find((name[some] + base[own]).astype(np.uint64))
        inside = (found >= begin[own]) & (found < end[own])
        out[some[inside]] = found[inside]
        return out


class Trie:
    """One range of first words; its levels are files mapped into memory."""

    CODES = ("one_rest", "two_code", "two_rest", "three_code")

    @staticmethod
    def write(folder: str, words: np.ndarray, names: np.ndarray, two: tuple, three: tuple) -> None:
        """``words``: sorted hashes; ``names``: sorted successor hashes; each level: (parent, name, count) of its nodes, in order."""
        levels = {f"words.{k}": v for k, v in EliasFano.coded(words, 1 << 64).items()}
        levels |= {f"vocabulary.{k}": v for k, v in EliasFano.coded(names, 1 << 8 * SUCCESSOR_BYTES).items()}
        for level, (parent, name, count), parents in (("two", two, len(words)), ("three", three, len(two[0]))):
            levels |= {f"{level}.{k}": v for k, v in Level.coded(parent, name, parents).items()}
            total = np.bincount(parent, count, parents)
            kinds = np.bincount(parent, minlength=parents)
            levels[f"{level}_code"], levels[f"{level}_book"] = quantised(count / (total + kinds)[parent])
            rest, held = np.zeros(parents, np.uint8), kinds > 0
            rest[held], book = quantised((kinds / np.maximum(total + kinds, 1))[held])
            above = {"two": "one", "three": "two"}[level]
            levels |= {f"{above}_rest": rest, f"{above}_rest_book": book}
        for name, level in levels.items():
            np.save(os.path.join(folder, name), level)

    def __init__(self, folder: str):
        load = lambda name: np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        self.words, self.vocabulary = (EliasFano({p: load(f"{x}.{p}") for p in EliasFano.PARTS}) for x in ("words", "vocabulary"))
        self.two, self.three = (Level({p: load(f"{x}.{p}") for p in Level.PARTS}) for x in ("two", "three"))
        self.codes = {c: load(c) for c in self.CODES}
        self.books = [np.array(load(b)) for b in ("one_rest_book", "two_book", "two_rest_book", "three_book")]

    def code(self, kind: str, rank: np.ndarray) -> np.ndarray:
        """Codes at these ranks; 0 where the rank is -1."""
        out = np.zeros(len(rank), np.uint8)
        known = rank >= 0
        out[known] = self.codes[kind][rank[known]]
        return out


def joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def cut_hashes(values: np.ndarray) -> bytes:
    """The first SUCCESSOR_BYTES bytes of each hash."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SUCCESSOR_BYTES]).tobytes()


def whole_hashes(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // SUCCESSOR_BYTES, 8), np.uint8)
    wide[:, 8 - SUCCESSOR_BYTES :] = np.frombuffer(blob, np.uint8).reshape(-1, SUCCESSOR_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


class Stream:
    """The n-grams of a block: texts end to end, each with a begin before it and an end after it."""

    def __init__(self, numbers: np.ndarray, tokens: np.ndarray, words: int, order: int):
        starts = np.cumsum(tokens + 1) - tokens - 1
        is_token = np.ones(len(numbers), bool)
        is_token[starts] = False
        self.at = np.flatnonzero(is_token)
        self.pairs, self.pair = np.unique(numbers[self.at - 1] * words + numbers[self.at], return_inverse=True)
        # All tokens but the first of a text have a triple: the pair before it, and itself.
        later = is_token.copy()
        later[starts + 1] = False
        self.later = later[self.at] & (order > 2)
        place = np.flatnonzero(self.later)
        self.triples, self.triple = np.unique(self.pair[place - 1] * words + numbers[self.at[place]], return_inverse=True)


def _blocked(parts: int, block_bytes: int, lists: bool, order: int):
    """A row for each block's texts, or with ``lists`` one for each range of first words that it has."""

    def run(batches):
        for big in batches:
            for batch in in_slices(big, "text", block_bytes):
                data, offsets = text_bytes(batch["text"])
                n = batch.num_rows
                text_of, start, end = word_spans(data, offsets)
                tokens = np.bincount(text_of, minlength=n) + 1
                stream = np.full(int(tokens.sum()) + n, BEGIN)
                stream[np.cumsum(tokens + 1) - 1] = END
                stream[2 * text_of + 1 + np.arange(len(start))] = word_hashes(data, start, end, lower=True)
                held_out = np.array(batch["held_out"].to_pylist(), bool)
                doc_ids = batch["doc_id"].to_pylist()
                block = hashlib.sha256(repr(doc_ids).encode() + tokens.tobytes() + held_out.tobytes() + stream.tobytes()).hexdigest()[:32]
                words, numbers = np.unique(stream, return_inverse=True)
                k = len(words)
                if not lists:
                    texts = joined(k.to_bytes(8, "little"), packed(tokens), packed(numbers), packed(held_out))
                    yield _rows([(block, None, doc_ids, texts)], batch["doc_id"].type)
                    continue
                grams = Stream(numbers, tokens, k, order)
                trains = ~np.repeat(held_out, tokens)
                uses = np.bincount(numbers[grams.at[trains]], minlength=k)
                two = np.bincount(grams.pair[trains], minlength=len(grams.pairs))
                three = np.bincount(grams.triple[trains[grams.later]], minlength=len(grams.triples))
                first, second = np.divmod(grams.pairs, k)
                above, third = np.divmod(grams.triples, k)
                sizes, deep = np.bincount(first, minlength=k), np.bincount(above, minlength=len(first))
                bounds = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
                a = np.append(np.searchsorted(words, bounds), k)
                b = np.searchsorted(first, a)
                c = np.searchsorted(above, b)
                rows = []
                for p in np.flatnonzero(a[1:] > a[:-1]).tolist():
                    w, x, y = (slice(e[p], e[p + 1]) for e in (a, b, c))
                    blob = joined(
                        words[w].tobytes(), packed(uses[w]), packed(sizes[w]), cut_hashes(words[second[x]]), packed(two[x]), packed(deep[x]), cut_hashes(words[third[y]]), packed(three[y])
                    )
                    rows.append((block, p, None, blob))
                yield _rows(rows, batch["doc_id"].type)

    return run


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    block, part, ids, blobs = zip(*rows)
    columns = [pa.array(block), pa.array(part, pa.int32()), pa.array(ids, pa.list_(id_type)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "part", "doc_ids", "blob"])


def _summed(parent: np.ndarray, name: np.ndarray, count: np.ndarray, parents: int, names: int):
    """Distinct children of all blocks, sorted by parent and name: (parent, name, count), and each listed one's place."""
    if parents * max(names, 1) < 1 << 63:
        keys, own = np.unique(parent * max(names, 1) + name, return_inverse=True)
        parent, name = np.divmod(keys, max(names, 1))
    else:
        order = np.lexsort((name, parent))
        new = np.ones(len(order), bool)
        new[1:] = (parent[order[1:]] != parent[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        parent, name = parent[order[new]], name[order[new]]
    total = np.zeros(len(parent), np.int64)
    np.add.at(total, own, count)
    return parent, name, total, own


def _answered(table: pa.Table) -> pa.Table:
    """One range: sum all blocks' counts, build the trie, ask it for each distinct n-gram and answer every block."""
    asked = []
    for blob in table["blob"].to_pylist():
        words, uses, sizes, second, two, deep, third, three = parted(blob)
        number = lambda b: unpacked(b).astype(np.int64)
        asked.append((np.frombuffer(words, np.uint64), number(uses), number(sizes), whole_hashes(second), number(two), number(deep), whole_hashes(third), number(three)))
    column = lambda i: np.concatenate([a[i] for a in asked])
    words, own = np.unique(column(0), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, own, column(1))
    second, third = column(3), column(6)
    names = np.unique(np.concatenate([second, third]))
    parent, name, count, pair = _summed(np.repeat(own, column(2)), np.searchsorted(names, second), column(4), len(words), len(names))
    above, deep, often, triple = _summed(np.repeat(pair, column(5)), np.searchsorted(names, third), column(7), len(parent), len(names))
    # The trie holds what training texts have; a node's parent is then in it too, in the same order.
    has, deep_has = count > 0, often > 0
    kept = np.unique(parent[has])
    rank_of = np.cumsum(has) - 1
    with tempfile.TemporaryDirectory() as folder:
        Trie.write(
            folder, words[kept], names,
            (np.searchsorted(kept, parent[has]), name[has], count[has]),
            (rank_of[above[deep_has]], deep[deep_has], often[deep_has]),
        )
        trie = Trie(folder)
        one = trie.words.find(words)
        two = trie.two.find(one[parent], trie.vocabulary.find(names)[name])
        three = trie.three.find(two[above], trie.vocabulary.find(names)[deep])
        codes = [trie.code("one_rest", one), trie.code("two_code", two), trie.code("two_rest", two), trie.code("three_code", three)]
        books = [b.tobytes() for b in trie.books]
        del trie
    blobs, x, y = [], 0, 0
    for own_words, *_, seconds, _, _, thirds, _ in ((a[0], a[1], a[3], a[4], a[5], a[6], a[7]) for a in asked):
        at = np.searchsorted(words, own_words)
        mine, mine_deep = pair[x : x + len(seconds)], triple[y : y + len(thirds)]
        x, y = x + len(seconds), y + len(thirds)
        blobs.append(joined(packed(total[at]), packed(codes[0][at]), packed(codes[1][mine]), packed(codes[2][mine]), packed(codes[3][mine_deep]), *books))
    n = len(blobs)
    known = int((total > 0).sum())
    return pa.table(
        [table["block"], table["part"], pa.array(blobs, pa.binary()), pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), pa.array([known] + [0] * (n - 1), pa.int64())],
        names=["block", "part", "blob", "tokens", "words"],
    )


SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(train_tokens: int, vocabulary: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["part", "doc_ids", "blob"]).to_pylist()
        answers = sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"])
        texts = [(i, r) for i, r in enumerate(rows) if r["part"] is None]
        if not texts or not answers:
            raise ValueError("the input's rows changed between two readings of it")
        out, ids, found, last = [], [], [], -1
        for r in answers:
            if r["part"] == last:
                continue  # equal blocks have equal answers
            last = r["part"]
            total, *codes = parted(r["blob"])
            values = [np.frombuffer(book)[unpacked(code)] for code, book in zip(codes[:4], codes[4:])]
            found.append((unpacked(total).astype(np.int64), *values))
        c, one_rest, two, two_rest, three = map(np.concatenate, zip(*found))
        # A context that no training text has leaves everything to the shorter one.
        one_rest, two_rest = np.where(one_rest > 0, one_rest, 1.0), np.where(two_rest > 0, two_rest, 1.0)
        for i, r in texts:
            k, *body = parted(r["blob"])
            tokens, numbers, held_out = map(unpacked, body)
            tokens, numbers, k = tokens.astype(np.int64), numbers.astype(np.int64), int.from_bytes(k, "little")
            grams = Stream(numbers, tokens, k, order)
            if len(c) != k or len(two) != len(grams.pairs) or len(three) != len(grams.triples):
                raise ValueError("the input's rows changed between two readings of it")
            single = (c + 1) / (train_tokens + vocabulary + 1)
            word = numbers[grams.at]
            base = np.log10(single)[word]
            first, second = np.divmod(grams.pairs, k)
            pairs = two + one_rest[first] * single[second]
            full = np.log10(pairs)[grams.pair]
            place = np.flatnonzero(grams.later)
            full[place] = np.log10(three[grams.triple] + two_rest[grams.pair[place - 1]] * pairs[grams.pair[place]])
            ends = np.concatenate([[0], np.cumsum(tokens)])
            add = lambda v: np.add.reduceat(v, ends[:-1])
            out.append((held_out.astype(bool), tokens, sums(c[word] > 0, ends), add(base), add(full)))
            ids.append(table["doc_ids"][i].values)
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table([pa.chunked_array(ids), *map(pa.array, columns)], names=["doc_id", *(f.split()[0] for f in SCORES.split(", "))])

    return run


def scores(
    docs: DataFrame, *, folds: int = 7, held_fold: int = 2, block_bytes: int = BLOCK_BYTES, parts: int | None = None, order: int = 3
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) modulo ``folds`` is not
    ``held_fold`` (a null doc_id counts as empty text). A null or empty text is
    its end token alone. Repeated rows count and are scored each; other columns
    are ignored. ``docs`` is read twice and must give the same rows in the same
    tasks each time, as a scan of files does; otherwise scoring fails. ``parts``
    is the number of ranges of first words, by default one for every PART_BYTES
    of text, and at least the session's number of shuffle partitions. ``order`` is
    the longest n-gram's, 2 or 3.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select("doc_id", (fold == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    schema = f"block string, part int, doc_ids array<{id_type}>, blob binary"
    answers = cut(
        rows.mapInArrow(_blocked(parts, block_bytes, True, order), schema)
        .groupBy("part")
        .applyInArrow(_answered, "block string, part int, blob binary, tokens long, words long")
    )
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    texts = rows.mapInArrow(_blocked(parts, block_bytes, False, order), schema)
    both = texts.unionByName(answers.select("block", "part", F.lit(None).cast(f"array<{id_type}>").alias("doc_ids"), "blob"))
    scored = both.groupBy("block").applyInArrow(_scored(*map(int, total), order), f"doc_id {id_type}, {SCORES}")
    return scored.withColumn("train_tokens", F.lit(int(total[0])).cast("long"))
