"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are taken in blocks. Within a block every pre-token gets a number, the
texts become runs of those numbers in order of position, and the block's
distinct pre-tokens are dealt out by a hash of their bytes. Where they meet, each
distinct word of the whole input is encoded once; its ids go back to every block
that has it, and the block puts its texts together again by position. Decoding
joins ids with the table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import heapq

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.llm.arrays import freed, gathered, in_batches, in_slices, packed, per_process, released, sums, text_bytes, unpacked
from hostelry.llm.units import LETTER, units, word_cuts

#: UTF-8 bytes of text in a block; a longer text is a block of its own. An Arrow batch and its last row make one block.
BLOCK_BYTES = 6 << 20
#: Bytes of letters below U+0280, which are letters in every version of Unicode: ASCII, and leads and others of two bytes.
IN_WORD = LETTER.copy()
IN_WORD[0x80:0xC0] = IN_WORD[0xC3:0xCA] = True


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The stretches of ``data`` between successive ends, which are not copied."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def _bytes_of(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and its n+1 offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_word(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each stretch is letters below U+0280, with or without a space in front: one pre-token."""
    inside = IN_WORD[data]
    inside[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the signs of times and division
    inside[ends[:-1][data[ends[:-1]] == 0x20]] = True
    return sums(~inside, ends) == 0


def packed_words(data: np.ndarray, ends: np.ndarray) -> bytes:
    """The words of ``data`` between successive ends."""
    head = np.concatenate([[len(ends) - 1], np.diff(ends)]).astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + data[ends[0] : ends[-1]].tobytes())


def unpacked_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    at = 4 + 4 * n
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends)]


def named(doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> str:
    """A block's name: a hash of all that is in it, so other contents never pass for the same block."""
    whole = hashlib.sha256(repr((doc_ids, np.diff(offsets).tolist())).encode())
    whole.update(data)
    return whole.hexdigest()[:32]


def framed(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Merges:
    """Byte-pair merges by rank: in each word the pair of least rank merges first, the leftmost of equal ones.

    Words are merged together, one pair in each of them at a time; long ones, where
    that would take many rounds, each by a queue of its pairs.
    """

    LONG = 48
    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merged(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        at = int(np.searchsorted(self.keys, key))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == key else None

    def encoded(self, words: list[bytes]) -> list[array]:
        """The ids of each word."""
        out: list[array | None] = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[i] = array("I", [rank])
            elif len(word) > self.LONG:
                out[i] = array("I", self.queued(word))
            else:
                rest.append(i)
        if rest:
            flat, ends = self.together([words[i] for i in rest])
            whole = flat.astype(np.uint32)
            for i, a, b in zip(rest, ends[:-1].tolist(), ends[1:].tolist()):
                out[i] = array("I", whole[a:b].tobytes())
        return out

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin."""
        sizes = np.array([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), self.NONE)
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.flatnonzero((self.keys[at] == key) & (owner[:-1] == owner[1:]))
            rank[found] = self.values[at[found]]
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, begin)
            spread = np.repeat(least, np.diff(np.append(begin, len(ids))))
            ended = spread == self.NONE
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            place = np.flatnonzero((rank == spread) & ~ended)
            place = place[np.append(True, owner[place[1:]] != owner[place[:-1]])] if len(place) else place
            ids[place] = rank[place]
            keep = ~ended
            keep[place + 1] = False
            ids, owner = ids[keep], owner[keep]
        flat, of = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(of, kind="stable")
        return flat[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def queued(self, word: bytes) -> list[int]:
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, n = self.merged, len(ids)
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i], ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (r := get(ids[x], ids[y])) is not None:
                    heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


BLOCKS = "block string, part int, doc_ids array<{id}>, blob binary"


def _numbered(data: np.ndarray, offsets: np.ndarray, split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's distinct pre-tokens, and its texts as the numbers of theirs: how many each has, and all end to end.

    Texts are cut into units where a pre-token always begins. Of distinct units those
    that are one pre-token by their bytes are told together, the others are split.
    """
    borders = units(data, offsets, word_cuts)
    coded = binaries(data, borders).dictionary_encode()
    found = coded.dictionary
    whole = is_word(*_bytes_of(found))
    split_up = [split.findall(unit.decode()) for unit in found.filter(pa.array(~whole)).to_pylist()]
    lengths = np.ones(len(found), np.int64)
    lengths[~whole] = np.fromiter(map(len, split_up), np.int64, len(split_up))
    pieces = pa.array([piece.encode() for unit in split_up for piece in unit], pa.large_binary())
    words = pa.concat_arrays([found.filter(pa.array(whole)), pieces]).dictionary_encode()
    number, is_one = words.indices.to_numpy(), np.repeat(whole, lengths)
    flat = np.empty(len(number), np.int64)
    flat[is_one], flat[~is_one] = np.split(number, [np.count_nonzero(whole)])
    numbers, sizes = gathered(flat, np.concatenate([[0], np.cumsum(lengths)]), coded.indices.to_numpy())
    return words.dictionary, sums(sizes, np.searchsorted(borders, offsets)), numbers


def _texts_of_blocks(words: pa.Array, sizes: np.ndarray, numbers: np.ndarray, doc_ids: list) -> list[tuple]:
    """One row: the block's texts as runs of word numbers."""
    return [(None, doc_ids, packed(np.concatenate([[len(sizes), len(words)], sizes, numbers])))]


def _words_of_blocks(words: pa.Array, parts: int) -> list[tuple]:
    """A row for each part that has words of the block: their numbers and bytes."""
    part = np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)) % parts
    order = np.argsort(part, kind="stable")
    data, ends = _bytes_of(words.take(pa.array(order)))
    own, first = np.unique(part[order], return_index=True)
    last = [*first[1:].tolist(), len(order)]
    return [(p, None, framed(packed(order[a:b]), packed_words(data, ends[a : b + 1]))) for p, a, b in zip(own.tolist(), first.tolist(), last)]


def _blocked(pattern: str, parts: int | None, block_bytes: int):
    """Rows for each block: its texts, or with ``parts`` its words dealt out."""

    @freed
    def run(batches):
        split = regex.compile(pattern)
        for big in batches:
            for batch in in_slices(big, "text", block_bytes):
                batch["text"].validate(full=True)
                data, offsets = text_bytes(batch["text"])
                doc_ids = batch["doc_id"].to_pylist()
                block = named(doc_ids, data, offsets)
                words, sizes, numbers = _numbered(data, offsets, split)
                rows = _words_of_blocks(words, parts) if parts else _texts_of_blocks(words, sizes, numbers, doc_ids)
                if rows:
                    part, ids, blobs = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(rows)), pa.array(part, pa.int32()), pa.array(ids, pa.list_(batch["doc_id"].type)), pa.array(blobs, pa.binary())],
                        ["block", "part", "doc_ids", "blob"],
                    )

    return run


def _encoded(ranks_path: str):
    """For one part of all distinct words: encode each once, and answer every block."""

    @freed
    def run(batches):
        merges = per_process(("merges", ranks_path), lambda: Merges(read_ranks(ranks_path)))
        ids_of: dict[bytes, array] = {}
        for batch in batches:
            out = []
            for blob in batch["blob"].to_pylist():
                size = int.from_bytes(blob[:4], "little")
                numbers, words = blob[4 : 4 + size], blob[4 + size :]
                own = unpacked_words(words)
                new = [word for word in own if word not in ids_of]
                ids_of.update(zip(new, merges.encoded(new)))
                found = [ids_of[word] for word in own]
                n = len(found)
                flat = np.frombuffer(b"".join(found), np.uint32)
                out.append(packed(np.concatenate([[n], unpacked(numbers), [len(i) for i in found], flat])))
            yield pa.RecordBatch.from_arrays(
                [batch["block"], pa.nulls(len(out), batch["doc_ids"].type), pa.array(out, pa.binary())], ["block", "doc_ids", "blob"]
            )

    return run


def _assembled(table: pa.Table) -> pa.Table:
    """One block: word numbers replaced by ids, text by text."""
    is_text = np.array([x is not None for x in table["doc_ids"].to_pylist()])
    blobs = table["blob"].to_pylist()
    numbers, lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob, texts in zip(blobs, is_text):
        if not texts:
            values = unpacked(blob).astype(np.int64)
            n = values[0]
            numbers.append(values[1 : n + 1])
            lengths.append(values[n + 1 : 2 * n + 1])
            ids.append(values[2 * n + 1 :])
    number, length, flat = map(np.concatenate, (numbers, lengths, ids))
    doc_ids, out = [], []
    # Equal blocks have equal contents and equal answers, so each row of texts takes all of them.
    for at in np.flatnonzero(is_text).tolist():
        values = unpacked(blobs[at]).astype(np.int64)
        n, distinct = values[:2].tolist()
        begin, size = np.zeros(distinct, np.int64), np.full(distinct, -1, np.int64)
        begin[number], size[number] = np.cumsum(length) - length, length
        if (size < 0).any():
            raise ValueError("the input's rows changed between two readings of it")
        ends = np.concatenate([[0], np.cumsum(values[2 : n + 2])])
        words = values[n + 2 :]
        doc_ids.append(table["doc_ids"][at].values)
        # Text by text, so that the working arrays are those of one text.
        for a, b in zip(ends[:-1], ends[1:]):
            picks = words[a:b]
            sizes = size[picks]
            total = np.cumsum(sizes)
            index = np.arange(total[-1] if len(total) else 0) + np.repeat(begin[picks] - (total - sizes), sizes)
            out.append(flat[index].astype("<u4").tobytes())
    if not doc_ids:
        raise ValueError("the input's rows changed between two readings of it")
    return pa.table([pa.chunked_array(doc_ids), pa.array(out, pa.binary())], names=["doc_id", "ids"])


def _put_together(table: pa.Table) -> pa.Table:
    """``_assembled``, after which the worker gives its working arrays back."""
    out = _assembled(table)
    released()
    return out


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, parts: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, end to end) for every row of ``docs``.

    A null or empty text has no ids; repeated rows are encoded each; other
    columns are ignored. ``docs`` is read twice and must give the same rows in
    the same tasks each time, as a scan of files does; otherwise encoding fails.
    ``parts`` is the number of shares the distinct words are
    dealt into, by default the session's number of shuffle partitions.
    """
    in_batches(docs.sparkSession)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows, schema = docs.select("doc_id", F.col("text").cast("string").alias("text")), BLOCKS.format(id=id_type)
    # Reading the rows twice spares a stored copy of all texts; a block's name tells if the readings differ.
    answers = (
        rows.mapInArrow(_blocked(pattern, parts, block_bytes), schema)
        .groupBy("part")
        .applyInArrow(_with_iterator(_encoded(ranks_path)), f"block string, doc_ids array<{id_type}>, blob binary")
    )
    texts = rows.mapInArrow(_blocked(pattern, None, block_bytes), schema).select("block", "doc_ids", "blob")
    return texts.unionByName(answers).groupBy("block").applyInArrow(_put_together, f"doc_id {id_type}, ids binary")


def _with_iterator(run):
    from collections.abc import Iterator

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    each.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return each


def _decoded(ranks_path: str):
    @freed
    def run(batches):
        def token_table():
            by_id = sorted((i, t) for t, i in read_ranks(ranks_path).items())
            offsets = np.zeros(by_id[-1][0] + 2, np.int64)
            for i, t in by_id:
                offsets[i + 1] = len(t)
            return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), np.cumsum(offsets)

        data, offsets = per_process(("token bytes", ranks_path), token_table)
        for batch in batches:
            out = []
            for ids in batch["ids"].to_pylist():
                picks = np.frombuffer(ids or b"", "<u4").astype(np.int64)
                out.append(gathered(data, offsets, picks)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` (null: none)."""
    in_batches(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(ranks_path), f"{fields}, decoded binary")
