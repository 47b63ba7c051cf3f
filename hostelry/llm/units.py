"""Tokens of whole texts by way of units: stretches of text that a tokenizer never joins across.

Texts of a slice are laid end to end and cut into units by whole-array tests. Each
distinct unit goes to the tokenizer's library once and is kept, up to a bound; all
others are looked up by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from hostelry.llm.arrays import SPACE, gathered, word_hashes

#: UTF-8 bytes of text taken at a time; a longer unit widens it.
PART = 2 << 20
#: Distinct units kept from part to part, and ids of them.
KEPT, KEPT_IDS = 1 << 20, 1 << 23


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is Unicode white space (places of 3 and more)."""
    a, b, c = data[at - 1], data[at - 2], data[at - 3]
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & (b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    others = ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE2) & (b == 0x81) & (a == 0x9F)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    return SPACE[a] | two | general | others


LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Marks that end a word and occur in no special token.
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in ".,;:!?"]] = True


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Marks places where a pre-token of a byte-level pattern always begins.

    They lie between a character that is not white space and ASCII white space, and
    between an ASCII letter and a mark. (The pattern takes letters apart from all else,
    and white space goes to what follows it.)
    """
    out = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(SPACE[data])
    at = at[at >= 3]
    out[at[~_ends_in_space(data, at)]] = True
    out[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]]
    return out


def space_cuts(data: np.ndarray) -> np.ndarray:
    """Marks places before a space and behind a character that is neither white space nor U+2581.

    A byte-level pattern begins a pre-token there, and a piece vocabulary whose pieces
    hold U+2581 only in front has no piece across.
    """
    out = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(data == 0x20)
    at = at[at >= 3]
    lower = (data[at - 3] == 0xE2) & (data[at - 2] == 0x96) & (data[at - 1] == 0x81)
    out[at[~(lower | _ends_in_space(data, at))]] = True
    return out


def units(data: np.ndarray, offsets: np.ndarray, cuts: Callable) -> np.ndarray:
    """Where units begin, and behind them the end of ``data``; every text that has any bytes begins one."""
    marked = cuts(data)
    marked[offsets] = True
    return np.flatnonzero(marked)


def distinct(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct units in order, the first unit with each, and every unit's number among them."""
    hashes = word_hashes(data, begins[:-1], begins[1:], False)
    coded = pa.array(hashes).dictionary_encode()
    found, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.zeros(len(found), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], first[order], place[number]


class Kept:
    """Ids of units, as ``encode`` gives them for a list of units (end to end, and how many each has)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.row, self.flat, self.ends = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def rows(self, data: np.ndarray, begins: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows in ``flat`` and ``ends`` of distinct units (rising hashes, and a unit with each)."""
        if len(self.hashes) > (self.most or KEPT) or len(self.flat) > KEPT_IDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        rows = np.empty(len(hashes), np.int64)
        rows[known] = self.row[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            view = memoryview(np.ascontiguousarray(data))
            picks = first[new]
            names = [bytes(view[a:b]) for a, b in zip(begins[picks].tolist(), begins[picks + 1].tolist())]
            flat, lengths = self.encode(names)
            rows[new] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.hashes, self.row = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.row, at[new], rows[new])
        return rows

    def ids(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and how many each has."""
        hashes, first, number = distinct(data, begins)
        rows = self.rows(data, begins, hashes, first)
        return gathered(self.flat, self.ends, rows[number])


def encoded(data: np.ndarray, offsets: np.ndarray, cuts: Callable, kept: Kept) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n+1 places in them where texts begin or end.

    A long text is taken in parts that end with a unit.
    """
    borders = units(data, offsets, cuts)
    flats, counts, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while at < len(borders) - 1:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + PART, "right")) - 1)
        flat, n = kept.ids(data[borders[at] : borders[to]], borders[at : to + 1] - borders[at])
        flats.append(flat)
        counts.append(n)
        at = to
    total = np.cumsum(np.concatenate(counts))
    return np.concatenate(flats), total[np.searchsorted(borders, offsets)]


class ByteLevel:
    """Ids of a byte-level vocabulary for units that white space begins, or that begin or end a text.

    ``ranks`` is the vocabulary for a library that takes long texts fast; ``whole``
    encodes texts by the vocabulary's own library. Units of characters below U+0180,
    whose classes are the same in every version of Unicode, are laid end to end for the
    first; all others, and those that hold a special token's string, go to the second.
    """

    def __init__(self, fast: Callable[[str], list[int]], whole: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], special: list[bytes]):
        self.fast, self.whole = fast, whole
        self.other = re.compile(b"|".join([rb"[\xc6-\xff]", *map(re.escape, special)]))
        self.token_bytes = token_bytes
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)

    def __call__(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units' ids end to end, and how many each has."""
        plain = [self._joins(name) for name in names]
        laid = b"".join(name for name, yes in zip(names, plain) if yes)
        flat = np.array(self.fast(laid.decode()), np.uint32)
        ends = np.cumsum(np.fromiter((len(n) for n, yes in zip(names, plain) if yes), np.int64, sum(plain)))
        if len(plain) == len(ends):
            return flat, self._counts(flat, ends)
        rest = self.whole([name.decode() for name, yes in zip(names, plain) if not yes])
        lengths = np.empty(len(names), np.int64)
        is_plain = np.array(plain)
        lengths[is_plain], lengths[~is_plain] = self._counts(flat, ends), [len(ids) for ids in rest]
        out = np.empty(int(lengths.sum()), np.uint32)
        owner = np.repeat(is_plain, lengths)
        out[owner], out[~owner] = flat, np.fromiter(itertools.chain.from_iterable(rest), np.uint32, int((~owner).sum()))
        return out, lengths

    def _joins(self, name: bytes) -> bool:
        """Whether a unit keeps its ids between others of this kind, and the fast library has the same ids."""
        return name[0] in b" \t\n\r" and name[-1] > 0x20 and self.other.search(name) is None

    def _counts(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        places = np.searchsorted(np.cumsum(self.sizes[flat]), ends) + 1
        return np.diff(places, prepend=0)


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def byte_level(path: str, pattern: str, special_as_text: bool) -> ByteLevel:
    """The encoder of a byte-level BPE file; special tokens' strings become their ids unless they are plain text.

    The fast library gets its ranks from the file: the ids of its entries, which rise in order of merging.
    """
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = special_as_text
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = printable_bytes()
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    ids = {i: bytes(byte[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if i not in added}
    del spec
    token_bytes = [b""] * (max([*ids, *added]) + 1)
    for i, text in (ids | added).items():
        token_bytes[i] = text
    fast = tiktoken.Encoding("entries", pat_str=pattern, mergeable_ranks={t: i for i, t in ids.items()}, special_tokens={})
    whole = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return ByteLevel(fast.encode_ordinary, whole, token_bytes, list(added.values()))


class Pieces:
    """Ids of a piece vocabulary (U+2581 for a space, bytes as a last resort) for units that a space begins.

    Its library puts a space before a text itself, so a unit goes to it without its own.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("\u2581" in entry.lstrip("\u2581") for entry in entries):
            raise ValueError("a piece goes on behind a space, so texts cannot be taken word by word")
        is_byte = [self.library.is_byte(i) for i in range(len(entries))]
        self.token_bytes = [bytes([int(e[3:5], 16)]) if b else e.replace("\u2581", " ").encode() for e, b in zip(entries, is_byte)]
        self.space = [entries.index("\u2581")]

    def __call__(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode([name[1:].decode() for name in names], num_threads=1)
        # An empty text has no pieces, not even the space before it.
        got = [self.space if name == b" " else ids for name, ids in zip(names, got)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths
