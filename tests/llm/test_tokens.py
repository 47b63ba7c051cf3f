from __future__ import annotations

import base64
import random
import struct
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from hostelry.llm import byte_bpe, token_counts
from hostelry.llm.arrays import text_bytes, unpacked

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(JSON, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def composed(counter, text, size, before, after=64):
    """(tokens, whether every chunk got the state it expected)."""
    maps = [
        counter.chunk_map(text[max(i - before, 0) : i], text[i : i + size], text[i + size : i + size + after], i <= before)
        for i in range(0, max(len(text), 1), size)
    ]
    return sum(n for n, _, _ in maps), all(x[2] == y[1] for x, y in zip(maps, maps[1:]))


def test_transducer_and_chunk_maps_on_mixed_texts(counter, library):
    random.seed(1)
    pool = ["a", "th", "the", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", "é", "1", "23", "!!", "aaaa", "漢", "😀", " ", " x", "ing", "\r\n", "\0", "\x1c"]
    sure = 0
    for _ in range(1500):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 40)))
        want = count(library, text)
        assert counter.whole(text) == want
        size = random.randint(1, 9)
        assert composed(counter, text, size, len(text)) == (want, True)
        got, fits = composed(counter, text, size, random.randint(1, 30))
        sure += fits
        assert got == want or not fits
    assert sure > 700


def carried(counter, text, size, after=64):
    total, state = 0, ("", (), 0)
    for i in range(0, len(text), size):
        tokens, state = counter.continued(state, text[i : i + size], text[i + size : i + size + after])
        total += tokens
    return total


def test_chunks_in_order_carry_the_state(counter, library):
    random.seed(4)
    pool = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "''", "<|endoftext|>", "<|end", "é", "1", "23", "!!", "aaaa", "漢", "😀", "\u00a0", " x", "\r\n", "\0", "\x1c", "=" * 9, " " * 7, "b" * 11]
    for _ in range(1500):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 40)))
        assert carried(counter, text, random.randint(1, 30)) == count(library, text)
    for text in ("x" + "a" * 5000, " " * 777 + "b", "abc" * 3000 + "!", "\n" * 400 + " a", "'" * 50 + "s"):
        for size in (1, 7, 90, 1000):
            assert carried(counter, text, size) == count(library, text)


def test_runs_without_a_boundary_compose(counter, library):
    random.seed(2)
    for alphabet in ("ab", "etaoins", "0123", "=-", " ", " \n", "é漢"):
        text = "".join(random.choice(alphabet) for _ in range(12_000)) + "x."
        assert composed(counter, text, 3000, 1024) == (count(library, text), True)


def test_long_runs(counter, library):
    for text in ("a" * 5000, "ab" * 2000, "é" * 900):
        assert counter.whole(text) == count(library, text)


def test_states_are_bounded(library):
    small = token_counts.Counter(JSON, P.PATTERN)
    small.units.transducer.max_states = 50
    text = "several different words make many more states than fifty of them"
    assert small.whole(text) == count(library, text)


@pytest.mark.parametrize("chunk", [90, 32_768])
def test_counts(docs, library, chunk):
    got = token_counts.token_counts(docs, JSON, P.PATTERN, chunk_chars=chunk).collect()
    want = [(r.doc_id, len((r.text or "").encode()), count(library, r.text or "")) for r in docs.collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_counts_where_no_guess_is_right(docs, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BEFORE", (1, 2))
    some = docs.where("length(text) < 250")
    got = token_counts.token_counts(some, JSON, P.PATTERN, chunk_chars=40).collect()
    assert sorted(r.n_tokens for r in got) == sorted(count(library, r.text) for r in some.collect())


def test_a_text_of_50_mb_without_spaces(spark, counter):
    # Every 1,048,575 characters are the same run of letters, which the slash ends.
    frame = spark.range(1).selectExpr("id AS doc_id", "repeat(concat(repeat('abcdefgh', 131071), 'abcdefg/'), 50) AS text")
    got = token_counts.token_counts(frame, JSON, P.PATTERN).first()
    assert got.n_bytes == 50 << 20
    once = counter.whole("abcdefgh" * 131071 + "abcdefg/")
    assert got.n_tokens == 50 * once


def test_a_long_run_whose_state_no_margin_tells(spark, counter):
    """Tokens of equal letters depend on how far back the run began."""
    frame = spark.range(2).selectExpr("id AS doc_id", "concat('xyz', repeat('a', 400000), ' b') AS text")
    got = [r.n_tokens for r in token_counts.token_counts(frame, JSON, P.PATTERN).collect()]
    assert got == [counter.whole("xyz" + "a" * 400000 + " b")] * 2


def test_merges_against_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    merges = byte_bpe.Merges(ranks)
    random.seed(3)
    syllables = ["a", "aa", "the", "ing", "tion", "er", "é", "漢", "😀", "1", "00", "!", "==", " ", "un", "s", "'", "ab", "ba", "xyz"]
    words = sorted({"".join(random.choice(syllables) for _ in range(random.randint(1, 14))) for _ in range(4000)} | {"a" * n for n in range(1, 200)})
    want = [library.encode_ordinary(w) for w in words]
    assert [list(i) for i in merges.encoded([w.encode() for w in words])] == want
    assert [merges.queued(w.encode()) for w in words if w.encode() not in ranks] == [x for w, x in zip(words, want) if w.encode() not in ranks]


def test_no_rows(none):
    assert token_counts.token_counts(none, JSON, P.PATTERN).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS).count() == 0


@pytest.mark.parametrize("size", [400, 5 << 20])
def test_ids_and_round_trip(docs, size):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    frame = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, block_bytes=size), RANKS)
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in frame.collect()]
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, struct.pack(f"<{len(ids)}I", *ids), (r.text or "").encode()))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_plain_words_are_told_without_the_pattern(monkeypatch):
    """Splitting units one by one, of which most are plain words, took a third of the query's time."""
    asked = []

    class Pattern:
        def __init__(self, pattern):
            self.own = regex.compile(pattern)

        def findall(self, text):
            asked.append(text)
            return self.own.findall(text)

    random.seed(11)
    words = ["".join(random.choices("abcdeéüßøſəɿ", k=random.randint(2, 9))) for _ in range(5000)]
    text = " ".join(words) + ", d'été\n x.y"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, None])], ["doc_id", "text"])
    monkeypatch.setattr(byte_bpe, "regex", SimpleNamespace(compile=Pattern))
    (blocks,) = byte_bpe._blocked(P.PATTERN, None, 1 << 20)(iter([batch]))
    n, distinct, *rest = unpacked(blocks["blob"][0].as_py()).tolist()
    found = regex.findall(P.PATTERN, text)
    assert (n, distinct, rest[:2]) == (2, len(set(found)), [len(found), 0])
    assert len(asked) < 10


def test_pre_tokens_of_blocks_against_the_library():
    """Pre-tokens told by their bytes and those that the pattern tells, over texts laid end to end."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges, split = byte_bpe.Merges(ranks), regex.compile(P.PATTERN)
    random.seed(12)
    pool = [chr(c) for c in range(0x300) if chr(c).isprintable() or c < 0x100] + [" ", "\n", "\u2003", "\u3000", "漢", "😀", "a", "b", ".", ",", "'s", "'ll", "the", "7", "\u0301"] * 9
    for size in (0, 1, 5, 40):
        texts = ["".join(random.choices(pool, k=random.randint(0, size))) for _ in range(900)] + ["", None]
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words, sizes, numbers = byte_bpe._numbered(data, offsets, split)
        ids = merges.encoded(words.to_pylist())
        assert len(set(words.to_pylist())) == len(words) and len(sizes) == len(texts)
        runs = np.split(numbers, np.cumsum(sizes)[:-1])
        assert [[i for n in run for i in ids[n]] for run in runs] == [library.encode_ordinary(t or "") for t in texts]
