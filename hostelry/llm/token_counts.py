"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The transducer reads the bytes of one pre-token. Its state holds, for every
start from which a vocabulary entry may still grow, the last token of the
encoding up to that start and the tokens emitted since; reading a byte moves to
one next state and emits the change in the token count (a merge takes tokens
back, so it may be negative). States are made when first reached and kept up to
a bound, as regular-expression engines do.

A long text is cut into chunks, which are mapped in parallel. A chunk's map takes
the state that enters (how far the current pre-token began before it, and the
transducer's state there) to the state that leaves and the tokens emitted between.
States of a transducer that forgets what lies some hundred characters back are few:
the entering one is read off the characters before the chunk, from the last certain
boundary among them, or, in a run that has none, from some way into it. Maps compose
if the state that one expects is the state that the one before leaves, which a scan
over the chunks' numbers checks. Texts where a guess was wrong are mapped again from
further back; where that is wrong too, their chunks pass in order through one task,
which carries the state from one to the next. Chunks are cut in one reading of the
text, and none sees more of it than a margin.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import per_process

#: Between a character that is not white space and one that is, a pre-token always ends.
#: The pattern's white space leaves out four control characters that Python's has.
BOUNDARY = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Without this, every space follows a character that is not white space.
AFTER_SPACE = re.compile(r"\s ")
CHUNK = 32_768
#: Characters before a chunk that its entering state is read off, by round; and those after it that may decide a boundary.
BEFORE, AFTER = (1024, 65_536), 64
#: A pre-token that began further back than this is told apart by the transducer's state alone.
MEMORY = BEFORE[0]
MAX_STATES = 200_000
MAX_UNITS = 300_000


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Transducer:
    """Counts the tokens of pre-tokens; deterministic, compiled state by state."""

    def __init__(self, merges: list[tuple[bytes, bytes]], max_states: int = MAX_STATES):
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair, token = (self.number[left], self.number[right]), len(self.parts)
            self.merged[pair] = token
            self.number[left + right] = token
            self.parts.append(pair)
        # Prefix tree of the vocabulary: children by byte, and the token that ends at a node.
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for text, token in self.number.items():
            node = 0
            for b in text:
                if (child := self.children[node].get(b)) is None:
                    child = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = token
        self.fitting: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states; -1 stands for the start of a pre-token."""
        begin = ((0, -1, 0),)
        self.states = [begin]
        self.names = {begin: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding: no earlier merge crosses the border."""
        if left < 0:
            return True
        pair = (left, right)
        if (known := self.fitting.get(pair)) is None:
            known = self.fitting[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges until both are single bytes; a merge across
        # the border that ranks before the one just undone would have happened first.
        bound = len(self.parts)
        while True:
            across = self.merged.get((left, right), bound)
            if across < bound:
                return False
            if left > right and left >= 256:
                bound, left = left, self.parts[left][1]
            elif right >= 256:
                # On a tie in time the border pair, standing further left, merges first.
                bound, right = right + 1, self.parts[right][0]
            elif left >= 256:
                bound, left = left, self.parts[left][1]
            else:
                return True

    def step(self, state: int, byte: int) -> tuple[int, int]:
        grown, token, delta = [], -1, 0
        for node, last, since in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            grown.append((child, last, since))
            if token < 0 and (end := self.token_at[child]) >= 0 and self.fits(last, end):
                token, delta = end, since + 1
        key = (*((n, last, since - delta) for n, last, since in grown if self.children[n]), (0, token, 0))
        if (to := self.names.get(key)) is None:
            to = self.names[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (to, delta)
        return move

    def run(self, text: bytes, begin: tuple = ()) -> tuple[int, tuple]:
        """Tokens of a pre-token, or of a part of one that ``begin`` enters, and the state after it."""
        if len(self.states) > self.max_states:
            self.reset()
        state = total = 0
        moves = self.moves
        if begin and (state := self.names.get(begin)) is None:
            state = self.names[begin] = len(self.states)
            self.states.append(begin)
            moves.append({})
        for byte in text:
            state, delta = moves[state].get(byte) or self.step(state, byte)
            total += delta
        return total, self.states[state]


class Units(dict):
    """Token counts of units of text: white space, then the run after it."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = printable_bytes()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.transducer = Transducer([(raw(a), raw(b)) for a, b in merges])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or "(?!)")
        self.pattern = regex.compile(pattern)

    def __missing__(self, unit: str) -> int:
        parts = self.special.split(unit)
        n = len(parts) - 1
        for part in parts:
            for piece in self.pattern.findall(part):
                n += self.transducer.run(piece.encode())[0]
        if len(unit) < 64:
            self[unit] = n
        return n


class Counter:
    """Counts whole texts and chunk maps."""

    def __init__(self, path: str, pattern: str):
        self.units = Units(path, pattern)

    def whole(self, text: str) -> int:
        """Tokens of a text that enters in the start state."""
        if len(self.units) > MAX_UNITS:
            self.units.clear()
        if AFTER_SPACE.search(text):
            units = UNIT.findall(text)
        else:
            units = text.replace(" ", "\0 ").split("\0") if "\0" not in text else UNIT.findall(text)
        return sum(map(self.units.__getitem__, units))

    def at(self, text: str, start: int, place: int) -> tuple[int, int, int, tuple]:
        """Where the pre-token at ``place`` begins, tokens from there to ``place``, and the state there.

        ``start`` is a begin of a pre-token, or a guess of one.
        """
        begin = special = start
        while begin < place:
            match = self.units.special.search(text, special)
            stop = match.start() if match else len(text)
            if special <= begin < stop:
                part = text[begin:stop]
                for piece in self.units.pattern.finditer(part):
                    if begin + piece.end() > place:
                        at = begin + piece.start()
                        tokens, state = self.units.transducer.run(text[at:place].encode())
                        return at, tokens, state
                begin = stop
            if match is None:
                break
            if match.end() > place > match.start():
                return match.start(), 0, ("special", place - match.start())
            begin = special = match.end()
        return place, 0, self.units.transducer.states[0]

    def continued(self, carried: tuple, chunk: str, after: str) -> tuple[int, tuple]:
        """(tokens emitted in the chunk, what is carried on) from what the chunk before carried.

        That is: characters that stand for the open pre-token, the transducer's state in it,
        and how many characters belong to a special token that has been counted.
        """
        context, state, skip = carried
        if skip:
            chunk, skip = chunk[skip:], max(skip - len(chunk), 0)
            if not chunk:
                return 0, ("", (), skip)
        text, place = context + chunk + after, len(context) + len(chunk)
        total = begin = special = 0
        known = len(context)
        while begin < place:
            match = self.units.special.search(text, special)
            stop = match.start() if match else len(text)
            for piece in self.units.pattern.finditer(text[begin:stop]):
                at, end = begin + piece.start(), begin + piece.end()
                if at >= place:
                    return total, ("", (), 0)
                own = text[max(at, known) : min(end, place)].encode()
                tokens, left = self.units.transducer.run(own, state if at < known else ())
                total += tokens
                if end > place:
                    # Two characters tell the kind of a pre-token, and the last whether it may go on.
                    open_part = text[at:place]
                    return total, (open_part if len(open_part) < 4 else open_part[:2] + open_part[-1], left, 0)
            if match is None or match.start() >= place:
                break
            total += 1
            if match.end() > place:
                return total, ("", (), match.end() - place)
            begin = special = match.end()
        return total, ("", (), 0)

    def chunk_map(self, before: str, chunk: str, after: str, first: bool) -> tuple[int, bytes, bytes]:
        """(tokens emitted in the chunk, state expected to enter, state that leaves)."""
        text = before + chunk + after
        a, b = len(before), len(before) + len(chunk)
        start = 0
        if not first:
            start = max((m.start() for m in BOUNDARY.finditer(text, 0, a + 1) if m.start() <= a), default=0)
        later = [m.start() for m in BOUNDARY.finditer(text, a, b + 1) if a < m.start() <= b][-1:]
        begin, tokens, state = self.at(text, start, a)
        end, more, left = self.at(text, later[0] if later else start, b)
        named = lambda offset, state: hashlib.blake2b(repr((min(offset, MEMORY), state)).encode(), digest_size=16).digest()
        between = self.whole(text[begin:end])
        if end < len(text) and BOUNDARY.match(text[end] + " ", 1) and not self.units.special.match(text, end):
            # White space before a character that is none leaves its last one to a pre-token of its own.
            between = self.whole(text[begin : end + 1]) - self.whole(text[end])
        return between + more - tokens, named(a - begin, state), named(b - end, left)


def _counted(path: str, pattern: str):
    def run(batches):
        count = per_process((path, pattern), lambda: Counter(path, pattern))
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in batch.schema.names if c != "text"), pa.array([count.whole(t or "") for t in texts], pa.int64())],
                [*(c for c in batch.schema.names if c != "text"), "n_tokens"],
            )

    return run


def _chunks_mapped(path: str, pattern: str):
    def run(batches):
        count = per_process((path, pattern), lambda: Counter(path, pattern))
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("before", "text", "after", "first"))
            maps = [count.chunk_map(*row) for row in zip(*columns)]
            n, enters, leaves = zip(*maps) if maps else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["chunk"], pa.array(n, pa.int64()), pa.array(enters, pa.binary()), pa.array(leaves, pa.binary())],
                ["key", "chunk", "n", "enters", "leaves"],
            )

    return run


def _chunked(size: int, before: int):
    """Chunks of each text with ``before`` characters in front and ``AFTER`` behind; ``first`` if these reach its begin."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                rows = []
                for i, at in enumerate(range(0, len(text), size)):
                    end = at + size
                    rows.append((key, i, text[max(at - before, 0) : at], text[at:end], text[end : end + AFTER], at <= before))
                    if len(rows) == 64 or end >= len(text):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK.types)], schema=_CHUNK)
                        rows = []

    return run


_CHUNK = pa.schema(
    [("key", pa.binary()), ("chunk", pa.int64()), ("before", pa.string()), ("text", pa.string()), ("after", pa.string()), ("first", pa.bool_())]
)


def _chunks(texts: DataFrame, size: int, before: int) -> DataFrame:
    return texts.mapInArrow(_chunked(size, before), "key binary, chunk long, before string, text string, after string, first boolean")


def scanned(texts: DataFrame, tokenizer_path: str, pattern: str, chunk_chars: int, before: int) -> DataFrame:
    """key, n_tokens and sure for each text (key, text): the composition of its chunks' maps.

    A chunk sees ``before`` characters in front of it.
    """
    chunks = _chunks(texts, chunk_chars, before).repartition(F.col("key"), F.col("chunk"))
    maps = chunks.mapInArrow(_chunks_mapped(tokenizer_path, pattern), "key binary, chunk long, n long, enters binary, leaves binary")
    # Texts that occur more than once are one here.
    once = maps.groupBy("key", "chunk").agg(*(F.min(c).alias(c) for c in ("n", "enters", "leaves")))
    fits = F.coalesce(F.lag("leaves").over(Window.partitionBy("key").orderBy("chunk")) == F.col("enters"), F.col("chunk") == 0)
    return once.withColumn("fits", fits).groupBy("key").agg(F.sum("n").alias("n_tokens"), F.min("fits").alias("sure"))


def _in_order(path: str, pattern: str):
    def run(batches):
        count = per_process((path, pattern), lambda: Counter(path, pattern))
        key, last, total, carried = None, -1, 0, ("", (), 0)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([total], pa.int64()), pa.array([True])], ["key", "n_tokens", "sure"])

        for batch in batches:
            for own, chunk, text, after in zip(*(batch[c].to_pylist() for c in ("key", "chunk", "text", "after"))):
                if own != key:
                    if key is not None:
                        yield row()
                    key, last, total, carried = own, -1, 0, ("", (), 0)
                if chunk > last:  # a text that occurs more than once comes so here
                    tokens, carried = count.continued(carried, text, after)
                    total, last = total + tokens, chunk
        if key is not None:
            yield row()

    return run


def in_order(texts: DataFrame, tokenizer_path: str, pattern: str, chunk_chars: int) -> DataFrame:
    """The same as ``scanned``, always sure: chunks pass one after the other with the state that the one before left."""
    chunks = _chunks(texts, chunk_chars, 0).repartition("key").sortWithinPartitions("key", "chunk")
    return chunks.mapInArrow(_in_order(tokenizer_path, pattern), "key binary, n_tokens long, sure boolean")


def token_counts(
    docs: DataFrame, tokenizer_path: str, pattern: str, *, limit: int = 512, chunk_chars: int = CHUNK
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted
    each; columns other than doc_id and text are ignored, whatever their names.
    A special token's string inside a text counts as one token, as the
    tokenizer file's library has it by default.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    long = F.length("text") > chunk_chars
    short_rows = (
        base.where(~long)
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        .mapInArrow(_counted(tokenizer_path, pattern), f"doc_id {_type(docs, 'doc_id')}, n_bytes long, n_tokens long")
    )
    key = F.unhex(F.sha2("text", 256)).alias("key")
    long_rows = base.where(long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), key, "text")
    texts, found = long_rows.select("key", "text"), None
    for before in (*BEFORE, None):
        composed = in_order(texts, tokenizer_path, pattern, chunk_chars) if before is None else scanned(texts, tokenizer_path, pattern, chunk_chars, before)
        maps = cut(composed)
        found = maps.where("sure") if found is None else found.unionByName(maps.where("sure"))
        unsure = maps.where("NOT sure").select("key")
        if unsure.isEmpty():
            break
        texts = long_rows.select("key", "text").join(unsure, "key", "left_semi")
    long_rows = long_rows.select("doc_id", "n_bytes", "key").join(found, "key").select("doc_id", "n_bytes", "n_tokens")
    return short_rows.unionByName(long_rows).withColumn("over_limit", F.col("n_tokens") > limit)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
