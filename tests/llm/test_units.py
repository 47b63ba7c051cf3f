"""Phrases, alignments and packed sequences against plain versions made with the tokenizers' libraries."""

from __future__ import annotations

import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostelry.llm import best_fit_packing, collocations, token_alignment
from hostelry.llm.units import Kept, Pieces, byte_level, encoded, printable_bytes, space_cuts, word_cuts

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a ", "x▁y ▁ z", "　wide   narrow  x", "é . ñ, ü; don't 'll", "a.b,c;d:e!f?g", "<|endoftext|> x<|endoftext|>.", "one  two   three    ",
    "\x1c.\x1d \x85   ​", "漢字 かな 한글 😀 😀", "\t\ttabs\t and\r\nlines\n\n", "\0 nul\0", "=" * 300, "aaaa" * 200, "ſ ŀ Ɓ ƀ ɐ", "1st 2nd 33.4 5,6", "ab " * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def pieces_library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("cuts", [word_cuts, space_cuts])
def test_units_give_the_librarys_ids(cuts, as_text):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = as_text
    kept = Kept(byte_level(JSON, P.PATTERN, as_text))
    for _ in range(2):  # from the library, then from what is kept
        flat, places = encoded(*laid(ODD), cuts, kept)
        got = [flat[a:b].tolist() for a, b in zip(places[:-1], places[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_pieces_word_by_word(pieces_library):
    texts = [" " + t for t in ODD if t]
    flat, places = encoded(*laid(texts), space_cuts, Kept(Pieces(MODEL)))
    assert [flat[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [pieces_library.encode(t) for t in ODD if t]


def frame(spark, docs):
    more = spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    return docs.unionByName(more, allowMissingColumns=True).repartition(3)


def test_parts_and_forgetting(monkeypatch):
    from hostelry.llm import units

    whole, places = encoded(*laid(ODD), word_cuts, Kept(byte_level(JSON, P.PATTERN, False)))
    monkeypatch.setattr(units, "PART", 40)
    monkeypatch.setattr(units, "KEPT", 20)
    flat, other = encoded(*laid(ODD), word_cuts, Kept(byte_level(JSON, P.PATTERN, False)))
    assert flat.tolist() == whole.tolist() and other.tolist() == places.tolist()


LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, words, least, share, top):
    counts, totals, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWERED)):
            found = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(found)
            counts.update((lang, tuple(found[i : i + k])) for k in range(1, words + 1) for i in range(len(found) - k + 1))
    often = {p: n for p, n in counts.items() if n >= least}
    for (lang, phrase), a in often.items():
        longer = [n for (other, q), n in often.items() if other == lang and len(q) > len(phrase) and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))]
        if len(phrase) < 2 or any(100 * n >= share * a for n in longer):
            continue
        cuts = [(often[lang, phrase[:k]], often[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(phrase).encode(), left, right))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return ranked


@pytest.mark.parametrize("width_bits, at_a_time, share", [(16, 1 << 19, 100), (6, 7, 60)])
def test_collocations(spark, docs, monkeypatch, width_bits, at_a_time, share):
    """A sketch of 64 cells lets everything survive; the result stays."""
    monkeypatch.setattr(collocations, "AT_A_TIME", at_a_time)
    rows = frame(spark, docs).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang"))).withColumn("rank", F.lit("x"))
    got = collocations.collocations(rows, least=4, share=share, top=50, width_bits=width_bits).collect()
    want = plain_collocations([(r.lang, r.text) for r in rows.collect()], 5, 4, share, 50)
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 40


def test_memory_of_a_task():
    """A batch of any size is worked on a little at a time (before: 92 MB of arrays beside a small sketch)."""
    text = " ".join(f"w{i % 977} x{i % 89}" for i in range(200))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3000, "text": [text] * 3000})
    tracemalloc.start()
    try:
        made = list(collocations._sketched(16, 5)(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert made[0]["words"].to_pylist() == [1_200_000]


def test_sketches_grow_with_the_text_only(spark):
    """Cells tell phrases apart however many there are, take few bytes, and longer phrases only stand in them where their pairs are frequent."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in np.where(rng.random(1000) < 0.3, rng.integers(0, 3, 1000), rng.integers(3, 500, 1000))) for _ in range(200)]
    exact = Counter()
    for text in texts:
        found = text.split(" ")
        exact.update(tuple(found[i : i + k]) for k in range(1, 6) for i in range(len(found) - k + 1))
    often = {p for p, n in exact.items() if n >= 60}
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    cells, totals = collocations.frequent_cells(rows, words=2, least=60)
    assert [tuple(r) for r in totals.collect()] == [("en", 200_000)]
    short = {p for p in often if len(p) <= 2}
    assert len(short) <= len(cells) <= len(short) * 1.02
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 200, "text": texts})
    whole = list(collocations._sketched(32, 2)(iter([batch])))
    held = sum(len(collocations.unpacked(b)) for batch in whole for b in batch["cells"].to_pylist() if b)
    assert sum(len(b) for batch in whole for c in ("cells", "counts") for b in batch[c].to_pylist() if b) < 4 * held

    class Shared:
        value = collocations.bit_map(cells, 32)

    longer = [b for batch in collocations._sketched(32, 5, 2, Shared)(iter([batch])) for b in batch["cells"].to_pylist() if b]
    may = {p for p in exact if len(p) > 2 and all(p[i : i + 2] in often for i in range(len(p) - 1))}
    n = sum(len(collocations.unpacked(b)) for b in longer)
    assert len(may) <= n * 1.01 and n < sum(len(p) > 2 for p in exact) / 100
    found, _ = collocations.frequent_cells(rows, words=5, least=60, known=2, cells=cells)
    assert 0 < len(often - short) <= len(found) <= len(often - short) * 1.1 + 1


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 2, "a b", 10**12), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**12)], "lang string, n_words int, phrase string, a long")
    totals = spark.createDataFrame([("en", 10**16 + 7)], "lang string, n long")
    assert collocations.scored(counts, totals).first().score == 1000 * 10**12 * (10**16 + 7) // (3 * 10**12 * 7 * 10**12)


def plain_alignment(texts, library, pieces):
    byte, out, documents = printable_bytes(), [], Counter()
    for text in texts:
        a_ids, b_ids = (library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        a_bytes = [bytes(byte[c] for c in library.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            out.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(a_ends) & set(b_ends))
        inside = lambda ids, ends, x, y: ",".join(str(i) for i, e in zip(ids, ends) if x < e <= y)
        groups = ";".join(f"{inside(a_ids, a_ends, x, y)}|{inside(b_ids, b_ends, x, y)}" for x, y in zip([0, *cuts], cuts))
        links = [(a, b) for a, x, y in zip(a_ids, [0, *a_ends], a_ends) for b, u, v in zip(b_ids, [0, *b_ends], b_ends) if max(x, u) < min(y, v)]
        documents.update(set(links))
        out.append((len(a_ids), len(b_ids), len(cuts), groups, links))
    best = Counter()
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    return [None if x is None else (*x[:4], len(x[4]), sum(documents[p] == best[p[0]] for p in x[4]), sum(documents[p] for p in x[4])) for x in out]


@pytest.mark.parametrize("block, short, broadcast", [(8 << 20, 64, 2_000_000), (900, 3, 40)])
def test_alignment(spark, docs, pieces_library, monkeypatch, block, short, broadcast):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "SHORT", short)
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    rows = frame(spark, docs).where("text IS NULL OR length(text) < 4000")
    found = token_alignment.aligned(rows, JSON, P.PATTERN, MODEL)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) for r in token_alignment.alignment(found, broadcast_rows=broadcast).collect()]
    source = rows.select("doc_id", "text").collect()
    want = [(r.doc_id, *(x or (0, 0, 0, "", 0, 0, 0))) for r, x in zip(source, plain_alignment([r.text for r in source], library, pieces_library))]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_alignment_of_a_long_word(spark):
    """Half a million characters without a space are one word; its work does not grow with the square."""
    rows = spark.range(1).selectExpr("id AS doc_id", "repeat('ab=c', 125000) AS text")
    row = token_alignment.alignment(token_alignment.aligned(rows, JSON, P.PATTERN, MODEL)).first()
    assert row.n_groups > 1000 and row.n_links == row.n_a + row.n_b - row.n_groups
    assert row.groups.count(";") == row.n_groups - 1


def plain_pieces(docs, library, capacity):
    out = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


@pytest.mark.parametrize("leaf, fan", [(10_000, 16), (9, 2)])
def test_packing(spark, docs, library, leaf, fan):
    rows = frame(spark, docs)
    cut_up = best_fit_packing.pieces(rows, JSON, P.PATTERN, capacity=64)
    packed = best_fit_packing.pack(cut_up, capacity=64, leaf_rows=leaf, fan=fan, lack=0)
    got = packed.collect()
    key = lambda r: (r[0] is None, r)
    want = plain_pieces([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()], library, 64)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=key) == sorted(want, key=key)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for members in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(w[3] for w in want) // 64)
    assert len(by_sequence) <= least + (1 if leaf == 10_000 else 12)
    whole = {r.sequence_id: bytes(r.ids) for r in best_fit_packing.sequences(packed).collect()}
    assert whole == {k: b"".join(x[2] for x in sorted(m)) for k, m in by_sequence.items()}


def test_what_goes_up_is_bounded_without_loss(spark):
    """Many bins of one size, a few small ones: as many sequences as where every bin goes up."""
    sizes = [70] * 4000 + [30] * 40 + [65] * 500 + [3] * 7
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
    packed = best_fit_packing.pack(items, capacity=100, leaf_rows=100, fan=4, lack=0)
    assert packed.count() == len(sizes)
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("places"))
    assert fills.where("n > 100 OR k <> places").count() == 0
    # No two 70s or 65s share a sequence; every 30 lies with one of them.
    assert fills.count() == 4500
    up = best_fit_packing._going_up(np.array([70] * 50 + [100] * 5 + [99, 40]), 100, 1, 8)
    assert up.sum() == 9 and not up[50:56].any()


def test_repeated_rows_and_clashing_names(spark):
    items = spark.createDataFrame([(1, 40)] * 60, "doc_id long, length long")
    assert best_fit_packing.pack(items, capacity=100, leaf_rows=20).select("sequence_id").distinct().count() == 30
    with pytest.raises(ValueError):
        best_fit_packing.pack(items.withColumn("fill", F.lit(1)))


def test_no_rows(none):
    assert collocations.collocations(none).count() == 0
    assert token_alignment.alignment(token_alignment.aligned(none, JSON, P.PATTERN, MODEL)).count() == 0
    assert best_fit_packing.pack(best_fit_packing.pieces(none, JSON, P.PATTERN)).count() == 0
