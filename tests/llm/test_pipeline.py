from __future__ import annotations

import base64
import hashlib
import re
import struct

import public_tokenizers as P
import tiktoken
from test_documents import goals, groups, shingles, spans_of

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_brute_force(spark, docs, tmp_path):
    columns, outs = docs.columns, []
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / str(i)))
        before, now = now, spark.read.parquet(str(tmp_path / str(i)))
        outs.append((before.collect(), now.collect()))
        assert i == 4 or now.columns == columns
    judged, single, cleared, mixed, encoded = outs
    assert all(len(WORD.findall(r.text or "")) >= 20 for r in judged[1])
    sets = {r.doc_id: shingles(r.text) for r in single[0]}
    assert sorted(r.doc_id for r in single[1]) == sorted({g for g in groups(sets).values()})
    before = {r.doc_id: r.text for r in cleared[0]}
    for r in cleared[1]:
        want = list(before[r.doc_id])
        for start, _, _, end in spans_of(before[r.doc_id]):
            want[start:end] = "*" * (end - start)
        assert r.text == "".join(want)
    assert {r.doc_id for r in mixed[1]} <= {r.doc_id for r in mixed[0]}
    sizes: dict = {}
    for r in mixed[0]:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    largest = max(len(WORD.findall(r.text)) for r in mixed[0])
    for source, target in goals(sizes).items():
        assert abs(sum(len(WORD.findall(r.text)) for r in mixed[1] if r.source == source) - target) <= largest
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, struct.pack(f"<{len(ids)}I", *ids)) for r in encoded[0] for ids in [library.encode_ordinary(r.text)])
    assert sorted((r.doc_id, bytes(r.ids)) for r in encoded[1]) == want


def test_empty_input(spark, none):
    now = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_doc_ids_of_several_texts_lose_no_group(spark):
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    # 5 has a copy of 1 and a text of its own; 3 is the smallest of two groups; 7 and no id have copies of 5's own text.
    rows = [(1, prose(1)), (5, prose(1)), (5, prose(2)), (7, prose(2)), (3, prose(3)), (3, prose(4)), (3, prose(4)), (9, prose(4)), (None, prose(2))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' AS source").coalesce(1)
    got = corpus_pipeline.deduplicate(spark, frame, "").collect()
    want = [(1, prose(1)), (3, prose(3)), (3, prose(4)), (5, prose(2))]
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == want


def test_last_stage_decodes_what_it_encodes(spark, docs):
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    want = [(str(r.doc_id), digest(r.text)) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted(want)
