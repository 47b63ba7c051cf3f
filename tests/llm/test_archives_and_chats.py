from __future__ import annotations

import hashlib
from collections import defaultdict

from hostelry.llm import chat_tree, merkle_audit

TURNS = "conv_id long, turn long, role string, text string"


def test_templates_are_reversible():
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\[INST]", "a [/INST] b", "<<SYS>>\n<</SYS>>", "ends with [", " </s", "<s>x</s>", "\\\\</s>\\"]
    for role in ("user", "assistant", "system", "tool", "a[INST]\nb", ""):
        whole = "".join(chat_tree.formatted(role, t)[0] for t in texts)
        assert list(chat_tree.parsed(whole)) == [(role, t) for t in texts]
        assert all(not chat_tree.CONTROL.search(chat_tree.escaped(t)) for t in texts)


def test_shared_turns_are_laid_out_once(spark):
    rows = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "d"), (1, 3, "assistant", "\\[INST] <</s>"),
        (2, 0, "user", "a"), (2, 1, "assistant", "zz"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "d"), (4, 0, None, None), (4, 1, "tool\nx[INST]", "<s>"),
        (None, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 7, "assistant", "x" * 20000), (6, 2, "system", "é😀"),
    ]
    stream, conversations = chat_tree.pack(spark.createDataFrame(rows, TURNS).repartition(3))
    found = {r.conv_id: r for r in chat_tree.read_back(stream, conversations).collect()}
    segments = sorted((r.start, r.start + r.size) for r in stream.collect())
    assert segments[0][0] == 0 and all(a[1] == b[0] for a, b in zip(segments, segments[1:]))
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    nodes = set()
    for conv, own in turns.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        size = sum(len(chat_tree.formatted(r, t)[0]) for _, r, t in own)
        got = found[conv]
        assert (got.n_turns, got.turns_sha256, got.formatted_chars) == (len(own), hashlib.sha256(said.encode()).hexdigest(), size)
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        nodes |= {tuple(x[1:] for x in own[: i + 1]) for i in range(len(own))}
    assert segments[-1][1] == sum(len(chat_tree.formatted(*n[-1])[0]) for n in nodes)
    # Depth-first: what a conversation attends to within one subtree lies together before later branches.
    assert [(i.start, i.end) for i in found[3].intervals] == [(i.start, i.end) for i in found[1].intervals][:2] + [(found[1].intervals[2].start, found[3].intervals[2].end)]


def test_no_conversations(spark):
    stream, conversations = chat_tree.pack(spark.createDataFrame([], TURNS))
    assert chat_tree.read_back(stream, conversations).count() == 0


PAGES = "page_id long, url string, html string, hash string"


def test_audit_finds_damage_and_nothing_else(spark):
    rows = [(i, f"u{i}", f"<p>{i}é</p>" * (i % 5), "x") for i in range(3000)] + [(None, None, None, None), (5, "u5", "again", "x")]
    other = [(i, u, (h[:-1] if i == 1500 else h and h.replace("7é", "7e") if i == 7 else h), x) for i, u, h, x in rows]
    one, two = (merkle_audit.records(spark.createDataFrame(r, PAGES)) for r in (rows, other))
    assert merkle_audit.audit(one, one).count() == 0
    a, b = ({(r.file, r.record): r.hash for r in x.collect()} for x in (one, two))
    want = {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    found = merkle_audit.audit(one, two).collect()
    assert {(r.file, r.record) for r in found} == want and len(found) == len(want) > 0
    short = merkle_audit.records(spark.createDataFrame(rows[:-3], PAGES))
    lost = merkle_audit.audit(one, short).collect()
    assert any(r.hash_b is None for r in lost)


def test_audit_of_nothing(spark):
    empty = merkle_audit.records(spark.createDataFrame([], PAGES))
    assert merkle_audit.audit(empty, empty).count() == 0
