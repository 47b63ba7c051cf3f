"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of a tree. Each
node belongs to the smallest conversation that has it, so what a conversation
owns is the end of its path: one segment. Segments are laid out depth-first in one packed
stream, every shared turn once; a segment carries the position its first
character has in the conversation, and its loss mask. A conversation's attention
is the list of its ancestors' intervals in the stream, by which it is read back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut

#: The template: what stands before and after a turn's text, by role.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
#: Any other role: this, the role, the middle, the text, the end.
OTHER = ("<s>", "[INST]", "</s>")
CONTROL = re.compile("|".join(map(re.escape, ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURN = "conv long, idx int, node binary, at long, size long, piece string, mask array<long>"
SEGMENT = (
    "conv long, attach long, size long, text string, mask array<struct<at:long,size:long>>, "
    "runs array<struct<owner:long,size:long>>, path array<struct<depth:int,owner:long>>"
)


def escaped(text: str) -> str:
    """The text without any control string; reversed by ``unescaped``."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and where in it the text is."""
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = OTHER[0] + escaped(role) + OTHER[1], OTHER[2]
    inner = escaped(text)
    return before + inner + after, len(before), len(inner)


def parsed(text: str):
    """The (role, text) of every turn in a formatted conversation."""
    at = 0
    while at < len(text):
        for role, (before, after) in TEMPLATE.items():
            if text.startswith(before, at):
                break
        else:
            role, before, after = None, OTHER[0], OTHER[2]
        start = at + len(before)
        end = text.index(after, start)
        inner = text[start:end]
        at = end + len(after)
        if role is None:
            role, _, inner = inner.partition(OTHER[1])
            role = unescaped(role)
        yield role, unescaped(inner)


def _turns(batches):
    """Rows of whole conversations in order: each turn's node (a hash of its path) and place."""
    conv, idx, at, node = object(), 0, 0, b""
    for batch in batches:
        rows = []
        for own, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
            if own != conv:
                conv, idx, at, node = own, 0, 0, b""
            piece, start, size = formatted(role, text)
            node = hashlib.blake2b(repr((role, text)).encode("utf-8", "surrogatepass"), key=node, digest_size=16).digest()
            rows.append((conv, idx, node, at, len(piece), piece, [start, size] if role == "assistant" else None))
            idx, at = idx + 1, at + len(piece)
        columns = zip(*rows) if rows else [()] * 7
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in TURN.split(", ")])


def _segments(batches):
    """Turns with owners, conversations whole and in order: one row for each conversation."""
    types = (
        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])),
        pa.list_(pa.struct([("owner", pa.int64()), ("size", pa.int64())])), pa.list_(pa.struct([("depth", pa.int32()), ("owner", pa.int64())])),
    )
    names = ["conv", "attach", "size", "text", "mask", "runs", "path"]
    rows: list = []
    conv, now = object(), None

    def close():
        if now is not None:
            text = "".join(now["text"])
            rows.append((conv, now["attach"], len(text), text, now["mask"], now["runs"], now["path"]))

    def batch_of():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names)
        rows.clear()
        return out

    for batch in batches:
        for own, owner, idx, at, size, piece, mask in zip(*(batch[c].to_pylist() for c in ("conv", "owner", "idx", "at", "size", "piece", "mask"))):
            if own != conv:
                close()
                conv, now = own, {"attach": at, "text": [], "mask": [], "runs": [], "path": []}
            if not now["path"] or now["path"][-1]["owner"] != owner:
                # Of a node's children its owner's comes first, then deeper attachments before shallower ones.
                now["path"].append({"depth": -idx, "owner": owner})
                now["runs"].append({"owner": owner, "size": 0})
            now["runs"][-1]["size"] += size
            if owner == own:
                if not now["text"]:
                    now["attach"] = at
                if mask:
                    now["mask"].append({"at": at - now["attach"] + mask[0], "size": mask[1]})
                now["text"].append(piece)
        if len(rows) >= 1000:
            yield batch_of()
    close()
    yield batch_of()


def pack(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, conversations) of rows (conv_id, turn, role, text).

    stream: conv (the owner), start, size, text, position (of its first
    character in the conversation) and mask, laid out depth-first. conversations: conv and runs, which name
    in order the owners of its path and how much of each owner's segment it has.
    Turns are ordered by turn, then role and text; repeated rows are turns of
    their own; a null text or role is empty; rows without a conv_id are one
    conversation. Other columns are ignored.
    """
    least = F.lit(-(1 << 63)).cast("long")
    empty = F.lit("")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), least).alias("conv"),
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    placed = cut(
        rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text").mapInArrow(_turns, TURN)
    )
    owners = placed.groupBy("node").agg(F.min("conv").alias("owner"))
    owned = placed.join(owners, "node").select("conv", "owner", "idx", "at", "size", "piece", "mask")
    segments = cut(owned.repartition("conv").sortWithinPartitions("conv", "idx").mapInArrow(_segments, SEGMENT))
    # Depth-first order is the order of paths; starts are prefix sums over sorted runs of segments.
    order = segments.where("size > 0").orderBy("path").withColumns({"share": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    order = cut(order.select("conv", "attach", "size", "text", "mask", "share", "row"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = order.groupBy("share").agg(F.sum("size").alias("size"))
    shares = shares.select("share", before(Window.orderBy("share")).alias("base"))
    start = F.col("base") + before(Window.partitionBy("share").orderBy("row"))
    stream = order.join(F.broadcast(shares), "share").select(
        "conv", start.alias("start"), "size", "text", F.col("attach").alias("position"), "mask"
    )
    return stream, segments.select("conv", "runs")


def attention(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv and pieces (i, start, end, text, mask) in order: the intervals it attends to, with what they hold."""
    runs = conversations.select("conv", F.posexplode("runs").alias("i", "run")).select(
        "conv", "i", F.col("run.owner").alias("owner"), F.col("run.size").alias("n")
    )
    held = runs.join(stream.withColumnRenamed("conv", "owner"), "owner")
    piece = F.struct(
        "i",
        "start",
        (F.col("start") + F.col("n")).alias("end"),
        F.substring("text", F.lit(1), F.col("n").cast("int")).alias("text"),
        F.filter("mask", lambda m: m["at"] + m["size"] <= F.col("n")).alias("mask"),
    )
    return held.groupBy("conv").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, intervals array<struct<start:long,end:long>>"


def _read(batches):
    for batch in batches:
        rows = []
        for pieces in batch["pieces"].to_pylist():
            text = "".join(p["text"] for p in pieces)
            turns, n, under = hashlib.sha256(), 0, []
            for role, said in parsed(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for p in pieces:
                under += [unescaped(p["text"][m["at"] : m["at"] + m["size"]]) for m in p["mask"]]
            loss = "".join(under)
            rows.append(
                (n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), [{"start": p["start"], "end": p["end"]} for p in pieces])
            )
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)]
        yield pa.RecordBatch.from_arrays([batch["conv"], *columns], ["conv", *(f.split()[0] for f in re.split(r", (?![^<]*>)", READ))])


def read_back(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """For each conversation, what its intervals of the stream say: turns, text under the loss mask, sizes."""
    out = attention(stream, conversations).mapInArrow(_read, f"conv long, {READ}")
    least = F.lit(-(1 << 63)).cast("long")
    return out.select(F.when(F.col("conv") != least, F.col("conv")).alias("conv_id"), *(c for c in out.columns if c != "conv"))
