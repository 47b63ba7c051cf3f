"""Best-fit packing of token sequences by hierarchical merging of residual bins.

Documents become ids and an end, and longer ones are cut into pieces. The pieces are
dealt evenly to leaves of a tree; each leaf packs its own best-fit, in order of falling
length. Bins that are nearly full are sequences; the others go up the tree as items,
and each node packs those of its children best-fit again.

What goes up is bounded whatever the input: of two bins that are at most half full
best-fit makes one, so a node has at most one such bin, and bins that are more than
half full never join each other. In all nodes above, a bin can therefore be joined
only by one of ``FAN`` small ones a node; bins of one size are alike, so of each size
``FAN`` times the levels above go up and the rest are sequences at once. The result is
as if all had gone up.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import in_slices, per_process, text_bytes
from hostelry.llm.units import Kept, byte_level, encoded, word_cuts

CAPACITY = 2048
#: Pieces that a leaf packs, children of a node, and tokens that a nearly full bin may lack.
LEAF_ROWS, FAN, LACK = 16_384, 16, 8
#: Merged bins up to which the mapping is broadcast.
BROADCAST_ROWS = 500_000
#: Local bins in an id below the leaf's number.
LOCAL = 1 << 31


def _cut_up(path: str, pattern: str, capacity: int, end_id: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = per_process(("byte level", path, pattern, False), lambda: Kept(byte_level(path, pattern, False)))
        for big in batches:
            for batch in in_slices(big, "text"):
                data, offsets = text_bytes(batch["text"])
                flat, places = encoded(data, offsets, word_cuts, kept)
                ids = np.insert(flat, places[1:], np.uint32(end_id)).astype("<u4")
                sizes = np.diff(places) + 1
                first = np.where(sizes % capacity, sizes % capacity, capacity)
                count = (sizes - first) // capacity + 1
                row = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                bytes_to = np.concatenate([[0], np.cumsum(length * 4)])
                # Batches of about 16 MB of ids; a long text's pieces may take several.
                parts = np.flatnonzero(np.diff(bytes_to[:-1] >> 24, prepend=-1))
                for a, b in zip(parts.tolist(), [*parts[1:].tolist(), len(row)]):
                    buffers = [None, pa.py_buffer((bytes_to[a : b + 1] - bytes_to[a]).astype(np.int32)), pa.py_buffer(ids[bytes_to[a] // 4 : bytes_to[b] // 4])]
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(row[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(start[a:b], pa.int64()), pa.array(length[a:b], pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), b - a, buffers)],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )

    return run


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document's pieces.

    A document is its text's ids (null: none) and ``end_id``; one of more than
    ``capacity`` ids is cut so that only its first piece is shorter than that.
    Repeated rows each have their own pieces; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _cut_up(tokenizer_path, pattern, capacity, end_id), f"doc_id {id_type}, piece int, start long, length long, ids binary"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin); items are taken by falling size, equal ones in order.

    Each goes to the fullest bin that has room. The kinds of free room are bits of
    one integer, so that the least that suffices is its lowest bit from the size up.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    rooms = 0
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _going_up(fills: np.ndarray, capacity: int, lack: int, most: int) -> np.ndarray:
    """Which bins go up: those not nearly full, of each fill at most ``most``."""
    order = np.argsort(fills, kind="stable")
    ordered = fills[order]
    rank = np.arange(len(fills)) - np.searchsorted(ordered, ordered)
    up = np.zeros(len(fills), bool)
    up[order] = rank < most
    return up & (fills < capacity - lack)


def _leaf(capacity: int, lack: int, most: int):
    def run(batches):
        leaf = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table["length"].to_numpy().astype(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        up = _going_up(fills, capacity, lack, most)[bins] & (offsets == 0)
        added = [pa.array(leaf * LOCAL + bins), pa.array(offsets), pa.array(fills[bins]), pa.array(up)]
        for name, column in zip(("bin", "offset", "fill", "up"), added):
            table = table.append_column(name, column)
        yield from table.to_batches(max_chunksize=4096)

    return run


def _node(capacity: int, lack: int, most: int):
    """One node: its children's bins as items. Each has its members, where they begin in it, and its fill."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["fill"].to_pylist(), table["members"].to_pylist()), key=lambda r: (-r[0], r[1][0]["bin"]))
        bins, offsets, fills = best_fit(np.array([r[0] for r in rows], np.int64), capacity)
        members: list[list[dict]] = [[] for _ in fills]
        for (_, own), to, at in zip(rows, bins.tolist(), offsets.tolist()):
            members[to] += [{"bin": m["bin"], "shift": m["shift"] + at} for m in own]
        up = _going_up(fills, capacity, lack, most)
        kept = [i for i in range(len(fills)) if up[i] or len(members[i]) > 1]
        node = table["node"][0].as_py()
        return pa.Table.from_pydict(
            {"node": [node] * len(kept), "fill": fills[kept], "members": [members[i] for i in kept], "up": up[kept]}, schema=_NODE
        )

    return run


_NODE = pa.schema(
    [("node", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))), ("up", pa.bool_())]
)
_NODE_DDL = "node long, fill long, members array<struct<bin: long, shift: long>>, up boolean"


def pack(items: DataFrame, *, capacity: int = CAPACITY, leaf_rows: int = LEAF_ROWS, fan: int = FAN, lack: int = LACK) -> DataFrame:
    """``items`` with sequence_id and offset: every row has a place in a sequence of at most ``capacity``.

    ``items`` needs ``length``, from 1 to ``capacity``; its other columns come back as
    they are (columns named bin, offset, fill, up or sequence_id are refused). Sequences
    have no gaps and begin at 0. A leaf holds ``leaf_rows`` rows in memory, so long
    values are better joined in later.
    """
    if clash := {"bin", "offset", "fill", "up", "sequence_id"} & set(items.columns):
        raise ValueError(f"columns {sorted(clash)} are named like those to be added")
    items = cut(items)
    leaves = max(1, math.ceil(items.count() / leaf_rows))
    levels = math.ceil(math.log(leaves, fan) - 1e-9) if leaves > 1 else 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    # Rows are dealt round and round after a sort, so a repeated task gets the same rows.
    leaf = _leaf(capacity, lack, fan * levels)
    placed = cut(items.repartition(leaves).mapInArrow(leaf, f"{fields}, bin long, offset long, fill long, up boolean"))
    own = F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members")
    carried = placed.where("up").select(F.expr(f"bin div {LOCAL}").alias("node"), "fill", own)
    merged = None
    for level in range(1, levels + 1):
        node = _node(capacity, lack, fan * (levels - level))
        done = cut(carried.withColumn("node", F.expr(f"node div {fan}")).groupBy("node").applyInArrow(node, _NODE_DDL))
        ended = done.where(F.lit(level == levels) | ~F.col("up")).where("size(members) > 1").select("members")
        merged = ended if merged is None else merged.unionByName(ended)
        carried = done.where("up").select("node", "fill", "members")
    if merged is None:
        return placed.withColumn("sequence_id", F.col("bin")).drop("bin", "fill", "up")
    moves = cut(merged.select(F.col("members")[0]["bin"].alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", "m.*"))
    if moves.count() <= BROADCAST_ROWS:
        moves = F.broadcast(moves)
    joined = placed.join(moves, "bin", "left")
    sequence, offset = F.coalesce("sequence_id", "bin"), F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))
    return joined.select(*items.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of every sequence, from ``packed`` pieces with their ids.

    ``pieces`` of one sequence number at most its capacity, so no group is larger.
    """
    laid = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(laid.alias("laid"))
    ids = F.aggregate("laid", F.lit(b"").cast("binary"), lambda whole, p: F.concat(whole, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("laid")["doc_id"].alias("doc_ids"))
