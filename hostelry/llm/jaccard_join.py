"""Exact n-gram Jaccard join by vertical partitioning.

Every distinct shingle has a place in one global order: by how many documents
have it, rare ones first (counted for all documents by a hash of 32 bits and
kept as a bounded list of classes), then by its hash. The order is cut into
fragments that hold about as many shingles each.

Two sets that are similar enough share a shingle among the first few of both in
the global order; those prefixes give candidate pairs. A histogram of each set's
shingles over fine fragments bounds the overlap and drops most pairs. For the
rest, overlaps are counted in each fragment separately and summed per pair, which
decides exactly.

Equal sets are one node. Pairs are not listed within what is already known to be
one component: in rounds, each set tries a few leaders of its prefix shingles,
other ones each time, and only shingles that still join different components are
paired out in full.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut
from hostelry.llm.arrays import freed, in_batches, in_slices, mixed, packed, powers, text_bytes, unpacked, word_hashes, word_spans
from hostelry.llm.components import components, dealt_anew

#: Words of a shingle; the similarity as a fraction of integers.
WORDS, PART, WHOLE = 5, 80, 100
#: Shingle hashes of a task counted at a time.
COUNTED = 2 << 20
#: A class list of shingles with at least 2**LEAST_CLASS documents, of at most MOST_HOT entries.
LEAST_CLASS, MOST_HOT = 4, 2_000_000
#: Bits of the map of shingles that more than one document may have; a fixed 16 MB.
MAP_BITS = 27
FRAGMENTS, FINE = 4, 256
#: Numbers of 64 bits in a set's sketch.
SKETCH = 8
#: Rows of ids that are broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; words are lower-cased (A-Z)."""
    data, offsets = text_bytes(column)
    text_of, start, end = word_spans(data, offsets)
    hashes = word_hashes(data, start, end, lower=True)
    ends = np.searchsorted(text_of, np.arange(len(column)), "right")
    factors = powers(0xC2B2AE3D27D4EB4F, words + 1)
    n = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * factors[k + 1]
    rolled = mixed(rolled)
    out, at = [], 0
    for to in ends.tolist():
        size = to - at
        if size >= words:
            out.append(np.unique(rolled[at : to - words + 1]))
        elif size:
            own = np.uint64(size) + (hashes[at:to] * factors[1 : size + 1]).sum(dtype=np.uint64)
            out.append(mixed(np.array([own])))
        else:
            out.append(np.zeros(0, np.uint64))
        at = to
    return out


def set_id(values: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; none for the empty set."""
    if not len(values):
        return None
    one = mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mixed(values + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([one, two + np.uint64(len(values))], ">u8").tobytes()


def _bucketed(parts: int):
    """Sorted 32-bit hashes of the shingles of all texts of a task, by range."""

    def rows(held: list[np.ndarray]):
        values = np.sort(np.concatenate(held))
        cuts = np.searchsorted(values, (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        blobs, owners = [], []
        for part in range(parts):
            own = values[cuts[part] : cuts[part + 1]]
            if len(own):
                owners.append(part)
                blobs.append(packed(np.diff(own.astype(np.int64), prepend=0)))
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    @freed
    def run(batches):
        held, size = [], 0
        for big in batches:
            for batch in in_slices(big, "text"):
                for values in shingle_sets(batch["text"]):
                    held.append((values >> np.uint64(32)).astype(np.uint32))
                    size += len(values)
                if size >= COUNTED:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


def _classes(parts: int):
    """One range: the map of hashes with two documents or more, and lists of hashes by log2 of their documents."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        values = np.concatenate([np.cumsum(unpacked(b).astype(np.int64)) for b in table["blob"].to_pylist()])
        values, counts = np.unique(values, return_counts=True)
        shift = 32 - MAP_BITS
        first = ((part << 32) // parts) >> shift
        last = (((part + 1) << 32) // parts - 1) >> shift
        bits = np.zeros(last - first + 1, bool)
        bits[(values[counts > 1] >> shift) - first] = True
        kind = np.log2(counts).astype(int)
        rows = [(part, -1, int(first), len(bits), zstandard.compress(np.packbits(bits).tobytes()))]
        for k in range(LEAST_CLASS, int(kind.max()) + 1):
            if len(own := values[kind == k]):
                rows.append((part, k, 0, len(own), packed(own)))
        names, types = ("part", "kind", "first", "n", "blob"), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return run


def global_order(docs: DataFrame, parts: int, total: int) -> tuple[np.ndarray, ...]:
    """(map of shingles that are not unique, hot hashes, their classes, places that cut the order); of fixed size at most."""
    found = cut(
        docs.select("text")
        .mapInArrow(_bucketed(parts), "part int, blob binary")
        .groupBy("part")
        .applyInArrow(_classes(parts), "part int, kind int, first long, n long, blob binary")
    )
    shared = np.zeros((1 << MAP_BITS) // 8 + 1, np.uint8)
    for row in found.where("kind < 0").toLocalIterator():
        bits = np.unpackbits(np.frombuffer(zstandard.decompress(row["blob"]), np.uint8), count=row["n"])
        own = np.packbits(np.concatenate([np.zeros(row["first"] % 8, np.uint8), bits]))
        shared[row["first"] // 8 : row["first"] // 8 + len(own)] |= own
    sizes = {r["kind"]: r["n"] for r in found.where("kind >= 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least, listed = max(sizes, default=0) + 1, 0
    while least - 1 in range(LEAST_CLASS, 64) and listed + sizes.get(least - 1, 0) <= MOST_HOT:
        least, listed = least - 1, listed + sizes.get(least - 1, 0)
    hashes, kinds = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
    for row in found.where(F.col("kind") >= least).toLocalIterator():
        hashes.append(unpacked(row["blob"]))
        kinds.append(np.full(row["n"], row["kind"], np.uint8))
    hash_, kind = np.concatenate(hashes), np.concatenate(kinds)
    order = np.argsort(hash_)
    # A class of log2 k has 1.5 * 2**k documents in the mean; the rest of all shingles are unlisted ones, of class 0.
    mass = {k: 1.5 * 2.0**k * n for k, n in sorted(sizes.items()) if k >= least}
    mass = {0: max(total - sum(mass.values()), 1.0)} | mass
    ends = np.cumsum(list(mass.values()))
    wanted = ends[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    at = np.searchsorted(ends, wanted)
    share = (wanted - np.append(0, ends)[at]) / np.array(list(mass.values()))[at]
    return shared, hash_[order], kind[order], np.array(list(mass))[at] + share


def kinds_of(short: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """The class of each 32-bit hash in the global order; 0 for those that are not listed."""
    _, hot, kinds, _ = order
    kind = np.zeros(len(short), np.uint8)
    if len(hot):
        found = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
        same = hot[found] == short
        kind[same] = kinds[found[same]]
    return kind


@freed
def _named(batches):
    """For each text: its set's size and id."""
    for big in batches:
        for batch in in_slices(big, "text"):
            sets = shingle_sets(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.binary())], ["doc_id", "n", "set_id"]
            )


def _prefixed(order):
    """For each text: its set's size, id, histogram and those prefix shingles that another text may have."""

    @freed
    def run(batches):
        shared = order.value[0]
        for big in batches:
            for batch in in_slices(big, "text"):
                n, ids, hist, sketch, keys, places = [], [], [], [], [], []
                for values in shingle_sets(batch["text"]):
                    size = len(values)
                    n.append(size)
                    ids.append(set_id(values))
                    if not size:
                        hist.append(None), sketch.append(None), keys.append(None), places.append(None)
                        continue
                    short = (values >> np.uint64(32)).astype(np.uint32)
                    kind = kinds_of(short, order.value)
                    prefix = size - -(-PART * size // WHOLE) + 1
                    first = np.argsort(kind, kind="stable")[:prefix]
                    bit = short[first] >> np.uint32(32 - MAP_BITS)
                    place = np.flatnonzero((shared[bit >> np.uint32(3)] << (bit & np.uint32(7)).astype(np.uint8)) & np.uint8(128))
                    keys.append(values[first[place]].view(np.int64).tolist())
                    places.append(place.tolist())
                    fine = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=FINE) if len(place) else None
                    hist.append(None if fine is None else zstandard.compress(fine.astype("<u4").tobytes(), 1))
                    # Whether an even or an odd number of shingles falls on each bit: what differs in few shingles differs in few bits.
                    odd = np.bincount((values & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                    sketch.append(np.packbits(odd.astype(bool)).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(hist, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                    ["doc_id", "n", "set_id", "hist", "sketch", "keys", "places"],
                )

    return run


@freed
def _near(batches):
    """Pairs whose histograms allow the similarity: what differs is at most the share left of both sizes."""
    for batch in batches:
        keep = []
        for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("hist_a", "hist_b", "n_a", "n_b"))):
            one, two = (np.frombuffer(zstandard.decompress(h), "<u4").astype(np.int64) for h in (a, b))
            # |x & y| >= PART / (WHOLE + PART) * (|x| + |y|), and |x| + |y| - 2 |x & y| >= sum of differences
            keep.append((WHOLE + PART) * int(np.abs(one - two).sum()) <= (WHOLE - PART) * (x + y))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "n_a", "n_b"])


def _fragmented(order):
    """The set of each text, cut into fragments of the global order."""

    @freed
    def run(batches):
        pivots = order.value[3]
        for big in batches:
            for batch in in_slices(big, "text"):
                rows = []
                for node, own, values in zip(batch["node"].to_pylist(), batch["set_id"].to_pylist(), shingle_sets(batch["text"])):
                    if own != set_id(values):
                        continue
                    place = kinds_of((values >> np.uint64(32)).astype(np.uint32), order.value) + values / 2.0**64
                    fragment = np.searchsorted(pivots, place, "right")
                    rows += [(node, int(f), values[fragment == f].view(np.int64)) for f in np.unique(fragment)]
                node, fragment, held = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(held, pa.list_(pa.int64()))], ["node", "fragment", "held"]
                )

    return run


PAIR = "a long, b long, n_a long, n_b long"
HEADS = ("a", "b", "n_a", "n_b")
#: How many leaders each set tries in each round, before pairs across components are listed.
ROUNDS = (1, 8, 16)


def within(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with ``ids`` on doc_id, which are broadcast when few enough."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        session = docs.sparkSession
        in_batches(session)
        id_type = docs.schema["doc_id"].dataType.simpleString()
        self.texts = cut(self.docs.mapInArrow(_named, f"doc_id {id_type}, n long, set_id binary"))
        # Equal sets are one node: of copies only the smallest doc_id of a set goes on.
        named = self.texts.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
        first = named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        copies = named.select("doc_id").join(first, "doc_id", "left_anti").distinct()
        distinct = within(self.docs, cut(copies), "left_anti")
        total = self.texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        order = self.order = session.sparkContext.broadcast(
            global_order(distinct, int(session.conf.get("spark.sql.shuffle.partitions")), total)
        )
        prefixed = cut(
            distinct.mapInArrow(
                _prefixed(order),
                f"doc_id {id_type}, n long, set_id binary, hist binary, sketch array<long>, keys array<long>, places array<long>",
            )
            .where(F.col("set_id").isNotNull())
            .withColumn("node", F.monotonically_increasing_id())
        )
        # Repeated rows of a first document are left: one node of each set stays, of the smallest doc_id.
        smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
        kept = prefixed.groupBy("set_id").agg(smallest["node"].alias("node")).select("node")
        self.sets = prefixed.select("node", "n", "set_id", "doc_id", "hist", "sketch", "keys", "places").join(kept, "node", "left_semi")
        if kept.count() == prefixed.count():
            self.sets = prefixed
        entries = self.sets.select("node", "n", F.explode(F.arrays_zip("keys", "places")).alias("e")).select(
            F.col("e.keys").alias("key"), "node", "n", F.col("e.places").alias("place")
        )
        shared = entries.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
        self.entries = cut(dealt_anew(entries, shared, "key"))

    def open_entries(self, entries: DataFrame, known: DataFrame | None) -> DataFrame:
        """Of ``entries`` those of prefix shingles that sets of different components have, with their components."""
        if known is None:
            return entries.withColumn("component", F.col("node"))
        owned = entries.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        keys = owned.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return cut(dealt_anew(owned, keys, "key"))

    def led(self, entries: DataFrame, tested: DataFrame | None, turn: int, most: int) -> DataFrame:
        """For each set at most ``most`` pairs with leaders of other components: those with which it shares most prefix shingles.

        A shingle's leaders are the sets with the least and the greatest hash; each turn hashes anew.
        """
        place = F.xxhash64("node", F.lit(turn)) if turn else F.col("component")
        own = F.struct(place.alias("place"), "component", "node", "n")
        leaders = entries.groupBy("key").agg(F.array(F.min(own), F.max(own)).alias("leaders"))
        pairs = dealt_anew(entries, leaders, "key").select("node", "n", "component", F.explode("leaders").alias("first"))
        pairs = pairs.where(F.col("first.component") != F.col("component")).select(
            F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b")
        )
        counted = untested(pairs.where(alike_in_size("n_a", "n_b")).groupBy(*HEADS).count(), tested)
        listed = F.collect_list(F.struct("count", "a", "n_a", "n_b"))
        best = counted.groupBy("b").agg(F.slice(F.sort_array(listed, asc=False), 1, most).alias("best"))
        best = best.select("b", F.explode("best").alias("p")).select("p.a", "b", "p.n_a", "p.n_b")
        # A pair may come both ways round.
        return best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
            F.max(F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b"))).alias("n_a"),
            F.max(F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a"))).alias("n_b"),
        )

    def across(self, entries: DataFrame, tested: DataFrame | None) -> DataFrame:
        """Every candidate pair of sets in different components whose sketches allow the similarity."""
        bits = [f"s{i}" for i in range(SKETCH)]
        sketches = self.sets.where("sketch IS NOT NULL").select("node", *(F.col("sketch")[i].alias(s) for i, s in enumerate(bits)))
        entries = cut(entries.join(sketches, "node"))
        one = entries.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"), F.col("component").alias("x"), *(F.col(s).alias(f"{s}_a") for s in bits))
        two = entries.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("at_b"), F.col("component").alias("y"), *(F.col(s).alias(f"{s}_b") for s in bits))
        # At the first shingle that a pair shares, what may follow in both must be enough.
        follow = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        enough = (WHOLE + PART) * follow >= PART * (F.col("n_a") + F.col("n_b"))
        differ = functools.reduce(operator.add, (F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in bits))
        close = (WHOLE + PART) * differ <= (WHOLE - PART) * (F.col("n_a") + F.col("n_b"))
        apart = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & alike_in_size("n_a", "n_b") & enough & close
        return untested(one.join(two, "key").where(apart).select(*HEADS).distinct(), tested)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among distinct candidate pairs (a, b, n_a, n_b)."""
        hist = self.sets.where(F.col("hist").isNotNull()).select("node", "hist")
        pairs = pairs.join(hist.toDF("a", "hist_a"), "a").join(hist.toDF("b", "hist_b"), "b")
        near = cut(pairs.select(*HEADS, "hist_a", "hist_b").mapInArrow(_near, PAIR))
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = cut(wanted.join(self.sets.select("node", "set_id", "doc_id"), "node"))
        # Repeated rows give a set's fragments again; each fragment of a pair counts once below.
        segments = (
            within(self.docs, wanted, "inner")
            .select("node", "set_id", "text")
            .mapInArrow(_fragmented(self.order), "node long, fragment int, held array<long>")
        )
        met = near.join(segments.toDF("a", "fragment", "held_a"), "a").join(segments.toDF("b", "fragment", "held_b"), ["b", "fragment"])
        # Counted where the pair is made: ten thousand pairs of fragments, the rows of an Arrow batch, would be of any size.
        shared = met.select(*HEADS, "fragment", F.size(F.array_intersect("held_a", "held_b")).cast("long").alias("shared"))
        total = shared.groupBy(*HEADS, "fragment").agg(F.max("shared").alias("shared")).groupBy(*HEADS).agg(F.sum("shared").alias("shared"))
        similar = WHOLE * F.col("shared") >= PART * (F.col("n_a") + F.col("n_b") - F.col("shared"))
        return cut(total.where(similar).select("a", "b"))


def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """``pairs`` without those tested before, whichever way round."""
    if tested is None:
        return pairs
    return pairs.join(tested.union(tested.select("b", "a")).toDF("a", "b"), ["a", "b"], "left_anti")


def alike_in_size(n_a: str, n_b: str):
    return WHOLE * F.least(n_a, n_b) >= PART * F.greatest(n_a, n_b)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of ``docs``.

    A null, empty or blank text has no shingles and is linked with nothing; a row
    without a doc_id gets no component. Repeated rows are one node. Other columns
    are ignored. Links are those of 100 * intersection >= 80 * union.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def with_sets(docs: DataFrame) -> DataFrame:
    """``docs`` with set_id, as ``grouped`` gives it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    @freed
    def run(batches):
        for big in batches:
            for batch in in_slices(big, "text"):
                ids = pa.array(map(set_id, shingle_sets(batch["text"])), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "set_id"])

    return docs.mapInArrow(run, f"{fields}, set_id binary")


def grouped(docs: DataFrame) -> DataFrame:
    """``classes`` with set_id (null: no shingles) and component (null likewise), which tells components of one doc_id apart."""
    join = Join(docs)
    links, known, tested, entries = None, None, None, join.entries
    for turn, most in enumerate((*ROUNDS, None)):
        entries = join.open_entries(entries, known)
        pairs = cut(join.led(entries, tested, turn, most) if most else join.across(entries, tested))
        if pairs.isEmpty():
            continue
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        found = join.verified(pairs)
        links = found if links is None else links.union(found)
        known = components(links)
    by_set = join.sets.select("set_id", "doc_id", F.col("node").alias("component"))
    if known is not None:
        owned = join.sets.select("set_id", "doc_id", "node").join(known, "node", "left")
        by_set = owned.select("set_id", "doc_id", F.coalesce("component", "node").alias("component"))
    join.order.destroy()
    least = by_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = dealt_anew(by_set, least, "component").select("set_id", "component", "component_id")
    out = join.texts.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(by_set, "set_id", "left")
    own = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "set_id", "component", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
