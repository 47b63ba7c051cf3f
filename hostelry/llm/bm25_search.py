"""Exact BM25 top-k by block-max WAND, shard by shard.

The inverted index is a table of shards, written once. A shard is a run of
documents of bounded size: postings by term, documents in an order that puts those
of one vocabulary together, so that the blocks of documents that the bounds speak
of hold alike ones. Statistics are global (counted from the index), so the shards'
results merge exactly.

Queries and documents both grow with a corpus, and bounds close little but other
vocabularies' blocks, so what is left has to be cheap: queries of one vocabulary are
scored together, common terms by one product of matrices over the documents that are
open to any of them, and only rare terms posting by posting.

Queries come in blocks of bounded size. A task keeps, through all its shards, the k
best so far of every query, and with it a threshold. In a shard, the pivot test of
WAND adds up the maxima of a query's lists: without hope of the threshold, the
shard is left alone. Then the maxima of all its terms in each block of documents
are added up, and only blocks that may reach the threshold are scored. The index is
searched in waves, a small one first: what a wave finds is the threshold that the
tasks of the next one start from, so they give little more than k rows a query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut, drop, shared_folder
from hostelry.llm.arrays import in_slices, packed, text_bytes, unpacked, word_hashes, word_spans
from hostelry.llm.components import dealt_anew

K1, B = 1.2, 0.75
SHARD_BYTES, SHARD_DOCS, BLOCK_DOCS = 16 << 20, 8192, 512
#: What a list has in a block of documents is held as a column from so many documents, times the share of the queries that ask for it.
DENSE = 1.0
#: Bytes of queries (16 for a distinct term) that are broadcast at a time.
QUERY_BYTES = 24 << 20
#: Queries that are worked out together, and terms of these.
TOGETHER, TERMS = 512, 1 << 17
#: Terms whose rare postings are added up at a time.
RARE = 1 << 11
#: Vocabularies that a shard's documents are put into.
KINDS = 8
#: The waves' shares of the shards, in 64ths.
WAVES = (1, 4, 16, 64)
#: Decimals of a score; ties are of scores as rounded.
DECIMALS = 6
#: What single precision may lose of a sum, relative to it.
LOSS = 1e-4


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all distinct terms of each text, by text and term, and the texts' lengths in words."""
    data, offsets = text_bytes(column)
    text_of, start, end = word_spans(data, offsets)
    term = word_hashes(data, start, end, lower=True)
    order = np.lexsort((term, text_of))
    text_of, term = text_of[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(term)))
    return text_of[first], term[first], count, np.bincount(text_of, minlength=len(column))


def _queries(batches):
    """Each query's distinct terms and how often it has them."""
    for big in batches:
        for batch in in_slices(big, "text"):
            text, term, count, _ = terms_of(batch["text"])
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, pa.array(term.view(np.int64)))
            counts = pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], terms, counts], ["query", "terms", "counts"])


def kinds(text: np.ndarray, own: np.ndarray, documents: int) -> np.ndarray:
    """Each document's vocabulary: the documents with the most common term, those of the others with their most common term, and so on.

    ``text`` and ``own``: the document and the number of the term of every posting.
    """
    kind = np.full(documents, KINDS)
    for number in range(KINDS):
        if not len(own):
            break
        kind[text[own == np.bincount(own).argmax()]] = number
        left = kind[text] == KINDS
        text, own = text[left], own[left]
    return kind


def _indexed(batches):
    """Shards of the task's documents: each one row, whatever batches they came in."""

    def shard(held: list[tuple], ids: list[pa.Array]):
        lengths = np.concatenate([h[3] for h in held])
        begins = np.cumsum([0] + [len(h[3]) for h in held])
        text = np.concatenate([h[0] + b for h, b in zip(held, begins)])
        term, count = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        # Documents by vocabulary and by their most frequent term, by hash on a tie: alike ones stand together.
        best = np.lexsort((term, -count, text))
        first = np.ones(len(best), bool)
        first[1:] = text[best[1:]] != text[best[:-1]]
        leading = np.zeros(len(lengths), np.uint64)
        leading[text[best[first]]] = term[best[first]]
        by_term = np.argsort(term, kind="stable")
        term, text, count = term[by_term], text[by_term], count[by_term]
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(term)))
        own = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((leading, kinds(text, own, len(lengths))))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        text = place[text]
        by_text = np.argsort(own * len(order) + text)
        text, count = text[by_text], count[by_text]
        named = pa.chunked_array(ids).take(pa.array(order)).combine_chunks()
        columns = (lengths[order], sizes, text, count)
        names = ["shard", "ids", "n", "words", "terms", "lengths", "sizes", "docs", "counts"]
        values = [[uuid.uuid4().int >> 66], [named.to_pylist()], [len(lengths)], [int(lengths.sum())], [term[begin].tobytes()], *([packed(c)] for c in columns)]
        types = [pa.int64(), pa.list_(named.type), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    held, ids, docs, size = [], [], 0, 0
    for big in batches:
        for batch in in_slices(big, "text"):
            while batch.num_rows:
                some = batch.slice(0, SHARD_DOCS - docs)
                batch = batch.slice(some.num_rows)
                held.append(terms_of(some["text"]))
                ids.append(some["doc_id"])
                docs, size = docs + some.num_rows, size + some["text"].nbytes
                if docs >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(held, ids)
                    held, ids, docs, size = [], [], 0, 0
    if held:
        yield shard(held, ids)


def _list_sizes(batches):
    """How many documents have each term, added up over a task's shards a few million lists at a time."""

    def rows(held: list[tuple]):
        terms, own = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        df = np.bincount(own, np.concatenate([s for _, s in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    held = []
    for batch in batches:
        for terms, sizes in zip(batch["terms"].to_pylist(), batch["sizes"].to_pylist()):
            held.append((np.frombuffer(terms, np.uint64), unpacked(sizes).astype(np.int64)))
            if sum(len(t) for t, _ in held) > 1 << 21:
                yield rows(held)
                held = []
    if held:
        yield rows(held)


def impacts(count: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of a term in a document without its idf."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


class Block:
    """A block of queries: terms and weights end to end, and for each query the least score that is of use."""

    def __init__(self, ids: list, terms: list[np.ndarray], weights: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        self.ends = np.cumsum([0, *map(len, terms)])
        self.words, own = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
        self.own = own.astype(np.int32)
        self.weights = np.concatenate([np.zeros(0), *weights])
        #: Of each word, the share of the queries that have it.
        self.share = np.bincount(self.own, minlength=len(self.words)) / max(len(ids), 1)
        #: Of each term, its query.
        self.query = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.ends))
        self.least = np.zeros(len(ids))

    def parts(self, terms: int, begin: int, end: int):
        """Runs of the queries from ``begin`` to ``end`` with about so many terms."""
        while begin < end:
            most = int(np.searchsorted(self.ends, self.ends[begin] + terms, "right")) - 1
            to = max(begin + 1, min(begin + TOGETHER, most, end))
            yield slice(begin, to)
            begin = to


class Shard:
    """One row of the index, ready for the terms of a block of queries."""

    def __init__(self, lengths, terms, sizes, docs, counts, words: np.ndarray, mean: float, share: np.ndarray | None = None):
        self.size, self.length = len(lengths), lengths
        at = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
        have = terms[at] == words if len(terms) else np.zeros(len(words), bool)
        #: The place of each of the block's terms among those that the shard has, or -1.
        self.place = np.where(have, np.cumsum(have) - 1, -1)
        begins = np.cumsum(sizes) - sizes
        kept = at[have]
        n = sizes[kept]
        ends = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(ends[-1]) + np.repeat(begins[kept] - ends[:-1], n)
        doc, impact = docs[index], impacts(counts[index], lengths[docs[index]], mean)
        # The maximum of every list in every block of documents; a block is a run of BLOCK_DOCS.
        self.blocks = -(-self.size // BLOCK_DOCS)
        owner = np.repeat(np.arange(len(kept)), n)
        cell = owner * self.blocks + doc // BLOCK_DOCS
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        first = np.flatnonzero(new)
        self.most = np.zeros((len(kept) + 1, self.blocks), np.float32)
        if len(first):
            self.most.reshape(-1)[cell[first]] = np.maximum.reduceat(impact, first)
        # What is dense stands in a matrix; its numbers pick documents, whose scores are then added exactly.
        many = np.diff(np.append(first, len(cell)))
        asked = np.ones(len(kept)) if share is None else share[have]
        dense = many * asked[owner[first]] >= DENSE
        inside = np.repeat(dense, many)
        long, number = np.unique(owner[first[dense]], return_inverse=True)
        self.column = np.full(len(kept) + 1, -1)
        self.column[long] = np.arange(len(long))
        #: Which columns have numbers in which blocks.
        self.filled = np.zeros((len(long), self.blocks), bool)
        self.filled[number, cell[first[dense]] - long[number] * self.blocks] = True
        #: Where the matrix has numbers, in order, and these exactly.
        self.cells, self.held = self.column[owner[inside]] * self.size + doc[inside], impact[inside]
        self.rough = np.zeros((len(long), self.size), np.float32)
        self.rough.reshape(-1)[self.cells] = self.held
        # The rest of all lists, end to end, small for the many that are read and exact for the few that are added;
        # the last list has none and stands for terms without one.
        self.doc, self.impact = doc[~inside].astype(np.uint16 if self.size <= 1 << 16 else np.int64), impact[~inside]
        self.light = self.impact.astype(np.float32)
        self.n = np.bincount(owner[~inside], minlength=len(kept) + 1)
        self.begin = np.cumsum(self.n) - self.n

    def bounds(self, block: Block, some: slice) -> np.ndarray:
        """For each of some queries and each block of documents, what no score there exceeds."""
        a, b = block.ends[some.start], block.ends[some.stop]
        each = self.most[self.place[block.own[a:b]]]
        each *= block.weights[a:b, None].astype(np.float32)
        out = np.zeros((some.stop - some.start, self.blocks), np.float32)
        ends = block.ends[some.start : some.stop + 1] - a
        filled = np.flatnonzero(np.diff(ends))
        if len(filled):
            out[filled] = np.add.reduceat(each, ends[:-1][filled], axis=0)
        return out

    def columns(self, block: Block, some: slice) -> np.ndarray:
        """The weights of some queries for the terms that stand as columns."""
        a, b = block.ends[some.start], block.ends[some.stop]
        column = self.column[self.place[block.own[a:b]]]
        held = np.flatnonzero(column >= 0)
        out = np.zeros((some.stop - some.start, len(self.rough)))
        out[block.query[a:b][held] - some.start, column[held]] = block.weights[a:b][held]
        return out

    def common(self, long: np.ndarray, open_blocks: np.ndarray) -> np.ndarray:
        """What the columns come to in each document, in single precision, for some queries; 0 in blocks that are closed to all of them."""
        weights, out = long.astype(np.float32), np.zeros((len(long), self.size), np.float32)
        for number, some in enumerate(open_blocks.T):
            rows, used = np.flatnonzero(some), np.flatnonzero(self.filled[:, number])
            docs = slice(number * BLOCK_DOCS, (number + 1) * BLOCK_DOCS)
            if len(rows):
                out[rows, docs] = weights[np.ix_(rows, used)] @ self.rough[used, docs]
        return out

    def rare(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place, number of the term) of every posting of some terms that is not in a column."""
        n = self.n.take(place)
        index = np.repeat(self.begin.take(place) - (np.cumsum(n) - n), n)
        index += np.arange(len(index))
        return self.doc.take(index), index, np.repeat(np.arange(len(n)), n)

    def hits(self, block: Block, some: slice, place: np.ndarray, rough: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, exact sum of its postings) wherever some queries may reach ``least``; ``rough``: what their columns come to."""
        mine = slice(block.ends[some.start], block.ends[some.stop])
        docs, index, of = self.rare(place[mine])
        cells = ((block.query[mine].astype(np.int64) - some.start) * self.size)[of] + docs
        acc = np.bincount(cells, self.light.take(index) * block.weights[mine][of], rough.size).reshape(rough.shape)
        found = np.flatnonzero(acc + rough >= np.maximum(least * (1 - LOSS), np.finfo(float).tiny)[:, None])
        own = np.zeros(rough.size, bool)
        own[found] = True
        own = np.flatnonzero(own[cells]) if len(found) else found
        held = np.bincount(np.searchsorted(found, cells[own]), self.impact[index[own]] * block.weights[mine][of[own]], len(found))
        return found // self.size, found % self.size, held

    def scored(
        self, place: np.ndarray, weights: np.ndarray, long: np.ndarray, rough: np.ndarray, open_blocks: np.ndarray, least: float, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) in the open blocks that reach ``least`` and may be among the k best there.

        ``long``: the query's weights by column; ``rough``: what they come to in each document, in single precision.
        """
        docs, index, of = self.rare(place)
        weights = weights[of]
        rough = np.bincount(docs, self.light.take(index) * weights, self.size) + rough
        found = np.flatnonzero(rough >= max(least * (1 - LOSS), np.finfo(float).tiny))
        found = found[open_blocks[found // BLOCK_DOCS]]
        if len(found) > k:
            least = max(least, np.partition(rough[found], -k)[-k] * (1 - LOSS) - 10.0**-DECIMALS)
            found = found[rough[found] >= least * (1 - LOSS)]
        if not len(found):
            return found, np.zeros(0)
        own = np.zeros(self.size, bool)
        own[found] = True
        own = np.flatnonzero(own[docs])
        acc = np.bincount(docs[own], self.impact[index[own]] * weights[own], self.size)
        return found, np.round(acc[found] + self.exact(long, found), DECIMALS)

    def exact(self, long: np.ndarray, found: np.ndarray) -> np.ndarray:
        """What a query's weights by column come to in some documents."""
        used = np.flatnonzero(long)
        if not len(used):
            return np.zeros(len(found))
        cells = used[:, None] * self.size + found
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return (np.where(self.cells[at] == cells, self.held[at], 0.0) * long[used, None]).sum(axis=0)


def best_of(found: list[tuple], k: int) -> list[tuple]:
    """The k best of (score, doc_id): high scores first, then small ids, null last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]


def runs(column: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _searched(shared, mean: float):
    def run(batches):
        block = shared.value
        k = block.k
        best: list[list[tuple]] = [[] for _ in block.ids]
        least = block.least.copy()
        id_type = None
        for batch in batches:
            id_type = batch["ids"].type.value_type
            for row in batch.select(["ids", "terms", "lengths", "sizes", "docs", "counts"]).to_pylist():
                numbers = [unpacked(row[c]).astype(np.int64) for c in ("lengths", "sizes", "docs", "counts")]
                shard = Shard(numbers[0], np.frombuffer(row["terms"], np.uint64), *numbers[1:], block.words, mean, block.share)
                ids = row["ids"]
                # The pivot test: the maxima of a query's lists, wherever in the shard they are.
                place = shard.place[block.own]
                tops = shard.most.max(axis=1, initial=0)[place] * block.weights
                hope = np.bincount(block.query, tops, len(block.ids)) * (1 + LOSS) >= least
                for part in block.parts(TERMS, 0, len(block.ids)):
                    if not hope[part].any():
                        continue
                    bounds = shard.bounds(block, part)
                    open_ = (bounds > 0) & (bounds * (1 + LOSS) >= least[part, None]) & hope[part, None]
                    long = shard.columns(block, part)
                    rough = shard.common(long, open_)
                    for some in block.parts(RARE, part.start, part.stop):
                        own = slice(some.start - part.start, some.stop - part.start)
                        rows, found, held = shard.hits(block, some, place, rough[own], least[some])
                        rows += own.start
                        inside = open_[rows, found // BLOCK_DOCS]
                        rows, found, held = rows[inside], found[inside], held[inside]
                        begins = np.flatnonzero(np.diff(rows, prepend=-1))
                        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
                            i = int(rows[begin])
                            q, docs = part.start + i, found[begin:end]
                            if end - begin > k:
                                mine = slice(block.ends[q], block.ends[q + 1])
                                docs, scores = shard.scored(place[mine], block.weights[mine], long[i], rough[i], open_[i], least[q], k)
                            else:
                                scores = np.round(held[begin:end] + shard.exact(long[i], docs), DECIMALS)
                            keep = scores >= least[q]
                            if keep.any():
                                new = [(s, ids[d]) for s, d in zip(scores[keep].tolist(), docs[keep].tolist())]
                                best[q] = best_of(best[q] + new, k)
                                if len(best[q]) == k:
                                    least[q] = max(least[q], best[q][-1][0])
        rows = [(block.ids[q], d, s) for q, found in enumerate(best) for s, d in found]
        if rows:
            query, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, id_type), pa.array(doc, id_type), pa.array(score, pa.float64())], ["query", "doc_id", "score"]
            )

    return run


def indexed(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text): a row for each shard, with the wave that searches it."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blobs = ", ".join(f"{c} binary" for c in ("terms", "lengths", "sizes", "docs", "counts"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shards = rows.mapInArrow(_indexed, f"shard long, ids array<{id_type}>, n long, words long, {blobs}")
    place = F.pmod(F.xxhash64("shard"), F.lit(WAVES[-1]))
    wave = F.lit(0)
    for share in WAVES[:-1]:
        wave = wave + (place >= share).cast("int")
    return cut(shards.withColumn("wave", wave))


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, rank, doc_id and score: the k best rows of ``docs`` for every row of ``queries`` (doc_id, text).

    Words are lower-cased (A-Z); a term that a query repeats counts as often. Scores
    have six decimals; ties of these go to the smaller doc_id, null last. A query
    without words, or without a word that any document has, gets no rows; repeated
    documents are ranked each; of queries that share a doc_id, the one whose terms
    sort first is answered. A null text is empty, other columns are ignored. The
    documents are read once; the index is read once for each block of queries.
    """
    session = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = indexed(docs)
    n, words = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / n if words else 1.0
    counts = index.select("terms", "sizes").mapInArrow(_list_sizes, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select("doc_id", F.col("text").cast("string").alias("text"))
    listed = asked.mapInArrow(_queries, f"query {id_type}, terms array<long>, counts array<long>").where("size(terms) > 0")
    listed = listed.groupBy("query").agg(F.min(F.struct("terms", "counts")).alias("q"))
    each = listed.select("query", F.explode(F.arrays_zip("q.terms", "q.counts")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = dealt_anew(each, counts, "term").select("query", F.struct("term", (F.col("count") * idf).alias("weight")).alias("t"))
    ready = cut(weighed.groupBy("query").agg(F.sort_array(F.collect_list("t")).alias("t")))
    total = ready.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0] * 16
    blocks = max(1, -(-total // query_bytes))
    ready = ready.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    folder = f"{shared_folder(session)}/cut-{uuid.uuid4().hex}"
    schema = f"query {id_type}, doc_id {id_type}, score double"
    for number in range(blocks):
        rows = ready.where(F.col("block") == number).select("query", "t.term", "t.weight").toArrow()
        lists = [runs(rows[c].combine_chunks()) for c in ("term", "weight")]
        block = Block(rows["query"].to_pylist(), [t.view(np.uint64) for t in lists[0]], lists[1], k)
        of = {q: i for i, q in enumerate(block.ids)}
        earlier = None
        for wave in range(len(WAVES)):
            shared = session.sparkContext.broadcast(block)
            found = cut(index.where(F.col("wave") == wave).select("ids", "terms", "lengths", "sizes", "docs", "counts").mapInArrow(_searched(shared, mean), schema))
            shared.destroy()
            earlier = found if earlier is None else earlier.unionByName(found)
            if wave + 1 < len(WAVES):
                # The k-th best so far of each query of the block: as many numbers as it has queries.
                kth = earlier.groupBy("query").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("kth"))
                for row in kth.where("kth IS NOT NULL").collect():
                    block.least[of[row["query"]]] = row["kth"]
        earlier.write.mode("append").parquet(folder)
    drop(ready)
    out = session.read.schema(schema).parquet(folder)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")
