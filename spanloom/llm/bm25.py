"""Exact top-k BM25 search on written, sharded inverted indexes with block-max WAND pruning.

Words are runs of anything but ASCII white space, A-Z in lower case; 64-bit
hashes stand for them. One pass over the documents writes the index to the
shared folder: a row is a shard of up to ``SHARD`` documents or ``SHARD_WORDS``
words of a partition, whole documents each, with the postings of all its words.
Queries are a stated set, taken in blocks of at most ``QUERIES`` queries and
``QUERY_WORDS`` distinct words; a block reads the lengths of the index's lists
for the global statistics, with which every shard's scores are final, then the
index for its lists. Each block's answers are written, so the plan does not
grow with the blocks.

In a shard a query sums its lists' maxima of each block of ``BLOCK`` documents
and takes the blocks from the highest sum down, in rounds that double. A block
whose sum cannot reach the k-th best score so far is not opened, and as the
sums fall, the first such block ends the search. In an opened block the
cursors of its lists read doc numbers alone; a document is a pivot if the block
maxima of the lists that hold it together reach the k-th best score, and
only pivots are scored. A query of over ``LONG`` terms, such as a whole
document, leaves hardly a block out, so all documents of the shard are scored
at once. The shards' answers are merged by score and doc_id, so the result is
exact.

Defined results: scores are rounded to six digits, ties go to the smaller
doc_id; documents without a word of the query are not returned, nor are those
with a null doc_id, which count in the statistics; null and empty queries have
no result; rows that repeat a doc_id count as documents but are returned once,
with their best score; very long texts are indexed whole, a shard each if need
be; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import delete, shared_dir

K1, B = 1.2, 0.75
SHARD = 16384
SHARD_WORDS = 4 << 20
BLOCK = 128
ROUND = 4
QUERIES = 2000
QUERY_WORDS = 1 << 20
LONG = 64
DIGITS = 6
#: A row group of the index is closed at this size, so that few shards are held at once.
GROUP_BYTES = 32 << 20
#: Numbers are little-endian: ids of 8 bytes, whether each is known, words of each document, hashes of terms in rising order, where each term's postings start and the last one's end, document numbers and counts.
INDEX = "documents long, words long, ids binary, known binary, lengths binary, terms binary, starts binary, docs binary, times binary"
FOUND = "query_id long, doc_id long, score double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def term_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one range after the other."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, a batch each."""
    ids: list[int | None] = []
    lengths: list[int] = []
    numbers: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    words = 0

    def row() -> pa.RecordBatch:
        terms, rank = np.unique(np.fromiter(map(term_of, numbers), np.uint64, len(numbers)), return_inverse=True)
        found = rank[np.concatenate([*held, np.empty(0, np.int64)])]
        cell, times = np.unique(found * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
        starts = np.searchsorted(cell, np.arange(len(terms) + 1) * len(ids))
        parts = [
            np.array([x or 0 for x in ids], np.int64),
            np.array([x is not None for x in ids], np.uint8),
            np.array(lengths, np.int64),
            terms,
            starts.astype(np.int64),
            (cell % len(ids)).astype(np.int32),
            times.astype(np.int32),
        ]
        columns = [pa.array([len(ids)]), pa.array([words]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words_of(text)
            if ids and (len(ids) == SHARD or words + len(own) > SHARD_WORDS):
                yield row()
                ids, lengths, numbers, held, words = [], [], {}, [], 0
            held.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64))
            ids.append(doc_id)
            lengths.append(len(own))
            words += len(own)
    if ids:
        yield row()


def _places(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked terms the sorted terms hold, and where."""
    at = np.minimum(np.searchsorted(terms, asked), max(len(terms) - 1, 0))
    own = np.flatnonzero(terms[at] == asked) if len(terms) else np.empty(0, np.int64)
    return own, at[own]


def _count(shared):
    """Rows (term, n): documents of the partition that hold a term, by its place among the asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        n = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                own, at = _places(np.frombuffer(terms.as_buffer(), np.uint64), asked)
                n[own] += np.diff(np.frombuffer(starts.as_buffer(), np.int64))[at]
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["term", "n"])

    return run


class Shard:
    """Postings of one shard, by term and document, with the maxima of their blocks."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, shares: np.ndarray, n_terms: int):
        self.ids, self.docs, self.shares = ids, docs, shares
        self.once = len(np.unique(ids)) == len(ids)
        self.blocks = max(1, -(-len(ids) // BLOCK))
        cell = terms * self.blocks + docs // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        self.cells, self.ends = cell[first], np.append(first, len(cell))
        self.cell_max = np.maximum.reduceat(shares, first) if len(cell) else np.empty(0)
        # The cells of each term lie together.
        self.term_cells = np.searchsorted(self.cells, np.arange(n_terms + 1) * self.blocks)

    def _best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (document number, score), a doc_id once."""
        if self.once and len(at) > k:
            own = score >= np.partition(score, len(at) - k)[len(at) - k]
            at, score = at[own], score[own]
        order = np.lexsort((self.ids[at], -score))
        order = order[np.sort(np.unique(self.ids[at[order]], return_index=True)[1])][:k]
        return at[order], score[order]

    def _scored(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, from the scores of all documents."""
        # Postings lie by term, so a term's are those from its first cell to its last.
        first, last = self.ends[self.term_cells[terms]], self.ends[self.term_cells[terms + 1]]
        pieces = [slice(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True) if x < y]
        if not pieces:
            return np.empty(0, np.int64), np.empty(0)
        score = np.bincount(np.concatenate([self.docs[x] for x in pieces]), np.concatenate([self.shares[x] for x in pieces]), len(self.ids))
        at = np.flatnonzero(score > 0)
        return self._best(at, np.round(score[at], DIGITS), k)

    def _pruned(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, from the scores of pivots in blocks that can hold one."""
        cells = spans(self.term_cells[terms], self.term_cells[terms + 1])
        block = self.cells[cells] % self.blocks
        bound = np.bincount(block, self.cell_max[cells], self.blocks)
        # Cells by block, the blocks from the highest sum down.
        falling = np.argsort(-bound, kind="stable")
        place = np.empty(self.blocks, np.int64)
        place[falling] = np.arange(self.blocks)
        cells = cells[np.argsort(place[block], kind="stable")]
        cut = np.append(0, np.cumsum(np.bincount(place[block], minlength=self.blocks)))
        bound = bound[falling]
        best, score = np.empty(0, np.int64), np.empty(0)
        slack, at, width = 10.0**-DIGITS, 0, ROUND
        while at < self.blocks:
            floor = score[-1] - slack if len(score) == k else 0.0
            end = at + int(np.count_nonzero((bound[at : at + width] > 0) & (bound[at : at + width] >= floor)))
            if end == at:
                break
            own = cells[cut[at] : cut[end]]
            first, last = self.ends[own], self.ends[own + 1]
            posting = spans(first, last)
            # A document's number among the opened blocks.
            docs = self.docs[posting]
            docs = (place[docs // BLOCK] - at) * BLOCK + docs % BLOCK
            hope = np.bincount(docs, np.repeat(self.cell_max[own], last - first), (end - at) * BLOCK)
            pivot = (hope > 0) & (hope >= floor)
            kept = pivot[docs]
            total = np.round(np.bincount(docs[kept], self.shares[posting[kept]], (end - at) * BLOCK), DIGITS)
            new = np.flatnonzero(pivot & (total >= floor))
            best, score = self._best(np.append(best, falling[at + new // BLOCK] * BLOCK + new % BLOCK), np.append(score, total[new]), k)
            at, width = end, 2 * width
        return best, score

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (doc_id, score)."""
        at, score = self._scored(terms, k) if len(terms) > LONG else self._pruned(terms, k)
        return self.ids[at], score


def _shard(row: dict, asked: np.ndarray, idf: np.ndarray, mean: float) -> Shard:
    """The postings of the asked terms in a row of the index."""
    ids, known, lengths = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("known", np.uint8), ("lengths", np.int64)))
    own, at = _places(np.frombuffer(row["terms"], np.uint64), asked)
    starts = np.frombuffer(row["starts"], np.int64)
    posting = spans(starts[at], starts[at + 1])
    docs, times = (np.frombuffer(row[c], np.int32)[posting].astype(np.int64) for c in ("docs", "times"))
    terms = np.repeat(own, starts[at + 1] - starts[at])
    if not known.all():
        kept = known[docs] > 0
        docs, times, terms = docs[kept], times[kept], terms[kept]
    shares = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[docs] / mean))
    return Shard(ids, docs, terms, shares, len(asked))


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf, mean, queries = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                shard = _shard({n: batch.column(n)[at].as_buffer() for n in batch.schema.names}, asked, idf, mean)
                found = [(q, *shard.search(t, k)) for q, t in queries]
                rows = [np.repeat(np.array([q for q, _, _ in found], np.int64), [len(x) for _, x, _ in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([s for _, _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["query_id", "doc_id", "score"])

    return run


def write_index(documents: DataFrame, path: str) -> None:
    """Writes the sharded index of documents (doc_id, text) to a folder that all executors share."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, INDEX)
    rows.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)


def _blocks(queries: DataFrame, query_key: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The queries that have a word, with the terms of each, block by block."""
    asked = queries.select(F.col(query_key).cast("long").alias("q"), "text").filter("q IS NOT NULL AND text IS NOT NULL").orderBy("q")
    block, size = [], 0
    for row in asked.toLocalIterator():
        terms = np.fromiter(set(map(term_of, words_of(row["text"]))), np.uint64)
        if len(terms) == 0:
            continue
        if block and (len(block) == QUERIES or size + len(terms) > QUERY_WORDS):
            yield block
            block, size = [], 0
        block.append((row["q"], np.sort(terms)))
        size += len(terms)
    if block:
        yield block


def answers(index: DataFrame, block: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, doc_id, score): each shard's k best of each query of a block."""
    context = index.sparkSession.sparkContext
    total, words = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = np.unique(np.concatenate([t for _, t in block]))
    counted = index.select("terms", "starts").mapInArrow(_count(context.broadcast(asked)), "term long, n long")
    held = np.zeros(len(asked))
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        held[r["term"]] = r["n"]
    idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
    numbered = [(q, np.searchsorted(asked, t)) for q, t in block]
    shared = context.broadcast((asked, idf, words / total if words else 1.0, numbered))
    return index.drop("documents", "words").mapInArrow(_search(shared, k), FOUND)


def search(documents: DataFrame, queries: DataFrame, k: int = 20, query_key: str = "item_id") -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's k best documents."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/bm25_{uuid.uuid4().hex}"
    write_index(documents, f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    paths = []
    for block in _blocks(queries, query_key):
        paths.append(f"{folder}/found/block={len(paths)}")
        answers(index, block, k).write.parquet(paths[-1])
    delete(spark, f"{folder}/index")
    found = spark.read.schema(FOUND).parquet(*paths) if paths else spark.createDataFrame([], FOUND)
    once = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
