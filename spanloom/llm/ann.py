"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product. Vectors are parted into ranges of
norms, each up to ``RATIO`` times its smallest, and scaled by the largest norm
of their range, so that a few long vectors do not push the others together.
They are given one more component that makes their length 1, queries are
scaled to length 1 with 0 there; then the largest inner product is the smallest
Euclidean distance in a range, which p-stable (Gaussian) hashes keep. Each of
``TABLES`` tables has hashes of width ``WIDTH``, whose number grows with the
logarithm of the range's rows (``hashes_for``), for all ranges by one rule. A
query visits its own bucket and the ``PROBES`` perturbed ones likeliest to
succeed: perturbations are tried in the order of their expected squared
distances to the bucket's edges, applied to the query's own order of edges. Its
buckets depend on the number of hashes, not on the range, so ranges with equal
numbers share a visit. The candidates of all tables are merged and reranked by
the inner product of the original vectors in double precision, summed for each
pair by itself in the order of the components, so that equal vectors have
equal scores wherever they lie.

Buckets are dealt to cells of about ``CELL_BYTES``; a query's vector goes once
to each cell that it visits. The vectors of a bucket with over a ``HOT``th of
all rows, which number at most HOT a table, are dealt over several cells by a
hash of their id, each of which its queries visit; a cell that over a
``HOT_VISITS``th of the queries visit is copied, and its queries are dealt over
the copies. Of equal vectors only the k + 1 smallest ids are indexed: ties go
to smaller ids, so no other can be among the k nearest.

Recall against brute force is 0.9 or more, measured on tables from a hundred
to fifty thousand vectors, nearly random ones among them; see the README.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or a component that is not finite take no part on either side; rows
that repeat an id and vector count once; an id with several vectors is found
with its best; fewer than k candidates in reach give fewer rows; an empty table
gives an empty table. Other columns are ignored. Double vectors stay doubles; a
product beyond their range is infinite.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, shuffle_width

TABLES, WIDTH, PROBES, SEED = 8, 3.0, 110, 20
CELL_BYTES = 32 << 20
HOT, HOT_VISITS = 1024, 64
RATIO = 1.5
FLUSH = 1 << 20
#: Candidates whose products are held at once.
CHUNK = 1 << 14
#: Rows of a bucket from which on its product is taken in place.
LONG_RANGE = 16


def hashes_for(rows: int) -> int:
    """How many hashes a table has for a range of so many rows: none for one row, 11 for 500, 12 for 10,000."""
    bits = math.log2(max(rows, 1))
    return round(min(1.5 * bits, 9 + 0.22 * bits))


def probe_template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places in a query's sorted list of 2 * hashes edge distances, likeliest first.

    The expected square of the j-th smallest distance follows from uniform
    positions; places j and 2 * hashes - 1 - j are the two edges of one hash.
    """
    m = 2 * hashes
    near = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, hashes + 1)]
    far = [1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(hashes + 1, m + 1)]
    cost = near + far
    out: list[tuple[int, ...]] = []
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, places = heapq.heappop(heap)
        if all(m - 1 - p not in places for p in places):
            out.append(places)
        last = places[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*places, last + 1)))
    return out


class Hashes:
    """The tables' hash functions; buckets are 64-bit mixtures of a table's hashes and their number."""

    def __init__(self, dimension: int, ranges: dict[int, tuple[int, float]]):
        """``ranges`` gives the rows and the largest norm of each range."""
        draw = np.random.default_rng(SEED)
        self.ranges = np.array(sorted(ranges), np.int64)
        self.largest = np.array([ranges[r][1] for r in sorted(ranges)])
        self.hashes = np.array([hashes_for(ranges[r][0]) for r in sorted(ranges)])
        most = int(self.hashes.max(initial=1))
        self.lines = draw.normal(size=(TABLES, most, dimension + 1)).transpose(0, 2, 1)
        self.shift = draw.random((TABLES, most)) * WIDTH
        self.mix = draw.integers(1, 1 << 62, (TABLES, most)) | 1
        self.templates = {int(h): probe_template(int(h), PROBES) if h else [] for h in np.unique(self.hashes)}

    def _places(self, x: np.ndarray, table: int, hashes: int) -> np.ndarray:
        return (x @ self.lines[table][:, :hashes] + self.shift[table][:hashes]) / WIDTH

    def buckets(self, vectors: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """tables x rows buckets of indexed vectors of these ranges."""
        own = np.searchsorted(self.ranges, ranges)
        x = vectors / self.largest[own][:, None]
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])
        out = np.empty((TABLES, len(x)), np.int64)
        for h in self.templates:
            at = np.flatnonzero(self.hashes[own] == h)
            for t in range(TABLES):
                out[t, at] = (np.floor(self._places(x[at], t, h)).astype(np.int64) * self.mix[t][:h]).sum(axis=1) + _salt(h)
        return out

    def probes(self, queries: np.ndarray) -> np.ndarray:
        """tables x rows x visits: the buckets that queries visit, in order for each number of hashes."""
        x = queries / np.abs(queries).max(axis=1, keepdims=True)
        x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        rows = np.arange(len(x))
        out = np.empty((TABLES, len(x), sum(1 + len(p) for p in self.templates.values())), np.int64)
        for t in range(TABLES):
            at = 0
            for h, template in self.templates.items():
                places = self._places(x, t, h)
                base = np.floor(places).astype(np.int64)
                edge = np.hstack([places - base, base + 1 - places])
                order = np.argsort(edge, axis=1, kind="stable")
                step = np.where(order < h, -1, 1) * self.mix[t][order % max(h, 1)]
                own = (base * self.mix[t][:h]).sum(axis=1) + _salt(h)
                out[t, :, at] = own
                for k, probe in enumerate(template):
                    out[t, :, at + 1 + k] = own + sum(step[rows, p] for p in probe)
                at += 1 + len(template)
        return out


def _salt(hashes: int) -> int:
    return hashes * 0x2545F4914F6CDD1D % (1 << 62)


def _matrix(column: pa.Array, kind: type | None = np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return values if kind is None else values.astype(kind)


def _usable(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _region(buckets: np.ndarray, table: int, regions: int) -> np.ndarray:
    return (buckets.astype(np.uint64) >> np.uint64(11)).astype(np.int64) % regions * TABLES + table


def _split(hot: dict[tuple[int, int], int], table: int, bucket: np.ndarray) -> dict[int, int]:
    """How many cells each hot bucket among these has."""
    own = {b: n for (t, b), n in hot.items() if t == table}
    return {int(b): own[int(b)] for b in np.unique(bucket) if int(b) in own} if own else {}


def _salted(cell: int, salt: int, regions: int) -> int:
    return cell + salt * regions * TABLES


def _dealt(ids: np.ndarray, parts) -> np.ndarray:
    return ids * 0x9E3779B1 % (1 << 31) % parts


def _index(hashes: Hashes, hot: dict, copies: dict[int, int], regions: int):
    """The indexed rows of each cell, as often as it is copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, found = batch.column(0).to_numpy(), hashes.buckets(_matrix(batch.column(1)), batch.column(2).to_numpy())
            for t in range(TABLES):
                cells = _region(found[t], t, regions)
                for b, n in _split(hot, t, found[t]).items():
                    own = found[t] == b
                    cells[own] = _salted(cells[own], _dealt(ids[own], n), regions)
                many = np.array([copies.get(c, 1) for c in cells.tolist()])
                for copy in range(many.max()):
                    pick = np.flatnonzero(many > copy)
                    at = pa.array(pick)
                    yield _cells(cells[pick] * HOT + copy, 1, found[t][pick], batch.column(0).take(at), batch.column(1).take(at), [[]] * len(pick))

    return run


def _cells(cells, role: int, bucket, ids: pa.Array, vectors: pa.Array, buckets: list) -> pa.RecordBatch:
    arrays = [pa.array(cells, pa.int64()), pa.array(np.full(len(cells), role, np.int32)), pa.array(bucket, pa.int64()), ids, vectors, pa.array(buckets, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["cell", "role", "bucket", "id", "vector", "buckets"])


def _visited(hashes: Hashes, hot: dict, regions: int, part: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[list[int]]]]:
    """For each table: rows of the batch, cells that they visit, and the buckets there."""
    found = hashes.probes(_matrix(part.column(1)))
    for t in range(TABLES):
        cells = _region(found[t], t, regions)
        split = _split(hot, t, found[t])
        rows, where, lists = [], [], []
        for k in range(part.num_rows):
            wanted: dict[int, list[int]] = {}
            for c, b in zip(cells[k].tolist(), found[t][k].tolist(), strict=True):
                for salt in range(split.get(b, 1)):
                    wanted.setdefault(_salted(c, salt, regions), []).append(b)
            rows += [k] * len(wanted)
            where += wanted
            lists += wanted.values()
        yield rows, where, lists


def _ask(hashes: Hashes, hot: dict, copies: dict[int, int], regions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0).to_numpy()
                for rows, where, lists in _visited(hashes, hot, regions, part):
                    pick = np.array(rows, np.int64)
                    many = np.array([copies.get(c, 1) for c in where], np.int64)
                    cells = np.array(where, np.int64) * HOT + _dealt(ids[pick], many)
                    yield _cells(cells, 2, np.zeros(len(rows), np.int64), part.column(0).take(pa.array(pick)), part.column(1).take(pa.array(pick)), lists)

    return run


def _visits(hashes: Hashes, hot: dict, regions: int):
    """Rows (cell, n): how many queries visit each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for _, where, _ in _visited(hashes, hot, regions, batch.slice(at, 500)):
                    ids, times = np.unique(np.array(where, np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times)], names=["cell", "n"])

    return run


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each query among (query, id, score) rows."""
    found = found[np.lexsort((found["id"], -found["score"], found["query"]))]
    same = (found["query"][1:] == found["query"][:-1]) & (found["id"][1:] == found["id"][:-1])
    found = found[np.r_[True, ~same]] if len(found) else found
    first = np.r_[True, found["query"][1:] != found["query"][:-1]] if len(found) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(found)), 0)) if len(found) else np.empty(0, int)
    return found[np.arange(len(found)) - start < k]


@np.errstate(over="ignore", invalid="ignore")
def _products(index: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the ranges [left, right), and their products with x as fast as they come, without copies where ranges are long."""
    lengths = right - left
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(left - (ends - lengths), lengths)
    if len(at) >= LONG_RANGE * len(left):
        return at, np.concatenate([index[i:j] @ x for i, j in zip(left.tolist(), right.tolist(), strict=True)])
    return at, np.concatenate([index[at[c : c + CHUNK]] @ x for c in range(0, len(at), CHUNK)])


@np.errstate(over="ignore", invalid="ignore")
def _scores(index: np.ndarray, largest: float, at: np.ndarray, near: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the rows ``at``, with all that tie, and their scores.

    The fast products, in the vectors' own precision, whose last bits depend on
    where a row lies, pick them with a margin over their rounding; the scores
    are then summed in double precision, each row by itself.
    """
    if len(at) > k:
        bound = 4.0 * len(x) ** 2 * np.finfo(index.dtype).eps * float(np.abs(x).max()) * largest
        edge = float(np.partition(near, len(at) - k)[len(at) - k]) - 2 * bound
        if np.isfinite(edge):
            at = at[near >= edge]
    scores = (index[at].astype(np.float64) * x.astype(np.float64)).sum(axis=1)
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if len(at) > k:
        kept = scores >= np.partition(scores, len(at) - k)[len(at) - k]
        at, scores = at[kept], scores[kept]
    return at, scores


FOUND = np.dtype([("query", "<i8"), ("id", "<i8"), ("score", "<f8")])


def _scan(k: int):
    """Reranks cell after cell; rows come sorted by cell, with the indexed vectors, by bucket, before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        cell, ids, buckets, vectors, ready = None, [], [], [], None

        def out() -> pa.RecordBatch:
            best = _best(np.concatenate([*held, np.empty(0, FOUND)]), k)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(best[c])) for c in FOUND.names], names=["query_id", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            starts = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]) if batch.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if columns[0][lo] != cell:
                    cell, ids, buckets, vectors, ready = columns[0][lo], [], [], [], None
                matrix = _matrix(batch.column(4).slice(lo, hi - lo), None)
                if columns[1][lo] == 1:
                    ids.append(columns[3][lo:hi])
                    buckets.append(columns[2][lo:hi])
                    vectors.append(matrix)
                    continue
                if not ids:
                    continue
                if ready is None:
                    index = np.vstack(vectors)
                    ready = np.concatenate(ids), np.concatenate(buckets), index, float(np.abs(index).max())
                    vectors = []
                own, place, index, largest = ready
                for q, x, wanted in zip(columns[3][lo:hi], matrix, batch.column(5).slice(lo, hi - lo).to_pylist(), strict=True):
                    left, right = np.searchsorted(place, wanted), np.searchsorted(place, wanted, side="right")
                    full = left < right
                    if not full.any():
                        continue
                    at, near = _products(index, left[full], right[full], x)
                    other = own[at] != q
                    if not other.all():
                        at, near = at[other], near[other]
                    if not len(at):
                        continue
                    at, scores = _scores(index, largest, at, near, x, k)
                    found = np.empty(len(at), FOUND)
                    found["query"], found["id"], found["score"] = q, own[at], scores
                    held.append(found)
                    many += len(at)
                if many > FLUSH:
                    yield out()
                    held, many = [], 0
        yield out()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; a query is no candidate of its own."""
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    plain = F.col(vector).cast(f"array<{kind}>")
    usable = vectors.select(F.col(key).cast("long").alias("id"), plain.alias("vector")).filter(F.col("id").isNotNull() & _usable("vector"))
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = lengths["n"] if lengths else 1
    usable = usable.filter(F.size("vector") == dimension)
    asked = queries.select(F.col(key).cast("long").alias("id"), plain.alias("vector")).filter(F.col("id").isNotNull() & _usable("vector")).filter(F.size("vector") == dimension).distinct()
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    # Scaled by the largest component, squares neither overflow nor vanish.
    top = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    norm = F.col("top") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    once = usable.distinct().withColumn("copy", copy).filter(F.col("copy") <= k + 1).withColumn("top", top).withColumn("norm", norm)
    indexed = checkpointed(once.select("id", "vector", F.floor(F.log("norm") / math.log(RATIO) + 0.5).alias("range"), "norm"))
    # Norms of doubles fall into some 3,600 ranges at most.
    ranges = {r["range"]: (r["n"], r["largest"]) for r in indexed.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("largest")).collect()}
    rows = sum(n for n, _ in ranges.values())
    hashes = Hashes(dimension, ranges)
    cell = max(1, CELL_BYTES // (8 * dimension))
    regions = max(1, -(-rows // cell))
    most = max(cell, rows // HOT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, found in enumerate(hashes.buckets(_matrix(batch.column(1)), batch.column(2).to_numpy())):
                    ids, times = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(ids), pa.array(times)], names=["table", "bucket", "n"])

    counts = indexed.mapInArrow(count, "table int, bucket long, n long").groupBy("table", "bucket").agg(F.sum("n").alias("n"))
    # Fewer than HOT buckets of a table can hold more than a HOTth of the rows.
    hot = {(r["table"], r["bucket"]): -(-r["n"] // most) for r in counts.filter(F.col("n") > most).collect()}
    visits = asked.mapInArrow(_visits(hashes, hot, regions), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    often = max(cell, asked.count() // HOT_VISITS)
    # A query has a bounded number of visits, so fewer than HOT_VISITS times that many cells are copied.
    copies = {r["cell"]: min(-(-r["n"] // often), HOT) for r in visits.filter(F.col("n") > often).collect()}
    row = f"cell long, role int, bucket long, id long, vector array<{kind}>, buckets array<long>"
    cells = indexed.mapInArrow(_index(hashes, hot, copies, regions), row).unionByName(asked.mapInArrow(_ask(hashes, hot, copies, regions), row))
    ordered = cells.repartition(width, "cell").sortWithinPartitions("cell", "role", "bucket")
    found = ordered.mapInArrow(_scan(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
