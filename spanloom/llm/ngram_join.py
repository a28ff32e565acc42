"""N-gram Jaccard self-join by T-occurrence search, and the groups that its links form.

A document's set holds the hashes of its distinct 5-word shingles. Two
documents link when their sets' Jaccard similarity is at least 0.8.

1. One pass counts how many documents hold each shingle, cut to 32 bits and its
   part of the space. The commonest ones only steer the order below, so a
   count that two shingles share does no harm.
2. A second pass orders each set with common shingles last and lists the
   document under its first n - ceil(0.8 n) + 1 shingles: linked sets share
   one of those. Lists travel as packed arrays. The pass also gives each
   document's set size and a 128-bit signature, which gathers equal sets.
3. Each list of two or more documents proposes a pair of each document with
   the list's smallest doc_id. Pairs are verified by T-occurrence search
   (below), and links and equal sets make components.
   A pair is left out if its sizes and the shingle's places in both orders
   rule out the required overlap, were it the first shingle they share.
4. For the groups alone, lists whose documents are still in different
   components propose the pairs across those components, and no others. A
   group of near copies thus costs its size, not the square of it, yet no link
   between components is missed.
   Where these pairs outnumber the documents, one in ``SAMPLE`` of them, drawn
   by a hash, is verified first, as its links merge most components; then all
   pairs across what is left are.

For the number of links, 5. follows: links lie within components, so the sets of
each component, one of each equal ones, are dealt by their size's class and a
hash into blocks of bounded size, and each two blocks of the same or of
neighbouring classes, which alone can link, are searched against each other.
Only counts leave a search, so a group of n different near copies is n rows
for each of its blocks; but all its pairs are verified, as each may be a link.

T-occurrence search has a query's set and an inverted index of a block of sets.
As in DivideSkip, the longest of the query's lists are set aside; the short
ones are merged with a heap, sets that reach the lowered count are probed in
the long lists by binary search, and those that reach the overlap that the two
sizes require are kept. Short enough lists of a query rule a block out at once.

A list of documents under one shingle is searched for pairs in blocks of its
rows, each two of which are a key of their own, so a very common shingle is no
task's burden. In step 2 a list is gathered as packed entries of 24 bytes.

All is exact but for the 64-bit hashes that stand for shingles, and the 128-bit
ones for sets.

Defined results: texts that are null or hold no word have an empty set and are
linked with nothing; fewer than five words form one shingle; a null doc_id is
its own component (null); rows that repeat a doc_id share its component; ties
do not arise, as a component is named by its smallest doc_id; an empty table
gives an empty table; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import gc
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, shuffle_width
from spanloom.llm.components import connected_components

SHINGLE = 5
#: Jaccard similarity, in hundredths.
PERCENT = 80
#: Shingles held by so many documents are common.
OFTEN = 6
#: Pairs that a task holds before it passes them on.
CHUNK = 1 << 21
#: At most so many common shingles are known to the ordering; any number gives the same links.
COMMON = 1 << 18
SHORT = 64
PER_LIST_TASK = 1 << 20
BLOCK = 1024
SAMPLE = 8
#: Bits of the bitmap of documents that some pair needs: 8 MB.
BITS = 1 << 26
#: DivideSkip's weight of a probe against a merge step; probes of many sets at once are cheap.
MU = 0.0005
#: So few sets are probed one by one.
FEW = 12
#: Shingles of a block, 1 MB, and of the members that a search holds at once.
BLOCK_SHINGLES = 1 << 17
HELD_SHINGLES = 1 << 22
#: Rows of a block of a long list, and the blocks of such a list before they grow.
LIST_BLOCK, LIST_BLOCKS = 256, 32


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.BASE, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(self.BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()
#: A random number for each byte.
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Words hashed at a time.
WORDS = 1 << 16


def _hash_words(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, from sums of byte values times powers along the text."""
    text = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers.to(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * up[: len(text)], out=sums[1:])
    gaps = np.flatnonzero(text == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(text)]
    many = len(words) - size + 1
    starts, ends = starts[:many], ends[size - 1 :]
    k = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(32)
    return k


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; bytes.split and bytes.lower know just the ASCII white space and letters."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(len(words), SHINGLE)
    found = [_hash_words(words[at : at + WORDS + size - 1], size) for at in range(0, len(words) - size + 1, WORDS)]
    return np.unique(np.concatenate(found))


def required_overlap(a: int, b: int) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def may_link(n1, at1, n2, at2):
    """Whether documents of these sizes can link if the shingle at these places of their orders is the first they share."""
    return (100 + PERCENT) * np.minimum(n1 - at1, n2 - at2) >= PERCENT * (n1 + n2)


class Inverted:
    """The inverted lists of a block of sets: for each shingle the places of the sets that hold it, in order."""

    def __init__(self, members: list[np.ndarray], within: np.ndarray | None = None):
        """``within`` are the only shingles that will be asked for."""
        self.sizes = np.array([len(m) for m in members], np.int64)
        tokens = np.concatenate([*members, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        if within is not None and len(within):
            at = np.minimum(np.searchsorted(within, tokens), len(within) - 1)
            hit = within[at] == tokens
            tokens, owner = tokens[hit], owner[hit]
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.shingles, first = np.unique(tokens[order], return_index=True)
        self.ends = np.append(first, len(tokens))
        self.places = self.owner.tolist()

    def lists(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the query's lists that are not empty, shortest first."""
        if not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        starts, ends = self.ends[at], self.ends[at + 1]
        order = np.argsort(ends - starts, kind="stable")
        return list(zip(starts[order].tolist(), ends[order].tolist(), strict=True))

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(member, overlap) for the members whose overlap with the query makes a link."""
        if not len(query) or not len(self.sizes):
            return []
        need = -(-PERCENT * (len(query) + self.sizes) // (100 + PERCENT))
        able = need[(need <= self.sizes) & (need <= len(query))]
        lists = self.lists(query)
        least = int(able.min()) if len(able) else 0
        # A set is once in each list at most.
        if not least or len(lists) < least:
            return []
        longest = lists[-1][1] - lists[-1][0]
        aside = min(int(least / (MU * math.log2(max(longest, 2)) + 1)), least - 1)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = ((member, sum(1 for _ in run)) for member, run in groupby(heapq.merge(*(self.places[x:y] for x, y in short))))
        found = [(member, count) for member, count in merged if count >= least - aside]
        if len(found) <= FEW:
            return [hit for member, count in found if (hit := self._probe(member, count, long, int(need[member])))]
        return self._probe_all(np.array(found, np.int64), long, need)

    def _probe(self, member: int, count: int, long: list[tuple[int, int]], need: int) -> tuple[int, int] | None:
        left = len(long)
        for x, y in long:
            if count + left < need:
                return None
            left -= 1
            spot = bisect_left(self.places, member, x, y)
            count += spot < y and self.places[spot] == member
        return (member, count) if count >= need else None

    def _probe_all(self, found: np.ndarray, long: list[tuple[int, int]], need: np.ndarray) -> list[tuple[int, int]]:
        member, count = found[:, 0], found[:, 1].copy()
        for k, (x, y) in enumerate(long):
            if k % 8 == 0:
                alive = count + len(long) - k >= need[member]
                member, count = member[alive], count[alive]
            own = self.owner[x:y]
            count += own[np.minimum(np.searchsorted(own, member), y - x - 1)] == member
        kept = count >= need[member]
        return list(zip(member[kept].tolist(), count[kept].tolist(), strict=True))


def t_occurrence(query: np.ndarray, members: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, overlap) for the members whose overlap with the query makes a link."""
    return Inverted(members, query).search(query)


def _keys(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each shingle, and 32 more of its bits."""
    return (shingles % np.uint64(parts)).astype(np.int64), (shingles >> np.uint64(32)).astype(np.uint32)


def _deal(parts: int):
    """Packs every document's shingles, cut to 32 bits, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for text in batch.column(0).to_pylist():
                found = shingle_set(text)
                sets[xxhash.xxh3_128_digest(found.tobytes())] = found
            part, key = _keys(np.concatenate([*sets.values(), np.empty(0, np.uint64)]), parts)
            order = np.argsort(part, kind="stable")
            part, key = part[order], key[order]
            ids, starts = np.unique(part, return_index=True)
            blobs = [x.tobytes() for x in np.split(key, starts[1:])] if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """(part, key, times) of the shingles of a part that recur, and the part's size at key -1."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("entries")])
    ids, times = np.unique(keys, return_counts=True)
    often = times >= OFTEN
    ids, times = np.append(ids[often].astype(np.int64), -1), np.append(times[often], len(keys))
    return pa.table([pa.array(np.full(len(ids), table.column("part")[0].as_py())), pa.array(ids), pa.array(times.astype(np.int64))], names=["part", "key", "times"])


ENTRY = np.dtype([("shingle", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _pack(entries: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(entries[c]).tobytes() for c in ENTRY.names)


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // ENTRY.itemsize
    out, at = np.empty(n, ENTRY), 0
    for c in ENTRY.names:
        kind = ENTRY[c]
        out[c] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _list_prefixes(common: np.ndarray, times: np.ndarray, width: int, parts: int):
    """Packs the entries of every document's first shingles by part of the shingle space; part -1 describes the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, seen, sizes = [], set(), []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text)
                key = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append((doc, len(found), key))
                if doc is None or not len(found) or key in seen:
                    continue
                seen.add(key)
                first = found
                if len(common):
                    part, cut = _keys(found, width)
                    wanted = cut.astype(np.int64) * width + part
                    at = np.minimum(np.searchsorted(common, wanted), len(common) - 1)
                    known = common[at] == wanted
                    late = found[known][np.argsort(times[at[known]], kind="stable")]
                    first = np.concatenate([found[~known], late])
                first = first[: prefix_length(len(found))]
                entry = np.empty(len(first), ENTRY)
                entry["shingle"], entry["doc"], entry["n"], entry["at"] = first, doc, len(found), np.arange(len(first))
                entries.append(entry)
            packed = np.concatenate([*entries, np.empty(0, ENTRY)])
            part = (packed["shingle"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            packed, part = packed[order], part[order]
            ids, starts = np.unique(part, return_index=True)
            blobs = [_pack(x) for x in np.split(packed, starts[1:])] if len(ids) else []
            blank = pa.nulls(len(ids), pa.int64())
            lists = [pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), blank, blank, pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(lists, names=["part", "entries", "doc", "n", "signature"])
            # Documents are spread over parts below 0, which need no gathering.
            docs, n, keys = zip(*sizes, strict=True) if sizes else ((), (), ())
            spread = -1 - (np.array([doc or 0 for doc in docs], np.int64) * 0x9E3779B1 >> 16) % parts
            rows = [pa.array(spread, pa.int64()), pa.nulls(len(sizes), pa.binary()), pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["part", "entries", "doc", "n", "signature"])

    return run


def _lists(table: pa.Table) -> pa.Table:
    """The entries of shingles under which two documents are listed that may link, with the smallest doc_id of each list, and whether it and the entry may."""
    if table.column("part")[0].as_py() < 0:
        none = pa.nulls(table.num_rows, pa.int64())
        rest = [none, table.column("doc"), table.column("n").cast(pa.int32()), none.cast(pa.int32()), none, none.cast(pa.bool_()), table.column("signature")]
        return pa.table(rest, names=["shingle", "doc", "n", "at", "first", "star", "signature"])
    packed = np.concatenate([_unpack(x.as_py()) for x in table.column("entries")])
    packed = packed[np.lexsort((packed["doc"], packed["shingle"]))]
    starts = np.flatnonzero(np.r_[True, packed["shingle"][1:] != packed["shingle"][:-1]])
    lengths = np.diff(np.r_[starts, len(packed)])
    length, end = np.repeat(lengths, lengths), np.repeat(starts + lengths, lengths)
    # In short lists an entry that may link with no other is of no use; in long ones all stay.
    kept = length > SHORT
    n, at = packed["n"].astype(np.int64), packed["at"]
    i = np.flatnonzero((length > 1) & ~kept)
    for step in range(1, SHORT):
        i = i[i + step < end[i]]
        ok = i[may_link(n[i], at[i], n[i + step], at[i + step])]
        kept[ok] = kept[ok + step] = True
    head = packed[np.repeat(starts, lengths)][kept]
    rows = packed[kept]
    star = (rows["doc"] != head["doc"]) & may_link(rows["n"].astype(np.int64), rows["at"], head["n"].astype(np.int64), head["at"])
    columns = [rows["shingle"].view(np.int64), rows["doc"], rows["n"], rows["at"], head["doc"], star]
    arrays = [*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.nulls(len(rows), pa.binary())]
    return pa.table(arrays, names=["shingle", "doc", "n", "at", "first", "star", "signature"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches each block: its rows follow each other, the query first. Texts travel, as they are smaller than their sets."""

    def flush() -> pa.RecordBatch:
        kept = [(group[0], members[k][0], c) for k, c in t_occurrence(query, [m for _, m in members])] if query is not None else []
        columns = list(zip(*kept, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "overlap"])

    group, query, members, held = None, None, [], 0
    for batch in batches:
        a, block, role, doc, text = (batch.column(k).to_pylist() for k in range(5))
        for k in range(batch.num_rows):
            if (a[k], block[k]) != group:
                if members:
                    yield flush()
                group, query, members, held = (a[k], block[k]), None, [], 0
            shingles = shingle_set(text[k])
            if role[k] == 0:
                query = shingles
            else:
                members.append((doc[k], shingles))
                held += len(shingles)
                if held >= HELD_SHINGLES:
                    yield flush()
                    members, held = [], 0
    if members:
        yield flush()


def _probably(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in a one-column frame, and few others.

    A bitmap of ``BITS`` bits, of that size for any input, is broadcast; it
    keeps texts that no pair needs out of the shuffle that follows.
    """
    spot = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(BITS))
    words = wanted.select(spot.alias("spot")).selectExpr("shiftright(spot, 5) AS word", "shiftleft(1L, cast(spot & 31 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITS >> 5, np.uint32)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(spots: pd.Series) -> pd.Series:
        at = spots.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return rows.filter(held(F.pmod(F.xxhash64(key), F.lit(BITS))))


def _verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    width = shuffle_width(documents.sparkSession)
    pairs = checkpointed(pairs)
    documents = _probably(documents, "doc_id", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    # Written tables on both sides of a join let Spark split a hot key.
    sizes = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))
    pairs = pairs.join(sizes, "a")
    members = pairs.select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    queries = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    places = checkpointed(members.unionByName(queries))
    wanted = documents.join(places, F.col("doc_id") == F.col("doc"))
    ordered = wanted.select("a", "block", "role", "doc", "text").repartition(width, "a", "block").sortWithinPartitions("a", "block", "role")
    return checkpointed(ordered.mapInArrow(_search, "a long, b long, overlap long"))


def _across(sample: int):
    """Proposes the pairs of each list, or of two blocks of one, that may link and whose components differ, or a
    hash's share of them; rows (shingle, pair of blocks, doc, n, at, label, side) come sorted by the first two.
    Rows of different blocks are on different sides, and only pairs of sides are asked for; a list that is one
    block has no sides (-1)."""

    def chosen(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
        """Those of the pairs of rows that may link across components, and that the hash draws."""
        ok = (rows[i, 5] != rows[j, 5]) & ((rows[i, 6] < 0) | (rows[i, 6] != rows[j, 6])) & may_link(rows[i, 3], rows[i, 4], rows[j, 3], rows[j, 4])
        a, b = np.minimum(rows[i[ok], 2], rows[j[ok], 2]), np.maximum(rows[i[ok], 2], rows[j[ok], 2])
        if sample > 1:
            mixed = (a.astype(np.uint64) * np.uint64(_Powers.BASE) ^ b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            drawn = (mixed >> np.uint64(40)) % np.uint64(sample) == 0
            a, b = a[drawn], b[drawn]
        if len(a):
            yield np.unique(np.stack([a, b], axis=1), axis=0)

    def pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Of whole lists: in short ones every row with the one after it, the one two after it and so on, all
        lists at once; in long ones the rows outside the commonest component with all rows, block by block."""
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, int)
        lengths = np.diff(np.r_[starts, len(rows)])
        end = np.repeat(starts + lengths, lengths)
        i = np.flatnonzero(np.repeat(lengths, lengths) <= SHORT)
        for step in range(1, SHORT):
            i = i[i + step < end[i]]
            yield from chosen(rows, i, i + step)
        for start, length in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
            labels, counts = np.unique(rows[start : start + length, 5], return_counts=True)
            rest = start + np.flatnonzero(rows[start : start + length, 5] != labels[np.argmax(counts)])
            for at in range(0, len(rest), BLOCK):
                for to in range(start, start + length, BLOCK):
                    j = np.arange(to, min(to + BLOCK, start + length))
                    part = rest[at : at + BLOCK]
                    yield from chosen(rows, np.repeat(part, len(j)), np.tile(j, len(part)))

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 7), np.int64)
        found, many = [], 0
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)], axis=1)])
            ends = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if not len(ends):
                continue
            for x in pairs(held[: ends[-1]]):
                found.append(x)
                many += len(x)
                if many > CHUNK:
                    yield out(found)
                    found, many = [], 0
            held = held[ends[-1] :]
        yield out([*found, *pairs(held)])

    return run


def jaccard_groups(documents: DataFrame, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of the input.

    With ``count_links`` also n_links, the number of other documents that the
    row's document links with, those with an equal set among them; 0 for empty
    sets and null doc_ids. All links are then verified. Rows that repeat a
    doc_id have the largest number among them.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = documents.filter("doc_id IS NOT NULL")
    width = shuffle_width(spark)
    dealt = documents.select("text").mapInArrow(_deal(width), "part long, entries binary")
    counts = checkpointed(dealt.groupBy("part").applyInArrow(_frequent, "part long, key long, times long"))
    _release(spark)
    total = counts.filter("key < 0").agg(F.sum("times")).first()[0] or 0
    common = counts.filter("key >= 0").orderBy(F.desc("times"), "key", "part").limit(COMMON).select((F.col("key") * width + F.col("part")).alias("key"), "times").toArrow()
    ids, times = common.column("key").to_numpy(), common.column("times").to_numpy()
    order = np.argsort(ids)
    parts = max(width, math.ceil(total * (100 - PERCENT) / 100 / PER_LIST_TASK))
    packed = documents.mapInArrow(_list_prefixes(ids[order], times[order], width, parts), "part long, entries binary, doc long, n long, signature binary")
    found = checkpointed(packed.groupBy("part").applyInArrow(_lists, "shingle long, doc long, n int, at int, first long, star boolean, signature binary"))
    lists = found.filter("shingle IS NOT NULL").drop("signature")
    rows = found.filter("shingle IS NULL").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n"), "signature")
    del dealt, packed
    _release(spark)
    # Equal sets are one node, named by their smallest doc_id.
    classes = checkpointed(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("signature").agg(F.min("doc_id").alias("rep")))
    reps = checkpointed(rows.filter("n > 0 AND doc_id IS NOT NULL").join(classes, "signature").select("doc_id", "rep").distinct())
    labels = _group_labels(known, lists, reps, width)
    if count_links:
        found = _link_counts(known, rows, classes, labels, width)
        rows = rows.join(found.withColumnRenamed("doc_id", "_linked"), F.col("doc_id") == F.col("_linked"), "left")
        rows = rows.select("doc_id", "n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = rows.join(labels.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    counts = ["n_links"] if count_links else []
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"), *counts)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the links of two blocks, or within one: rows (label, class, block, other class, other block, side, signature, weight, text) come sorted by the first six."""

    def counted(sides: dict[int, dict[bytes, tuple[int, np.ndarray]]]) -> pa.RecordBatch:
        one, other = sides[0], sides.get(1)
        index = Inverted([x for _, x in (one if other is None else other).values()])
        keys = list(one if other is None else other)
        weights = [w for w, _ in (one if other is None else other).values()]
        total: dict[bytes, int] = {}
        for key, (weight, query) in one.items():
            for member, _ in index.search(query):
                if keys[member] != key:
                    total[key] = total.get(key, 0) + weights[member]
                    if other is not None:
                        total[keys[member]] = total.get(keys[member], 0) + weight
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["signature", "others"])

    task, sides = None, {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(9)]
        for *key, side, signature, weight, text in zip(*columns, strict=True):
            if key != task:
                if 0 in sides:
                    yield counted(sides)
                task, sides = key, {}
            shingles = shingle_set(text)
            # Rows that repeat a doc_id may hold another text than the one that is asked for.
            if xxhash.xxh3_128_digest(shingles.tobytes()) == signature:
                sides.setdefault(side, {})[signature] = (weight, shingles)
    if 0 in sides:
        yield counted(sides)


def _link_counts(known: DataFrame, rows: DataFrame, classes: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_links) of every document with a set."""
    sized = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "signature").distinct()
    weights = sized.groupBy("signature").agg(F.count("*").alias("weight"), F.max("n").alias("n"))
    sets = classes.join(weights, "signature").join(labels, F.col("rep") == F.col("doc_id")).drop("doc_id")
    # Sets that link differ in size by less than a quarter, so by one class at most.
    sets = checkpointed(sets.withColumn("class", F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")))
    several = sets.groupBy("label").agg(F.count("*").alias("sets")).filter("sets > 1").select("label")
    blocks = sets.join(several, "label").groupBy("label", "class").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    blocks = checkpointed(blocks)
    up = blocks.select("label", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    down = blocks.select("label", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    around = blocks.join(up, ["label", "class"], "left").join(down, ["label", "class"], "left").fillna(0, ["above", "below"])
    dealt = sets.join(around, ["label", "class"]).withColumn("block", F.pmod(F.xxhash64("signature"), F.col("blocks")).cast("int"))
    own, mine, c = F.col("block"), F.col("class"), lambda n: F.lit(n).cast("int")
    each = lambda n, use: F.when(F.col(n) > 0, F.transform(F.sequence(c(0), F.col(n) - 1), use)).otherwise(F.array().cast(PLACES))
    place = lambda one, a, two, b, side: F.struct(one.cast("int").alias("class_1"), a.alias("block_1"), two.cast("int").alias("class_2"), b.alias("block_2"), side.cast("int").alias("side"))
    within = each("blocks", lambda y: place(mine, F.least(own, y), mine, F.greatest(own, y), F.when(own <= y, 0).otherwise(1)))
    over = each("above", lambda y: place(mine, own, mine + 1, y, F.lit(0)))
    under = each("below", lambda y: place(mine - 1, y, mine, own, F.lit(1)))
    places = checkpointed(dealt.select("label", "signature", "weight", "rep", F.inline(F.concat(within, over, under))))
    wanted = _probably(known, "doc_id", places.select("rep")).join(places, F.col("doc_id") == F.col("rep"))
    key = ["label", "class_1", "block_1", "class_2", "block_2"]
    ordered = wanted.select(*key, "side", "signature", "weight", "text").repartition(width, *key).sortWithinPartitions(*key, "side")
    found = ordered.mapInArrow(_search_blocks, "signature binary, others long").groupBy("signature").agg(F.sum("others").alias("others"))
    by_set = weights.join(found, "signature", "left").select("signature", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return sized.join(by_set, "signature").groupBy("doc_id").agg(F.max("n_links").alias("n_links"))


PLACES = "array<struct<class_1:int,block_1:int,class_2:int,block_2:int,side:int>>"


def _group_labels(known: DataFrame, lists: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """The components of all links, from the links between components alone."""
    spark = known.sparkSession
    stars = lists.filter("star").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    links = _verified(known, stars).select("a", "b")
    _release(spark)
    labels = _labels(reps, links)
    open_lists = _open(lists, labels, width)
    some = checkpointed(open_lists.mapInArrow(_across(SAMPLE), "a long, b long").distinct())
    if 2 * some.count() > open_lists.select("doc").distinct().count():
        links = checkpointed(links.unionByName(_verified(known, some).select("a", "b")))
        labels = _labels(reps, links)
        open_lists = _open(lists, labels, width)
        _release(spark)
    rest = open_lists.mapInArrow(_across(1), "a long, b long").distinct()
    links = checkpointed(links.unionByName(_verified(known, rest).select("a", "b")))
    labels = _labels(reps, links)
    _release(spark)
    return labels


def _open(lists: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """The lists whose documents have more than one label, with the labels, each list, or each two blocks of a long one, together."""
    placed = checkpointed(lists.select("shingle", "doc", "n", "at").join(labels, F.col("doc") == F.col("doc_id")).select("shingle", "doc", "n", "at", "label"))
    mixed = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).filter("low < high")
    # Up to LIST_BLOCKS blocks, of LIST_BLOCK rows or, for the longest lists, more.
    blocks = F.least(F.ceil(F.col("many") / LIST_BLOCK), F.greatest(F.lit(LIST_BLOCKS), F.ceil(F.col("many") / (1 << 16)))).cast("int")
    rows = placed.join(mixed.select("shingle", blocks.alias("blocks")), "shingle").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = rows.withColumn("other", other)
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    side = F.when(low == high, -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    keyed = spread.select("shingle", (low * F.lit(1 << 31) + high).alias("pair"), "doc", "n", "at", "label", side.alias("side"))
    return checkpointed(keyed.repartition(width, "shingle", "pair").sortWithinPartitions("shingle", "pair"))


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of frames that were checkpointed and are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, label) of every document with a set; the label is the smallest doc_id of its component."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    edges = links.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # Rows that repeat a doc_id with different sets hold these together.
    same = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).filter("a < _most").join(reps.withColumnRenamed("rep", "b"), "doc_id").select("a", "b")
    parts = connected_components(edges.unionByName(same).filter("a <> b").distinct())
    return checkpointed(reps.join(parts, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("label")).distinct())
