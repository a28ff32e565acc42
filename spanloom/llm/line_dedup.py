"""Line deduplication against levelled sorted runs of line hashes.

The documents are taken in batches of rising doc_id. A run is a table of the
line keys that one or more batches were first to hold, with the smallest
doc_id of each, bucketed and sorted by key. A batch reduces its lines to one
row per key, merge-anti-joins every run, and writes the rest as a run of level
0; ``fanout`` runs of a level are compacted into one of the next. As batches
rise by doc_id, a key's row names the smallest doc_id that holds it.

Runs that a caller gives stay in their folder after a call. ``LineRuns.open``
finds them again, and a later call with these runs drops the lines that they
hold from all its documents, whatever their doc_ids, and adds its own. Only
while batches are added are the runs tables of the session's catalog; folders
of compacted runs are deleted, and so is all that a call without given runs
has written but for the keys that each document loses.

A key is the line without white space at its ends, A-Z in lower case; keys
under ``LEAST`` code points are never dropped. 128-bit hashes stand for keys.

Defined results: a null or empty text is one empty line; lines that repeat
within one document all stay if it is the smallest that holds them; rows that
repeat a doc_id count as one document; rows with a null doc_id neither drop
lines nor make others drop theirs; an empty table gives an empty table. Other
columns of the input are ignored. Texts are processed whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import SPACES, checkpointed, delete, shared_dir, shuffle_width

LEAST = 10
BATCHES = 4
FANOUT = 2
RUN = "key binary, owner long"
_STRIP = SPACES.encode()


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip(_STRIP).lower()
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode()) < LEAST:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(map(line_key, (text or "").encode().split(b"\n"))) - {None}
            ids += [doc_id] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts and the kept text to columns whose second and third are the text and the keys to drop."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts, drops = part.column(1), part.column(2)
            total, dropped, kept = [], [], []
            for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                total.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x in lines if line_key(x) not in drop]
                dropped.append(total[-1] - len(lines))
                kept.append(b"\n".join(lines).decode())
            added = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[3:], *added], names=["doc_id", "text", *part.schema.names[3:], "n_lines", "n_dropped", "kept"])


class LineRuns:
    """The levels of sorted runs (key, owner), each a folder ``level=L/run=N`` under one folder of the shared one."""

    def __init__(self, spark, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_width(spark)
        self.folder = folder or f"{shared_dir(spark)}/line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.known: set[str] = set()
        self.made = 0

    @classmethod
    def open(cls, spark, folder: str, fanout: int = FANOUT) -> LineRuns:
        """The runs that an earlier call left in its folder."""
        found = cls(spark, fanout, folder)
        for level, path in sorted((int(re.search(r"/level=(\d+)/", p)[1]), p) for p in found._folders()):
            name = f"line_run_{uuid.uuid4().hex}"
            while len(found.levels) <= level:
                found.levels.append([])
            found.levels[level].append(name)
            found.paths[name] = path
            found.made = max(found.made, int(path.rsplit("=", 1)[1]))
        return found

    def _folders(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/level=*/run=*")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().toString() for x in files.globStatus(at) or []]

    def _write(self, frame: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.made += 1
        name, path = f"line_run_{uuid.uuid4().hex}", f"{self.folder}/level={level}/run={self.made}"
        frame.repartition(self.buckets, "key").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.levels[level].append(name)
        self.paths[name] = path
        self.known.add(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _rows(self, name: str) -> DataFrame:
        """A run of this call by its bucketed table, so that a join need not sort it again; an older one by its files."""
        return self.spark.table(name) if name in self.known else self.spark.read.schema(RUN).parquet(self.paths[name])

    def add(self, pairs: DataFrame) -> None:
        """Adds the keys that no run holds, each with the smallest doc_id of the batch."""
        fresh = pairs.groupBy("key").agg(F.min("doc_id").alias("owner"))
        for name in self.runs():
            fresh = fresh.join(self._rows(name).select("key").hint("merge"), "key", "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Makes the runs of one level one run of the next; their folders go."""
        gone = self.levels[level]
        rows = self._rows(gone[0])
        for name in gone[1:]:
            rows = rows.unionByName(self._rows(name))
        self._write(rows, level + 1)
        self.levels[level] = []
        for name in gone:
            self._forget(name)
            delete(self.spark, self.paths.pop(name))

    def _forget(self, name: str) -> None:
        if name in self.known:
            self.spark.sql(f"DROP TABLE {name}")
            self.known.remove(name)

    def close(self) -> None:
        """Takes the runs out of the catalog; their files stay."""
        for name in self.runs():
            self._forget(name)

    def owners(self) -> DataFrame:
        """All runs as plain files, so that a join with them is free to shuffle and to split hot keys."""
        return self.spark.read.schema(RUN).parquet(*(self.paths[name] for name in self.runs()))


def dedup_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, keep: Sequence[str] = (), runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, text, the columns of ``keep``, n_lines, n_dropped, kept): each text without the lines that a smaller doc_id, or a run given, holds."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    given = runs is not None
    earlier = None if runs is None or not runs.runs() else checkpointed(runs.owners().select("key"))
    runs = LineRuns(spark, fanout) if runs is None else runs
    pairs_at = f"{runs.folder}/pairs_{uuid.uuid4().hex}"
    documents.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_keys, "doc_id long, key binary").write.parquet(pairs_at)
    pairs = spark.read.schema("doc_id long, key binary").parquet(pairs_at)
    cuts = pairs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = pairs if low is None else pairs.filter(F.col("doc_id") > low)
        runs.add(part if high is None else part.filter(F.col("doc_id") <= high))
    runs.close()
    owned = runs.owners()
    if earlier is not None:
        owned = owned.join(earlier, "key", "left_anti").unionByName(earlier.select("key", F.lit(None).cast("long").alias("owner")))
    drops = checkpointed(pairs.join(owned, "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("doc_id").agg(F.collect_set("key").alias("drops")))
    # With the drops written, nothing reads the pairs any more, nor runs that no caller knows of.
    delete(spark, pairs_at if given else runs.folder)
    joined = documents.join(drops.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "drops", *keep)
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_filter, schema)
