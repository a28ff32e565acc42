"""Shards of near equal bytes, words and rows by vector bin packing.

Equal texts form a group, and a group stays whole in one shard unless it holds
more of all bytes, words or rows than a shard may. Groups with more than one
part in ``shards * PARTS`` of them, of which there are at most 3 * shards *
PARTS, are packed singly; the others, each smaller than that, are gathered
whole in ``bundles`` by a hash of their text. A group too large for a shard is
dealt over as many pieces as it has such parts. So the driver holds at most
``bundles`` and 6 * shards * PARTS items, whatever the table holds.

Items go from the largest to the shard where the dot product of the item's
shares with the shard's residual capacity is highest, among shards that still
hold it in all three dimensions if any does.

Defined results: a null text is empty but for its own group, and has size 1;
rows that repeat a doc_id or have none get slots of their own; fewer rows than
shards leave shards empty; one text larger than a shard overfills it; an empty
table gives an empty table; other columns are ignored. Ties in size go by text
hash. The draw that deals a large group's rows over pieces takes their places in
the table, so that rows which agree in all columns are told apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed
from spanloom.llm.mixing import WORD

BUNDLES = 4096
PARTS = 64


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items has a row of non-negative amounts each."""
    total = items.sum(axis=0, dtype=float)
    share = items / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), dtype=np.int32)
    for k in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        fits = (residual >= share[k] - 1e-12).all(axis=1)
        fit = residual @ share[k]
        at = int(np.argmax(np.where(fits, fit, -np.inf) if fits.any() else fit))
        placed[k] = at
        residual[at] -= share[k]
    return placed


def shard(documents: DataFrame, shards: int, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots run from 0 in each shard without gaps."""
    spark = documents.sparkSession
    rows = checkpointed(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("group"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    amounts = (F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows"))
    total = rows.agg(*amounts).first()
    part = [max(1.0, (x or 0) / (shards * PARTS)) for x in total]
    over = F.greatest(*(F.col(c) / x for c, x in zip(("bytes", "words", "rows"), part, strict=True)))
    large = rows.groupBy("group").agg(*amounts).filter(over > 1).select("group", over.alias("parts"))
    # At most shards * PARTS groups can exceed a part in each of the three dimensions.
    known = [(r["group"], k + 1, int(np.ceil(r["parts"])), r["parts"] > PARTS) for k, r in enumerate(sorted(large.collect()))]
    split = {item for _, item, _, cut in known if cut}
    large = spark.createDataFrame([x[:3] for x in known], "group string, item int, pieces int")
    # The rows of a large group are numbered piece by piece even where it stays whole, as it may hold a shard's worth of them.
    spread = F.when(F.col("item").isNull(), F.pmod(F.xxhash64("group"), F.lit(bundles))).otherwise(F.pmod(F.xxhash64("doc_id", "place"), F.col("pieces")))
    dealt = rows.join(F.broadcast(large), "group", "left").select("doc_id", "size", "words", "text_crc32", "place", F.coalesce("item", F.lit(0)).alias("item"), spread.cast("int").alias("piece"))
    cells = sorted(dealt.groupBy("item", "piece").agg(*amounts).collect())
    units: dict[tuple[int, int], list[float]] = {}
    names = [(r["item"], r["piece"] if r["item"] == 0 or r["item"] in split else -1) for r in cells]
    for name, r in zip(names, cells, strict=True):
        held = units.setdefault(name, [0.0, 0.0, 0.0])
        for k, c in enumerate(("bytes", "words", "rows")):
            held[k] += r[c]
    placed = dict(zip(units, pack(np.array(list(units.values()), dtype=float).reshape(-1, 3), shards).tolist(), strict=True))
    start, plan = [0] * shards, []
    for name, r in zip(names, cells, strict=True):
        at = placed[name]
        plan.append((r["item"], r["piece"], at, start[at]))
        start[at] += r["rows"]
    plan = spark.createDataFrame(plan, "item int, piece int, shard int, start long")
    order = Window.partitionBy("item", "piece").orderBy("doc_id", "text_crc32", "place")
    return dealt.join(F.broadcast(plan), ["item", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(order) - 1).alias("slot"))
