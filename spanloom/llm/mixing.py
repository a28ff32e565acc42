"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: its weight's share of all words, but at
most ``most`` times its own size; what a source cannot take is shared among
the others by weight until no source is above its limit. A document is then
to be taken target / source size times: the whole part of that rate holds for
every document of the source, and the fraction is the probability of one more
copy. Pivotal rounding pairs documents with open fractions and moves words
between the two, in a random direction that leaves both expectations alone,
until one fraction is 0 or 1. The words that a source takes in expectation are
the same after every pair, so before the last step a source misses its target
by its one last open document alone.

Pairs are formed within blocks of about ``BLOCK`` documents of one source and
similar size; the one open document of each block goes to the next level of a
reduction tree, whose root goes from large documents to small ones. The last
open document of a source is rounded to the nearer end, and what this moves
away from the target is taken up by others: from large to small, one document
of each size class and side, drawn by a hash, has its fraction turned over
where that brings the source nearer. So only for these, some 150 of a source at
most, the chance of a copy is not exactly the fraction. A hot source merely has
more blocks. Only DataFrame functions are used.

Defined results: a null text has size 0 and, like an empty one, is never
taken; a null source is a source of its own, last in order; draws depend on
doc_id and size alone, so reruns agree on any cluster; rows that repeat a
doc_id are rounded each by itself; an empty table gives an empty table. Other
columns of the input do not matter: only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32


def words_in(text: str) -> Column:
    """A document's size."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): one row per source, from rows (source, size).

    Sources are few against documents, one row each, so the ordered windows
    over all of them are small. Sorted by limit / weight, the sources that
    reach their limit come first, so running sums find them without a loop.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        pick = F.when(place % len(weights) == k, F.lit(w)).otherwise(pick)
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        by_source.withColumn("weight", pick.cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("all_words", F.sum("source_size").over(every).cast("double"))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("limit") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    )
    rest_words = F.col("all_words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.try_divide(rest_words, rest_weight))
    return filled.withColumn("target", target).select("source", "source_size", "n", "target")


def _draw(*of: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _moves(a: Column, b: Column, level: int) -> Column:
    """The words that can move up to a or down from it, and a draw."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    return F.struct(up.alias("up"), down.alias("down"), _draw(a["doc_id"], b["doc_id"], a["size"], b["size"], F.lit(level)).alias("draw"))


def _ends(a: Column, b: Column, y: Column) -> Column:
    """The words that move to a, and whether that makes a's fraction, rather than b's, 0 or 1."""
    rise = y["draw"] * (y["up"] + y["down"]) < y["down"]
    return F.when(rise, F.struct(F.lit(True).alias("rise"), y["up"].alias("by"), ((1 - a["p"]) * a["size"] <= b["p"] * b["size"]).alias("a_ends"))).otherwise(
        F.struct(F.lit(False).alias("rise"), (-y["down"]).alias("by"), (a["p"] * a["size"] <= (1 - b["p"]) * b["size"]).alias("a_ends"))
    )


def _moved(done: Column, a: Column, b: Column, z: Column) -> Column:
    """The state after the move: the ended one, whose fraction is exactly 0 or 1, is done, and the other open."""
    to_one = z["rise"] == z["a_ends"]
    ended = F.when(z["a_ends"], a).otherwise(b)
    stays = F.when(z["a_ends"], b).otherwise(a)
    left = stays["p"] + F.when(z["a_ends"], -z["by"]).otherwise(z["by"]) / stays["size"]
    return F.struct(F.concat(done, F.array(_item(ended, F.when(to_one, 1.0).otherwise(0.0)))).alias("done"), _item(stays, left).alias("open"))


def _pivot(items: Column, level: int) -> Column:
    """Rounds an array of (doc_id, size, p) in order; every item comes back, all but at most one with p 0 or 1."""

    def step(state: Column, k: Column) -> Column:
        pair = F.struct(state["open"].alias("a"), items[k].alias("b"))
        return _let(pair, lambda x: _let(_moves(x["a"], x["b"], level), lambda y: _let(_ends(x["a"], x["b"], y), lambda z: _moved(state["done"], x["a"], x["b"], z))))

    first = F.struct(F.slice(items, 1, 0).alias("done"), items[0].alias("open"))
    return F.aggregate(F.when(F.size(items) > 1, F.sequence(F.lit(1), F.size(items) - 1)).otherwise(F.array().cast("array<int>")), first, step)


def _item(of: Column, p: Column) -> Column:
    return F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def _size_class() -> Column:
    """Quarters of octaves of the size."""
    return F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 4).cast("int")


def _round_blocks(live: DataFrame, keys: list[str], spot: Column, order: Column, level: int) -> DataFrame:
    """Rounds each block, which ``keys`` and ``spot`` make up, in the given order."""
    item = F.struct("doc_id", "size", "p")
    blocks = live.groupBy(*keys, spot.alias("spot")).agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), item.alias("item")))).alias("items"))
    states = blocks.select(*keys, _pivot(F.transform("items", lambda x: x["item"]), level).alias("state"))
    return checkpointed(states.select(*keys, F.inline(F.concat("state.done", F.array("state.open")))))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document."""
    sized = checkpointed(documents.select("doc_id", "source", words_in("text").alias("size")))
    targets = checkpointed(source_targets(sized, weights, most))
    classes = checkpointed(sized.groupBy("source", _size_class().alias("class")).agg(F.count("*").alias("m")))
    most_blocks = classes.agg(F.max("m")).first()[0] or 0
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    by_class = classes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("class").alias("_class"), "source_size", "target", "m")
    # A join with one row per source and size class; where it shuffles, Spark may split a hot source.
    rated = (
        sized.join(by_class, F.col("source").eqNullSafe(F.col("_source")) & (_size_class() == F.col("_class")))
        .withColumn("base", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0))
        .withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    )
    group = ["source", "source_size", "target", "base"]
    live = rated.select(*group, F.col("_class").alias("class"), "doc_id", "size", "p", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks"))
    settled = (F.col("p") <= 0) | (F.col("p") >= 1)
    parts = [live.filter(settled).select(*group, "doc_id", "size", "p")]
    live, level = live.filter(~settled), 0
    while True:
        most_blocks = -(-most_blocks // BLOCK)
        spot = F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.col("blocks"))
        live = _round_blocks(live, [*group, "class", "blocks"], spot, F.xxhash64("doc_id", "size", F.lit(-1 - level)), level)
        parts.append(live.filter(settled).select(*group, "doc_id", "size", "p"))
        live, level = live.filter(~settled).withColumn("blocks", F.ceil(F.col("blocks") / BLOCK).cast("long")), level + 1
        if most_blocks <= 1:
            break
    # The root: one open document of each size class, from large to small.
    root = _round_blocks(live, group, F.lit(0), -F.col("size"), level)
    parts.append(root.select(*group, "doc_id", "size", F.round("p").alias("p")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _settled(out, most).select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("int").alias("copies"))


def _settled(rounded: DataFrame, most: float) -> DataFrame:
    """The rows (source, target, base, doc_id, size, p) with the residue of each source taken up by turning fractions over."""
    may_turn = (F.col("size") > 0) & ((F.col("p") == 1) | (F.col("base") + 1 <= most))
    pick = F.struct(_draw(F.col("doc_id"), F.col("size"), F.lit(-1)).alias("draw"), "doc_id", "size")
    one = rounded.filter(may_turn).groupBy("source", _size_class().alias("class"), "p").agg(F.min(pick).alias("item"))
    # At most two documents of each size class of a source.
    lists = one.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("item.size").alias("size"), "p", F.col("item.doc_id").alias("doc_id"))), asc=False).alias("items"))
    taken = rounded.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * (F.col("base") + F.col("p"))).alias("taken"))
    joined = lists.withColumnRenamed("source", "_source").join(taken, F.col("_source").eqNullSafe(F.col("source"))).select("source", "items", (F.col("target") - F.col("taken")).alias("residue"))

    def step(state: Column, x: Column) -> Column:
        right_way = F.when(x["p"] == 0, state["residue"] > 0).otherwise(state["residue"] < 0)
        turned = F.struct((state["residue"] + F.when(x["p"] == 0, -x["size"]).otherwise(x["size"])).alias("residue"), F.concat(state["turned"], F.array(x)).alias("turned"))
        return F.when(right_way & (x["size"] <= 1.5 * F.abs(state["residue"])), turned).otherwise(state)

    start = F.struct(F.col("residue").cast("double").alias("residue"), F.slice("items", 1, 0).alias("turned"))
    turned = checkpointed(joined.select("source", F.explode(F.aggregate("items", start, step)["turned"]).alias("x")).select(F.col("source").alias("_source"), F.col("x.doc_id").alias("_doc"), F.col("x.size").alias("_size"), F.col("x.p").alias("_p")))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size")) & (F.col("p") == F.col("_p"))
    found = rounded.join(turned.withColumn("_turned", F.lit(1)), same, "left")
    # Of rows that agree in doc_id and size one is turned over.
    copy = F.row_number().over(Window.partitionBy("source", "doc_id", "size", "p").orderBy("base"))
    plain, hit = found.filter("_turned IS NULL"), found.filter("_turned IS NOT NULL").withColumn("_copy", copy)
    changed = hit.withColumn("p", F.when(F.col("_copy") == 1, 1 - F.col("p")).otherwise(F.col("p"))).drop("_copy")
    return plain.unionByName(changed)
