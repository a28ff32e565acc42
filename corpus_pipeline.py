"""A training-data pipeline: five stages, each an operator of spanloom.llm, over all documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's docs. All but the last return
the columns of documents, further ones too, whatever their names.

Defined results: a null or empty text passes the first three stages unless its
score alone is toxic, and is never taken by the mix; rows without a doc_id
pass them as well and are mixed each by itself, as are rows that repeat a
doc_id; of those, near copies of a smaller doc_id go together. Of equal texts
the smallest doc_id stays. Empty documents give an empty result, empty labels
reject nothing, and very long texts are processed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from spanloom.llm.common import crc32_mod, delete, shared_dir, table

def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as one column, so that no other column's name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    labels = table(spark, sf_dir, "labels").filter(crc32_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("text", F.struct(*docs.columns).alias("_row")), toxicity.fit(docs, labels))
    return scored.filter("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that a document with a smaller doc_id holds; every document stays, be it with no text left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_rest")), keep=["_rest"])
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("_rest.n_chars")) if "n_chars" in rest else None
    return left.select(*(F.col("doc_id") if c == "doc_id" else text.alias("text") if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"_rest.`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays."""
    groups = ngram_join.jaccard_groups(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that agree in doc_id, source and size have the mix's copies in turn."""

    def numbered(rows: DataFrame, order: Column) -> DataFrame:
        alike = F.xxhash64("doc_id", "source", "size")
        return rows.withColumn("_key", alike).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order)))

    own = numbered(_packed(docs).select("doc_id", "_row.source", mixing.words_in("text").alias("size"), "_row"), F.xxhash64("_row.text")).select("_key", "_n", "_row")
    mixed = numbered(mixing.mix(docs), F.desc("copies")).select(F.col("_key").alias("_other"), F.col("_n").alias("_m"), "copies")
    # The difference of the numbers is no key of the join, so both sides stay as the windows dealt them.
    taken = own.join(mixed, (F.col("_key") == F.col("_other")) & (F.col("_n") - F.col("_m") == 0)).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids; they decode to the text."""
    import public_tokenizers

    coded = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every stage but the last is written to the shared folder and read again. Only the last of them stays there, as the result is read from it."""
    folder = f"{shared_dir(spark)}/pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                delete(spark, before)
            before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
