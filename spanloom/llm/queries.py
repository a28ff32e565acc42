"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import ann, bm25, bpe, html_text, lang_id, line_dedup, mixing, ngram_join, sharding, toxicity
from spanloom.llm.common import crc32_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from four fifths of the labelled rows."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").filter(crc32_mod(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), stats AS (
  SELECT count(*)::DOUBLE AS n, sum(len(words))::DOUBLE / count(*) AS mean FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word
  FROM benchmark
), tf AS (
  SELECT doc_id, len(words) AS dl, word, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS word FROM docs) GROUP BY doc_id, dl, word
), df AS (
  SELECT word, count(*)::DOUBLE AS df FROM tf GROUP BY word
), shares AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asked JOIN tf USING (word) JOIN df USING (word) CROSS JOIN stats GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM shares
)
SELECT * FROM ranked WHERE rank <= 20
"""


def op3_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every twentieth document, its whole text the query."""
    documents = table(spark, sf_dir, "documents")
    return bm25.search(documents, documents.filter(F.col("doc_id") % 20 == 0), 20, "doc_id")


OP3_DOCUMENTS_SQL = OP3_SQL.replace("FROM benchmark", "FROM (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 20 = 0)")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of documents with similar shingles, and how many documents each links with."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), count_links=True)


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from two thirds of the rows."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(documents.filter(crc32_mod(F.col("doc_id"), 3) != 1))
    scored = lang_id.predict(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines before and after line deduplication."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.doc_id, n, line, owner IS NOT NULL AND owner <> keyed.doc_id AS dropped
  FROM keyed LEFT JOIN owners ON keyed.k = owners.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids and their round trip, as digests."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ann": op2_ann,
        "op3_bm25": op3_bm25,
        "op3_bm25_documents": op3_bm25_documents,
        "op4_sharding": op4_sharding,
        "op5_ngram_join": op5_ngram_join,
        "op6_lang_id": op6_lang_id,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_bpe": op9_bpe,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_bm25": OP3_SQL, "op3_bm25_documents": OP3_DOCUMENTS_SQL, "op8_line_dedup": OP8_SQL}
