"""Alignments, exons and blacklisted regions derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import spread

# Reads of one order lie together, so ids are numbered order by order: the order's key times 1000, and the line's place in the order.
ALN = """
SELECT l_orderkey * 1000 + row_number() OVER w AS id, qname, source_id, chr, pos, rlen, mapq, flag, cigar,
       coalesce(lead(chr) OVER w, first_value(chr) OVER w) AS chr_next, coalesce(lead(pos) OVER w, first_value(pos) OVER w) AS pos_next
FROM (SELECT *, concat('q', cast(l_orderkey AS string)) AS qname, 1 + l_orderkey % 3 AS source_id,
             concat('chr', cast(1 + l_suppkey % 5 AS string)) AS chr,
             1 + l_partkey * 100 + l_linenumber * 7 AS pos, cast(60 + l_linenumber * 10 AS bigint) AS rlen,
             cast(l_quantity AS int) AS mapq,
             1 + CASE WHEN l_linestatus = 'F' THEN 2048 ELSE 2 END
               + CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1024 ELSE 0 END AS flag,
             CASE l_linenumber % 4 WHEN 0 THEN '70M30S' WHEN 1 THEN '30S70M' WHEN 2 THEN '100M' ELSE '20H80M' END AS cigar
      FROM lineitem) r
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
"""

EXON = """
SELECT p_partkey + 1 AS id, concat('G', cast(cast(floor(p_partkey/4) AS bigint) AS string)) AS gene_name,
       concat('chr', cast(1 + cast(floor(p_partkey/4) AS bigint) % 5 AS string)) AS chr,
       1 + p_partkey*100 AS start_pos, 1 + p_partkey*100 + p_size*4 AS end_pos,
       CASE WHEN cast(floor(p_partkey/4) AS bigint) % 2 = 0 THEN '+' ELSE '-' END AS strand,
       concat('E', cast(p_partkey AS string)) AS ense
FROM part
"""

BLACKLIST = """
SELECT s_suppkey + 1 AS id, s_name AS name, concat('chr', cast(1 + s_suppkey % 5 AS string)) AS chr,
       s_suppkey*2000 AS start_pos, s_suppkey*2000 + 300 AS end_pos
FROM supplier
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str, by: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {rows}"), rows=spread(rows, rows, by) if by else rows)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ALN, "lineitem", "l_orderkey")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EXON, "part").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BLACKLIST, "supplier").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
