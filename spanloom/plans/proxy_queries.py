"""Every operator as a query over the proxy views, with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import containers as K
from spanloom.functions import reads as R
from spanloom.functions import statistics as S
from spanloom.operators import clusters as C
from spanloom.operators import events as E
from spanloom.operators import fragments as P
from spanloom.operators import intervals as I
from spanloom.operators import vcf as V
from spanloom.plans import proxies as X
from spanloom.session import many_tasks, shared_folder, spread, stored
from spanloom.sources import bam as B
from spanloom.sources import text_formats as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = f"WITH {PROXIES}{sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Parts of the SQL side.
PROXIES = f"""aln AS ({X.ALN}), exon AS ({X.EXON}), bl AS ({X.BLACKLIST}),
judged AS (
  SELECT *, (flag & 1) <> 0 AND (flag & 4) = 0 AND (flag & 8) = 0 AND (flag & 1024) = 0 AND mapq >= 8 AS ok,
         (CASE WHEN chr <> chr_next THEN 2 WHEN abs(pos - pos_next) > 10000 THEN 1 ELSE 0 END) + (CASE WHEN (flag & 2048) <> 0 THEN 4 ELSE 0 END) AS t,
         CASE WHEN rlen <= 0 THEN pos ELSE pos + rlen - 1 END AS high
  FROM aln
), kept AS (
  SELECT j.* FROM judged j JOIN (SELECT qname, source_id FROM judged GROUP BY qname, source_id HAVING bool_and(ok) AND bit_or(t) <> 0) g
    ON j.qname = g.qname AND j.source_id = g.source_id
), hits AS (
  SELECT e.id AS exon_id, k.id AS alignment_id, greatest(k.pos, e.start_pos) AS pos, least(k.high, e.end_pos) - greatest(k.pos, e.start_pos) + 1 AS len, e.gene_name
  FROM kept k JOIN exon e ON k.chr = e.chr AND k.pos <= e.end_pos AND k.high >= e.start_pos
), typed AS (
  SELECT k.*, k.t + CASE WHEN k.id IN (SELECT alignment_id FROM hits) THEN 8 ELSE 0 END AS type FROM kept k
), gene AS (
  SELECT gene_name, arg_min(chr, id) AS gene_chr, min(start_pos) AS gene_start, max(end_pos) AS gene_end, arg_min(strand, id) AS strand FROM exon GROUP BY gene_name
), ranked_gene AS (
  SELECT *, dense_rank() OVER (PARTITION BY gene_chr ORDER BY gene_start, gene_end) AS rank FROM gene
), strip AS (
  SELECT *, dense_rank() OVER (ORDER BY chr, cast(floor(pos / 20000) AS bigint)) AS cluster_id,
         concat('G', cast(50 * cast(floor(pos / 20000) AS bigint) + source_id - 1 AS string)) AS gene_name
  FROM aln
), win AS (
  SELECT cluster_id AS id, source_id AS sid, min(chr) AS chr, min(pos) AS start_pos, max(pos + rlen - 1) AS end_pos, min(gene_name) AS gene_name
  FROM strip GROUP BY cluster_id, source_id
), event AS (
  SELECT w.id AS id, min(chr) AS chr, min(start_pos) AS window_start, max(end_pos) AS window_end, min(start_pos) + 500 AS insertion_point,
         min(gene_name) AS gene_name
  FROM win w GROUP BY w.id
)
"""


# The same parts for Spark.
#: The parts of the query that is being built which are written already, where it uses them often enough to write them first.
_written: ContextVar[dict[str, Callable[[], DataFrame]] | None] = ContextVar("written", default=None)


def _part(make: Query) -> Query:
    """A part of queries; in those that write first, it is written to the shared folder at its first use and read from there at each."""

    @functools.wraps(make)
    def part(spark, d):
        held = _written.get()
        if held is None:
            return make(spark, d)
        if make.__name__ not in held:
            held[make.__name__] = stored(make(spark, d))
        return held[make.__name__]()

    return part


def _write_first(run: Query) -> Query:
    """The query over parts that are written to the shared folder once, rather than derived at each use."""

    @functools.wraps(run)
    def query(spark, d):
        token = _written.set({})
        try:
            return run(spark, d)
        finally:
            _written.reset(token)

    return query


@_part
def _alignments(spark: SparkSession, d: str) -> DataFrame:
    return X.alignments(spark, d)


@_part
def _kept(spark: SparkSession, d: str) -> DataFrame:
    return P.fragment_filter(_alignments(spark, d))


@_part
def _hits(spark: SparkSession, d: str) -> DataFrame:
    return P.exon_overlaps(_kept(spark, d), X.exons(spark, d))


@_part
def _marked(spark: SparkSession, d: str) -> DataFrame:
    return P.mark_exonic(_kept(spark, d), _hits(spark, d))


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _marked(spark, d), _hits(spark, d), X.exons(spark, d)


@_part
def _strip_ids(spark: SparkSession, d: str) -> DataFrame:
    """The strips' numbers; where they are written first, their size is known, so reads need no shuffle to be joined with them."""
    strips = _alignments(spark, d).select("chr", F.floor(F.col("pos") / 20000).alias("strip")).distinct()
    return strips.withColumn("cluster_id", F.row_number().over(Window.orderBy("chr", "strip")).cast("long"))


def _strip(spark: SparkSession, d: str) -> DataFrame:
    """A clustering: strips of 20,000 positions, with the source as sub-number."""
    joined = _alignments(spark, d).withColumn("strip", F.floor(F.col("pos") / 20000)).join(_strip_ids(spark, d), ["chr", "strip"])
    return joined.select(
        "cluster_id",
        F.col("source_id").alias("cluster_sid"),
        F.col("id").alias("alignment_id"),
        F.lit(3).alias("label"),
        F.lit(10).alias("neighbors"),
        F.concat(F.lit("G"), (50 * F.col("strip") + F.col("source_id") - 1).cast("string")).alias("gene_name"),
    )


@_part
def _windows(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_windows(_strip(spark, d), _alignments(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).groupBy("id").agg(
        F.min("chr").alias("chr"), F.min("start").alias("window_start"), F.max("end").alias("window_end"), (F.min("start") + 500).alias("insertion_point"), F.min("gene_name").alias("gene_name")
    )


def _merging(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select(F.col("id").alias("retrocopy_id"), F.col("id").alias("cluster_id"), F.col("sid").alias("cluster_sid"))


# -- reads --


@query("SELECT id, ok FROM judged")
def read_acceptance(spark, d):
    return _alignments(spark, d).select("id", R.accepted(8).alias("ok"))


@query("SELECT id, t AS type FROM judged")
def read_type_bits(spark, d):
    return _alignments(spark, d).select("id", R.type_bits(10000).cast("int").alias("type"))


@query("SELECT id, qname, source_id, t AS type FROM kept")
def fragment_filter(spark, d):
    return _kept(spark, d).select("id", "qname", "source_id", "type")


@query("""SELECT doc_id, coalesce(length(s) > 0 AND cast(cast(greatest(length(s) - length(replace(s, 'A', '')), length(s) - length(replace(s, 'C', '')),
  length(s) - length(replace(s, 'G', '')), length(s) - length(replace(s, 'T', ''))) AS DOUBLE) / length(s) AS FLOAT) > cast(0.4 AS FLOAT), false) AS over
FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)""")
def base_overfrequency(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    return rows.select("doc_id", R.over_frequent_base("s", 0.4).alias("over"))


@query(r"""SELECT id, list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MDN=X]', 1), lambda x: cast(x AS BIGINT)))::BIGINT AS reference_length,
  list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MIS=X]', 1), lambda x: cast(x AS BIGINT)))::BIGINT AS query_length FROM aln""")
def cigar_lengths(spark, d):
    return _alignments(spark, d).select("id", R.reference_length().alias("reference_length"), R.query_length().alias("query_length"))


NAMES = """SELECT s_suppkey, concat(CASE s_suppkey % 3 WHEN 0 THEN 'chr' WHEN 1 THEN 'CHR' ELSE '' END, CASE cast(floor(s_suppkey / 3) AS bigint) % 28 WHEN 23 THEN 'x' WHEN 24 THEN 'Y'
  WHEN 25 THEN 'MT' WHEN 26 THEN 'm' WHEN 27 THEN 'Un_contig' ELSE cast(cast(floor(s_suppkey / 3) AS bigint) % 28 AS string) END) AS raw FROM supplier"""


@query(rf""", n AS ({NAMES}) SELECT s_suppkey, raw, CASE
  WHEN regexp_full_match(lower(raw), '(chr)?([1-9]|1[0-9]|2[0-2])') THEN concat('chr', regexp_extract(raw, '[0-9]+'))
  WHEN lower(raw) IN ('x', 'chrx') THEN 'chrX' WHEN lower(raw) IN ('y', 'chry') THEN 'chrY'
  WHEN lower(raw) IN ('m', 'mt', 'chrm', 'chrmt') THEN 'chrM' ELSE raw END AS name FROM n""")
def chr_standardise(spark, d):
    return X._view(spark, d, NAMES, "supplier").select("s_suppkey", "raw", R.standard_chromosome("raw").alias("name"))


@query("""SELECT cigar, CASE WHEN cigar ILIKE '%M%S' OR cigar ILIKE '%M%H' THEN 'right' WHEN cigar ILIKE '%S%M' OR cigar ILIKE '%H%M' THEN 'left' END AS side, count(*) AS n
FROM aln GROUP BY ALL""")
def clip_shape(spark, d):
    return _alignments(spark, d).groupBy("cigar", R.clip_side().alias("side")).agg(F.count("*").alias("n"))


@query("SELECT id, type FROM typed")
def exonic_bit(spark, d):
    return _typed(spark, d)[0].select("id", "type")


@query("SELECT id AS read_id, chr, pos, 7 + 3 * (row_number() OVER (ORDER BY chr, pos, id) - 1) AS id FROM aln")
def alignment_ids(spark, d):
    rows = _alignments(spark, d).withColumnRenamed("id", "read_id")
    return P.strided_ids(rows, 7, 3, ["chr", "pos", "read_id"]).select("read_id", "chr", "pos", "id")


@query("""SELECT source_id, count(*) AS abnormal, count(*) FILTER (WHERE (type & 8) <> 0) AS exonic FROM typed GROUP BY source_id""")
def abnormal_counters(spark, d):
    kind = R.flagged("type", 8)
    return _typed(spark, d)[0].groupBy("source_id").agg(F.count("*").alias("abnormal"), F.count_if(kind).alias("exonic"))


# -- intervals --


@query("SELECT exon_id, alignment_id, pos, len FROM hits")
def flagship_overlaps(spark, d):
    return P.exon_overlaps(_kept(spark, d), X.exons(spark, d))


ALL_PAIRS = """, pair AS (
  SELECT e.id AS exon_id, j.id AS alignment_id, greatest(j.pos, e.start_pos) AS pos, least(j.high, e.end_pos) - greatest(j.pos, e.start_pos) + 1 AS len,
         floor(cast(j.high - j.pos AS FLOAT) * cast(0.5 AS FLOAT)) AS need_read, floor(cast(e.end_pos - e.start_pos AS FLOAT) * cast({exon} AS FLOAT)) AS need_exon
  FROM judged j JOIN exon e ON j.chr = e.chr AND j.pos <= e.end_pos AND j.high >= e.start_pos
)
"""


@query(ALL_PAIRS.format(exon="0.9") + "SELECT exon_id, alignment_id, pos, len FROM pair")
def overlap_join(spark, d):
    return P.exon_overlaps(_alignments(spark, d), X.exons(spark, d))


@query(ALL_PAIRS.format(exon="0.9") + "SELECT exon_id, alignment_id, pos, len FROM pair WHERE len - 1 >= need_read AND len - 1 >= need_exon")
def overlap_join_fraction_both(spark, d):
    return P.exon_overlaps(_alignments(spark, d), X.exons(spark, d), 0.9, 0.5)


@query(ALL_PAIRS.format(exon="0.9") + "SELECT exon_id, alignment_id, pos, len FROM pair WHERE len - 1 >= need_read OR len - 1 >= need_exon")
def overlap_join_fraction_either(spark, d):
    return P.exon_overlaps(_alignments(spark, d), X.exons(spark, d), 0.9, 0.5, either=True)


@query(ALL_PAIRS.format(exon="0.5") + "SELECT exon_id, alignment_id, pos, len FROM pair WHERE len - 1 >= need_read AND len - 1 >= need_exon")
def overlap_join_reciprocal(spark, d):
    return P.exon_overlaps(_alignments(spark, d), X.exons(spark, d), 0.5, 0.5)


@query("""SELECT b.id AS blacklist_id, w.id AS cluster_id, w.sid AS cluster_sid, greatest(w.start_pos, b.start_pos) AS pos,
  least(w.end_pos, b.end_pos) - greatest(w.start_pos, b.start_pos) + 1 AS len
FROM win w JOIN bl b ON w.chr = b.chr AND w.start_pos <= b.end_pos AND w.end_pos >= b.start_pos""")
def blacklist_overlap(spark, d):
    return C.blacklist_hits(_windows(spark, d), X.blacklist(spark, d))


@query("""SELECT id FROM judged j WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE b.chr = j.chr AND greatest(j.pos - 100, 0) <= b.end_pos AND j.high + 100 >= b.start_pos)""")
def blacklist_anti_padded(spark, d):
    reads = _alignments(spark, d).select("id", "chr", "pos", R.end_position().alias("high"))
    return I.overlap_anti_join(reads, X.blacklist(spark, d), ("chr", "pos", "high"), ("chr", "start", "end"), ["id"], padding=100).select("id")


@query("SELECT b.id AS point_id, e.id AS exon_id FROM (SELECT id, chr, start_pos + 150 AS at FROM bl) b JOIN exon e ON b.chr = e.chr AND b.at BETWEEN e.start_pos AND e.end_pos")
def point_in_interval(spark, d):
    points = X.blacklist(spark, d).select(F.col("id").alias("point_id"), F.col("chr").alias("c1"), (F.col("start") + 150).alias("at"))
    ranges = X.exons(spark, d).select(F.col("id").alias("exon_id"), F.col("chr").alias("c2"), "start", "end")
    return I.point_join(points, ranges, ("c1", "at"), ("c2", "start", "end")).select("point_id", "exon_id")


HOSTS = """SELECT r.id AS rid,
  (SELECT string_agg(DISTINCT gene_name, '/' ORDER BY gene_name) FROM gene g WHERE g.gene_chr = r.chr AND r.insertion_point BETWEEN gene_start AND gene_end) AS intragenic,
  (SELECT string_agg(DISTINCT gene_name, '/' ORDER BY gene_name) FROM exon e WHERE e.chr = r.chr AND r.insertion_point BETWEEN start_pos AND end_pos) AS exonic,
  (SELECT string_agg(DISTINCT gene_name, '/' ORDER BY gene_name) FROM gene g WHERE g.gene_chr = r.chr AND ({near})) AS near
FROM event r"""


@query(HOSTS.format(near="r.insertion_point BETWEEN gene_end + 1 AND gene_end + 5000"))
@_write_first
def near_gene_compat(spark, d):
    return E.hosts(_events(spark, d), X.exons(spark, d), 5000)


@query(HOSTS.format(near="r.insertion_point BETWEEN gene_end + 1 AND gene_end + 5000 OR r.insertion_point BETWEEN gene_start - 5000 AND gene_start - 1"))
@_write_first
def near_gene_symmetric(spark, d):
    return E.hosts(_events(spark, d), X.exons(spark, d), 5000, symmetric=True)


# -- relational --

MATES = """, named AS (
  SELECT y.*, h.gene_name FROM typed y LEFT JOIN (SELECT alignment_id, gene_name FROM hits) h ON y.id = h.alignment_id WHERE y.type <> 0
), point AS (
  SELECT DISTINCT a.id, a.chr, a.pos AS low, a.high, m.gene_name
  FROM named a JOIN named m ON a.qname = m.qname AND a.source_id = m.source_id AND a.id <> m.id
  WHERE (m.type & 8) <> 0 AND ((a.type & 8) = 0 OR a.gene_name IS DISTINCT FROM m.gene_name)
)
"""


@query(MATES + "SELECT * FROM point")
@_write_first
def mate_self_join(spark, d):
    return C.mate_points(*_typed(spark, d))


@query("""SELECT s.cluster_id, s.source_id AS cluster_sid, id AS alignment_id FROM strip s
JOIN (SELECT cluster_id, source_id FROM strip GROUP BY cluster_id, source_id HAVING count(*) >= 40) k ON s.cluster_id = k.cluster_id AND s.source_id = k.source_id""")
def support_having(spark, d):
    return C.supported(_strip(spark, d), _alignments(spark, d), 40).select("cluster_id", "cluster_sid", "alignment_id")


COARSE = """, coarse AS (SELECT id, qname, source_id, chr, cast(floor(pos / 3000) AS bigint) AS pos, chr_next, cast(floor(pos_next / 3000) AS bigint) AS pos_next, mapq AS type FROM aln),
runs AS (
  SELECT DISTINCT qname, source_id, chr, pos, chr_next, pos_next, min(qname) OVER w AS first_name, max(qname) OVER w AS last_name
  FROM coarse WINDOW w AS (PARTITION BY source_id, chr, pos, chr_next, pos_next)
), dup AS (
  SELECT qname, source_id FROM (
    SELECT qname, source_id, first_name, row_number() OVER (PARTITION BY qname, source_id ORDER BY chr, pos, chr_next, pos_next) AS n FROM runs WHERE first_name <> last_name
  ) WHERE n = 1 AND qname <> first_name
)
"""


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return _alignments(spark, d).select("id", "qname", "source_id", "chr", F.floor(F.col("pos") / 3000).alias("pos"), "chr_next", F.floor(F.col("pos_next") / 3000).alias("pos_next"), F.col("mapq").alias("type"))


@query(COARSE + "SELECT qname, source_id FROM dup")
def dedup_fragments(spark, d):
    return P.duplicate_fragments(_coarse(spark, d))


@query(COARSE + "SELECT id, CASE WHEN d.qname IS NOT NULL THEN 0 ELSE type END AS type FROM coarse c LEFT JOIN dup d ON c.qname = d.qname AND c.source_id = d.source_id")
def in_subquery_update(spark, d):
    return P.drop_duplicates(_coarse(spark, d)).select("id", "type")


def _store(reads: DataFrame, exons: DataFrame, k: int) -> dict[str, DataFrame]:
    spark = reads.sparkSession
    tables = {
        "batch": spark.createDataFrame([(1, "then")], "id int, timestamp string"),
        "source": reads.select(F.col("source_id").cast("int").alias("id"), F.lit(1).alias("batch_id"), F.lit("path").alias("path")).distinct(),
        "exon": exons,
        "alignment": reads,
        "overlapping": P.exon_overlaps(reads, exons),
    }
    return {name: rows.withColumn("_store", F.lit(k)) for name, rows in tables.items()}


@query("""SELECT e.ense, j.id + CASE WHEN s.store = 2 THEN (SELECT max(id) FROM aln WHERE source_id = 1) ELSE 0 END AS alignment_id,
  greatest(j.pos, e.start_pos) AS pos, least(j.high, e.end_pos) - greatest(j.pos, e.start_pos) + 1 AS len
FROM judged j JOIN (SELECT 1 AS store UNION ALL SELECT 2) s ON s.store = CASE WHEN j.source_id = 1 THEN 1 ELSE 2 END
JOIN exon e ON j.chr = e.chr AND j.pos <= e.end_pos AND j.high >= e.start_pos AND e.id % 3 <> CASE WHEN s.store = 1 THEN 0 ELSE 1 END""")
def union_remap(spark, d):
    reads, exons = _alignments(spark, d), X.exons(spark, d)
    one = _store(reads.filter("source_id = 1"), exons.filter("id % 3 <> 0"), 0)
    two = _store(reads.filter("source_id <> 1"), exons.filter("id % 3 <> 1"), 1)
    both = P.union_stores({name: one[name].unionByName(two[name]) for name in one})
    return both["overlapping"].join(both["exon"].select(F.col("id").alias("exon_id"), "ense"), "exon_id").select("ense", "alignment_id", "pos", "len")


@query("SELECT * FROM gene")
def gene_extent(spark, d):
    return C.gene_extents(X.exons(spark, d))


@query("SELECT gene_name, gene_chr, gene_start, gene_end, rank::INTEGER AS rank FROM ranked_gene")
def gene_dense_rank(spark, d):
    return E.gene_ranks(C.gene_extents(X.exons(spark, d))).select("gene_name", "gene_chr", "gene_start", "gene_end", "rank")


DEPTH = """, clipped AS (
  SELECT *, CASE WHEN cigar ILIKE '%M%S' OR cigar ILIKE '%M%H' THEN pos + rlen WHEN cigar ILIKE '%S%M' OR cigar ILIKE '%H%M' THEN pos END AS clip FROM strip
), common AS (
  SELECT cluster_id AS id, arg_min(clip, (-n, clip IS NULL, clip)) AS clip FROM (SELECT cluster_id, clip, count(*) AS n FROM clipped WHERE (flag & 2048) <> 0 GROUP BY ALL) GROUP BY cluster_id
)
"""


@query("SELECT cluster_id AS rid, count(DISTINCT id) AS depth FROM strip GROUP BY cluster_id")
@_write_first
def distinct_depth(spark, d):
    return E.depths(_events(spark, d), _merging(spark, d), _strip(spark, d), _alignments(spark, d)).select("rid", "depth")


def _clipped_events(spark: SparkSession, d: str) -> DataFrame:
    """Events whose point is the smallest clip position of their split reads."""
    spots = _alignments(spark, d).filter(R.flagged("flag", 2048)).select(F.col("id").alias("alignment_id"), R.clip_position().alias("clip"))
    return _strip(spark, d).join(spots, "alignment_id").groupBy(F.col("cluster_id").alias("id")).agg(F.min("clip").alias("insertion_point"))


@query(DEPTH + """SELECT c.cluster_id AS rid, count(DISTINCT c.id) FILTER (WHERE (c.flag & 2048) <> 0 AND c.clip = p.at) AS split_reads
FROM clipped c JOIN (SELECT cluster_id, min(clip) AS at FROM clipped WHERE (flag & 2048) <> 0 GROUP BY cluster_id) p ON c.cluster_id = p.cluster_id GROUP BY c.cluster_id""")
@_write_first
def split_read_depth(spark, d):
    return E.depths(_clipped_events(spark, d), _merging(spark, d), _strip(spark, d), _alignments(spark, d)).select("rid", "split_reads")


@query("SELECT id, string_agg(DISTINCT gene_name, '/' ORDER BY gene_name) AS genes FROM win GROUP BY id")
def concat_distinct_genes(spark, d):
    return _windows(spark, d).groupBy("id").agg(K.joined_names(F.col("gene_name")).alias("genes"))


# -- runs --


@query("""SELECT id, sum(new) OVER (PARTITION BY chr ORDER BY pos, high, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
  SELECT *, CASE WHEN reach IS NULL OR pos > reach THEN 1 ELSE 0 END AS new FROM (
    SELECT id, chr, pos, high, max(high) OVER (PARTITION BY chr ORDER BY pos, high, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM judged))""")
def window_islands(spark, d):
    rows = _alignments(spark, d).select("id", "chr", "pos", R.end_position().alias("high"))
    return E.islands(rows, ["chr"], "pos", "high", ["id"]).select("id", "island")


@query(""", placed AS (
  SELECT w.*, g.gene_chr, g.gene_start, g.gene_end, g.rank, sum(new) OVER (PARTITION BY w.chr ORDER BY w.start_pos, w.end_pos, w.id, w.sid ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN start_pos > coalesce(max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, id, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new
        FROM win WHERE gene_name IN (SELECT gene_name FROM gene)) w JOIN ranked_gene g ON w.gene_name = g.gene_name
), looked AS (
  SELECT *, coalesce(gene_start <= max(gene_end) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS crossed,
         coalesce(abs(rank - lag(rank) OVER o) <= 3, false) AS near, lag(gene_name) OVER o AS last_gene
  FROM placed WINDOW o AS (PARTITION BY chr, island, gene_chr ORDER BY gene_start, gene_end, gene_name, id, sid)
), numbered AS (
  SELECT *, CASE WHEN crossed OR near THEN 0 ELSE 1 END AS fresh, CASE WHEN crossed THEN CASE WHEN gene_name <> last_gene THEN 2 ELSE 0 END WHEN near THEN 4 ELSE 0 END AS bits,
         sum(CASE WHEN crossed OR near THEN 0 ELSE 1 END) OVER (PARTITION BY chr, island, gene_chr ORDER BY gene_start, gene_end, gene_name, id, sid ROWS UNBOUNDED PRECEDING) AS run
  FROM looked
), levelled AS (
  SELECT id, sid, bit_or(bits) OVER (PARTITION BY chr, island, gene_chr, run) | CASE WHEN sum(fresh) OVER (PARTITION BY chr, island) > 1 THEN 8 ELSE 0 END AS level FROM numbered
) SELECT id, sid, CASE WHEN level = 0 THEN 1 ELSE level END AS level FROM levelled""")
@_write_first
def island_parent_split_levels(spark, d):
    genes = E.gene_ranks(C.gene_extents(X.exons(spark, d)))
    joined = _windows(spark, d).join(genes, "gene_name")
    return E.parental_runs(E.islands(joined, ["chr"], "start", "end", ["id", "sid"])).select("id", "sid", "level")


# -- clustering --


def _dbscan_sql(points: str, name: str, eps: int, min_pts: int) -> str:
    """CTEs up to ``name`` (g, local, id, label, neighbors) of density clusters of (g, id, low, high).

    A point that no earlier core point reaches through core points leads a
    cluster; the cluster lists the neighbours of all core points it owns.
    """
    return f""", {name}_p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY low, high, id) AS n, greatest((low + high) // 2 - {eps}, 1) AS fro, (low + high) // 2 + {eps} AS til FROM {points}
), {name}_near AS MATERIALIZED (
  SELECT a.g, a.n AS a, b.n AS b, count(*) OVER (PARTITION BY a.g, a.n) AS many FROM {name}_p a JOIN {name}_p b ON a.g = b.g AND b.low <= a.til AND b.high >= a.fro
), {name}_many AS (
  SELECT DISTINCT g, a AS n, many FROM {name}_near
), {name}_step AS MATERIALIZED (
  SELECT s.g, s.a, s.b FROM {name}_near s JOIN {name}_many c ON c.g = s.g AND c.n = s.b WHERE s.many >= {min_pts} AND c.many >= {min_pts}
), {name}_reach AS (
  SELECT DISTINCT g, a AS lead, a AS n FROM {name}_step UNION SELECT r.g, r.lead, s.b FROM {name}_reach r JOIN {name}_step s ON s.g = r.g AND s.a = r.n
), {name}_own AS (
  SELECT g, n, min(lead) AS lead FROM {name}_reach GROUP BY g, n
), {name} AS (
  SELECT DISTINCT o.g, dense_rank() OVER (PARTITION BY o.g ORDER BY o.lead) AS local, p.id, CASE WHEN c.many >= {min_pts} THEN 3 ELSE 2 END AS label, c.many AS neighbors
  FROM {name}_own o JOIN {name}_near s ON s.g = o.g AND s.a = o.n JOIN {name}_p p ON p.g = o.g AND p.n = s.b JOIN {name}_many c ON c.g = o.g AND c.n = s.b
)
"""


FOUND = MATES + ", grouped AS (SELECT *, {'chr': chr, 'gene_name': gene_name} AS g FROM point)" + _dbscan_sql("grouped", "scan", 3000, 4) + """, found AS (
  SELECT dense_rank() OVER (ORDER BY g.chr, g.gene_name, local) AS cluster_id, 1 AS cluster_sid, id AS alignment_id, label, neighbors, g.chr AS chr, g.gene_name AS gene_name FROM scan
)
"""


def _recursive(name: str) -> None:
    _sql[name] = _sql[name].replace("WITH ", "WITH RECURSIVE ", 1)


def _found(spark: SparkSession, d: str) -> DataFrame:
    local = C.cluster_points(C.mate_points(*_typed(spark, d)), ["chr", "gene_name"], 3000, 4)
    return C.number_clusters(local, ["chr", "gene_name"])


@query(FOUND + "SELECT cluster_id, cluster_sid, alignment_id, label, neighbors, chr, gene_name FROM found")
@_write_first
def interval_dbscan(spark, d):
    return _found(spark, d)


@query(FOUND + """, backed AS (
  SELECT {'id': f.cluster_id, 'sid': f.cluster_sid} AS g, f.alignment_id AS id, y.pos AS low, y.high FROM (
    SELECT f.*, count(*) OVER (PARTITION BY f.cluster_id, y.source_id) AS n FROM found f JOIN typed y ON y.id = f.alignment_id) f JOIN typed y ON y.id = f.alignment_id WHERE n >= 2
)""" + _dbscan_sql("backed", "again", 3000, 3) + """SELECT cluster_id, cluster_sid, alignment_id, label, neighbors, gene_name FROM found
UNION ALL SELECT a.g.id, 1 + a.local, a.id, a.label, a.neighbors, (SELECT min(gene_name) FROM found f WHERE f.cluster_id = a.g.id) FROM again a""")
@_write_first
def recluster_supported(spark, d):
    return C.recluster(_found(spark, d), _typed(spark, d)[0], 2, 3000, 3)


_recursive("interval_dbscan")
_recursive("recluster_supported")


@query(MATES + """SELECT a.chr, a.gene_name, a.id, count(*) AS neighbors FROM point a JOIN point b ON a.chr = b.chr AND a.gene_name = b.gene_name
  AND b.low <= cast(floor((a.low + a.high) / 2) AS bigint) + 3000 AND b.high >= greatest(cast(floor((a.low + a.high) / 2) AS bigint) - 3000, 1)
GROUP BY a.chr, a.gene_name, a.id HAVING count(*) >= 4""")
@_write_first
def dbscan_core_points(spark, d):
    return C.core_points(C.mate_points(*_typed(spark, d)), ["chr", "gene_name"], 3000, 4)


@query("SELECT id, sid, chr, start_pos AS start, end_pos AS \"end\", gene_name FROM win")
def cluster_windows(spark, d):
    return _windows(spark, d).select("id", "sid", "chr", "start", "end", "gene_name")


@query("""SELECT w.id, w.sid, 1 + CASE WHEN w.chr NOT IN ('chr2') AND g.gene_chr NOT IN ('chr2') THEN 2 ELSE 0 END
  + CASE WHEN w.chr <> g.gene_chr OR NOT (w.start_pos <= g.gene_end + 1000 AND w.end_pos >= g.gene_start - 1000) THEN 4 ELSE 0 END
  + CASE WHEN NOT EXISTS (SELECT 1 FROM bl b WHERE b.chr = w.chr AND w.start_pos <= b.end_pos AND w.end_pos >= b.start_pos) THEN 8 ELSE 0 END + 16 AS filter
FROM win w JOIN gene g ON w.gene_name = g.gene_name""")
@_write_first
def cluster_filter_mask(spark, d):
    windows = _windows(spark, d)
    hits = C.blacklist_hits(windows, X.blacklist(spark, d))
    return C.filter_clusters(windows, C.gene_extents(X.exons(spark, d)), hits, ["chr2"], 1000).select("id", "sid", "filter")


# -- statistics --


@query(""", clip AS (
  SELECT cluster_id AS id, source_id AS sid, CASE WHEN cigar ILIKE '%M%S' OR cigar ILIKE '%M%H' THEN pos + rlen WHEN cigar ILIKE '%S%M' OR cigar ILIKE '%H%M' THEN pos END AS clip
  FROM strip WHERE (flag & 2048) <> 0
), best AS (
  SELECT id, sid, clip FROM (SELECT id, sid, clip, row_number() OVER (PARTITION BY id, sid ORDER BY count(*) DESC, clip ASC NULLS LAST) AS n FROM clip GROUP BY id, sid, clip) WHERE n = 1
) SELECT w.id, w.sid, coalesce(b.clip, cast(floor((w.start_pos + w.end_pos) / 2) AS bigint)) AS point, CASE WHEN b.clip IS NULL THEN 1 ELSE 2 END AS point_type
FROM win w LEFT JOIN best b ON w.id = b.id AND w.sid = b.sid""")
@_write_first
def clip_mode_insertion_point(spark, d):
    return E.insertion_points(_windows(spark, d), E.clip_modes(_strip(spark, d), _alignments(spark, d)))


@query(""", r AS (
  SELECT cluster_id, rank() OVER (PARTITION BY cluster_id ORDER BY pos) + (count(*) OVER (PARTITION BY cluster_id, pos) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY cluster_id ORDER BY pos_next) + (count(*) OVER (PARTITION BY cluster_id, pos_next) - 1) / 2.0 AS ry
  FROM (SELECT DISTINCT cluster_id, pos, pos_next FROM strip)
) SELECT cluster_id, count(*) AS n, CASE WHEN count(*) > 1 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(cast(rx AS DOUBLE), cast(ry AS DOUBLE)), 9) END AS rho FROM r GROUP BY cluster_id""")
@_write_first
def spearman_rho(spark, d):
    reads = _alignments(spark, d)
    own = reads.select(F.col("id").alias("alignment_id"), F.col("pos").alias("x"), F.col("pos_next").alias("y"))
    listed = _strip(spark, d).select("cluster_id", "alignment_id")
    # Dealt by read for the join, and once by cluster for the distinct pairs and all their ranks.
    pairs = spread(listed, reads, "alignment_id").join(spread(own, reads, "alignment_id"), "alignment_id").select("cluster_id", "x", "y")
    return S.spearman(spread(pairs, reads, "cluster_id").distinct(), ["cluster_id"]).select("cluster_id", "n", F.round("rho", 9).alias("rho"))


@query()
def spearman_permutation_p(spark, d):
    reads = _alignments(spark, d).select(F.floor(F.col("pos") / 20000).alias("g"), F.col("pos").alias("x"), F.col("pos_next").alias("y"))
    return S.spearman_test(reads, "g")


@query(""", member AS (
  SELECT s.cluster_id, s.source_id AS cluster_sid, y.id, y.qname, y.source_id, y.pos FROM strip s JOIN typed y ON y.id = s.id
), brought AS (
  SELECT DISTINCT m.cluster_id, m.cluster_sid, m.qname, m.source_id, t.pos AS y FROM member m JOIN typed t ON t.qname = m.qname AND t.source_id = m.source_id AND t.id <> m.id WHERE (t.type & 8) <> 0
) SELECT DISTINCT m.cluster_id AS retrocopy_id, m.pos AS x, b.y FROM member m JOIN brought b ON b.cluster_id = m.cluster_id AND b.cluster_sid = m.cluster_sid AND b.qname = m.qname AND b.source_id = m.source_id""")
@_write_first
def orientation_pairs(spark, d):
    return E.orientation_pairs(_merging(spark, d), _strip(spark, d), _typed(spark, d)[0])


@query("""SELECT id, min(chr) AS chr, min(start_pos) AS window_start, max(end_pos) AS window_end, string_agg(DISTINCT gene_name, '/' ORDER BY gene_name) AS parental_gene_name, 1 + max(sid) % 2 AS level,
  arg_min((start_pos + end_pos) // 2, {'s': start_pos, 'i': sid}) AS insertion_point, 1 AS insertion_point_type, CASE WHEN id % 2 = 0 THEN (id % 7 - 3) / 8.0 END AS orientation_rho, CASE WHEN id % 2 = 0 THEN (id % 5) / 50.0 END AS orientation_p_value
FROM win GROUP BY id""")
@_write_first
def event_rows(spark, d):
    windows = _windows(spark, d)
    none = windows.select("id", "sid", F.lit(None).cast("long").alias("clip"))
    merging = windows.select(F.col("id").alias("retrocopy_id"), F.col("id").alias("cluster_id"), F.col("sid").alias("cluster_sid"), (1 + F.max("sid").over(Window.partitionBy("id")) % 2).alias("level"))
    tested = windows.select(F.col("id").alias("retrocopy_id")).distinct().filter("retrocopy_id % 2 = 0").select("retrocopy_id", ((F.col("retrocopy_id") % 7 - 3) / 8.0).alias("rho"), ((F.col("retrocopy_id") % 5) / 50.0).alias("p_value"))
    return E.events(merging, windows, E.insertion_points(windows, none), tested)


LIKELIHOOD = """, term AS (
  SELECT cluster_id, source_id, (flag & 2) <> 0 AS crossing, log10(2 * power(10.0, -mapq / 10.0)) AS wrong, log10(2 * (1 - power(10.0, -mapq / 10.0))) AS good FROM strip
), likely AS (
  SELECT source_id, cluster_id AS retrocopy_id, count(*) FILTER (WHERE crossing) AS reference_depth, count(*) FILTER (WHERE NOT crossing) AS alternate_depth,
         -count(*) * log10(2) + sum(CASE WHEN crossing THEN good ELSE wrong END) AS ref, -count(*) * log10(2) AS het, -count(*) * log10(2) + sum(CASE WHEN crossing THEN wrong ELSE good END) AS alt
  FROM term GROUP BY source_id, cluster_id
)
"""


def _genotypes(spark: SparkSession, d: str) -> DataFrame:
    """Proper reads of a strip stand for crossing ones, the others for abnormal ones; only seen pairs."""
    reads = _strip(spark, d).select(F.col("cluster_id").alias("retrocopy_id"), "alignment_id").join(_alignments(spark, d).select(F.col("id").alias("alignment_id"), "source_id", "mapq", "flag"), "alignment_id")
    proper = R.flagged("flag", 2)
    sources = _alignments(spark, d).select(F.col("source_id").alias("id")).distinct()
    return E.genotypes(sources, _events(spark, d), reads.filter(proper), reads.filter(~proper)).filter("reference_depth + alternate_depth > 0")


@query(LIKELIHOOD + "SELECT source_id, retrocopy_id, reference_depth::INTEGER AS reference_depth, alternate_depth::INTEGER AS alternate_depth, round(ref, 6) AS ho_ref, round(het, 6) AS he, round(alt, 6) AS ho_alt FROM likely")
@_write_first
def genotype_likelihood(spark, d):
    rows = _genotypes(spark, d)
    return rows.select("source_id", "retrocopy_id", "reference_depth", "alternate_depth", F.round("ho_ref_likelihood", 6).alias("ho_ref"), F.round("he_likelihood", 6).alias("he"), F.round("ho_alt_likelihood", 6).alias("ho_alt"))


CALL = "CASE WHEN ref >= het AND ref >= alt AND (ref > alt OR ref > het) THEN '0/0' WHEN het > ref AND het >= alt THEN '0/1' WHEN alt > ref AND alt > het THEN '1/1' ELSE './.' END"


@query(LIKELIHOOD + f"SELECT source_id, retrocopy_id, {CALL} AS genotype FROM likely")
@_write_first
def genotype_call(spark, d):
    return _genotypes(spark, d).select("source_id", "retrocopy_id", S.call(F.col("ho_ref_likelihood"), F.col("he_likelihood"), F.col("ho_alt_likelihood")).alias("genotype"))


@query("""SELECT e.id AS retrocopy_id, j.source_id, count(*) AS n FROM event e JOIN judged j ON e.chr = j.chr AND e.insertion_point BETWEEN j.pos AND j.high
WHERE (j.flag & 3) = 3 AND (j.flag & 3084) = 0 AND j.mapq >= 8
  AND e.insertion_point - cast(floor((j.high - j.pos + 1) / 20) AS bigint) >= j.pos AND e.insertion_point + cast(floor((j.high - j.pos + 1) / 20) AS bigint) <= j.high
GROUP BY e.id, j.source_id""")
@_write_first
def crossing_reads(spark, d):
    return E.crossing_reads(_alignments(spark, d), _events(spark, d)).groupBy("retrocopy_id", "source_id").agg(F.count("*").alias("n"))


# -- text formats --


def _text(frame: DataFrame, *columns) -> DataFrame:
    return frame.select(F.concat_ws("\t", *columns).alias("value"))


@query("SELECT chr AS seqname, 'exon' AS feature, start_pos AS start, end_pos AS \"end\", strand, gene_name, ense, 2 AS attributes FROM exon WHERE id % 3 = 0")
def gff_parse(spark, d):
    e = X.exons(spark, d)
    kind = F.when(F.col("id") % 3 == 0, "exon").otherwise("gene")
    attrs = F.concat(F.lit('gene_name "'), F.col("gene_name"), F.lit('"; exon_id='), F.col("ense"), F.lit(";"))
    text = _text(e, "chr", F.lit("made"), kind, F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    rows = T.parse_gff(text).filter(T.gff_filter("exon", {"gene_name": "^G"}, {"exon_id": "E"}))
    return rows.select("seqname", "feature", "start", "end", "strand", T.attribute("gene_name").alias("gene_name"), T.attribute("exon_id").alias("ense"), F.size("attributes").alias("attributes"))


@query("SELECT chr AS chrom, start_pos AS start, end_pos AS \"end\", name, 2 AS blocks FROM bl")
def bed_parse(spark, d):
    text = _text(X.blacklist(spark, d), "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.translate("name", " ", "_"), F.lit("0\t+\t1\t2\t0,0,0\t2\t5,6,\t0,9,"))
    return T.parse_bed(text).select("chrom", "start", "end", "name", F.size("block_sizes").alias("blocks"))


@query("""SELECT concat('c', cast(p_partkey AS string)) AS contig, concat(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), repeat('ACGT', p_size)) AS sequence,
  length(concat(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), repeat('ACGT', p_size))) AS length FROM part""")
def fasta_parse(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    record = F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit("|more words\n"), name, F.lit("\n;a comment\n"), F.expr("repeat('ACGT\n', p_size)"))
    return T.parse_fasta(part.select(record.alias("value")))


@query("SELECT qname, flag, chr, pos, mapq, cigar, chr_next, pos_next FROM aln")
def sam_parse(spark, d):
    a = _alignments(spark, d)
    mate = F.when(F.col("chr") == F.col("chr_next"), "=").otherwise(F.col("chr_next"))
    number = lambda c: F.col(c).cast("string")
    text = _text(a, "qname", number("flag"), F.substring("chr", 4, 9), number("pos"), number("mapq"), "cigar", mate, number("pos_next"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"))
    return T.parse_sam(text).select("qname", "flag", "chr", "pos", "mapq", "cigar", "chr_next", "pos_next")


CONTIGS = [f"chr{k}" for k in range(1, 6)]


@query("SELECT source_id, qname, flag, chr, pos, mapq, cigar, chr_next, pos_next, 'ACGT' AS seq, CASE cigar WHEN '20H80M' THEN 80 ELSE 100 END AS qlen FROM aln")
def bam_parse(spark, d):
    """The reads of each source and hundredth of its names as a binary file, decoded again."""
    rows = _alignments(spark, d)
    schema = "source_id long, content binary"

    def pack(group):
        import itertools

        import pandas as pd

        from spanloom.sources import bam

        fields = ("qname", "flag", "chr", "pos", "mapq", "cigar", "chr_next", "pos_next")
        made = bam.encoded(zip(*(group[f].tolist() for f in fields), itertools.repeat("ACGT")), CONTIGS)
        return pd.DataFrame([(group["source_id"].iloc[0], made)], columns=["source_id", "content"])

    files = rows.withColumn("part", F.pmod(F.xxhash64("qname"), F.lit(100))).repartition(many_tasks(spark), "source_id", "part").groupBy("source_id", "part").applyInPandas(pack, schema)
    return B.parse_bam(files, "source_id").select("source_id", "qname", "flag", "chr", "pos", "mapq", "cigar", "chr_next", "pos_next", "seq", "qlen")


@query("SELECT id, pos, mapq FROM judged WHERE chr = 'chr2' AND pos <= 30000 AND high >= 10000")
def columnar_window(spark, d):
    path = f"{shared_folder(spark)}/columnar_{uuid.uuid4().hex}"
    B.write_columnar(_alignments(spark, d).select("id", "chr", "pos", "rlen", "mapq"), path)
    return B.read_window(spark, path, "chr2", 10000, 30000).select("id", "pos", "mapq")


@query("""SELECT name, kind FROM (VALUES ('a.gff3', true), ('genes.gtf.gz', true), ('x.bed', false), ('gff', false)) v(name, kind)""")
def name_sniff(spark, d):
    names = ["a.gff3", "genes.gtf.gz", "x.bed", "gff"]
    return spark.createDataFrame([(n, T.looks_like_gff(n)) for n in names], "name string, kind boolean")


@query("""SELECT 12 + row_number() OVER (ORDER BY name) AS n, concat('##contig=<ID=', name, ',length=', len, '>') AS line
FROM (SELECT concat('s', lpad(cast(s_suppkey AS varchar), 9, '0')) AS name, 100 + s_suppkey AS len FROM supplier)
UNION ALL SELECT 1, '##fileformat=VCFv4.2' UNION ALL SELECT 2, '##fileDate=2020-01-02 03:04:05' UNION ALL SELECT 3, '##source=spanloom' UNION ALL SELECT 4, '##reference=file://r.fa'
UNION ALL SELECT 100000, concat('#', array_to_string(['CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 's1', 's2'], chr(9)))""")
def vcf_header(spark, d):
    listed = spark.read.parquet(f"{d}/supplier.parquet").select(F.format_string("s%09d", "s_suppkey"), 100 + F.col("s_suppkey")).collect()
    lines = V.header(["s1", "s2"], "r.fa", [tuple(r) for r in listed], when=datetime(2020, 1, 2, 3, 4, 5))
    contigs = sum(x.startswith("##contig") for x in lines)
    numbered = [(k + 1 if k < 4 else 12 + k - 3, x) for k, x in enumerate(lines[: 4 + contigs])] + [(100000, lines[-1])]
    return spark.createDataFrame(numbered, "n long, line string")


@query("SELECT id, CASE WHEN insertion_point = 1 THEN 1 ELSE insertion_point - 1 END AS vcf_pos, substr(repeat('ACGTN', 20000), cast(insertion_point - 1 AS integer), 1) AS ref FROM event WHERE insertion_point <= 100000 AND insertion_point > 1"
       " UNION ALL SELECT id, CASE WHEN insertion_point = 1 THEN 1 ELSE insertion_point - 1 END, 'N' FROM event WHERE insertion_point > 100001 OR insertion_point = 1")
def reference_lookup(spark, d):
    contigs = spark.createDataFrame([(c,) for c in CONTIGS], "contig string").withColumn("sequence", F.lit("acgtn" * 20000))
    return V.reference_bases(_events(spark, d), contigs).select("id", "vcf_pos", "ref")


def _described(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumnsRenamed({"gene_name": "parental_gene_name"})
    level = F.when(F.col("id") % 4 == 0, 8).otherwise(1)
    rows = rows.withColumn("level", level).withColumn("insertion_point_type", (1 + F.col("id") % 2).cast("int")).withColumn("orientation_rho", (F.col("id") % 7 - 3) / 8.0).withColumn("orientation_p_value", (F.col("id") % 5) / 50.0)
    return V.described(rows, X.exons(spark, d), _merging(spark, d), _strip(spark, d), _alignments(spark, d), 5000)


DESCRIBED = f""", host AS ({HOSTS.format(near="r.insertion_point BETWEEN gene_end + 1 AND gene_end + 5000")}),
clipped AS (SELECT *, CASE WHEN cigar ILIKE '%M%S' OR cigar ILIKE '%M%H' THEN pos + rlen WHEN cigar ILIKE '%S%M' OR cigar ILIKE '%H%M' THEN pos END AS clip FROM strip),
seen AS (SELECT c.cluster_id AS rid, count(DISTINCT c.id) AS depth, count(DISTINCT c.id) FILTER (WHERE (c.flag & 2048) <> 0 AND c.clip = e.insertion_point) AS split_reads
  FROM clipped c JOIN event e ON c.cluster_id = e.id GROUP BY c.cluster_id),
line AS (
  SELECT e.id, e.chr, e.insertion_point, concat('SVTYPE=INS',
    CASE WHEN e.id % 2 = 0 THEN concat(';IMPRECISE;CIPOS=', window_start - insertion_point, ',', window_end - insertion_point) ELSE '' END,
    CASE WHEN e.id % 4 <> 0 AND (e.id % 5) / 50.0 <= 0.05 THEN concat(';ORHO=', format('{{:.6f}}', (e.id % 7 - 3) / 8.0), ';POLARITY=', CASE WHEN ((e.id % 7 - 3) >= 0) = (coalesce(g.strand, '?') = '+') THEN '+' ELSE '-' END) ELSE '' END,
    ';PG=', e.gene_name, ';PGTYPE=', CASE WHEN e.id % 4 = 0 THEN 8 ELSE 1 END,
    CASE WHEN h.intragenic IS NOT NULL THEN concat(CASE WHEN h.exonic IS NOT NULL THEN concat(';EXONIC=', h.exonic) ELSE '' END, CASE WHEN h.exonic IS DISTINCT FROM h.intragenic THEN concat(';INTRONIC=', h.intragenic) ELSE '' END)
         WHEN h.near IS NOT NULL THEN concat(';NEAR=', h.near) ELSE '' END,
    ';DP=', s.depth, CASE WHEN e.id % 2 = 1 THEN concat(';SR=', s.split_reads) ELSE '' END) AS info
  FROM event e LEFT JOIN gene g ON e.gene_name = g.gene_name JOIN seen s ON s.rid = e.id LEFT JOIN host h ON h.rid = e.id
)
"""


@query(DESCRIBED + "SELECT id, info FROM line")
@_write_first
def vcf_info_string(spark, d):
    return _described(spark, d).select("id", V.info().alias("info"))


@query("""SELECT count(*) AS events, count(*) FILTER (WHERE n > 1) AS shared, sum(n)::BIGINT AS genotypes, sum(two) / sum(n) AS homozygous_ratio FROM (
  SELECT o_orderkey, (o_orderkey % 3 <> 0)::INTEGER + (o_orderkey % 4 = 0)::INTEGER AS n, (o_orderkey % 4 = 0)::INTEGER AS two FROM orders WHERE o_orderstatus <> 'P')""")
def vcf_summary(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    cells = [F.when(F.col("o_orderkey") % 3 != 0, "0/1:1,2:0").otherwise("0/0:1,0:0"), F.when(F.col("o_orderkey") % 4 == 0, "1/1:0,2:0").otherwise("./.:0,0:0")]
    text = _text(o, F.lit("chr1"), F.col("o_orderkey").cast("string"), F.lit(".\tN\t<INS:ME:RTC>\t."), F.when(F.col("o_orderstatus") == "P", "LOW").otherwise("PASS"), F.lit("SVTYPE=INS"), F.lit("GT:DP2:GL"), *cells)
    return V.summary(text)


# -- containers --


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def map_lookup(spark, d):
    regions = spark.read.parquet(f"{d}/region.parquet").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("names"))
    return spark.read.parquet(f"{d}/nation.parquet").crossJoin(F.broadcast(regions)).select("n_nationkey", F.try_element_at("names", "n_regionkey").alias("r_name"))


@query("""SELECT conv_id, turn, CASE WHEN list_position(a, 'e') > 0 THEN list_position(a, 'e') - 1 END AS first_e, CASE WHEN list_position(a, 'e') > 0 THEN list_concat(a[:list_position(a, 'e') - 1], a[list_position(a, 'e') + 1:]) ELSE a END AS without,
  list_concat(a[:1], a[3:]) AS shorter, list_append(a, 'end') AS longer FROM (SELECT conv_id, turn, string_split(coalesce(role, ''), '') AS a FROM conversations)""")
def array_functions(spark, d):
    a = F.split(F.coalesce("role", F.lit("")), "")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", a.alias("a"))
    e = F.lit("e")
    return rows.select("conv_id", "turn", K.find(F.col("a"), e).alias("first_e"), K.remove(F.col("a"), e).alias("without"), K.remove_index(F.col("a"), F.lit(1)).alias("shorter"), K.append(F.col("a"), F.lit("end")).alias("longer"))


@query("""SELECT r_regionkey, list_sort(list(n_name)) AS names, list(n_nationkey ORDER BY n_name) AS numbers, coalesce(bool_or(n_name = 'NATION_3'), false) AS has3,
  list_sort(list(n_name) FILTER (WHERE n_name <> 'NATION_3')) AS removed, coalesce(list_sort(list(n_name) FILTER (WHERE n_nationkey > 10)), []) AS high
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def map_functions(spark, d):
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    rows = spark.read.parquet(f"{d}/nation.parquet").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(entries.alias("m"))
    m, third = F.col("m"), F.lit("NATION_3")
    return rows.select(
        "r_regionkey",
        K.map_keys(m).alias("names"),
        K.map_values(m).alias("numbers"),
        K.map_contains(m, third).alias("has3"),
        K.map_keys(K.map_remove(K.map_insert(m, third, F.lit(0).cast("long")), third)).alias("removed"),
        K.map_keys(K.map_filter(m, lambda _, v: v > 10)).alias("high"),
    )


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS name, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder,
  trim(concat('""', url, '""'), '"') AS plain FROM pages""")
def path_functions(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    quoted = F.concat(F.lit('""'), F.col("url"), F.lit('""\n'))
    return rows.select("page_id", K.file_name(F.col("url")).alias("name"), K.folder_name(F.col("url")).alias("folder"), K.trim_character(K.chomp(quoted), '"').alias("plain"))


# -- genotypes of every source and event --

GRID = """, crossed AS (
  SELECT e.id AS retrocopy_id, j.source_id, count(*) AS n, sum(log10(2 * power(10.0, -mapq / 10.0))) AS wrong, sum(log10(2 * (1 - power(10.0, -mapq / 10.0)))) AS good
  FROM event e JOIN judged j ON e.chr = j.chr AND e.insertion_point BETWEEN j.pos AND j.high
  WHERE (j.flag & 3) = 3 AND (j.flag & 3084) = 0 AND j.mapq >= 8
    AND e.insertion_point - cast(floor((j.high - j.pos + 1) / 20) AS bigint) >= j.pos AND e.insertion_point + cast(floor((j.high - j.pos + 1) / 20) AS bigint) <= j.high
  GROUP BY e.id, j.source_id
), listed AS (
  SELECT cluster_id AS retrocopy_id, source_id, count(*) AS n, sum(log10(2 * power(10.0, -mapq / 10.0))) AS wrong, sum(log10(2 * (1 - power(10.0, -mapq / 10.0)))) AS good
  FROM strip GROUP BY cluster_id, source_id
), depth AS (
  SELECT s.source_id, e.id AS retrocopy_id, coalesce(c.n, 0) AS reference_depth, coalesce(l.n, 0) AS alternate_depth, -(coalesce(c.n, 0) + coalesce(l.n, 0)) * log10(2) AS het,
         coalesce(l.wrong, 0) + coalesce(c.good, 0) AS r, coalesce(c.wrong, 0) + coalesce(l.good, 0) AS a
  FROM (SELECT DISTINCT source_id FROM aln) s CROSS JOIN event e LEFT JOIN crossed c ON c.retrocopy_id = e.id AND c.source_id = s.source_id
  LEFT JOIN listed l ON l.retrocopy_id = e.id AND l.source_id = s.source_id
), grid AS (SELECT *, het + r AS ref, het + a AS alt FROM depth)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The genotype table of every source and event, from crossing and abnormal reads."""
    reads, events = _alignments(spark, d), _events(spark, d)
    sources = reads.select(F.col("source_id").alias("id")).distinct()
    return E.genotypes(sources, events, E.crossing_reads(reads, events), E.abnormal_scores(_merging(spark, d), _strip(spark, d), reads))


@query(GRID + f"SELECT source_id, retrocopy_id, reference_depth::INTEGER AS reference_depth, alternate_depth::INTEGER AS alternate_depth, {CALL} AS genotype FROM grid")
@_write_first
def source_cross_retrocopy(spark, d):
    call = S.call(F.col("ho_ref_likelihood"), F.col("he_likelihood"), F.col("ho_alt_likelihood"))
    return _grid(spark, d).select("source_id", "retrocopy_id", "reference_depth", "alternate_depth", call.alias("genotype"))


@query(DESCRIBED + GRID + f""", shown AS (
  SELECT retrocopy_id AS id, string_agg(concat({CALL}, ':', reference_depth, ',', alternate_depth, ':', format('{{:g}}', ref), ',', format('{{:g}}', het), ',', format('{{:g}}', alt)), chr(9) ORDER BY source_id) AS cells
  FROM grid GROUP BY retrocopy_id
) SELECT l.chr, l.insertion_point, concat_ws(chr(9), l.chr, CASE WHEN l.insertion_point = 1 THEN 1 ELSE l.insertion_point - 1 END, '.', 'N', '<INS:ME:RTC>', '.', 'PASS', l.info, 'GT:DP2:GL', s.cells) AS line
FROM line l JOIN shown s ON l.id = s.id""")
@_write_first
def vcf_body_pivot(spark, d):
    return V.body(_described(spark, d), _grid(spark, d), [1, 2, 3]).select("chr", "insertion_point", "line")


# -- containers, continued --


@query("""SELECT conv_id, turn, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_intersect(a, b)) AS i, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS m,
  len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM (
  SELECT conv_id, turn, coalesce(string_split(lower(role), 's'), CAST([] AS VARCHAR[])) AS a, coalesce(string_split(lower(text), 's'), CAST([] AS VARCHAR[])) AS b FROM conversations)""")
def set_algebra(spark, d):
    """The sets of whole texts; a null text or role has the empty set."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    a, b = (F.coalesce(F.split(F.lower(x), "s"), F.array().cast("array<string>")) for x in ("role", "text"))
    return rows.select("conv_id", "turn", K.union(a, b).alias("u"), K.intersection(a, b).alias("i"), K.difference(a, b).alias("m"), K.is_subset(a, b).alias("subset"))
