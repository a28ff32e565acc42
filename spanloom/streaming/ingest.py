"""Incremental intake: new alignment files of a folder become columnar batches.

A fragment lies within one file, and the fragment filter needs all its reads;
each micro-batch therefore takes whole files and runs the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.fragments import fragment_filter
from spanloom.sources.text_formats import parse_sam


def stream_fragments(spark: SparkSession, folder: str, output: str, checkpoint: str, max_distance: int = 10000, min_mapq: int = 8, files_per_batch: int = 16) -> StreamingQuery:
    """Appends the abnormal fragments of every file that appears in the folder; stops when it has caught up."""
    arriving = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumn("path", F.input_file_name())

    def take(batch: DataFrame, number: int) -> None:
        reads = parse_sam(batch, ("path",)).withColumn("source_id", F.col("path"))
        fragment_filter(reads, max_distance, min_mapq).drop("seq").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
