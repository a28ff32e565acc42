"""A store of tables: a Parquet folder each, and the schema version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanloom.schema import TABLES, VERSION


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark's scans report it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def plain_path(reported: Column) -> Column:
    """A scan's file path, whose odd characters are percent-encoded, in the form of ``qualified``."""
    return F.regexp_replace(F.url_decode(F.replace(reported, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


class Workspace:
    """Tables under one path, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Workspace:
        """A new store with empty tables; one that is there is replaced."""
        store = cls(spark, path)
        spark.createDataFrame([VERSION], "major_version int, minor_version int").write.mode("overwrite").parquet(f"{store.path}/schema")
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store.path}/{name}")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Workspace:
        """A store that is there, if its version is this one."""
        store = cls(spark, path)
        try:
            found = tuple(spark.read.parquet(f"{store.path}/schema").first())
        except AnalysisException as error:
            raise FileNotFoundError(f"no store at {path}") from error
        if found != VERSION:
            raise ValueError(f"the store has schema version {found[0]}.{found[1]}; {VERSION[0]}.{VERSION[1]} is needed")
        return store

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def write(self, name: str, frame: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Writes the table with its declared columns and types, and returns it as read."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
        frame.select(*columns).write.mode(mode).parquet(f"{self.path}/{name}")
        return self.read(name)

    @staticmethod
    def read_together(stores: list[Workspace], name: str) -> DataFrame:
        """One table of several stores in one scan, with the store's place in the list as ``_store``."""
        spark = stores[0].spark
        folders = [qualified(spark, f"{s.path}/{name}") for s in stores]
        places = spark.createDataFrame([(f, k) for k, f in enumerate(folders)], "_folder string, _store int")
        rows = spark.read.schema(TABLES[name]).parquet(*folders).withColumn("_folder", F.regexp_replace(plain_path(F.col("_metadata.file_path")), "/[^/]*$", ""))
        return rows.join(F.broadcast(places), "_folder").drop("_folder")

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in names}
