"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratafac.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read
    it back: computed once, lineage cut, and re-readable after lost executors."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Written tables of a job in the shared checkpoint folder. A table that
    nothing will read again, not even to recompute a lost part, can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[DataFrame, str] = {}

    def _path(self, name: str) -> str:
        return scratch_path(self.spark, f"{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def bucketed(self, df: DataFrame, name: str, buckets: int, by: str, kind: str) -> DataFrame:
        """Written with a folder per ``kind`` and bucketed, so that grouping its
        rows ``by`` needs no shuffle."""
        table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        path = self._path(name)
        df.write.partitionBy(kind).bucketBy(buckets, by).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(df))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
