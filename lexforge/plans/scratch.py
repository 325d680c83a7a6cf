"""Tables that a plan writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own, on a cluster that is an error."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="lexforge-")
    return home


def spread(spark: SparkSession) -> int:
    """Partitions for work that its input's bytes don't tell of, as rows that compress well or become many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Scratch:
    """Parquet tables that cut lineage, survive lost executors, and go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.home = spark, f"{shared_folder(spark)}/lexforge-files/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.home}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        self._delete(self.home)

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
