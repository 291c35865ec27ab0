"""Tables that a stream publishes together, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Published:
    """Tables under a shared folder; a batch's rows of all tables appear at once, when its commit is written.

    A batch that runs again after a failure overwrites what it left; one that was committed is not written again. So a
    replay changes nothing, and readers never see half a batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> list[int]:
        """The numbers of the committed batches."""
        fs, where = self._fs(f"{self.folder}/commits")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def write(self, batch: int, **tables: DataFrame) -> bool:
        """Whether the batch was written: False if it had been committed before."""
        fs, mark = self._fs(f"{self.folder}/commits/batch={batch}")
        if fs.exists(mark):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        fs.mkdirs(mark)
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of all committed batches."""
        paths = [f"{self.folder}/{name}/batch={b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)
