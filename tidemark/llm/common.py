"""What the training-data operators share: sealed columns and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as a Java and a Python regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: The same six characters, for trim().
SPACES = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one, a temporary folder does on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return base.rstrip("/") + "/tidemark"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage is cut, and lost executors don't matter."""
    return _stored(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables of one run of an operator in the shared folder; they go when the run ends, but for those that are kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder = spark, name, new_path(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.folder)

    def store(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        return _stored(df, f"{self.folder}/{name}", by)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that outlives the run: the operator's result, which is read from it."""
        return store(df, f"{self.name}-{name}")

    def drop(self, name: str) -> None:
        self._remove(f"{self.folder}/{name}")

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class Sealed:
    """A frame under internal column names, so that no input column can clash with an operator's own ones."""

    def __init__(self, df: DataFrame, *needed: str):
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        self.names = df.columns
        self.inner = {n: f"in{i}__" for i, n in enumerate(self.names)}
        self.df = df.toDF(*self.inner.values())

    def __getitem__(self, name: str):
        return F.col(self.inner[name])

    def open(self, df: DataFrame, **new) -> DataFrame:
        """The input's columns under their own names, then the new ones, which replace any of the same name."""
        old = [F.col(self.inner[n]).alias(n) for n in self.names if n not in new]
        return df.select(*old, *[c.alias(n) for n, c in new.items()])

    def replace(self, df: DataFrame, **new) -> DataFrame:
        """The input's columns in their order, some with new contents."""
        return df.select(*[new.get(n, F.col(self.inner[n])).alias(n) for n in self.names])
