"""Session factory with the settings the library is written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.caseSensitive": "false",
}


def build(master: str = "local[*]", app: str = "tidemark", **extra: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments use '__' for '.'."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
