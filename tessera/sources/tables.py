"""Named tables: scan, atomic save, month-partitioned write, windowed scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table by name with a declared schema; a table that isn't there is empty."""
    path = f"{root}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def save(df: DataFrame, root: str, name: str) -> None:
    """Writes beside the table and swaps it in, so that the table may be read by the plan that writes it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    new, live, old = (path(f"{root}/{x}") for x in (f".{name}.new", f"{name}.parquet", f".{name}.old"))
    fs = live.getFileSystem(conf)
    df.write.mode("overwrite").parquet(str(new.toString()))
    fs.delete(old, True)
    if fs.exists(live):
        fs.rename(live, old)
    fs.rename(new, live)
    fs.delete(old, True)


def save_months(df: DataFrame, path: str, date: str = "date") -> None:
    """Writes a panel by month; only the months in ``df`` are replaced."""
    month = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    month.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def load_window(spark: SparkSession, path: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Rows with start <= date < end; months outside are not read."""
    panel = spark.read.parquet(path)
    return panel.filter(F.col("month").between(start[:7], end[:7])).filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))).select(*columns)
