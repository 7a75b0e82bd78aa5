"""New surrogate keys without a task that sees every row, and staged tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def numbered(rows: DataFrame, keys: list[str], after: Column | int = 0, name: str = "id") -> DataFrame:
    """rows with dense numbers after+1, after+2, ... that depend on the keys alone, which have to be unique.

    Rows are numbered within hash buckets; only the buckets' sizes are summed up in one place.
    """
    put = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*keys))
    return put.withColumn("_n", own).join(F.broadcast(starts), "_b").withColumn(name, (F.lit(after) + F.col("_s") + F.col("_n")).cast("long")).drop("_b", "_s", "_n")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, as in tests, a folder of the warehouse serves."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its rows are computed once, later plans know their size, lost executors are survived.

    The table is deleted when the driver's program ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the table is then only left behind
        pass
