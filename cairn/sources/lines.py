"""Text sources: DDL files and Markdown folders as frames of (doc, line_no, line)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.keys import staged

#: Environment variables, and relative places that are tried after them in this order.
DDL_VARIABLE, DDL_PLACES = "CAIRN_DDL_PATH", ["test_erp.sql", "../test_erp.sql", "../../test_erp.sql", "data/test_erp.sql"]
MODEL_VARIABLE, MODEL_PLACES = "CAIRN_MODEL_PATH", ["er-model", "../er-model", "../../er-model"]
CENSUS_FILE = "00-总览与分组清单.md"


class SourceNotFound(FileNotFoundError):
    """No candidate place holds the input."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _first(spark: SparkSession, explicit: str | None, variable: str, places: list[str], holds: str = "") -> str:
    if explicit and not _exists(spark, explicit):
        raise SourceNotFound(explicit)
    tried = [explicit] if explicit else [x for x in [os.environ.get(variable)] if x] + places
    for place in tried:
        if _exists(spark, f"{place}/{holds}" if holds and place != explicit else place):
            return place
    raise SourceNotFound(f"none of {tried}")


def locate_ddl(spark: SparkSession, explicit: str | None = None) -> str:
    """SRC-1: an explicit file, then the environment, then fixed places; through Spark's file systems."""
    return _first(spark, explicit, DDL_VARIABLE, DDL_PLACES)


def locate_model(spark: SparkSession, explicit: str | None = None) -> str:
    """SRC-2: as locate_ddl; a folder that isn't named explicitly has to hold the census document."""
    return _first(spark, explicit, MODEL_VARIABLE, MODEL_PLACES, CENSUS_FILE)


def split_lines(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_no from 1, line) of whole texts; CRLF, LF and CR end a line, and none follows the last end."""
    parts = F.split(F.col(text), r"\r\n|\n|\r")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return texts.select(F.col(doc).alias("doc"), F.posexplode(parts).alias("at", "line")).select("doc", (F.col("at") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """SRC-3, SRC-4: (doc, line_no, line) of one file, or of each that a pattern names; doc is folder/name and sorts by path.

    Files are read in byte ranges by as many tasks as Spark cuts them into; a range's first line number is the count of
    lines in the ranges before it.  Lines end at LF, CR or CRLF.
    """
    place = {"doc": F.concat(F.lit(f"{folder}/" if folder else ""), F.col("_metadata.file_name")), "file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}
    rows = staged(spark.read.text(path).select(F.col("value").alias("line"), *[c.alias(n) for n, c in place.items()], F.monotonically_increasing_id().alias("at")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n")).select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    return rows.join(ranges, ["file", "start"]).select("doc", (F.col("at") - F.col("first") + F.col("lines") + 1).cast("int").alias("line_no"), "line")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(spark, f"{folder}/*.md", folder.rstrip("/").rpartition("/")[2])


def read_store(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """SRC-6: a table of an existing metadata store over JDBC; its driver has to be on Spark's class path.

    With a numeric key the table is read by that many tasks.  Their bounds are quantiles of the key, for which its column alone
    is read first, so keys that crowd together are shared out as well; a task also reads the rows without key.
    """
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    if key is None:
        return source(dbtable=table).load()
    key = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    keys = source(query=f"SELECT {key} FROM {table}").load().toDF("k")
    cuts = keys.select(F.percentile_approx(F.col("k"), [i / partitions for i in range(1, partitions)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return source(dbtable=table).load()
    ranges = [f"{key} < {cuts[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])), f"{key} >= {cuts[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=options)


def write_store(rows: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 8, **options: str) -> None:
    """Writes rows to a table of the store, over at most `partitions` connections at once."""
    rows.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(partitions), **options).mode(mode).save()
