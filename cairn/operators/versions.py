"""Snapshots of a catalog's structure, their differences down to columns, and comparison of DDL sources (V-1 to V-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import trim
from cairn.operators.keys import staged
from cairn.sources.sinks import Store

ALGORITHM = 2
MARK = "\x01"


class NoVersion(LookupError):
    """No version of that number."""


def signatures(assets: DataFrame, columns: DataFrame) -> DataFrame:
    """(asset_urn, asset_name, signature, schema_hash): name|TYPE|NULLABLE of each column, sorted and joined.

    The order of columns doesn't matter; missing parts are empty, and an asset without columns has an empty signature.
    """
    part = lambda c: F.coalesce(trim(c), F.lit(""))
    each = F.concat_ws("|", part("name"), F.upper(part("type")), F.upper(part("nullable")))
    lists = columns.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_list(each)), MARK).alias("signature"))
    rows = assets.select("id", F.col("asset_urn"), F.col("name").alias("asset_name")).join(lists, F.col("id") == F.col("asset_id"), "left")
    rows = rows.withColumn("signature", F.coalesce("signature", F.lit("")))
    return rows.select("asset_urn", "asset_name", "signature", F.sha2("signature", 256).alias("schema_hash"))


def snapshot(now: DataFrame, before: DataFrame | None, before_algorithm: int | None = ALGORITHM) -> DataFrame:
    """Items of a version (asset_urn, asset_name, change_type, signature, schema_hash) from two sets of signatures or items.

    Without a predecessor, or with one of another signature algorithm, all is ADDED (a FULL version).
    DROPPED items keep the old signature and are no baseline for the next version.
    """
    if before is None or before_algorithm != ALGORITHM:
        return now.withColumn("change_type", F.lit("ADDED")).select("asset_urn", "asset_name", "change_type", "signature", "schema_hash")
    base = before.where("change_type <> 'DROPPED'") if "change_type" in before.columns else before
    o, n = base.alias("o"), now.alias("n")
    change = F.when(F.col("o.schema_hash").isNull(), "ADDED").when(F.col("n.schema_hash").isNull(), "DROPPED").when(F.col("o.schema_hash") == F.col("n.schema_hash"), "RETAINED").otherwise("CHANGED")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return o.join(n, "asset_urn", "full_outer").select("asset_urn", pick("asset_name"), change.alias("change_type"), pick("signature"), pick("schema_hash"))


def header(items: DataFrame, number: int, before: DataFrame | None, note: str | None = None, before_algorithm: int | None = ALGORITHM) -> DataFrame:
    """V-3: one row about a version: its number, FULL or INCREMENT, note, signature algorithm and counts of changes."""
    full = before is None or before_algorithm != ALGORITHM
    n = lambda x: F.count_if(F.col("change_type") == x).alias(x.lower())
    counts = items.agg(n("ADDED"), n("RETAINED"), n("CHANGED"), n("DROPPED"))
    about = [F.lit(number).cast("long").alias("version_no"), F.lit("FULL" if full else "INCREMENT").alias("kind"), F.lit(note).cast("string").alias("note"), F.lit(ALGORITHM).cast("long").alias("signature_algo")]
    return counts.select(*about, "added", "retained", "changed", "dropped")


def create(store: Store, assets: DataFrame, columns: DataFrame, note: str | None = None, tries: int = 5) -> int:
    """V-3: a snapshot as the store's next version: `version` gets its header and `version_item` its items in one commit; its number.

    The number is one more than the last that the store holds.  Writers that take the same number at once meet in
    the commit: all but one make their snapshot anew against the winner's, with growing pauses.
    """
    now, numbers = staged(signatures(assets, columns)), []

    def make(store: Store, base: int):
        held = store.tables(base)
        headers = store.read("version", base) if "version" in held else None
        last = headers.orderBy(F.desc("version_no")).select("version_no", "signature_algo").first() if headers is not None else None
        number = (last["version_no"] if last else 0) + 1
        before = store.read("version_item", base).where(F.col("version_no") == last["version_no"]).drop("version_no") if last else None
        algorithm = last["signature_algo"] if last else None
        items = staged(snapshot(now, before, algorithm))
        numbers.append(number)
        return {}, {"version": header(items, number, before, note, algorithm), "version_item": items.select(F.lit(number).cast("long").alias("version_no"), "*")}

    store.update(make, tries)
    return numbers[-1]


def history(headers: DataFrame) -> DataFrame:
    """V-7: all versions, the newest first."""
    return headers.orderBy(F.desc("version_no"))


def get(headers: DataFrame, number: int) -> DataFrame:
    """V-7: the header of one version, made once, as it may count the items of whole catalogs; NoVersion where there is none."""
    one = headers.where(F.col("version_no") == number).take(1)
    if not one:
        raise NoVersion(number)
    return headers.sparkSession.createDataFrame(one, headers.schema)


def changes(items: DataFrame) -> DataFrame:
    """V-7: the items of a version that are not RETAINED, by kind and name."""
    return items.where("change_type <> 'RETAINED'").select("asset_urn", "asset_name", "change_type").orderBy("change_type", "asset_name")


def summary(items: DataFrame) -> DataFrame:
    return items.groupBy("change_type").agg(F.count("*").alias("n")).orderBy("change_type")


def _columns(items: DataFrame, side: str) -> DataFrame:
    """Columns of signatures; the second of equally named columns is told apart by its place."""
    each = items.select("asset_urn", F.explode(F.split("signature", MARK)).alias("c")).where("c <> ''").withColumn("column", F.substring_index("c", "|", 1))
    place = F.row_number().over(Window.partitionBy("asset_urn", "column").orderBy("c"))
    return each.select("asset_urn", "column", place.alias("place"), F.expr("substring(c, length(column) + 2)").alias(side))


def column_delta(items: DataFrame, before: DataFrame) -> DataFrame:
    """V-5: (asset_urn, column, delta ADDED|DROPPED|CHANGED, text) of CHANGED assets against the version before."""
    changed = items.where("change_type = 'CHANGED'").select("asset_urn", "signature")
    was = before.where("change_type <> 'DROPPED'") if "change_type" in before.columns else before
    old = was.join(changed.select("asset_urn"), "asset_urn", "left_semi")
    both = _columns(old, "old").join(_columns(changed, "new"), ["asset_urn", "column", "place"], "full_outer").where("NOT old <=> new")
    delta = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "DROPPED").otherwise("CHANGED")
    text = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.concat("column", F.lit(": "), "old", F.lit(" → "), "new")).otherwise(F.col("column"))
    return both.select("asset_urn", "column", delta.alias("delta"), text.alias("text"))


def compare_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """V-6: (name, change, old_columns, new_columns, recounted) of two DDL sources (name, column_count)."""
    o = old.select("name", F.col("column_count").alias("old_columns"))
    n = new.select("name", F.col("column_count").alias("new_columns"))
    change = F.when(F.col("old_columns").isNull(), "ADDED").when(F.col("new_columns").isNull(), "DROPPED").otherwise("RETAINED")
    recounted = F.coalesce(F.col("old_columns") != F.col("new_columns"), F.lit(False))
    return o.join(n, "name", "full_outer").select("name", change.alias("change"), "old_columns", "new_columns", recounted.alias("recounted"))


def compare_report(compared: DataFrame) -> DataFrame:
    """Counts and the identities added + retained = new, dropped + retained = old."""
    n = lambda x: F.count_if(F.col("change") == x)
    return compared.agg(
        n("ADDED").alias("added"), n("DROPPED").alias("dropped"), n("RETAINED").alias("retained"), F.count("new_columns").alias("n_new"), F.count("old_columns").alias("n_old"),
        F.count_if("recounted").alias("recounted"), ((n("DROPPED") == 0) & (n("ADDED") > 0)).alias("strict_superset"),
    )
