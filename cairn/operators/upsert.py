"""Catalog upserts by natural key with pinned ids (U-1), partial updates (U-4, U-5) and insert-if-absent (U-6).

The frames of changes are the dry run; `applied` turns them into the next generation of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import cut
from cairn.operators.catalog import seeds
from cairn.operators.keys import numbered, staged
from cairn.sources.sinks import Store

STRUCTURE = ["prefix_family", "has_pk", "table_comment", "charset", "collate_name", "column_count"]
COLUMN_FACTS = ["ordinal", "type", "nullable", "default_val", "key_hint", "meaning"]
# Lengths that stored texts are cut to.
LENGTHS = {"table_comment": 500, "charset": 64, "collate_name": 64}


class GuardError(ValueError):
    """A payload breaks a rule; nothing is written."""


def _differs(facts: list[str]) -> Column:
    out = F.lit(False)
    for c in facts:
        out = out | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return out


def _changes(old: DataFrame, new: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Full outer join of both sides on keys: change, id, name and facts of the new side, else of the old."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "evicted").when(_differs(facts), "updated").otherwise("unchanged")
    pick = lambda c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*keys, change.alias("change"), "o.id", pick("name"), *[pick(c) for c in facts])


def asset_changes(old: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, change, id, name, structure): tables of a DDL file against stored assets, names without case.

    A name that a file creates twice counts once, as first created; the reference keeps both and
    would then break its unique key.  The stored spelling of a name stays.
    """
    first = Window.partitionBy(F.lower("name")).orderBy("doc", "start_line") if "start_line" in tables.columns else Window.partitionBy(F.lower("name")).orderBy("name")
    new = tables.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    for c, n in LENGTHS.items():
        new = new.withColumn(c, cut(c, n))
    return _changes(old.select(F.lower("name").alias("key"), "id", "name", *STRUCTURE), new.select(F.lower("name").alias("key"), "name", *STRUCTURE), ["key"], STRUCTURE)


def column_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_key, key, change, id, name, facts) of columns that carry `table`; another spelling alone changes nothing."""
    first = Window.partitionBy(F.lower("table"), F.lower("name")).orderBy("ordinal")
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    keys = [F.lower("table").alias("table_key"), F.lower("name").alias("key")]
    return _changes(old.select(*keys, "id", "name", *COLUMN_FACTS), once.select(*keys, "name", *COLUMN_FACTS), ["table_key", "key"], COLUMN_FACTS)


def upsert_report(changes: DataFrame) -> DataFrame:
    """(change, n), all four kinds of change."""
    kinds = changes.sparkSession.createDataFrame([(x,) for x in ("created", "updated", "unchanged", "evicted")], "change string")
    return kinds.join(changes.groupBy("change").agg(F.count("*").alias("n")), "change", "left").fillna(0, ["n"])


def applied(old: DataFrame, changes: DataFrame, schema: str, source_id: int) -> DataFrame:
    """The assets after the upsert: ids pinned, governance kept, every remaining asset pointing to the new source."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    live = changes.where("change <> 'evicted'")
    urn = F.concat(F.lit(f"mysql:{schema}:"), F.col("name"))
    made = numbered(live.where("change = 'created'").drop("id"), ["key"], top)
    kept = live.where("change <> 'created'").select("id", *STRUCTURE)
    rest = [c for c in old.columns if c not in (*STRUCTURE, "source_id")]
    same = old.select(*rest).join(kept, "id")
    new = made.select("id", "name", *STRUCTURE).withColumn("asset_urn", urn)
    return same.unionByName(new, allowMissingColumns=True).withColumn("source_id", F.lit(source_id).cast("long"))


def owned_changes(old: DataFrame, new: DataFrame, assets: DataFrame, after: DataFrame) -> DataFrame:
    """(change, lives, all columns of old): column_changes of a DDL file (table, name, facts) by the ids of the tables, not their names.

    assets are those before the upsert, after those it leaves; lives: the column's table is among these.  What a
    column has beside its facts, its spelling too, stays.  Names of tables meet ids once, in one shuffle; from
    there on both sides carry ids alone.
    """
    ids = after.select(F.lower("name").alias("_key"), F.col("id").alias("asset_id"), F.lit(True).alias("lives"))
    left = assets.select(F.lower("name").alias("_key"), "id").join(after.select("id"), "id", "left_anti")
    known = ids.unionByName(left.select("_key", F.col("id").alias("asset_id"), F.lit(False).alias("lives")))
    first = Window.partitionBy(F.lower("table"), F.lower("name")).orderBy("ordinal")
    named = new.select("table", "name", *COLUMN_FACTS).join(known, F.lower("table") == F.col("_key"), "left").withColumn("_n", F.row_number().over(first))
    n = named.where("_n = 1").select("asset_id", "name", "lives", F.lit(True).alias("_new"), *COLUMN_FACTS).alias("n")
    o = old.alias("o")
    change = F.when(F.col("o.id").isNull(), "created").when(F.col("_new").isNull(), "evicted").when(_differs(COLUMN_FACTS), "updated").otherwise("unchanged")
    facts = {c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in COLUMN_FACTS} | {c: F.coalesce(f"o.{c}", f"n.{c}") for c in ("name", "asset_id")}
    joined = o.join(n, (F.col("o.asset_id") == F.col("n.asset_id")) & (F.lower("o.name") == F.lower("n.name")), "full_outer")
    return joined.select(change.alias("change"), F.coalesce("lives", F.lit(False)).alias("lives"), *[facts.get(c, F.col(f"o.{c}")).alias(c) for c in old.columns])


def applied_columns(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The columns after the upsert, from owned_changes: ids pinned, facts that changed taken over.

    Columns whose table is gone go with it, whatever `changes` says of them; another spelling of a name changes nothing.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    live = changes.where("change <> 'evicted' AND lives")
    made = numbered(live.where("change = 'created'").drop("id").withColumn("_key", F.lower("name")), ["asset_id", "_key"], top)
    return live.where("change <> 'created'").select(*old.columns).unionByName(made.select(*old.columns))


def ddl_upsert(store: Store, tables: DataFrame, columns: DataFrame, source: str, schema: str) -> DataFrame:
    """U-1 as one commit: assets, columns and sources of a DDL file over a store's tables `asset`, `column` and `source`; (entity, change, n).

    tables (name and STRUCTURE) and columns (table, name, COLUMN_FACTS) are what the file holds.  Names match without
    case; assets that the file lacks go, with their columns.  All of it is visible at once or, if a task or another writer comes between, nothing.
    """
    base = store.generation()
    assets, owned = store.read("asset", base), store.read("column", base)
    asset_diff = staged(asset_changes(assets, tables))
    known = store.read("source", base) if "source" in store.tables(base) else None
    number = (known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"] if known is not None else 0) + 1
    after = staged(applied(assets, asset_diff, schema, number))
    column_diff = staged(owned_changes(owned, columns, assets, after))
    n_tables, n_columns = tables.select(F.countDistinct(F.lower("name"))).first()[0], columns.count()
    one = store.spark.createDataFrame([(number, source, "DDL", n_tables, n_columns)], "id long, name string, type string, table_count long, column_count long")
    store.commit({"asset": after, "column": applied_columns(owned, column_diff)}, {"source": one}, base)
    reports = [upsert_report(d).select(F.lit(e).alias("entity"), "change", "n") for e, d in (("asset", asset_diff), ("column", column_diff))]
    return reports[0].unionByName(reports[1])


def reorder_columns(columns: DataFrame, asset_id: int, ids: list[int]) -> DataFrame:
    """U-4: ordinals of one asset's columns as ids lists them; it has to list exactly that asset's columns."""
    order = columns.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(ids)], "id long, _at int")
    own = columns.where(F.col("asset_id") == asset_id)
    if len(set(ids)) != len(ids) or own.join(order, "id", "full_outer").where("asset_id is null or _at is null").take(1):
        raise GuardError("the ids are not the asset's columns")
    return columns.join(F.broadcast(order), "id", "left").withColumn("ordinal", F.coalesce("_at", "ordinal")).drop("_at").select(*columns.columns)


def patch_governance(assets: DataFrame, patches: DataFrame, users: DataFrame) -> DataFrame:
    """U-5: the non-null fields of patches (id, ...) replace those of assets; owners and stewards have to be users."""
    fields = [c for c in patches.columns if c != "id"]
    people = [c for c in ("owner_id", "steward_id") if c in fields]
    for c in people:
        if patches.where(F.col(c).isNotNull()).join(users.select(F.col("id").alias("_user")), F.col(c) == F.col("_user"), "left_anti").take(1):
            raise GuardError(f"{c}: no such user")
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    return assets.join(p, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in assets.columns])


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """U-6: stored rows and those of rows whose keys are not there yet, with new ids."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return stored.unionByName(numbered(rows.join(stored.select(*keys), keys, "left_anti"), keys, top), allowMissingColumns=True)


def insert_seeds(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """U-6: the given tables, each with the seeds that it lacks; what it has under a seed's key stays as it is."""
    return {t: insert_absent(rows, *seeds(rows.sparkSession)[t]) for t, rows in stored.items()}
