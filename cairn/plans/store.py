"""Queries over upserts, edge passes and exports."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import ORIGIN_LOGICAL
from cairn.operators import classify, documents, relations, upsert
from cairn.operators.keys import delete, shared_dir, staged
from cairn.plans.registry import query
from cairn.plans.tables import Tables
from cairn.sources import sinks


# ---------------------------------------------------------------- catalog upserts


def _facts(assets: DataFrame) -> DataFrame:
    return assets.select("id", "name", classify.prefix_family("name").alias("prefix_family"), "has_pk", "table_comment", "charset", "collate_name", F.col("n_columns").alias("column_count"))


@query(", ch AS (SELECT lower(name) AS key, CASE WHEN id % 20 = 0 THEN 'created' WHEN id % 23 = 0 THEN 'evicted' WHEN n_columns % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change, CASE WHEN id % 20 <> 0 THEN id END AS id FROM asset WHERE id % 20 <> 0 OR id % 23 <> 0) SELECT * FROM ch")
def ddl_upsert_diff(t: Tables) -> DataFrame:
    return _same_case(t).select("key", "change", "id")


def _same_case(t: Tables) -> DataFrame:
    new = _facts(t.asset.where("id % 23 <> 0")).drop("id").withColumn("charset", F.when(F.col("column_count") % 5 == 0, "gbk").otherwise(F.col("charset")))
    return upsert.asset_changes(_facts(t.asset.where("id % 20 <> 0")), new)


@query("""
    SELECT v.change, count(a.id) AS n FROM (VALUES ('created'), ('updated'), ('unchanged'), ('evicted')) v(change) LEFT JOIN
      (SELECT id, CASE WHEN id % 20 = 0 THEN 'created' WHEN id % 23 = 0 THEN 'evicted' WHEN n_columns % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM asset WHERE id % 20 <> 0 OR id % 23 <> 0) a ON a.change = v.change GROUP BY 1""")
def ddl_upsert_report(t: Tables) -> DataFrame:
    return upsert.upsert_report(_same_case(t))


@query("""
    SELECT lower(a.name) AS table_key, lower(c.name) AS key, CASE WHEN k % 11 = 0 THEN 'created' WHEN k % 13 = 0 THEN 'evicted' WHEN k % 15 = 0 THEN 'updated' ELSE 'unchanged' END AS change
    FROM col c JOIN asset a ON a.id = c.asset_id WHERE NOT (k % 11 = 0 AND k % 13 = 0)""")
def column_upsert_diff(t: Tables) -> DataFrame:
    names = t.asset.select(F.col("id").alias("asset_id"), F.col("name").alias("table"))
    c = t.col.join(names, "asset_id").withColumns({"default_val": F.lit(None).cast("string"), "key_hint": F.lit(None).cast("string"), "meaning": F.lit(None).cast("string")})
    new = c.where("k % 13 <> 0").withColumns({"name": F.upper("name"), "type": F.when(F.col("k") % 15 == 0, "json").otherwise(F.col("type"))})
    return upsert.column_changes(c.where("k % 11 <> 0"), new).select("table_key", "key", "change")


def _ddl_applied(t: Tables) -> tuple[sinks.Store, int, DataFrame]:
    """A store with assets and columns, and over it a DDL file that makes, changes and leaves out some of both: the store, its generation before, the report."""
    store = sinks.Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    atexit.register(delete, t.spark, store.root)
    names = t.asset.select(F.col("id").alias("asset_id"), F.col("name").alias("table"))
    c = staged(t.col.join(names, "asset_id")).withColumns({x: F.lit(None).cast("string") for x in ("default_val", "key_hint", "meaning")})  # three plans read it
    held = _facts(t.asset.where("id % 20 <> 0")).withColumns({"asset_urn": F.concat(F.lit("mysql:shop:"), "name"), "source_id": F.lit(7).cast("long")})
    base = store.commit({"asset": held, "column": c.where("asset_id % 20 <> 0 AND k % 11 <> 0").select("id", "asset_id", "name", *upsert.COLUMN_FACTS)})
    tables = _facts(t.asset.where("id % 23 <> 0")).drop("id").withColumn("charset", F.when(F.col("column_count") % 5 == 0, "gbk").otherwise(F.col("charset")))
    new = c.where("asset_id % 23 <> 0 AND k % 13 <> 0").withColumns({"name": F.upper("name"), "type": F.when(F.col("k") % 15 == 0, "json").otherwise(F.col("type"))})
    return store, base, upsert.ddl_upsert(store, tables, new, "shop.sql", "shop")


@query("""
    SELECT lower(a.name) AS table_key, lower(c.name) AS key, CASE WHEN k % 15 = 0 THEN 'json' ELSE type END AS type, CASE WHEN a.id % 20 <> 0 AND k % 11 <> 0 THEN c.id END AS kept_id, true AS owned
    FROM col c JOIN asset a ON a.id = c.asset_id WHERE a.id % 23 <> 0 AND k % 13 <> 0""")
def ddl_apply_columns(t: Tables) -> DataFrame:
    """Columns as the commit leaves them: pinned ids, changed types, new ones under their asset's id, whether that was there or is new."""
    store, base, _ = _ddl_applied(t)
    before = store.read("column", base).select(F.col("id").alias("kept_id"))
    after = store.read("column").join(before, F.col("id") == F.col("kept_id"), "left").select("asset_id", "name", "type", "kept_id")
    after = after.join(store.read("asset").select(F.col("id").alias("asset_id"), F.lower("name").alias("table_key")), "asset_id", "left")
    return after.select("table_key", F.lower("name").alias("key"), "type", "kept_id", F.col("table_key").isNotNull().alias("owned"))


@query("""
    SELECT 'asset' AS entity, id, CAST(NULL AS BIGINT) AS asset_id FROM asset WHERE id % 20 <> 0 AND id % 23 = 0
    UNION ALL SELECT 'column', id, asset_id FROM col WHERE asset_id % 20 <> 0 AND k % 11 <> 0 AND (asset_id % 23 = 0 OR k % 13 = 0)""")
def ddl_apply_evictions(t: Tables) -> DataFrame:
    """What the commit takes away: assets that the file lacks with all their columns, and columns it lacks."""
    store, base, _ = _ddl_applied(t)
    gone = lambda table: store.read(table, base).join(store.read(table).select("id"), "id", "left_anti")
    return gone("asset").select(F.lit("asset").alias("entity"), "id", F.lit(None).cast("long").alias("asset_id")).unionByName(gone("column").select(F.lit("column").alias("entity"), "id", "asset_id"))


@query("""
    SELECT e.entity, v.change, count(x.change) AS n FROM (VALUES ('asset'), ('column')) e(entity) CROSS JOIN (VALUES ('created'), ('updated'), ('unchanged'), ('evicted')) v(change) LEFT JOIN (
      SELECT 'asset' AS entity, CASE WHEN id % 20 = 0 THEN 'created' WHEN id % 23 = 0 THEN 'evicted' WHEN n_columns % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM asset WHERE id % 20 <> 0 OR id % 23 <> 0
      UNION ALL SELECT 'column', CASE WHEN NOT old THEN 'created' WHEN NOT new THEN 'evicted' WHEN k % 15 = 0 THEN 'updated' ELSE 'unchanged' END FROM (SELECT k, asset_id % 20 <> 0 AND k % 11 <> 0 AS old, asset_id % 23 <> 0 AND k % 13 <> 0 AS new FROM col) c WHERE old OR new
    ) x ON x.entity = e.entity AND x.change = v.change GROUP BY 1, 2""")
def ddl_apply_report(t: Tables) -> DataFrame:
    return _ddl_applied(t)[2]


@query("SELECT id, CAST(CASE WHEN asset_id = 3 THEN max(ordinal) OVER (PARTITION BY asset_id) - ordinal ELSE ordinal END AS INT) AS ordinal FROM col")
def columns_reorder(t: Tables) -> DataFrame:
    ids = [r["id"] for r in t.col.where("asset_id = 3").orderBy(F.desc("ordinal")).select("id").collect()]  # the columns of one table
    return upsert.reorder_columns(t.col, 3, ids).select("id", "ordinal")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'PII' END AS sensitivity_level, CASE WHEN id % 4 = 0 AND id % 8 = 0 THEN CAST(1 AS BIGINT) END AS owner_id FROM asset")
def governance_patch(t: Tables) -> DataFrame:
    assets = t.asset.select("id", F.lit(None).cast("string").alias("sensitivity_level"), F.lit(None).cast("long").alias("owner_id"))
    patches = t.asset.where("id % 4 = 0").select("id", F.lit("PII").alias("sensitivity_level"), F.when(F.col("id") % 8 == 0, F.lit(1).cast("long")).alias("owner_id"))
    return upsert.patch_governance(assets, patches, t.asset.where("id < 3").select("id"))


# ---------------------------------------------------------------- edges of logical models


def _id() -> Column:
    """Edges of the two kinds share numbers from a million tables on, so the store's id also tells the kind."""
    return F.col("id") * 2 + (F.col("from_asset_id") != F.col("id")).cast("long")


def _number() -> Column:
    """The number of an edge again, from its id in the store."""
    return F.expr("id div 2")


def _store(t: Tables) -> DataFrame:
    names = t.asset.select(F.col("id").alias("to_asset_id"), F.col("name").alias("_n"))
    e = t.edge.withColumn("id", _id()).join(names, "to_asset_id", "left")
    null = {c: F.lit(None).cast("string") for c in ("to_column", "cross_domain", "basis_raw", "ingest_trace", "source_doc", "discriminator")}
    return e.withColumns(null | {"target_raw": F.coalesce("_n", F.lit("外部系统")), "origin": F.lit(ORIGIN_LOGICAL), "is_inferred": F.lit(True), "candidate_targets": F.array().cast(documents.CANDIDATES)}).select(*relations.NAMES)


def _relation_changes(t: Tables) -> DataFrame:
    ends = t._ends()
    kept = ends.where("id % 13 <> 0")
    more = ends.where("id % 29 = 0").withColumn("from_column", F.concat(F.lit("new_"), F.col("id").cast("string")))
    lines = t.logical_lines(kept.unionByName(more))
    catalog = t.asset.select("id", "name")
    return relations.upsert_relations(_store(t), documents.resolve_targets(documents.logical_relations(lines), catalog), catalog)


@query("SELECT id, CASE WHEN id % 13 <> 0 THEN 'reused' WHEN id % 17 = 0 THEN 'stale_kept' ELSE 'removed' END AS action, confirm_status, conflict_flag OR (id % 13 = 0 AND id % 17 = 0) AS conflict_flag FROM edge")
def rel_upsert_stored(t: Tables) -> DataFrame:
    """Ids pinned, verdicts kept, stale edges removed or kept for review."""
    return _relation_changes(t).where("action <> 'created'").select(_number().alias("id"), "action", "confirm_status", "conflict_flag")


@query("""
    SELECT count(*) FILTER (WHERE id % 13 <> 0) + count(*) FILTER (WHERE id % 29 = 0) AS edges, count(*) FILTER (WHERE id % 29 = 0) AS created, count(*) FILTER (WHERE id % 13 <> 0) AS reused,
      count(*) FILTER (WHERE id % 13 = 0 AND id % 17 <> 0) AS removed, count(*) FILTER (WHERE id % 13 = 0 AND id % 17 = 0) AS stale_kept,
      count(*) FILTER (WHERE to_asset_id IS NOT NULL AND (id % 13 <> 0 OR id % 17 = 0)) + count(*) FILTER (WHERE to_asset_id IS NOT NULL AND id % 29 = 0) AS resolved FROM edge""")
def rel_upsert_report(t: Tables) -> DataFrame:
    return relations.relation_report(_relation_changes(t)).select("edges", "created", "reused", "removed", "stale_kept", "resolved")


@query("SELECT id, CASE WHEN id % 17 = 0 THEN 'kept' ELSE 'removed' END AS dangling FROM edge WHERE from_asset_id % 31 = 0 OR to_asset_id % 31 = 0")
def rel_dangling_sweep(t: Tables) -> DataFrame:
    return relations.sweep_dangling(_store(t), t.asset.where("id % 31 <> 0").select("id", "name")).where("dangling is not null").select(_number().alias("id"), "dangling")


# ---------------------------------------------------------------- diagram evidence


def _own_columns(t: Tables) -> DataFrame:
    return t.edge.select(F.col("from_asset_id").alias("asset_id"), F.col("from_column").alias("name"))


@query("SELECT from_asset_id AS child, lower(from_column) AS fk_key, count(DISTINCT to_asset_id) AS n_parents FROM edge WHERE to_asset_id IS NOT NULL AND id % 7 IN (0, 1) AND (id % 7 = 0 OR EXISTS (SELECT 1 FROM edge x WHERE x.from_asset_id = edge.to_asset_id AND x.from_column = edge.from_column) IS NOT NULL) GROUP BY 1, 2")
def er_overlay_multi_parent(t: Tables) -> DataFrame:
    lines = documents.diagram_relations(t.diagram_lines).where("kind IN ('ONE_TO_MANY', 'MANY_TO_ONE')")
    # of the fixture, children are on the right of every line; turn those of the other kind
    turned = F.col("kind") == "MANY_TO_ONE"
    lines = lines.withColumns({"left_table": F.when(turned, F.col("right_table")).otherwise(F.col("left_table")), "right_table": F.when(turned, F.col("left_table")).otherwise(F.col("right_table"))})
    return relations.parents_at(relations.oriented(lines, t.asset.select("id", "name"), _own_columns(t)))


#: Lines of the overlay's fixture: classes of id % 20, place at the position, kind, left and right end, evidence, label, columns.
#: Odd classes are not stored; 6, 8, 10 and 14 are stored without target; up to two lines meet at a position.
DRAWN = [
    ((0, 1, 2, 3, 4, 5, 6, 7, 10), 0, "ONE_TO_MANY", "to", "from", "注释明示", "x", "own"),
    ((3,), 1, "ONE_TO_ONE", "to", "from", "注释明示", "x", "own"),
    ((5,), 1, "ONE_TO_MANY", "from", "to", "注释明示", "x", "own"),
    ((7, 10), 1, "ONE_TO_MANY", "from", "from", "注释明示", "x", "own"),
    ((8,), 0, "MANY_TO_ONE", "from", "to", "注释明示", "弱关联", "own"),
    ((9,), 0, "ONE_TO_MANY", "to", "from", "注释明示", "x", "none"),
    ((11,), 0, "ONE_TO_MANY", "to", "from", "注释明示", "x", "other"),
    ((12,), 0, "ONE_TO_MANY", "from", "from", "注释明示", "x", "own"),
    ((13, 14), 0, "ONE_TO_ONE", "to", "from", "注释明示", "x", "own"),
    ((15,), 0, "AMBIGUOUS", "to", "from", "注释明示", "x", "own"),
    ((16, 18), 0, "ONE_TO_MANY", "to", "from", "索引佐证", "x", "own"),
    ((16, 18), 1, "MANY_TO_ONE", "from", "to", "注释明示", "x", "own"),
    ((17,), 0, "MANY_TO_MANY", "to", "from", "注释明示", "x", "own"),
    ((19,), 0, "UNSUPPORTED_SYMBOL", "to", "from", "注释明示", "x", "own"),
    ((19,), 1, "ONE_TO_MANY", "nowhere", "from", "注释明示", "x", "own"),
]


def _overlay(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every edge with two different ends takes part in one of twenty ways, on a position of its own."""
    own = F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("_id"))
    ends = t._ends().where("to_name IS NOT NULL AND from_asset_id <> to_asset_id").withColumn("r", F.col("id") % 20).withColumn("id", _id()).withColumn("from_column", own)
    end = {"to": F.col("to_name"), "from": F.col("from_name"), "nowhere": F.lit("no_such_table")}
    names = {"own": F.array("from_column"), "other": F.array(F.lit("nope_id")), "none": F.array().cast("array<string>")}
    cardinality = {"ONE_TO_MANY": "1:N", "MANY_TO_ONE": "1:N", "ONE_TO_ONE": "1:1"}

    def drawn(nth, kind, left, right, level, label, columns, late):
        level = F.when(F.col("r").isin(*late), "待确认").otherwise(level)
        facts = {"line_no": (F.col("id") * 2 + nth).cast("int"), "left_table": end[left], "right_table": end[right], "kind": F.lit(kind), "cardinality": F.lit(cardinality.get(kind)).cast("string"), "evidence_level": level}
        facts |= {"confidence": F.lit(0.8), "cross_domain": F.lit(None).cast("string"), "from_columns": names[columns], "to_column": F.lit("id"), "label": F.lit(label)}
        return F.struct(F.lit("01/e").alias("doc"), *[c.alias(n) for n, c in facts.items()])

    each = F.array_compact(F.array(*[F.when(F.col("r").isin(*classes), drawn(*rest, (3,) if rest[0] == 0 else ())) for classes, *rest in DRAWN]))
    lines = ends.select(F.inline(each))
    store = _store(t).withColumn("from_column", own).where(_number() % 2 == 0).withColumn("to_asset_id", F.when((_number() % 20).isin(6, 8, 10, 14), None).otherwise(F.col("to_asset_id")))
    owners = ends.select(F.explode(F.when(F.col("r") == 5, F.array("from_asset_id", "to_asset_id")).otherwise(F.array("from_asset_id"))).alias("asset_id"), F.col("from_column").alias("name"))
    return relations.overlay(store, lines, t.asset.select("id", "name"), owners)


@query("""
    SELECT from_asset_id, to_asset_id, concat('c', CAST(id AS STRING), '_id') AS from_column, 'ER证据摘录' AS origin, '1:N' AS cardinality, '注释明示' AS evidence_level, id % 20 = 7 AS conflict_flag
    FROM edge WHERE id % 20 IN (1, 3, 5, 7) AND to_asset_id IS NOT NULL AND to_asset_id <> from_asset_id""")
def er_overlay_new_edges(t: Tables) -> DataFrame:
    after, _ = _overlay(t)
    number = F.regexp_extract("from_column", "[0-9]+", 0).cast("long")
    named = after.where("origin <> '逻辑FK列'").select("*", number.alias("column_id")).withColumn("from_column", F.expr("concat('c', column_id div 2, '_id')"))
    return named.select("from_asset_id", "to_asset_id", "from_column", "origin", "cardinality", "evidence_level", "conflict_flag")


COUNTED = """, e AS (SELECT id % 20 AS r, id % 2 = 0 AND confirm_status <> '驳回' AS live, cardinality IS NULL AS bare, CASE evidence_level WHEN '注释明示' THEN 1 WHEN '索引佐证' THEN 2 ELSE 3 END AS rank
      FROM edge WHERE to_asset_id IS NOT NULL AND to_asset_id <> from_asset_id),
    c AS (
      SELECT 'new_edges' AS counter, count(*) FILTER (WHERE r IN (1, 3, 5, 7)) AS n FROM e
      UNION ALL SELECT 'matched', count(*) FILTER (WHERE r = 3 OR live AND r <> 12) + count(*) FILTER (WHERE live AND r IN (10, 16, 18)) FROM e
      UNION ALL SELECT 'cardinality_filled', count(*) FILTER (WHERE live AND bare AND r IN (0, 2, 4, 6, 16, 18)) FROM e
      UNION ALL SELECT 'evidence_upgraded', count(*) FILTER (WHERE r = 3 OR live AND rank > 1 AND r IN (0, 2, 4, 6, 16, 18)) + count(*) FILTER (WHERE live AND rank > 2 AND r IN (16, 18)) FROM e
      UNION ALL SELECT 'resolved_prose', count(*) FILTER (WHERE live AND r = 6) FROM e UNION ALL SELECT 'deferred_denial', count(*) FILTER (WHERE live AND r = 8) FROM e
      UNION ALL SELECT 'deferred_multi', 2 * count(*) FILTER (WHERE live AND r = 10) FROM e UNION ALL SELECT 'conflicts', count(*) FILTER (WHERE r = 7 OR live AND r = 12) FROM e
      UNION ALL SELECT v.counter, count(e.r) FROM (VALUES ('skipped_reverse', 5), ('skipped_no_column', 9), ('skipped_not_owned', 11), ('skipped_ambiguous', 13), ('cardinality_clash', 15), ('skipped_multi', 17), ('skipped_unsupported', 19), ('skipped_endpoint', 19)) v(counter, r) LEFT JOIN e ON e.r = v.r GROUP BY 1)"""


@query(f"{COUNTED} SELECT counter, n FROM c WHERE n > 0")
def er_overlay_counters(t: Tables) -> DataFrame:
    """All sixteen counters, with lines that meet at one position."""
    return _overlay(t)[1]


# ---------------------------------------------------------------- exports


@query("SELECT g.asset_urn, g.grading, (SELECT count(*) FROM col c WHERE c.asset_id = g.id) AS n_columns, (SELECT string_agg(c.name, ',' ORDER BY c.ordinal) FROM col c WHERE c.asset_id = g.id) AS columns FROM graded g WHERE g.domain_code = 'D05'")
def export_asset_rows(t: Tables) -> DataFrame:
    rows = sinks.asset_documents(t.graded, t.col, domain="d05")
    names = F.array_join(F.transform("columns", lambda x: x["name"]), ",")
    return rows.select("asset_urn", "grading", F.coalesce(F.size("columns"), F.lit(0)).cast("long").alias("n_columns"), names.alias("columns"))


@query("""
    SELECT e.id, f.asset_urn AS from_urn, g.asset_urn AS to_urn, g.asset_urn IS NOT NULL AND g.domain_code IS DISTINCT FROM 'D05' AS external_target
    FROM edge e JOIN graded f ON f.id = e.from_asset_id AND f.domain_code = 'D05' LEFT JOIN graded g ON g.id = e.to_asset_id""")
def export_relations_slice(t: Tables) -> DataFrame:
    chosen = sinks.asset_documents(t.graded, t.col, domain="D05")
    return sinks.relation_slice(t.edge, t.graded, chosen).select("id", "from_urn", "to_urn", "external_target")
