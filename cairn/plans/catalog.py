"""Queries over calls of the catalog: traces by name, versions, terms, code values and names."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import catalog, dq, lineage, upsert, versions
from cairn.operators.keys import delete, shared_dir
from cairn.plans.graph import ASSETS, DOWN, S12, _diff_sql, _items, _signature_sql
from cairn.plans.registry import query
from cairn.plans.tables import Tables
from cairn.streaming import audit

# ---------------------------------------------------------------- traces


def _budget(limit: int) -> str:
    """DuckDB: the nodes of a trace of at most limit nodes and 4 (limit + 1) paths, and whether it was truncated."""
    most = 4 * (limit + 1)
    return f"""{DOWN}, few AS (SELECT * FROM walk ORDER BY depth, node, edge_id LIMIT {most}),
      near AS (SELECT node, depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, edge_id) AS n FROM few) x WHERE n = 1),
      held AS (SELECT * FROM near ORDER BY depth, node LIMIT {limit}),
      said AS (SELECT (SELECT count(*) FROM walk) > {most} OR (SELECT count(*) FROM near) > {limit} AS truncated)"""


@query(f"{_budget(20)} SELECT h.node AS id, a.name, CAST(h.depth AS BIGINT) AS depth, truncated FROM held h JOIN asset a ON a.id = h.node, said")
def lineage_truncated(t: Tables) -> DataFrame:
    found = lineage.trace(t.edge, t.asset, 1, limit=20)
    return found.nodes.select("id", "name", F.col("depth").cast("long").alias("depth"), F.lit(found.truncated).alias("truncated"))


@query(f"{DOWN}, kept AS (SELECT * FROM tree ORDER BY depth, node LIMIT 200) SELECT k.node AS id, a.name FROM kept k JOIN asset a ON a.id = k.node")
def lineage_by_name(t: Tables) -> DataFrame:
    name = t.asset.where("id = 1").select(F.upper("name").alias("name")).first()["name"]
    return lineage.lookup(t.edge, t.asset, name, seconds=None).nodes.select("id", "name")


@query(f"""{DOWN}, kept AS (SELECT * FROM tree ORDER BY depth, node LIMIT 200), named AS (SELECT k.*, a.name FROM kept k JOIN asset a ON a.id = k.node WHERE k.node % 3 <> 0),
    p(node, path) AS (SELECT n.node, CASE WHEN n.depth = 0 THEN n.name ELSE concat((SELECT name FROM asset WHERE id = 1), '… → ', n.name) END FROM named n WHERE n.depth = 0 OR n.parent NOT IN (SELECT node FROM named)
      UNION ALL SELECT n.node, concat(p.path, ' → ', n.name) FROM p JOIN named n ON n.parent = p.node)
    SELECT n.name AS affected_asset, p.path AS impact_path FROM named n JOIN p ON p.node = n.node WHERE n.depth > 0""")
def impact_broken_chain(t: Tables) -> DataFrame:
    return lineage.impact(t.edge, t.graded.where("id % 3 <> 0"), 1).select("affected_asset", "impact_path")


# ---------------------------------------------------------------- versions

COUNTS = ", ".join(f"count(*) FILTER (WHERE change_type = '{x}') AS {x.lower()}" for x in ("ADDED", "RETAINED", "CHANGED", "DROPPED"))
HEADERS = f"""{S12}, {_signature_sql(3)}, {_diff_sql(3)}, head AS (
    SELECT CAST(1 AS BIGINT) AS version_no, 'FULL' AS kind, 'first' AS note, CAST(2 AS BIGINT) AS signature_algo, count(*) AS added, CAST(0 AS BIGINT) AS retained, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS dropped FROM s1
    UNION ALL SELECT 2, 'INCREMENT', NULL, 2, {COUNTS} FROM d2
    UNION ALL SELECT 3, 'INCREMENT', NULL, 2, {COUNTS} FROM d3)"""


def _headers(t: Tables) -> DataFrame:
    first = versions.header(_items(t, 1), 1, None, "first")
    return first.unionByName(versions.header(_items(t, 2), 2, first)).unionByName(versions.header(_items(t, 3), 3, first))


@query(f"{HEADERS} SELECT * FROM head")
def version_list(t: Tables) -> DataFrame:
    return versions.history(_headers(t))


@query(f"{HEADERS} SELECT * FROM head WHERE version_no = 2")
def version_get(t: Tables) -> DataFrame:
    return versions.get(_headers(t), 2)


@query(f"{S12} SELECT d.asset_urn, coalesce(n.asset_name, o.asset_name) AS asset_name, change_type FROM d2 d LEFT JOIN s1 o ON o.asset_urn = d.asset_urn LEFT JOIN s2 n ON n.asset_urn = d.asset_urn WHERE change_type <> 'RETAINED'")
def version_changes(t: Tables) -> DataFrame:
    return versions.changes(_items(t, 2))


@query(f", {_signature_sql(2)} SELECT asset_urn, 'ADDED' AS change_type FROM s2")
def version_full_after_other_algorithm(t: Tables) -> DataFrame:
    now = versions.signatures(t.asset.where(ASSETS[2]), t.col.where("k <> 3"))
    return versions.snapshot(now, _items(t, 1), before_algorithm=1).select("asset_urn", "change_type")


# ---------------------------------------------------------------- seeds, code values and terms

CODES_SQL = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in catalog.CODES)
SEEDED = f""", given(category, code_value, meaning, ordinal) AS (VALUES {CODES_SQL}),
    codes AS (SELECT id, category, code_value, meaning, ordinal FROM code UNION ALL SELECT NULL, category, code_value, meaning, ordinal FROM given g WHERE NOT EXISTS (SELECT 1 FROM code c WHERE c.category = g.category AND c.code_value = g.code_value))"""


def _codes(t: Tables) -> DataFrame:
    return upsert.insert_seeds({"code_value": t.code})["code_value"]


@query(f"{SEEDED} SELECT category, code_value, meaning, ordinal, id AS kept_id, (SELECT count(*) FROM codes) AS ids FROM codes")
def seed_code_values(t: Tables) -> DataFrame:
    """Codes that the tables use, and the seeds beside them; which of the new ids a row gets is not told, only that each is new."""
    rows = _codes(t)
    top, ids = t.code.agg(F.max("id")).first()[0], rows.agg(F.countDistinct("id")).first()[0]
    return rows.select("category", "code_value", "meaning", "ordinal", F.when(F.col("id") <= top, F.col("id")).alias("kept_id"), F.lit(ids).cast("long").alias("ids"))


@query(f"{SEEDED} SELECT code_value, ordinal, meaning FROM codes WHERE category = 'confirm_status'")
def code_values_of_category(t: Tables) -> DataFrame:
    return catalog.code_values(_codes(t), "confirm_status").select("code_value", "ordinal", "meaning")


#: Of every table with seeds: its rows by SQL, their key, a field that a seed must not change, and the seeds' keys with that field.
SEED_PARTS = {
    "dq_rule": ("SELECT id, code AS key, checker AS fact FROM rule", [(r[0], r[3]) for r in dq.RULES]),
    "naming_rule": ("SELECT id, name, pattern FROM naming", [(r[0], r[2]) for r in catalog.NAMING]),
    "standard_field": ("SELECT id, field_name, semantic FROM field", [(r[0], r[3]) for r in catalog.FIELDS]),
    "term": ("SELECT id, CASE id WHEN 5 THEN '贸易商' ELSE name END, domain_code FROM term", [(r[0], r[1]) for r in catalog.TERMS]),
    "user": ("SELECT id, username, role FROM member", [(r[0], r[2]) for r in catalog.USERS]),
}
_GIVEN = ", ".join(f"('{e}', '{k}', '{f}')" for e, (_, rows) in SEED_PARTS.items() for k, f in rows)
_HELD = " UNION ALL ".join(f"SELECT '{e}' AS entity, x.* FROM ({sql}) x(id, key, fact)" for e, (sql, _) in SEED_PARTS.items())


@query(f""", held AS ({_HELD}), given(entity, key, fact) AS (VALUES {_GIVEN})
    SELECT entity, key, fact, id AS kept_id FROM held UNION ALL SELECT entity, key, fact, NULL FROM given g WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.entity = g.entity AND h.key = g.key)""")
def seeds_inserted(t: Tables) -> DataFrame:
    """All seeds over tables that hold one of most kinds already, under other facts, which stay."""
    stored = {"dq_rule": t.rule, "naming_rule": t.naming, "standard_field": t.field, "term": t.term.withColumn("name", F.when(F.col("id") == 5, "贸易商").otherwise(F.col("name"))), "user": t.member}
    shown = {"dq_rule": ("code", "checker"), "naming_rule": ("name", "pattern"), "standard_field": ("field_name", "semantic"), "term": ("name", "domain_code"), "user": ("username", "role")}
    parts = []
    for entity, rows in upsert.insert_seeds(stored).items():
        top = stored[entity].agg(F.max("id")).first()[0]
        key, fact = shown[entity]
        parts.append(rows.select(F.lit(entity).alias("entity"), F.col(key).alias("key"), F.col(fact).alias("fact"), F.when(F.col("id") <= top, F.col("id")).alias("kept_id")))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT id, CASE id WHEN 2 THEN 'renamed' ELSE field_name END AS field_name, CASE id WHEN 2 THEN 'json' ELSE data_type END AS data_type, CASE WHEN id <> 2 THEN length_val END AS length_val, CASE WHEN id <> 2 THEN semantic END AS semantic, id = 2 OR enabled AS enabled
    FROM field WHERE id <> 4 UNION ALL SELECT (SELECT max(id) FROM field) + 1, 'made', 'varchar', 30, NULL, true""")
def dictionary_fields(t: Tables) -> DataFrame:
    """A standard field made, one replaced by what is given, one deleted."""
    rows = catalog.create_entry(t.field, "standard_field", field_name="made", data_type="varchar", length_val=30)
    return catalog.delete_entry(catalog.update_entry(rows, "standard_field", 2, field_name="renamed", data_type="json"), "standard_field", 4)


@query("""SELECT id, CASE id WHEN 2 THEN 'changed' ELSE category END AS category, CASE id WHEN 2 THEN 'x' ELSE code_value END AS code_value, CASE WHEN id <> 2 THEN meaning END AS meaning, ordinal
    FROM code WHERE id <> 4 UNION ALL SELECT (SELECT max(id) FROM code) + 1, 'made', 'y', NULL, 0""")
def dictionary_codes(t: Tables) -> DataFrame:
    rows = catalog.create_entry(t.code, "code_value", category="made", code_value="y")
    return catalog.dictionary_list(catalog.delete_entry(catalog.update_entry(rows, "code_value", 2, category="changed", code_value="x"), "code_value", 4), "code_value")


@query("""SELECT id, name, target, pattern, description, enabled
    FROM naming WHERE id NOT IN (2, 4) UNION ALL SELECT 2, 'two', 'column', '^[a-z]+$', NULL, false UNION ALL SELECT (SELECT max(id) FROM naming) + 1, 'made', 'table', 'a|b', 'either', true""")
def dictionary_naming(t: Tables) -> DataFrame:
    rows = catalog.create_entry(t.naming, "naming_rule", name="made", target="table", pattern="a|b", description="either")
    return catalog.delete_entry(catalog.update_entry(rows, "naming_rule", 2, name="two", target="column", pattern="^[a-z]+$", enabled=False), "naming_rule", 4)


@query("""SELECT 'summary' AS part, id AS at, name, concat(coalesce(grading, '?'), ' ', CAST(n_columns AS STRING)) AS fact FROM graded WHERE id = 8
    UNION ALL SELECT 'column', ordinal, name, type FROM col WHERE asset_id = 8
    UNION ALL SELECT 'out', e.id, g.name, from_column FROM edge e LEFT JOIN asset g ON g.id = e.to_asset_id WHERE e.from_asset_id = 8
    UNION ALL SELECT 'in', e.id, f.name, from_column FROM edge e LEFT JOIN asset f ON f.id = e.from_asset_id WHERE e.to_asset_id = 8""")
def asset_detail(t: Tables) -> DataFrame:
    urn = t.asset.where("id = 8").select("asset_urn").first()["asset_urn"]
    d = catalog.detail(t.graded, t.col, t.edge, urn)
    row = lambda df, part, at, name, fact: df.select(part.alias("part"), F.col(at).cast("long").alias("at"), name.alias("name"), fact.alias("fact"))
    said = F.concat_ws(" ", F.coalesce("grading", F.lit("?")), F.col("n_columns").cast("string"))
    other = F.when(F.col("direction") == "out", F.col("to_name")).otherwise(F.col("from_name"))
    return row(d["summary"], F.lit("summary"), "id", F.col("name"), said).unionByName(row(d["columns"], F.lit("column"), "ordinal", F.col("name"), F.col("type"))).unionByName(row(d["relations"], F.col("direction"), "id", other, F.col("from_column")))


@query("""SELECT id, CASE WHEN id = 2 THEN 'renamed' ELSE name END AS name, domain_code, CASE WHEN id = 2 THEN 'PUBLISHED' ELSE status END AS status FROM term WHERE id <> 3
    UNION ALL SELECT (SELECT max(id) FROM term) + 1, 'a new term', 'D07', 'DRAFT'""")
def term_changes(t: Tables) -> DataFrame:
    users = t.spark.createDataFrame([(i + 1, *u) for i, u in enumerate(catalog.USERS)], "id long, username string, display string, role string")
    terms = catalog.add_term(t.term, "a new term", users, domain_code="D07")
    terms = catalog.update_term(terms, 2, name="renamed", status="PUBLISHED")
    return catalog.delete_term(terms, t.ref, 3)[0]


@query("SELECT * FROM ref WHERE term_id <> 3")
def term_delete_refs(t: Tables) -> DataFrame:
    return catalog.delete_term(t.term, t.ref, 3)[1]


@query("SELECT id, name FROM asset WHERE lower(name) = (SELECT lower(name) FROM asset WHERE id = 9)")
def asset_by_name(t: Tables) -> DataFrame:
    name = t.asset.where("id = 9").select(F.upper("name").alias("name")).first()["name"]
    return catalog.by_name(t.asset, name).select("id", "name")


# ---------------------------------------------------------------- names


@query("""(SELECT name, 'documented' AS missing_in FROM (SELECT name FROM asset EXCEPT ALL SELECT name FROM asset WHERE id % 50 <> 0) x) UNION ALL SELECT 'ghost_table', 'found'""")
def documented_names(t: Tables) -> DataFrame:
    ghost = t.spark.createDataFrame([("ghost_table",)], "name string")
    return dq.name_differences(t.asset, t.asset.where("id % 50 <> 0").select("name").unionByName(ghost))


# ---------------------------------------------------------------- the audit trail as a stream


@query("SELECT date_trunc('hour', at_ts) AS window_start, action, count(*) AS n FROM audit GROUP BY 1, 2 HAVING date_trunc('hour', at_ts) + INTERVAL 1 HOUR <= (SELECT max(at_ts) FROM audit) - INTERVAL 10 MINUTE")
def audit_stream_counts(t: Tables) -> DataFrame:
    """Counts of closed hours after the stream was stopped and started again, with a tenth of the earlier entries sent a second time."""
    root = f"{shared_dir(t.spark)}/audit-{uuid.uuid4().hex}"
    atexit.register(delete, t.spark, root)
    ends = t.audit.agg(F.min("at_ts").cast("double").alias("a"), F.max("at_ts").cast("double").alias("b")).first()
    middle = F.lit((ends["a"] + ends["b"]) / 2).cast("timestamp")
    rows = t.audit.withColumns({c: F.lit(None).cast("string") for c in ("target", "detail")})
    earlier, later = rows.where(F.col("at_ts") < middle), rows.where(F.col("at_ts") >= middle)
    for part in (earlier, later.unionByName(earlier.where("id % 10 = 0"))):
        audit.record(part, f"{root}/in")
        audit.write(audit.action_counts(audit.entries(t.spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.schema("window_start timestamp, action string, n long").parquet(f"{root}/out")
