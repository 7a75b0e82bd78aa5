"""Queries over lineage, impact and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import lineage, relations, versions
from cairn.operators.keys import staged
from cairn.plans.registry import query
from cairn.plans.tables import Tables


def _walk(here: str, there: str, root: int, depth: int = 6) -> str:
    """DuckDB: the canonical row of every node reached, as tree(node, depth, parent, edge_id)."""
    return f""", walk(node, depth, parent, edge_id, path) AS (
        SELECT CAST({root} AS BIGINT), 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), [CAST({root} AS BIGINT)]
        UNION ALL SELECT e.{there}, w.depth + 1, w.node, e.id, list_append(w.path, e.{there}) FROM walk w JOIN edge e ON e.{here} = w.node
        WHERE w.depth < {depth} AND e.{there} IS NOT NULL AND NOT list_contains(w.path, e.{there})),
      tree AS (SELECT node, depth, parent, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, edge_id) AS n FROM walk) x WHERE n = 1)
      """


DOWN, UP = _walk("to_asset_id", "from_asset_id", 1), _walk("from_asset_id", "to_asset_id", 1500)
ROWS = "SELECT node, CAST(depth AS BIGINT) AS depth, parent, edge_id FROM tree"


def _rows(tree: DataFrame) -> DataFrame:
    return tree.select("node", F.col("depth").cast("long").alias("depth"), "parent", "edge_id")


@query(f"{DOWN} {ROWS}")
def lineage_downstream(t: Tables) -> DataFrame:
    return _rows(lineage.tree(t.edge, 1))


@query(f"{UP} {ROWS}")
def lineage_upstream(t: Tables) -> DataFrame:
    return _rows(lineage.tree(t.edge, 1500, "UPSTREAM"))


@query(f"{_walk('to_asset_id', 'from_asset_id', 1, 10)} {ROWS}")
def lineage_levels(t: Tables) -> DataFrame:
    return _rows(lineage.tree(t.edge, 1, depth=10))


CAPPED = ", kept AS (SELECT * FROM tree ORDER BY depth, node LIMIT 50)"


@query(f"{DOWN} {CAPPED} SELECT k.node AS id, a.name, CAST(k.depth AS BIGINT) AS depth FROM kept k JOIN asset a ON a.id = k.node")
def lineage_capped(t: Tables) -> DataFrame:
    return lineage.trace(t.edge, t.asset, 1, limit=50).nodes.select("id", "name", F.col("depth").cast("long").alias("depth"))


@query(f"{DOWN} {CAPPED} SELECT e.id FROM edge e WHERE e.from_asset_id IN (SELECT node FROM kept) AND e.to_asset_id IN (SELECT node FROM kept)")
def lineage_edges(t: Tables) -> DataFrame:
    return lineage.trace(t.edge, t.asset, 1, limit=50).edges.select("id")


# which nations' suppliers deliver to which: nearly every pair, so simple paths abound and the budget of 404 ends the walk in its second level
DENSE = """, dense(id, f, g) AS (SELECT DISTINCT s_nationkey * 25 + c_nationkey, CAST(c_nationkey AS BIGINT), CAST(s_nationkey AS BIGINT) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey),
    ways AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS edge_id UNION ALL SELECT f, 1, g, id FROM dense WHERE g = 1
      UNION ALL SELECT b.f, 2, b.g, b.id FROM dense a JOIN dense b ON b.g = a.f WHERE a.g = 1 AND b.f <> 1),
    near AS (SELECT * FROM ways ORDER BY depth, node, edge_id LIMIT 404), firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, edge_id) = 1)"""


@query(f"{DENSE} SELECT node AS id, n_name AS name, CAST(depth AS BIGINT) AS depth, CAST(parent_id AS BIGINT) AS parent_id, CAST(edge_id AS BIGINT) AS edge_id, (SELECT count(*) > 404 FROM ways) AS truncated FROM firsts JOIN nation ON n_nationkey = node")
def lineage_dense(t: Tables) -> DataFrame:
    line, orders = t.raw("lineitem").select("l_orderkey", "l_suppkey"), t.raw("orders").select("o_orderkey", "o_custkey")
    customer, supplier = t.raw("customer").select("c_custkey", "c_nationkey"), t.raw("supplier").select("s_suppkey", "s_nationkey")
    pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").cast("long").alias("from_asset_id"), F.col("s_nationkey").cast("long").alias("to_asset_id")).distinct()
    edges = staged(pairs.withColumn("id", F.col("to_asset_id") * 25 + F.col("from_asset_id")))
    seen = lineage.trace(edges, t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 1, depth=10, limit=100)
    return seen.nodes.withColumns({"depth": F.col("depth").cast("long"), "truncated": F.lit(seen.truncated)})


@query(f"{DOWN} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM tree GROUP BY 1")
def lineage_depth_histogram(t: Tables) -> DataFrame:
    return lineage.tree(t.edge, 1).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


# the impact list of the nodes that are kept: a view's in impact_list, every one where they are counted
LISTED = """, named AS (SELECT k.*, a.name FROM kept k JOIN asset a ON a.id = k.node),
    p(node, path) AS (SELECT node, name FROM named WHERE depth = 0 UNION ALL SELECT n.node, concat(p.path, ' → ', n.name) FROM p JOIN named n ON n.parent = p.node),
    rows AS (SELECT n.name AS affected_asset, g.domain_code, g.grading, CAST(n.depth AS BIGINT) AS depth, u.name AS via_parent, e.from_column AS via_column, p.path AS impact_path, e.cardinality, e.evidence_level, e.confidence, e.origin
      FROM named n JOIN p ON p.node = n.node JOIN graded g ON g.id = n.node JOIN asset u ON u.id = n.parent JOIN edge e ON e.id = n.edge_id WHERE n.depth > 0)
    """
IMPACT = DOWN + ", kept AS (SELECT * FROM tree ORDER BY depth, node LIMIT 200)" + LISTED


@query(f"{IMPACT} SELECT * FROM rows")
def impact_list(t: Tables) -> DataFrame:
    return lineage.impact(t.edge, t.graded, 1).withColumn("depth", F.col("depth").cast("long"))


@query(f"{DOWN}, kept AS (SELECT * FROM tree){LISTED} SELECT coalesce(domain_code, '?') AS domain_code, count(*) AS n, max(depth) AS deepest FROM rows GROUP BY 1")
def impact_by_domain(t: Tables) -> DataFrame:
    rows = lineage.affected(t.edge, t.graded, 1)
    return rows.groupBy(F.coalesce("domain_code", F.lit("?")).alias("domain_code")).agg(F.count("*").alias("n"), F.max(F.col("depth").cast("long")).alias("deepest"))


@query("""
    SELECT e.id, d.direction, f.name AS from_name, g.name AS to_name FROM edge e JOIN (VALUES ('out'), ('in')) d(direction) ON (d.direction = 'out' AND e.from_asset_id = 8) OR (d.direction = 'in' AND e.to_asset_id = 8)
    LEFT JOIN asset f ON f.id = e.from_asset_id LEFT JOIN asset g ON g.id = e.to_asset_id""")
def asset_relations_in_out(t: Tables) -> DataFrame:
    return relations.relations_of(t.edge, t.asset, 8).select("id", "direction", "from_name", "to_name")


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fk_chain_region_to_orders(t: Tables) -> DataFrame:
    # each level is counted before the next join, so no join multiplies rows
    orders = t.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    by_customer = t.raw("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))
    nations = t.raw("nation").join(by_customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return nations.groupBy("r_name").agg(F.count("*").alias("nations"), zero("customers"), zero("orders"))


# ---------------------------------------------------------------- versions: v1, then v2 with changed types, new and missing tables, then v3 with a missing column

ASSETS = {1: "id % 20 <> 0", 2: "id % 23 <> 0", 3: "id % 23 <> 0 AND id % 29 <> 0"}
COLUMNS = {1: "k > 0", 2: "k <> 3", 3: "k <> 3 AND k <> 4"}


def _version(t: Tables, n: int) -> DataFrame:
    kind = F.when((F.lit(n) > 1) & (F.col("k") % 15 == 0), F.lit("json")).otherwise(F.col("type"))
    return versions.signatures(t.asset.where(ASSETS[n]), t.col.where(COLUMNS[n]).withColumn("type", kind))


def _items(t: Tables, n: int) -> DataFrame:
    return versions.snapshot(_version(t, n), None if n == 1 else _items(t, n - 1))


def _signature_sql(n: int) -> str:
    kind = "CASE WHEN k % 15 = 0 THEN 'json' ELSE type END" if n > 1 else "type"
    return f"""s{n} AS (SELECT a.asset_urn, a.name AS asset_name, coalesce(s.signature, '') AS signature, sha256(coalesce(s.signature, '')) AS schema_hash FROM (SELECT * FROM asset WHERE {ASSETS[n]}) a LEFT JOIN (
        SELECT asset_id, string_agg(x, chr(1) ORDER BY x) AS signature FROM (SELECT asset_id, concat(name, '|', upper({kind}), '|', upper(nullable)) AS x FROM col WHERE {COLUMNS[n]}) c GROUP BY 1) s ON s.asset_id = a.id)"""


def _diff_sql(n: int) -> str:
    return f"""d{n} AS (SELECT coalesce(n.asset_urn, o.asset_urn) AS asset_urn, CASE WHEN o.asset_urn IS NULL THEN 'ADDED' WHEN n.asset_urn IS NULL THEN 'DROPPED' WHEN o.schema_hash = n.schema_hash THEN 'RETAINED' ELSE 'CHANGED' END AS change_type,
        coalesce(n.schema_hash, o.schema_hash) AS schema_hash FROM s{n - 1} o FULL JOIN s{n} n ON o.asset_urn = n.asset_urn)"""


S12 = f", {_signature_sql(1)}, {_signature_sql(2)}, {_diff_sql(2)}"


@query(f", {_signature_sql(1)} SELECT * FROM s1")
def version_signature(t: Tables) -> DataFrame:
    return _version(t, 1)


@query(f"{S12} SELECT * FROM d2")
def version_diff(t: Tables) -> DataFrame:
    return _items(t, 2).select("asset_urn", "change_type", "schema_hash")


@query(f"{S12} SELECT change_type, count(*) AS n FROM d2 GROUP BY 1")
def version_summary(t: Tables) -> DataFrame:
    return versions.summary(_items(t, 2))


@query(f", {_signature_sql(2)}, {_signature_sql(3)}, {_diff_sql(3)} SELECT * FROM d3")
def version_tombstone(t: Tables) -> DataFrame:
    return _items(t, 3).select("asset_urn", "change_type", "schema_hash")


@query(f"""{S12}, o AS (SELECT a.asset_urn, c.name, concat(upper(type), '|', nullable) AS v FROM asset a JOIN col c ON c.asset_id = a.id WHERE {COLUMNS[1]}),
    n AS (SELECT a.asset_urn, c.name, concat(CASE WHEN k % 15 = 0 THEN 'JSON' ELSE upper(type) END, '|', nullable) AS v FROM asset a JOIN col c ON c.asset_id = a.id WHERE {COLUMNS[2]}),
    b AS (SELECT coalesce(o.asset_urn, n.asset_urn) AS asset_urn, coalesce(o.name, n.name) AS col_name, o.v AS ov, n.v AS nv FROM o FULL JOIN n ON o.asset_urn = n.asset_urn AND o.name = n.name)
    SELECT b.asset_urn, col_name AS "column", CASE WHEN ov IS NULL THEN 'ADDED' WHEN nv IS NULL THEN 'DROPPED' ELSE 'CHANGED' END AS delta, CASE WHEN ov IS NULL OR nv IS NULL THEN col_name ELSE concat(col_name, ': ', ov, ' → ', nv) END AS text
    FROM b JOIN d2 ON d2.asset_urn = b.asset_urn AND d2.change_type = 'CHANGED' WHERE ov IS DISTINCT FROM nv""")
def version_column_delta(t: Tables) -> DataFrame:
    return versions.column_delta(_items(t, 2), _items(t, 1))


def _sources(t: Tables) -> DataFrame:
    new = t.asset.where(ASSETS[2]).select("name", F.when(F.col("id") % 15 == 0, F.col("n_columns") + 1).otherwise(F.col("n_columns")).alias("column_count"))
    return versions.compare_sources(t.asset.where(ASSETS[1]).select("name", F.col("n_columns").alias("column_count")), new)


SOURCES = f""", c AS (SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'ADDED' WHEN n.name IS NULL THEN 'DROPPED' ELSE 'RETAINED' END AS change, o.name IS NOT NULL AND n.name IS NOT NULL AND n.id % 15 = 0 AS recounted, o.name AS o, n.name AS n
    FROM (SELECT * FROM asset WHERE {ASSETS[1]}) o FULL JOIN (SELECT * FROM asset WHERE {ASSETS[2]}) n ON o.name = n.name)"""


@query(f"{SOURCES} SELECT name, change, recounted FROM c")
def ddl_source_compare(t: Tables) -> DataFrame:
    return _sources(t).select("name", "change", "recounted")


@query(f"{SOURCES} SELECT count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'DROPPED') AS dropped, count(*) FILTER (WHERE change = 'RETAINED') AS retained, count(n) AS n_new, count(o) AS n_old, count(*) FILTER (WHERE recounted) AS recounted, count(*) FILTER (WHERE change = 'DROPPED') = 0 AND count(*) FILTER (WHERE change = 'ADDED') > 0 AS strict_superset FROM c")
def ddl_source_report(t: Tables) -> DataFrame:
    return versions.compare_report(_sources(t))
