"""Queries over parsed documents, search, glossary, audit, quality and the three-level model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import carried
from cairn.operators import catalog, classify, ddl, documents, dq
from cairn.operators.keys import staged
from cairn.plans.registry import query
from cairn.plans.tables import Tables

BIG = "CAST({} AS BIGINT)".format


# ---------------------------------------------------------------- DDL text


PARSED = """
    SELECT a.name AS table_name, CAST(c.ordinal AS BIGINT) AS ordinal, c.name, c.type, c.nullable,
      CASE WHEN c.nullable = 'N' AND c.k % 4 = 1 THEN concat('v', CAST(c.k AS STRING)) END AS default_val,
      CASE WHEN a.has_pk AND c.name = 'col_1' THEN 'PK' END AS key_hint, CASE WHEN c.k % 5 = 0 THEN concat('it''s column ', CAST(c.k AS STRING)) END AS meaning
    FROM asset a JOIN col c ON c.asset_id = a.id"""


def _parsed(lines: DataFrame) -> DataFrame:
    return ddl.columns(lines).select(F.col("table").alias("table_name"), F.col("ordinal").cast("long").alias("ordinal"), "name", "type", "nullable", "default_val", "key_hint", "meaning")


@query(PARSED)
def ddl_parse_columns(t: Tables) -> DataFrame:
    return _parsed(t.ddl_lines)


@query(PARSED)
def ddl_parse_dump(t: Tables) -> DataFrame:
    """All tables in one document, which is cut into chunks of lines for as many tasks."""
    number = F.substring("doc", 4, 9).cast("long") * 10_000_000 + F.col("line_no")
    return _parsed(t.ddl_lines.select(F.lit("dump").alias("doc"), number.alias("line_no"), "line"))


@query("SELECT concat('ddl', CAST(id % 64 AS STRING)) AS doc, name FROM asset WHERE NOT coalesce(has_pk, false)")
def ddl_tables_without_key(t: Tables) -> DataFrame:
    return ddl.tables_without_key(t.ddl_lines)


@query("SELECT concat('ddl', CAST(id % 64 AS STRING)) AS doc, name, CAST(2 AS BIGINT) AS n FROM asset WHERE id % 50 = 0")
def ddl_names_created_twice(t: Tables) -> DataFrame:
    """A DDL file to which some tables have been added a second time at its end."""
    again = t.asset.where("id % 50 = 0").select(F.concat(F.lit("ddl"), (F.col("id") % 64).cast("string")).alias("doc"), F.explode(F.array(F.struct((F.col("id") * 2 + 10**8).alias("line_no"), F.concat(F.lit("CREATE TABLE `"), "name", F.lit("` (")).alias("line")), F.struct((F.col("id") * 2 + 10**8 + 1).alias("line_no"), F.lit(");").alias("line")))).alias("x")).select("doc", "x.*")
    return ddl.names_created_twice(t.ddl_lines.withColumn("line_no", F.col("line_no").cast("long")).unionByName(again))


@query("""
    SELECT a.name, coalesce(has_pk, false) AS has_pk, table_comment, charset, collate_name, (SELECT count(*) FROM col c WHERE c.asset_id = a.id) AS column_count FROM asset a""")
def ddl_parse_tables(t: Tables) -> DataFrame:
    return ddl.tables(t.ddl_lines).select("name", "has_pk", "table_comment", "charset", "collate_name", F.col("column_count").cast("long").alias("column_count"))


@query("""
    SELECT concat('ddl', CAST(a.id % 64 AS STRING)) AS doc, count(*) AS unique_tables, count(*) AS raw_tables, count(*) FILTER (WHERE NOT coalesce(has_pk, false)) AS no_pk, CAST(0 AS BIGINT) AS no_comment,
      CAST(sum(n) AS BIGINT) AS n_columns, count(*) FILTER (WHERE has_pk) AS pk_lines, CAST(0 AS BIGINT) AS fk_lines
    FROM (SELECT a.*, (SELECT count(*) FROM col c WHERE c.asset_id = a.id) AS n FROM asset a) a GROUP BY 1""")
def ddl_census(t: Tables) -> DataFrame:
    return ddl.census(t.ddl_lines).select("doc", *[F.col(c).cast("long").alias(c) for c in ("unique_tables", "raw_tables", "no_pk", "no_comment", "n_columns", "pk_lines", "fk_lines")])


FAMILY = """CASE WHEN name LIKE 'N0DD15FF%' THEN 'N0DD15FF(hex)' WHEN name LIKE '%bak%' THEN '*_bak(date)' WHEN position('_' IN name) = 0 THEN '(no-prefix)' ELSE concat(split_part(name, '_', 1), '_') END"""


@query(f"SELECT id, {FAMILY} AS prefix_family FROM asset")
def prefix_family(t: Tables) -> DataFrame:
    return t.asset.select("id", classify.prefix_family("name").alias("prefix_family"))


@query(f"SELECT {FAMILY} AS prefix_family, count(*) AS n FROM asset GROUP BY 1")
def prefix_distribution(t: Tables) -> DataFrame:
    return ddl.prefix_distribution(t.asset)


# ---------------------------------------------------------------- labels


@query("SELECT id, grading, domain_code FROM graded")
def grade_assign(t: Tables) -> DataFrame:
    listed = t.asset.where("a_domain is not null").select("name", F.col("a_domain").alias("code"))
    return classify.label(t.asset, listed).select("id", "grading", "domain_code")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE grading = 'A') AS a, count(*) FILTER (WHERE grading = 'B') AS b, count(*) FILTER (WHERE grading = 'C') AS c, count(*) FILTER (WHERE grading IS NULL) AS unassigned, count(DISTINCT domain_code) AS domains FROM graded")
def labels_report(t: Tables) -> DataFrame:
    return classify.labels_report(t.graded)


@query("""
    SELECT a_domain AS code, concat('领域', a_domain) AS name, 'A' AS grading, count(*) AS declared_count FROM asset WHERE a_domain IS NOT NULL AND name NOT LIKE 'test%' GROUP BY 1, 2
    UNION ALL SELECT 'B', 'B级平台框架同构表', 'B', count(*) FROM graded WHERE grading = 'B' UNION ALL SELECT 'C', 'C级备份与测试表', 'C', count(*) FROM graded WHERE grading = 'C'""")
def domain_registry(t: Tables) -> DataFrame:
    domains = documents.domain_census(t.census_lines)
    classify.check_census(domains)
    return classify.domain_registry(domains, t.graded)


RULES = [("^lcap_|_qrtz_", "PLATFORM"), ("_bak_", "BACKUP"), ("widget", "WIDGET"), ("^jf_", "SALES"), ("^test_", "TEST")]


@query("""SELECT id, CASE WHEN regexp_matches(lower(name), '^lcap_|_qrtz_') THEN 'PLATFORM' WHEN name LIKE '%\\_bak\\_%' ESCAPE '\\' THEN 'BACKUP' WHEN contains(name, 'widget') THEN 'WIDGET' WHEN starts_with(name, 'jf_') THEN 'SALES'
    WHEN starts_with(name, 'test_') THEN 'TEST' ELSE 'UNMATCHED' END AS domain FROM asset""")
def domain_rules_first_match(t: Tables) -> DataFrame:
    return classify.first_rule(t.asset, RULES).select("id", "domain")


# ---------------------------------------------------------------- model documents

LEVEL = "CASE e.id % 5 WHEN 0 THEN '注释明示' WHEN 1 THEN '索引佐证' WHEN 2 THEN '字段命名' WHEN 3 THEN '业务语义推断' ELSE '待确认' END"
NAMED = "FROM edge e JOIN asset f ON f.id = e.from_asset_id LEFT JOIN asset g ON g.id = e.to_asset_id"


@query(f"""
    SELECT f.name AS from_table, e.from_column, coalesce(g.name, '外部系统') AS target_raw, {LEVEL} AS evidence_level, e.confidence, CASE WHEN e.id % 5 = 0 THEN 'id' END AS to_column,
      CASE WHEN e.id % 5 = 3 THEN 'D03' END AS cross_domain, CASE WHEN e.id % 5 = 2 THEN 'order_type' END AS discriminator {NAMED}""")
def logical_fk_parse(t: Tables) -> DataFrame:
    return documents.logical_relations(t.logical_lines()).select("from_table", "from_column", "target_raw", "evidence_level", "confidence", "to_column", "cross_domain", "discriminator")


@query(f"SELECT f.name AS from_table, e.from_column, e.to_asset_id, g.name AS target {NAMED}")
def logical_fk_resolve(t: Tables) -> DataFrame:
    return documents.resolve_targets(documents.logical_relations(t.logical_lines()), t.asset.select("id", "name")).select("from_table", "from_column", "to_asset_id", "target")


KIND = "CASE e.id % 7 WHEN 0 THEN 'ONE_TO_MANY' WHEN 1 THEN 'MANY_TO_ONE' WHEN 2 THEN 'MANY_TO_MANY' WHEN 3 THEN 'ONE_TO_ONE' WHEN 4 THEN 'UNSUPPORTED_SYMBOL' ELSE 'AMBIGUOUS' END"
DIAGRAM = "FROM edge e JOIN asset f ON f.id = e.from_asset_id JOIN asset g ON g.id = e.to_asset_id WHERE e.id % 7 <> 6"


@query(f"SELECT e.from_column, f.name AS right_table, {KIND} AS kind, CASE e.id % 7 WHEN 2 THEN 'N:M' WHEN 3 THEN '1:1' WHEN 0 THEN '1:N' WHEN 1 THEN '1:N' END AS cardinality {DIAGRAM}")
def er_symbol_kind(t: Tables) -> DataFrame:
    return documents.diagram_relations(t.diagram_lines).select(F.col("from_columns")[0].alias("from_column"), "right_table", "kind", "cardinality")


@query(f"SELECT {KIND} AS kind, count(*) AS n {DIAGRAM} GROUP BY 1")
def er_kind_census(t: Tables) -> DataFrame:
    return documents.diagram_relations(t.diagram_lines).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""SELECT f.name AS right_table, g.name AS left_table, e.from_column, CASE e.id % 5 WHEN 0 THEN '注释明示' WHEN 1 THEN '索引佐证' WHEN 2 THEN '字段命名' WHEN 3 THEN '业务语义推断' ELSE '待确认' END AS evidence_level,
    e.confidence, CASE WHEN e.id % 5 = 3 THEN 'D07' END AS cross_domain {DIAGRAM}""")
def er_evidence(t: Tables) -> DataFrame:
    return documents.diagram_relations(t.diagram_lines).select("right_table", "left_table", F.col("from_columns")[0].alias("from_column"), "evidence_level", "confidence", "cross_domain")


@query(f"SELECT f.name AS right_table, e.from_column AS from_columns, 'id' AS to_column {DIAGRAM}")
def er_columns(t: Tables) -> DataFrame:
    return documents.diagram_relations(t.diagram_lines).select("right_table", F.array_join("from_columns", ",").alias("from_columns"), "to_column")


@query("""
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
    FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) c""")
def section_carry_forward(t: Tables) -> DataFrame:
    turns = t.raw("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return turns.select("conv_id", "turn", carried(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("section"))


CORE = "asset"


@query(f"SELECT CASE id % 3 WHEN 0 THEN 'MASTER' WHEN 1 THEN 'TRANSACTIONAL' ELSE 'CONFIG' END AS category, lower(name) AS tokens, 'D01' AS domain_code FROM {CORE}")
def core_entity_tokens(t: Tables) -> DataFrame:
    rows = documents.core_entities(t.core_lines)
    return rows.select("category", F.array_join(catalog.tokens("expression"), ",").alias("tokens"), "domain_code")


@query("SELECT e.id, CASE e.id % 4 WHEN 0 THEN 'order_type' WHEN 1 THEN 'biz_type' WHEN 2 THEN 'source_no' END AS discriminator FROM edge e")
def discriminator_extract(t: Tables) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in ("（按 order_type 区分）", "x (按 biz_type 路由)", "（依 source_no 判）", "(多态)")])
    return t.edge.select("id", documents.discriminator(F.element_at(texts, (F.col("id") % 4 + 1).cast("int"))).alias("discriminator"))


@query("""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'b/diagram,new/doc' WHEN id % 3 = 1 THEN 'new/doc' ELSE 'b/diagram,new/doc' END AS merged FROM edge""")
def candidate_merge(t: Tables) -> DataFrame:
    stored = F.when(F.col("id") % 3 == 0, '[{"target":"a","source":"doc"},{"target":"b","source":"diagram"}]').when(F.col("id") % 3 == 1, "not json").otherwise('[{"target":"b","source":"diagram"}]')
    fresh = F.from_json(F.lit('[{"target":"new","source":"doc"},{"target":"new","source":"doc"}]'), documents.CANDIDATES)
    merged = documents.candidates_replace(documents.candidates_read(stored), "doc", fresh)
    return t.edge.select("id", F.array_join(F.array_sort(F.transform(merged, lambda x: F.concat_ws("/", x["target"], x["source"]))), ",").alias("merged"))


@query("""
    SELECT id, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS n, CASE id % 3 WHEN 1 THEN 'a/doc,b/diagram' ELSE 'b/diagram' END AS listed FROM edge""")
def candidate_upsert(t: Tables) -> DataFrame:
    """A candidate is added to empty, unreadable and other lists, and is there once where it already was; written and read again."""
    stored = F.when(F.col("id") % 3 == 0, '[{"target":"b","source":"diagram"}]').when(F.col("id") % 3 == 1, '[{"target":"a","source":"doc"}]').otherwise("not json")
    one = F.from_json(F.lit('[{"target":"b","source":"diagram"}]'), documents.CANDIDATES)[0]
    again = documents.candidates_read(documents.candidates_write(documents.candidates_upsert(documents.candidates_read(stored), one)))
    return t.edge.select("id", F.size(again).alias("n"), F.array_join(F.transform(again, lambda x: F.concat_ws("/", x["target"], x["source"])), ",").alias("listed"))


# ---------------------------------------------------------------- search, glossary, audit


@query("""
    SELECT 'domain' AS facet, coalesce(domain_code, '?') AS value, count(*) AS n FROM graded GROUP BY 2 UNION ALL SELECT 'grading', coalesce(grading, '?'), count(*) FROM graded GROUP BY 2
    UNION ALL SELECT 'total', 'total', count(*) FROM graded""")
def catalog_facets(t: Tables) -> DataFrame:
    return catalog.facets(t.graded)


@query("SELECT id, name FROM graded WHERE contains(lower(name), 'ring') AND lower(grading) = 'a'")
def catalog_search(t: Tables) -> DataFrame:
    return catalog.search(t.graded, "RING", grading="a", limit=None).select("id", "name")


@query("SELECT id, name FROM graded WHERE domain_code = 'B' ORDER BY name LIMIT 200")
def catalog_search_limit(t: Tables) -> DataFrame:
    return catalog.search(t.graded, domain="b").select("id", "name")


@query("SELECT c.ordinal, c.name, c.type, c.nullable FROM col c JOIN asset a ON a.id = c.asset_id WHERE a.name = (SELECT name FROM asset WHERE id = 5)")
def asset_detail_columns(t: Tables) -> DataFrame:
    urn = t.asset.where("id = 5").select("asset_urn").first()["asset_urn"]
    return catalog.detail_columns(t.asset, t.col, urn).select("ordinal", "name", "type", "nullable")


@query("SELECT t.id, t.name, t.status, count(r.term_id) AS ref_count FROM term t LEFT JOIN ref r ON r.term_id = t.id GROUP BY 1, 2, 3")
def term_list(t: Tables) -> DataFrame:
    return catalog.term_list(t.term, t.ref).select("id", "name", "status", "ref_count")


@query("SELECT DISTINCT t.id, t.name FROM term t JOIN ref r ON r.term_id = t.id WHERE r.asset_id = 7")
def terms_by_asset(t: Tables) -> DataFrame:
    return catalog.terms_for_asset(t.term, t.ref, 7).select("id", "name")


@query("""
    SELECT CAST(id AS BIGINT) AS column_id, CASE WHEN k % 7 = 0 THEN 'column_of_another_asset' WHEN k % 5 < 2 AND k % 2 = 0 THEN 'exists' ELSE 'bound' END AS outcome FROM col""")
def term_bind_validate(t: Tables) -> DataFrame:
    other = F.when(F.col("k") % 7 == 0, F.when(F.col("asset_id") == 1, 2).otherwise(1).cast("long"))
    asked = t.col.select(F.col("k").alias("term_id"), other.alias("asset_id"), F.col("id").alias("column_id"))
    return catalog.bind(asked, t.ref, t.col, t.asset).select("column_id", "outcome")


@query("SELECT id, username, action FROM audit WHERE contains(username, '7') AND contains(action, 'c') ORDER BY at_ts DESC, id DESC LIMIT 500 OFFSET 500")
def audit_search(t: Tables) -> DataFrame:
    return catalog.audit_search(t.audit, "7", "C", page=1, size=500).select("id", "username", "action")


@query("SELECT action, count(*) AS n FROM audit GROUP BY 1")
def audit_action_counts(t: Tables) -> DataFrame:
    return t.audit.groupBy("action").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- quality

SCAN = """, issues AS (
    SELECT 'R-STR-001' AS rule_code, asset_urn, CAST(NULL AS STRING) AS column_name FROM asset WHERE NOT coalesce(has_pk, false)
    UNION ALL SELECT 'R-STR-002', asset_urn, c.name FROM graded g JOIN col c ON c.asset_id = g.id WHERE g.grading = 'A' AND NOT regexp_full_match(c.name, '^[a-z][a-z0-9_]*$')
    UNION ALL SELECT 'R-STR-003', asset_urn, NULL FROM asset WHERE lower(charset) <> 'utf8mb4'
    UNION ALL SELECT 'R-STR-004', asset_urn, NULL FROM asset WHERE lower(collate_name) <> 'utf8mb4_general_ci')
    """


@query(f"{SCAN} SELECT * FROM issues")
def dq_scan(t: Tables) -> DataFrame:
    return dq.scan(t.graded, t.col).select("rule_code", "asset_urn", "column_name")


@query(f"{SCAN} SELECT rule_code, count(*) AS n FROM issues GROUP BY 1")
def dq_scan_report(t: Tables) -> DataFrame:
    return dq.scan_report(dq.scan(t.graded, t.col))


@query(f"{SCAN}, said AS (SELECT *, CASE WHEN right(asset_urn, 1) = '7' THEN 'closed' ELSE 'open' END AS status FROM issues) SELECT rule_code, count(*) AS n FROM said WHERE status = 'open' GROUP BY 1")
def dq_open_summary(t: Tables) -> DataFrame:
    closed = F.when(F.right("asset_urn", F.lit(1)) == "7", "closed").otherwise(F.col("status"))
    return dq.open_summary(dq.scan(t.graded, t.col).withColumn("status", closed))


@query(f"{SCAN} SELECT rule_code, asset_urn, column_name FROM issues WHERE rule_code = 'R-STR-004' ORDER BY asset_urn LIMIT 50 OFFSET 100")
def dq_issue_page(t: Tables) -> DataFrame:
    return dq.issue_page(dq.scan(t.graded, t.col), "R-STR-004", "ope", page=2).select("rule_code", "asset_urn", "column_name")


@query("SELECT asset_urn FROM graded WHERE grading = 'B' AND NOT regexp_full_match(name, '[a-z][a-z0-9_]*')")
def dq_table_naming(t: Tables) -> DataFrame:
    return dq.table_naming(t.graded, t.col, "[a-z][a-z0-9_]*", "B").select("asset_urn")


KEYS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS reference, count(*) AS n FROM {c} LEFT JOIN {p} ON {k} = {pk} WHERE {pk} IS NULL AND {k} IS NOT NULL" for c, k, p, pk in KEYS))
def ri_dangling_all(t: Tables) -> DataFrame:
    parts = [dq.dangling(t.raw(c), k, t.raw(p), pk).agg(F.count("*").alias("n")).select(F.lit(f"{c}.{k}").alias("reference"), "n") for c, k, p, pk in KEYS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT e.id FROM edge e WHERE NOT EXISTS (SELECT 1 FROM col c WHERE c.asset_id = e.from_asset_id AND lower(c.name) = concat('col_', CAST(e.id % 97 AS STRING)))")
def edge_column_owned(t: Tables) -> DataFrame:
    e = t.edge.withColumn("from_column", F.concat(F.lit("COL_"), (F.col("id") % 97).cast("string")))
    return dq.unowned_columns(e, t.col).select("id")


@query("SELECT from_asset_id, from_column, coalesce(CAST(to_asset_id AS STRING), concat('raw:', CAST(target AS STRING))) AS target, count(*) AS n FROM (SELECT * FROM edge UNION ALL SELECT * FROM edge WHERE id % 12 = 0 UNION ALL SELECT * FROM edge WHERE id % 24 = 0) e GROUP BY 1, 2, 3 HAVING count(*) > 1")
def edge_duplicates(t: Tables) -> DataFrame:
    """A store in which some edges were written twice or three times."""
    again = t.edge.unionByName(t.edge.where("id % 12 = 0")).unionByName(t.edge.where("id % 24 = 0"))
    return dq.duplicate_edges(again.withColumn("target_raw", F.col("target").cast("string"))).select("from_asset_id", "from_column", "target", "n")


@query("SELECT a.id, b.id AS reverse_id FROM edge a JOIN edge b ON a.from_asset_id = b.to_asset_id AND a.to_asset_id = b.from_asset_id WHERE a.from_asset_id < a.to_asset_id")
def edge_reversed_pairs(t: Tables) -> DataFrame:
    return dq.reversed_pairs(t.edge.withColumn("from_column", F.lit("c")))


def _stored(t: Tables) -> DataFrame:
    """Edges with traces, bases and cardinalities of which some break a rule of the store."""
    trace = F.when(F.col("id") % 6 == 0, "来源｜未消解").when(F.col("id") % 6 == 1, "未消解｜ER消解").when(F.col("id") % 6 == 2, "来源")
    basis = F.when(F.col("id") % 9 == 0, "注释明示｜ER佐证").when(F.col("id") % 9 == 1, "ER")
    return t.edge.withColumns({"ingest_trace": trace, "basis_raw": basis, "cardinality": F.when(F.col("id") % 8 == 0, "N:M").otherwise(F.col("cardinality"))})


@query("SELECT id FROM edge WHERE id % 8 = 0")
def edge_many_to_many(t: Tables) -> DataFrame:
    return dq.many_to_many(_stored(t)).select("id")


@query("SELECT id FROM edge WHERE id % 6 = 0 AND to_asset_id IS NOT NULL AND origin = '逻辑FK列' AND NOT conflict_flag")
def edge_pinned_unresolved(t: Tables) -> DataFrame:
    return dq.pinned_but_unresolved(_stored(t)).select("id")


@query("SELECT id FROM edge WHERE id % 9 = 0")
def edge_impure_basis(t: Tables) -> DataFrame:
    return dq.impure_basis(_stored(t)).select("id")


@query("SELECT from_column, count(DISTINCT to_asset_id) AS n_targets FROM edge WHERE to_asset_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT to_asset_id) > 1")
def same_column_multi_target(t: Tables) -> DataFrame:
    return dq.same_column_targets(t.edge)


@query(", k(child, fk, parent) AS (VALUES ('lineitem', 'l_orderkey', 'orders'), ('lineitem', 'l_partkey', 'part'), ('lineitem', 'l_suppkey', 'supplier'), ('orders', 'o_custkey', 'customer'), ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation'), ('nation', 'n_regionkey', 'region')) SELECT * FROM k")
def infer_fk_by_name(t: Tables) -> DataFrame:
    tables = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    rows = [(n, c, i == 0 and n != "lineitem") for n in tables for i, c in enumerate(t.raw(n).columns)]
    return dq.infer_keys(t.spark.createDataFrame(rows, "table string, name string, is_key boolean"))


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS reference, CASE WHEN max(n) > 1 THEN '1:N' ELSE '1:1' END AS cardinality FROM (SELECT count(*) AS n FROM {c} GROUP BY {k}) x" for c, k, _, _ in KEYS))
def infer_cardinality(t: Tables) -> DataFrame:
    parts = [dq.key_cardinality(t.raw(c), k).select(F.lit(f"{c}.{k}").alias("reference"), "cardinality") for c, k, _, _ in KEYS]
    return reduce(DataFrame.unionByName, parts)


BRIDGES = [("lineitem", "l_orderkey", "l_partkey"), ("lineitem", "l_orderkey", "l_suppkey"), ("lineitem", "l_partkey", "l_suppkey"), ("orders", "o_orderkey", "o_custkey")]
BRIDGE = """SELECT '{0}.{1}.{2}' AS bridge, (SELECT CASE WHEN max(x) > 1 AND max(y) > 1 THEN 'N:M' WHEN max(x) > 1 THEN '1:N' WHEN max(y) > 1 THEN 'N:1' ELSE '1:1' END FROM (
    SELECT count(*) OVER (PARTITION BY {1}) AS x, count(*) OVER (PARTITION BY {2}) AS y FROM (SELECT DISTINCT {1}, {2} FROM {0}) d) c) AS cardinality, (SELECT count(*) FROM (SELECT DISTINCT {1}, {2} FROM {0}) d) AS n_pairs"""


@query(" UNION ALL ".join(BRIDGE.format(*x) for x in BRIDGES))
def infer_bridges(t: Tables) -> DataFrame:
    """What tables with two keys say about the tables these refer to."""
    parts = [dq.bridge_cardinality(t.raw(n).select(a, b), a, b).select(F.lit(f"{n}.{a}.{b}").alias("bridge"), "cardinality", "n_pairs") for n, a, b in BRIDGES]
    return reduce(DataFrame.unionByName, parts)


#: What a DDL file of the raw tables would say beside their columns' names: comments, an index, a foreign key.  `p_size` is no key of nations.
SAID = {"l_orderkey": "关联 orders", "p_size": "关联 nation 表"}
KEY_LINES = {"orders": "  KEY `ix` (`o_custkey`, `o_orderdate`),", "customer": "  CONSTRAINT `f` FOREIGN KEY (`c_nationkey`) REFERENCES `nation` (`n_nationkey`),"}
LADDER = [
    ("customer", "c_nationkey", "nation", "n_nationkey", "显式外键"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "注释明示"), ("part", "p_size", "nation", "n_nationkey", "注释明示"), ("orders", "o_custkey", "customer", "c_custkey", "索引佐证"),
    ("lineitem", "l_partkey", "part", "p_partkey", "字段命名"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "字段命名"), ("supplier", "s_nationkey", "nation", "n_nationkey", "字段命名"), ("nation", "n_regionkey", "region", "r_regionkey", "字段命名"),
]


@query(" UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS fk, '{p}' AS parent, '{step}' AS step, (SELECT count(*) = 0 FROM {c} WHERE {k} NOT IN (SELECT {pk} FROM {p})) AS holds" for c, k, p, pk, step in LADDER))
def infer_fk_ladder(t: Tables) -> DataFrame:
    """Keys of the raw tables by the strongest evidence a DDL file gives, tested on the rows of both tables."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    text = []
    for n in names:
        text.append(f"CREATE TABLE `{n}` (")
        text += [f"  `{c}` int COMMENT '{SAID.get(c, '')}'," for c in t.raw(n).columns]
        text += [x for x in [KEY_LINES.get(n)] if x] + ([f"  PRIMARY KEY (`{t.raw(n).columns[0]}`)"] if n != "lineitem" else []) + [");"]
    lines = t.spark.createDataFrame([("ddl", i, x) for i, x in enumerate(text, 1)], "doc string, line_no int, line string")
    columns = ddl.columns(lines).select("table", "name", "meaning", F.col("primary_key").alias("is_key"))
    found = dq.tested_on_rows(staged(dq.infer_ladder(columns, ddl.constraints(lines))), {n: t.raw(n) for n in names})
    return found.select("child", "fk", "parent", "step", F.col("refuted_by").isNull().alias("holds"))


# ---------------------------------------------------------------- three-level model


def _model(t: Tables) -> dict[str, DataFrame]:
    return catalog.build_model(documents.core_entities(t.core_lines), t.graded.withColumn("column_count", F.col("n_columns")))


@query(f"SELECT CASE id % 3 WHEN 0 THEN 'MASTER' WHEN 1 THEN 'TRANSACTIONAL' ELSE 'CONFIG' END AS category, name, concat('标签', CAST(id AS STRING)) AS label, CAST(1 AS BIGINT) AS n_mapped FROM {CORE}")
def model_bom(t: Tables) -> DataFrame:
    return _model(t)["bom"].select("category", "name", "label", "n_mapped")


@query(f"SELECT id AS asset_id, name AS ldm_name, name AS pdm_name FROM {CORE}")
def model_mapping(t: Tables) -> DataFrame:
    return _model(t)["mapping"].select("asset_id", "ldm_name", "pdm_name")


@query("""SELECT name AS ldm_name, domain_code AS ldm_domain_code, name AS pdm_name, id AS asset_id, asset_urn, CAST(n_columns AS BIGINT) AS column_count, '05 §二 三分类·名称经物理目录校验' AS basis, id % 2 = 0 AS resolved
    FROM graded WHERE id % 3 = 0 AND id = (SELECT min(id) FROM asset WHERE id % 3 = 0)""")
def model_trace(t: Tables) -> DataFrame:
    """The first object of the first document, while every odd asset has left the catalog since."""
    model = _model(t)
    key = model["bom"].join(model["mapping"].where("asset_id % 3 = 0"), "bom_key").select(F.min_by("bom_key", "asset_id").alias("k")).first()["k"]
    return catalog.model_trace(model, t.asset.where("id % 2 = 0"), key).withColumn("column_count", F.col("column_count").cast("long"))


@query(f"""
    SELECT item, n FROM (SELECT count(*) AS n FROM {CORE}) x, (VALUES ('bom'), ('ldm'), ('pdm'), ('mapping')) v(item) UNION ALL SELECT 'unmapped', CAST(0 AS BIGINT)
    UNION ALL SELECT CASE id % 3 WHEN 0 THEN 'MASTER' WHEN 1 THEN 'TRANSACTIONAL' ELSE 'CONFIG' END, count(*) FROM {CORE} GROUP BY 1""")
def model_overview(t: Tables) -> DataFrame:
    return catalog.model_overview(_model(t))
