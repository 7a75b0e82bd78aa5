"""Catalog tables derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each may name raw tables and earlier ones in braces.
TABLES = {
    "asset": """
        SELECT id, name, concat('mysql:shop:', name) AS asset_urn, has_pk, charset, collate_name, a_domain, n_columns, concat('table ', CAST(id AS STRING)) AS table_comment FROM (
          SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
            CASE p_partkey % 8
              WHEN 0 THEN concat('lcap_', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING))
              WHEN 1 THEN concat('N0DD15FF_QRTZ_', CAST(p_partkey AS STRING))
              WHEN 2 THEN concat('jf_', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), '_bak_20251205125025')
              WHEN 3 THEN concat('test_', CAST(p_partkey AS STRING))
              WHEN 4 THEN concat('temp', CAST(p_partkey AS STRING))
              ELSE concat('jf_', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) END AS name,
            CASE p_size % 9 WHEN 0 THEN false WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE true END AS has_pk,
            CASE WHEN p_size % 13 = 0 THEN 'latin1' ELSE 'utf8mb4' END AS charset,
            CASE p_size % 4 WHEN 0 THEN 'utf8mb4_general_ci' WHEN 1 THEN 'utf8mb4_unicode_ci' WHEN 2 THEN 'utf8mb4_0900_ai_ci' END AS collate_name,
            CASE WHEN p_partkey % 8 >= 4 THEN concat('D', lpad(CAST(p_partkey % 18 + 1 AS STRING), 2, '0')) END AS a_domain,
            CAST(p_size AS INT) AS n_columns
          FROM {part}) p""",
    "col": """
        SELECT asset_id * 100000 + k AS id, asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY k) - 1 AS INT) AS ordinal,
          CASE WHEN k % 10 = 0 THEN concat('colName', CAST(k AS STRING)) ELSE concat('col_', CAST(k AS STRING)) END AS name,
          CASE k % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(64)' WHEN 2 THEN 'decimal(10,2)' ELSE 'datetime' END AS type,
          CASE WHEN k % 3 = 0 THEN 'N' ELSE 'Y' END AS nullable, CAST(k AS BIGINT) AS k
        FROM (SELECT DISTINCT CAST(l_partkey + 1 AS BIGINT) AS asset_id, l_suppkey AS k FROM {lineitem}) d""",
    "edge": """
        SELECT id, from_asset_id, CASE WHEN id % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE target END AS to_asset_id, target,
          concat('ref_', CAST(id % 97 AS STRING), '_id') AS from_column,
          CASE id % 5 WHEN 0 THEN '注释明示' WHEN 1 THEN '索引佐证' WHEN 2 THEN '字段命名' WHEN 3 THEN '业务语义推断' ELSE '待确认' END AS evidence_level,
          CASE id % 5 WHEN 0 THEN CAST(0.8 AS DOUBLE) WHEN 1 THEN CAST(0.7 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) WHEN 3 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence,
          CASE WHEN id % 3 = 0 THEN 'ER证据摘录' ELSE '逻辑FK列' END AS origin,
          CASE WHEN id % 17 = 0 THEN '已确认' WHEN id % 19 = 0 THEN '驳回' ELSE '待确认' END AS confirm_status,
          CASE id % 4 WHEN 0 THEN '1:N' WHEN 1 THEN '1:1' END AS cardinality, id % 23 = 0 AS conflict_flag
        FROM (
          SELECT CAST(p_partkey + 1 AS BIGINT) AS id, CAST(p_partkey + 1 AS BIGINT) AS from_asset_id, CAST(floor((p_partkey + 1) / 2) AS BIGINT) AS target FROM {part} WHERE p_partkey > 0
          UNION ALL
          SELECT CAST(p_partkey + 1000001 AS BIGINT), CAST(p_partkey + 1 AS BIGINT), CAST((p_partkey * 3 + 1) % (SELECT count(*) FROM {part}) + 1 AS BIGINT) FROM {part} WHERE p_partkey % 7 = 0) e""",
    "term": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, concat('D', lpad(CAST(s_nationkey AS STRING), 2, '0')) AS domain_code, CASE s_suppkey % 3 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'REVIEW' ELSE 'PUBLISHED' END AS status FROM {supplier}",
    "ref": "SELECT DISTINCT k AS term_id, asset_id, CASE WHEN k % 2 = 0 THEN id END AS column_id, CASE WHEN k % 2 = 0 THEN 'COLUMN' ELSE 'TABLE' END AS ref_type FROM {col} WHERE k % 5 < 2",
    "audit": "SELECT event_id AS id, concat('user', CAST(user_id AS STRING)) AS username, event_type AS action, CAST(ts AS TIMESTAMP) AS at_ts FROM {events}",
    "code": """
        SELECT CAST(row_number() OVER (ORDER BY category, code_value) AS BIGINT) AS id, category, code_value, concat(CAST(n AS STRING), ' rows') AS meaning,
          CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, code_value) AS INT) AS ordinal
        FROM (SELECT 'order_status' AS category, o_orderstatus AS code_value, count(*) AS n FROM {orders} GROUP BY o_orderstatus
          UNION ALL SELECT 'order_priority', o_orderpriority, count(*) FROM {orders} GROUP BY o_orderpriority
          UNION ALL SELECT 'market_segment', c_mktsegment, count(*) FROM {customer} GROUP BY c_mktsegment
          UNION ALL SELECT 'event_type', event_type, count(*) FROM {events} GROUP BY event_type
          UNION ALL SELECT 'confirm_status', confirm_status, count(*) FROM {edge} GROUP BY confirm_status) c""",
    "field": """
        SELECT max(k) + 1 AS id, CASE k WHEN 1 THEN 'remark' WHEN 3 THEN 'create_time' ELSE concat('col_', CAST(k AS STRING)) END AS field_name, min(type) AS data_type, CAST(k % 90 AS INT) AS length_val, concat(CAST(count(*) AS STRING), ' columns') AS semantic, k % 4 <> 0 AS enabled
        FROM {col} GROUP BY k""",
    "naming": """
        SELECT CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS id, CASE p_brand WHEN 'Brand#5' THEN 'table-snake' ELSE lower(p_brand) END AS name, 'table' AS target, concat('^jf_.*_', CAST(n AS STRING), '$') AS pattern, CAST(NULL AS STRING) AS description, true AS enabled
        FROM (SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand) b""",
    "rule": """
        SELECT CAST(row_number() OVER (ORDER BY a_domain) AS BIGINT) AS id, CASE a_domain WHEN 'D05' THEN 'R-STR-003' ELSE concat('R-', a_domain) END AS code, a_domain AS name, 'structure' AS category, 'TABLE_NAMING' AS checker, concat('.*', CAST(n AS STRING)) AS param, 'A' AS scope_grading, 'low' AS severity, true AS enabled
        FROM (SELECT a_domain, count(*) AS n FROM {asset} GROUP BY a_domain) d WHERE a_domain IS NOT NULL""",
    "member": "SELECT user_id + 1 AS id, CASE user_id WHEN 3 THEN 'viewer' ELSE concat('user', CAST(user_id AS STRING)) END AS username, concat('User ', CAST(user_id AS STRING)) AS display, 'READONLY' AS role FROM (SELECT DISTINCT user_id FROM {events}) u",
    "graded": """
        SELECT asset.*, CASE WHEN name LIKE '%\\_bak\\_20251205125025' ESCAPE '\\' OR name LIKE 'test\\_%' ESCAPE '\\' THEN 'C' WHEN a_domain IS NOT NULL THEN 'A' WHEN name LIKE 'lcap\\_%' ESCAPE '\\' OR name LIKE 'N0DD15FF\\_%' ESCAPE '\\' THEN 'B' END AS grading,
          CASE WHEN name LIKE '%\\_bak\\_20251205125025' ESCAPE '\\' OR name LIKE 'test\\_%' ESCAPE '\\' THEN 'C' WHEN a_domain IS NOT NULL THEN a_domain WHEN name LIKE 'lcap\\_%' ESCAPE '\\' OR name LIKE 'N0DD15FF\\_%' ESCAPE '\\' THEN 'B' END AS domain_code
        FROM {asset} asset""",
}
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"]


def oracle(sql: str) -> str:
    """sql after the derived tables, for DuckDB."""
    names = {n: n for n in [*RAW, *TABLES]}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({t.format(**names)})" for n, t in TABLES.items()) + ("," if sql.lstrip().startswith(",") else "") + " " + sql.lstrip().removeprefix(",")


class Tables:
    """The raw and derived tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        text = TABLES[name]
        used = {n: self.raw(n) if n in RAW else getattr(self, n) for n in [*RAW, *TABLES] if f"{{{n}}}" in text}
        return self.spark.sql(text, **used)

    asset = cached_property(lambda self: self._derived("asset"))
    col = cached_property(lambda self: self._derived("col"))
    edge = cached_property(lambda self: self._derived("edge"))
    term = cached_property(lambda self: self._derived("term"))
    ref = cached_property(lambda self: self._derived("ref"))
    audit = cached_property(lambda self: self._derived("audit"))
    code = cached_property(lambda self: self._derived("code"))
    field = cached_property(lambda self: self._derived("field"))
    naming = cached_property(lambda self: self._derived("naming"))
    rule = cached_property(lambda self: self._derived("rule"))
    member = cached_property(lambda self: self._derived("member"))

    @cached_property
    def graded(self) -> DataFrame:
        from cairn.operators.classify import domain, grading

        return self.asset.withColumns({"grading": grading("name", "a_domain"), "domain_code": domain("name", "a_domain")})

    # -------------------------------------------------------- documents in the shapes that the parsers read

    def _numbered(self, rows: DataFrame, doc: str, *order: str) -> DataFrame:
        from pyspark.sql import Window

        return rows.withColumn("doc", F.concat(F.lit(doc), (F.col("at") % 64).cast("string"))).withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).select("doc", "line_no", "line")

    @cached_property
    def ddl_lines(self) -> DataFrame:
        q = F.lit("'")
        a, c = self.asset, self.col
        default = F.when(F.col("nullable") == "N", " NOT NULL").otherwise(" DEFAULT NULL")
        value = F.when(F.col("k") % 4 == 1, F.concat(F.lit(" DEFAULT "), q, F.lit("v"), F.col("k"), q)).otherwise("")
        comment = F.when(F.col("k") % 5 == 0, F.concat(F.lit(" COMMENT "), q, F.lit("it''s column "), F.col("k"), q)).otherwise("")
        parts = [
            a.select(F.col("id").alias("at"), F.lit(-1).alias("k"), F.concat(F.lit("CREATE TABLE `"), "name", F.lit("` (")).alias("line")),
            c.select(F.col("asset_id").alias("at"), F.col("ordinal").alias("k"), F.concat(F.lit("  `"), "name", F.lit("` "), "type", default, value, comment, F.lit(",")).alias("line")),
            a.where("has_pk").select(F.col("id").alias("at"), F.lit(10**6).alias("k"), F.lit("  PRIMARY KEY (`col_1`) USING BTREE").alias("line")),
            a.select(F.col("id").alias("at"), F.lit(2 * 10**6).alias("k"), F.concat(F.lit(") ENGINE = InnoDB CHARACTER SET = "), "charset", F.coalesce(F.concat(F.lit(" COLLATE = "), "collate_name"), F.lit("")), F.lit(" COMMENT = "), q, "table_comment", q, F.lit(";")).alias("line")),
        ]
        return self._numbered(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "ddl", "at", "k")

    def _ends(self) -> DataFrame:
        name = lambda k, n: self.asset.select(F.col("id").alias(k), F.col("name").alias(n))
        return self.edge.join(name("from_asset_id", "from_name"), "from_asset_id").join(name("to_asset_id", "to_name"), "to_asset_id", "left")

    def logical_lines(self, edges: DataFrame | None = None) -> DataFrame:
        e = edges if edges is not None else self._ends()
        basis = F.element_at(F.array(*[F.lit(x) for x in ("注释明示 (id)", "索引佐证", "命名推断（按 order_type 区分）", "语义推断·跨域 D03", "x")]), (F.col("id") % 5 + 1).cast("int"))
        row = F.concat(F.lit("| **"), "from_column", F.lit("** | bigint | FK["), F.coalesce("to_name", F.lit("外部系统")), F.lit("·"), basis, F.lit("] | 说明 | 备注 |"))
        heads = e.select(F.col("from_asset_id").alias("at"), "from_name").distinct().select("at", F.lit(-1).cast("long").alias("k"), F.concat(F.lit("### "), "from_name", F.lit(" — 说明")).alias("line"))
        return self._numbered(heads.unionByName(e.select(F.col("from_asset_id").alias("at"), F.col("id").alias("k"), row.alias("line"))), "03/m", "at", "k")

    @cached_property
    def diagram_lines(self) -> DataFrame:
        e = self._ends().where("to_name is not null")
        symbol = F.element_at(F.array(*[F.lit(x) for x in ("||--o{", "}o..||", "}o--o{", "||..o|", "..o{", "||--o{", "not")]), (F.col("id") % 7 + 1).cast("int"))
        start = F.when(F.col("id") % 7 == 5, "N:N ").when(F.col("id") % 7 == 0, "1:N ").otherwise("")
        mark = F.element_at(F.array(*[F.lit(x) for x in ("[注释明示]", "[命名推断+索引]", "[命名推断]", "[语义][跨域·D07]", "[待定]")]), (F.col("id") % 5 + 1).cast("int"))
        line = F.concat("to_name", F.lit(" "), symbol, F.lit(" "), "from_name", F.lit(' : "'), start, mark, F.lit(" c."), "from_column", F.lit(' -> p.id"'))
        fences = self.spark.range(64).select(F.col("id").alias("at"), F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("k"), F.lit("```mermaid").alias("line")), F.struct(F.lit(10**12).alias("k"), F.lit("```").alias("line")))).alias("x")).select("at", "x.k", "x.line")
        return self._numbered(fences.unionByName(e.select(F.col("from_asset_id").alias("at"), F.col("id").alias("k"), line.alias("line"))), "01/e", "k", "at")

    @cached_property
    def core_lines(self) -> DataFrame:
        a = self.asset.select((F.col("id") % 3).alias("at"), F.col("id").alias("k"), F.concat(F.lit("| **"), "name", F.lit("**（标签"), F.col("id"), F.lit("） | D01 | 说明 |")).alias("line"))
        heads = [(i, k, x) for i in range(3) for k, x in ((-3, "## 二 核心实体"), (-2, f"### 2.{i + 1} 类"), (-1, "| 实体 | 域 | 说明 |"), (10**12, "## 三 其他"), (10**12 + 1, "| no_entity | D01 | x |"))]
        return self._numbered(self.spark.createDataFrame(heads, "at long, k long, line string").unionByName(a), "05/c", "k")

    @cached_property
    def census_lines(self) -> DataFrame:
        lists = self.asset.where("a_domain is not null AND name NOT LIKE 'test%'").groupBy("a_domain").agg(F.array_join(F.array_sort(F.collect_list("name")), "、").alias("names"), F.count("*").alias("n"))
        at = F.substring("a_domain", 2, 2).cast("long")
        parts = F.array(F.concat(F.lit("### "), "a_domain", F.lit(" 领域"), "a_domain", F.lit("（"), "n", F.lit("）")), F.lit(""), F.col("names"))
        return self._numbered(lists.select(at.alias("at"), F.posexplode(parts).alias("k", "line")), "00/g", "at", "k")
