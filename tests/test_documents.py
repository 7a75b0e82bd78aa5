"""Parsers on hand-written lines: the shapes of DDL files, diagrams, logical models, census and core-entity documents."""

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import trim
from cairn.operators import classify, ddl, documents
from cairn.sources.lines import split_lines


def lines(spark, text, doc="d"):
    return split_lines(spark.createDataFrame([(doc, text)], "doc string, text string"))


DDL = "\r\n".join([
    "CREATE TABLE IF NOT EXISTS `t_one` (",
    "  `id` bigint unsigned NOT NULL AUTO_INCREMENT COMMENT 'key',",
    "  `name` varchar(64) DEFAULT '' COMMENT 'it''s NOT NULL',",
    "  `amount` decimal(10,2)  DEFAULT NULL,",
    "  PRIMARY KEY (`id`) USING BTREE,",
    "  INDEX `idx`(`name`)",
    ") ENGINE=InnoDB CHARACTER SET = utf8mb4 COLLATE = utf8mb4_bin COMMENT = 'one''s';",
    "CREATE TABLE t_two (",
    "  `a` int DEFAULT 0,",
    "  `PRIMARY` KEY (`x`)",
    ");",
    "create table `t_one` (",
    "  `a` int, ",
    "  PRIMARY KEY (`a`, `b`)",
    ");",
    "",
])


def test_ddl(spark):
    rows = {(r["start_line"], r["name"]): r for r in ddl.columns(lines(spark, DDL)).collect()}
    one = rows[1, "id"]
    assert (one["type"], one["nullable"], one["key_hint"], one["meaning"], one["ordinal"]) == ("bigint unsigned", "N", "PK,AUTO", "key", 0)
    name = rows[1, "name"]  # words inside a comment count
    assert (name["type"], name["nullable"], name["default_val"], name["meaning"]) == ("varchar(64)", "N", "", "it's NOT NULL")
    assert (rows[1, "amount"]["type"], rows[1, "amount"]["default_val"], rows[8, "a"]["default_val"]) == ("decimal(10,2)", None, "0")
    assert rows[12, "a"]["key_hint"] == "PK" and len(rows) == 5
    tables = {r["start_line"]: r for r in ddl.tables(lines(spark, DDL)).collect()}
    assert (tables[1]["table_comment"], tables[1]["charset"], tables[1]["collate_name"], tables[1]["has_pk"]) == ("one's", "utf8mb4", "utf8mb4_bin", True)
    assert (tables[8]["has_pk"], tables[8]["charset"], tables[8]["column_count"]) == (False, None, 1)
    census = ddl.census(lines(spark, DDL)).first()
    assert (census["raw_tables"], census["unique_tables"], census["no_pk"], census["n_lines"]) == (3, 2, 1, 15)


def test_ddl_without_closing_line(spark):
    rows = ddl.columns(lines(spark, "CREATE TABLE a (\n `x` int\nCREATE TABLE b (\n `y` int\n)")).collect()
    assert {(r["table"], r["name"]) for r in rows} == {("a", "x"), ("a", "y"), ("b", "y")}
    assert ddl.columns(lines(spark, "")).count() == 0


CASES = [
    ('p ||--o{ c : "1:N [命名推断] c.customer_id -> p.id"', "ONE_TO_MANY", "1:N", "字段命名", ["customer_id"], "id"),
    ('c }o..|| p : "[命名推断] mv.inventory_id"', "MANY_TO_ONE", "1:N", "字段命名", ["inventory_id"], None),
    ('a }o--o{ b : "M:N x"', "MANY_TO_MANY", "N:M", "待确认", [], None),
    ('a ||..o| b : "imi.request_id(x)=wrr.request_id"', "ONE_TO_ONE", "1:1", "待确认", ["request_id"], "request_id"),
    ('a ||--o{ b : "[命名推断+索引] rs.customer_id"', "ONE_TO_MANY", "1:N", "索引佐证", ["customer_id"], None),
    ('a ||--o{ b : "N:N x"', "AMBIGUOUS", None, "待确认", [], None),
    ('a ..o{ b : "x"', "UNSUPPORTED_SYMBOL", None, "待确认", [], None),
    ('a ||--o{ b : "jf_personnel.id / lcap_user.id"', "ONE_TO_MANY", "1:N", "待确认", [], None),
    ('a }o--|| b : "customer_reconciliation_id x [注释明示]"', "MANY_TO_ONE", "1:N", "注释明示", ["customer_reconciliation_id"], None),
]


def test_diagrams(spark):
    text = "a ||--o{ b : \"outside\"\n``` mermaid\n" + "\n".join(c[0] for c in CASES) + "\nEntity {\n bigint id\n}\n```\na ||--o{ b : \"outside\"\n```sql\na ||--o{ b : \"outside\"\n```"
    got = documents.diagram_relations(lines(spark, text)).orderBy("line_no").collect()
    assert [(r["kind"], r["cardinality"], r["evidence_level"], r["from_columns"], r["to_column"]) for r in got] == [c[1:] for c in CASES]


LOGICAL = """## 1. jf_order — 订单
| 字段 | 类型 | 关系 | 说明 | 备注 |
| **customer_id**† | bigint | FK[jf_customer·注释明示·跨域 D03 (id)] | x | y |
| ref_id | bigint | FK[jf_a / jf_b·索引佐证（按 order_type 区分）] | x | y |
| parent_id | bigint | FK[自关联·自关联] | x | y |
| customer_id | bigint | FK[jf_customer·again] | x | y |
## 说明（图例）
| customer_id | bigint | FK[jf_customer·注释明示] | x | y |
### jf_line（行）
| note | text | FK[外部单号] | x | y |
"""


def test_logical_models(spark):
    found = documents.logical_relations(lines(spark, LOGICAL))
    rows = {(r["from_table"], r["from_column"]): r for r in found.collect()}
    assert set(rows) == {("jf_order", "customer_id"), ("jf_order", "ref_id"), ("jf_order", "parent_id"), ("jf_line", "note")}
    c = rows["jf_order", "customer_id"]
    assert (c["target_raw"], c["basis_raw"], c["to_column"], c["cross_domain"], c["evidence_level"], c["confidence"]) == ("jf_customer", "注释明示 跨域 D03 (id)", "id", "D03", "注释明示", 0.8)
    assert (rows["jf_order", "ref_id"]["discriminator"], rows["jf_line", "note"]["evidence_level"]) == ("order_type", "待确认")
    catalog = spark.createDataFrame([(1, "JF_order"), (2, "jf_a"), (3, "jf_b"), (4, "jf_line")], "id long, name string")
    got = {(r["from_column"], r["to_asset_id"]) for r in documents.resolve_targets(found, catalog).collect()}
    assert got == {("customer_id", None), ("ref_id", 2), ("ref_id", 3), ("parent_id", 1), ("note", None)}


CENSUS = "### D01 销售（2）\n说明见下 a\n### D02 采购（2，含备份）\n\n`b`、c\nprose\n### D03 仓储（1）\n### D04 空（0）\n## 其他\n### OT 其他（1）\n"


def test_census(spark):
    got = {r["code"]: (r["declared_count"], r["tables"]) for r in documents.domain_census(lines(spark, CENSUS)).collect()}
    assert got == {"D01": (2, ["说明见下 a"]), "D02": (2, ["b", "c"]), "D04": (0, [])}
    domains = documents.domain_census(lines(spark, CENSUS))
    with pytest.raises(classify.LabelError):
        classify.check_census(domains)
    classify.check_census(domains.where("code = 'D02'"))
    with pytest.raises(classify.LabelError):
        classify.check_census(domains.where("code = 'D02'").unionByName(domains.where("code = 'D02'").withColumn("code", F.lit("D09"))))


CORE = "## 一\n### 2.1 主\n| x | D01 | y |\n## 二 核心\n| none | D01 | y |\n### 2.1 主\n| 实体 | 域 | 说明 |\n| :-- | -- | -- |\n| **jf_a**（甲）/ jf_b | D01 | d |\n| two | D01 |\n### 2.3 配\n| c_c | D02 | e |\n## 三\n| z | D01 | y |"


def test_core_entities(spark):
    got = [(r["category"], r["expression"], r["domain_code"]) for r in documents.core_entities(lines(spark, CORE)).orderBy("line_no").collect()]
    assert got == [("MASTER", "**jf_a**（甲）/ jf_b", "D01"), ("CONFIG", "c_c", "D02")]


def test_grading_and_families(spark):
    rows = [("trader_bak_20251205125025", None), ("test_jf_sales_order", "D01"), ("jf_goods_bak", "D02"), ("lcap_user", None), ("N0DD15FF_QRTZ_CRON_TRIGGERS", None), ("P3B9E1A2_TASK_RU", None), ("mystery_table", None), ("x_copy1", None), ("plain", None)]
    df = spark.createDataFrame(rows, "name string, a string").select("name", classify.grading("name", "a").alias("g"), classify.prefix_family("name").alias("f"))
    assert [r["g"] for r in df.collect()] == ["C", "C", "A", "B", "B", "B", None, None, None]
    assert [r["f"] for r in df.collect()] == ["*_bak(date)", "test_", "jf_", "lcap_", "N0DD15FF(hex)", "P3B9E1A2(hex)", "mystery_", "*_copy", "(no-prefix)"]


def test_column_patterns_run_once_a_line(spark):
    """Patterns are what the parser costs: COLUMN runs for the name and for the rest, TYPE once, and no trimming is a pattern."""
    plan = ddl.columns(lines(spark, DDL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ddl.COLUMN) == 2 and plan.count(ddl.TYPE) == 1
    assert r"[\x00-\x20]+" not in plan


def test_ddl_odd_columns(spark):
    text = "\n".join([
        "CREATE TABLE `t` (",
        "  `a` \x01 INT  UNSIGNED\tNOT NULL ,  ",
        "\t`b` 'odd',",
        "  `c`",
        "  `d` int default 'x' Comment 'a'', b',,",
        "  `e` int COMMENT '" + "ßı' DEFAULT null,",
        "  `f` key (`a`),",
        "  x int,",
        "  primary key (`A`)",
        ")",
    ])
    got = [tuple(r) for r in ddl.columns(lines(spark, text)).select("name", "type", "nullable", "default_val", "key_hint", "meaning").orderBy("ordinal").collect()]
    assert got == [
        ("a", "INT UNSIGNED", "N", None, "PK", None), ("b", "'odd'", "Y", None, None, None), ("c", "", "Y", None, None, None),
        ("d", "int", "Y", "x", None, "a', b"), ("e", "int", "Y", None, None, "ßı"),
    ]


def test_trim_before_a_line_end(spark):
    row = spark.createDataFrame([("\x00 a b \u0085", "\t c \n", None)], "x string, y string, z string").select(trim("x"), trim("y"), trim("z")).first()
    assert tuple(row) == ("a b \u0085", "c", None)
