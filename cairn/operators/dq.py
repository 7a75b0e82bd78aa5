"""Rule-driven quality scans (Q-0 to Q-7), store invariants (Q-8 to Q-10) and inferred keys (I-1, I-2)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.keys import staged

from cairn.functions.text import fully

RULE = "code string, name string, category string, checker string, param string, scope_grading string, severity string, enabled boolean"
# The seeded rules.
RULES = [
    ("R-STR-001", "表必须有主键", "structure", "NO_PK", None, None, "high", True),
    ("R-STR-002", "列名必须为 snake_case", "structure", "COLUMN_NAMING", "^[a-z][a-z0-9_]*$", "A", "medium", True),
    ("R-STR-003", "表字符集必须为 utf8mb4", "structure", "CHARSET", "utf8mb4", None, "low", True),
    ("R-STR-004", "表排序规则必须为 utf8mb4_general_ci", "structure", "COLLATE_DRIFT", "utf8mb4_general_ci", None, "low", True),
    ("R-REL-001", "同名列异指向检查(05 B-4)", "relationship", "NONE", None, None, "high", False),
]


class ScanError(ValueError):
    """A rule's scope matches no asset, so that finding nothing would mean nothing."""


def _issues(rows: DataFrame, detail, column: str | None = None) -> DataFrame:
    return rows.select("asset_urn", (F.col(column) if column else F.lit(None).cast("string")).alias("column_name"), F.substring(detail, 1, 500).alias("detail"))


def no_pk(assets: DataFrame, columns: DataFrame, param: str | None, scope: str | None) -> DataFrame:
    return _issues(assets.where(~F.coalesce("has_pk", F.lit(False))), F.lit("no primary key"))


def _drift(column: str, default: str) -> Callable:
    def check(assets: DataFrame, columns: DataFrame, param: str | None, scope: str | None) -> DataFrame:
        return _issues(assets.where(F.lower(column) != (param or default).lower()), F.concat(F.lit(f"{column}="), F.col(column)))

    return check


def _in_scope(assets: DataFrame, scope: str | None) -> DataFrame:
    return assets.where(F.lower("grading") == scope.lower()) if scope else assets


def table_naming(assets: DataFrame, columns: DataFrame, param: str, scope: str | None) -> DataFrame:
    return _issues(_in_scope(assets, scope).where(~fully("name", param)), F.concat(F.lit("name="), F.col("name")))


def column_naming(assets: DataFrame, columns: DataFrame, param: str, scope: str | None) -> DataFrame:
    own = _in_scope(assets, scope).select("id", "asset_urn")
    found = columns.select("asset_id", F.col("name").alias("_c")).where(~fully("_c", param)).join(own, F.col("asset_id") == F.col("id"))
    if scope and not found.take(1) and not own.take(1):
        raise ScanError(f"no asset has grading {scope}")
    return _issues(found, F.concat(F.lit("column="), F.col("_c")), "_c")


#: More checkers may be registered here; a rule with an unknown one reports nothing.
CHECKERS: dict[str, Callable] = {"NO_PK": no_pk, "CHARSET": _drift("charset", "utf8mb4"), "COLLATE_DRIFT": _drift("collate_name", "utf8mb4_general_ci"), "TABLE_NAMING": table_naming, "COLUMN_NAMING": column_naming}


def seeded_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE)


def scan(assets: DataFrame, columns: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Q-0: (rule_code, asset_urn, column_name, detail, status) of all enabled rules; replaces every earlier issue."""
    found = [CHECKERS[r[3]](assets, columns, r[4], r[5]).withColumn("rule_code", F.lit(r[0])) for r in rules if r[7] and r[3] in CHECKERS]
    empty = assets.sparkSession.createDataFrame([], "asset_urn string, column_name string, detail string, rule_code string")
    return reduce(DataFrame.unionByName, found, empty).select("rule_code", "asset_urn", "column_name", "detail", F.lit("open").alias("status"))


def scan_report(issues: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(rule_code, n) of every enabled rule, those without issues included."""
    codes = issues.sparkSession.createDataFrame([(r[0],) for r in rules if r[7]], "rule_code string")
    return codes.join(issues.groupBy("rule_code").agg(F.count("*").alias("n")), "rule_code", "left").fillna(0, ["n"])


def open_summary(issues: DataFrame) -> DataFrame:
    return issues.where("status = 'open'").groupBy("rule_code").agg(F.count("*").alias("n"))


def issue_page(issues: DataFrame, rule_code: str | None = None, status: str | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """Q-7: a page of at most 500; with a rule the status is found within, without one it has to be equal."""
    size = max(1, min(500, size))
    if rule_code:
        issues = issues.where(F.col("rule_code") == rule_code)
    if status:
        issues = issues.where(F.contains("status", F.lit(status)) if rule_code else F.col("status") == status)
    return issues.orderBy("rule_code", "asset_urn", "column_name").offset(page * size).limit(size)


# ---------------------------------------------------------------- invariants


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Q-8: rows of child whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def unowned_columns(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges whose source table has no column of that name, without case."""
    own = columns.select("asset_id", F.lower("name").alias("_c"))
    return edges.join(own, (F.col("from_asset_id") == F.col("asset_id")) & (F.lower("from_column") == F.col("_c")), "left_anti")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(from_asset_id, from_column, target, n) of positions with one target twice."""
    target = F.coalesce(F.col("to_asset_id").cast("string"), F.concat(F.lit("raw:"), F.coalesce("target_raw", F.lit(""))))
    return edges.groupBy("from_asset_id", "from_column", target.alias("target")).agg(F.count("*").alias("n")).where("n > 1")


def reversed_pairs(edges: DataFrame) -> DataFrame:
    """(id, reverse_id): edges of one column between the same two tables in both directions."""
    a, b = edges.alias("a"), edges.alias("b")
    same = (F.col("a.from_asset_id") == F.col("b.to_asset_id")) & (F.col("a.to_asset_id") == F.col("b.from_asset_id")) & (F.lower("a.from_column") == F.lower("b.from_column"))
    return a.join(b, same).where("a.from_asset_id < a.to_asset_id").select(F.col("a.id").alias("id"), F.col("b.id").alias("reverse_id"))


def many_to_many(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("cardinality") == "N:M")


def pinned_but_unresolved(edges: DataFrame) -> DataFrame:
    """Edges whose trace ends unresolved though they have a target."""
    return edges.where(F.contains("ingest_trace", F.lit("未消解")) & ~F.contains("ingest_trace", F.lit("ER消解")) & F.col("to_asset_id").isNotNull() & (F.col("origin") == "逻辑FK列") & ~F.col("conflict_flag"))


def impure_basis(edges: DataFrame) -> DataFrame:
    return edges.where(F.contains("basis_raw", F.lit("｜ER")))


def same_column_targets(edges: DataFrame) -> DataFrame:
    """Q-10, an extension: columns of one name that point to several tables."""
    return edges.where("to_asset_id is not null").groupBy("from_column").agg(F.countDistinct("to_asset_id").alias("n_targets")).where("n_targets > 1")


def name_differences(found: DataFrame, documented: DataFrame) -> DataFrame:
    """I-5: (name, missing_in) of table names that only one side has, as often as it has more of them; none when both agree."""
    a, b = found.select("name"), documented.select("name")
    return a.exceptAll(b).withColumn("missing_in", F.lit("documented")).unionByName(b.exceptAll(a).withColumn("missing_in", F.lit("found")))


# ---------------------------------------------------------------- inferred keys


def infer_keys(columns: DataFrame) -> DataFrame:
    """I-1 by names: (child, fk, parent) where a column's name after its table prefix is another table's key (table, name, is_key)."""
    bare = F.regexp_replace("name", r"^[a-z]+_", "")
    c = columns.select(F.col("table").alias("child"), F.col("name").alias("fk"), bare.alias("bare"), "is_key")
    p = columns.where("is_key").select(F.col("table").alias("parent"), bare.alias("bare"))
    return c.join(p, "bare").where("child <> parent").select("child", "fk", "parent")


def key_cardinality(child: DataFrame, key: str) -> DataFrame:
    """I-2 on data: 1:1 where no value of the key occurs twice, else 1:N."""
    counts = child.where(F.col(key).isNotNull()).groupBy(key).count()
    return counts.agg(F.when(F.coalesce(F.max("count"), F.lit(0)) > 1, "1:N").otherwise("1:1").alias("cardinality"))


#: The steps of evidence for a key, the strongest first.
STEPS = ["显式外键", "注释明示", "索引佐证", "字段命名", "业务语义推断"]
#: Names of keys that say nothing about their table.
GENERIC = ["id", "key", "code", "no", "name"]
SKETCH = 256


def infer_ladder(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """I-1: (child, fk, parent, to_column, step): the strongest evidence that a column refers to another table.

    columns: (table, name, meaning, is_key), constraints as ddl.constraints gives them.  The steps, in order: a foreign key;
    a comment that names a table; a name that means a table's key, on a column that an index begins with; such a name
    alone; and a name that ends in a table's name.  A name means a key if it is `<table>_id` or `<table>_code`, or
    has the key's own name behind its prefix, unless that is one that every table may have.  Names match without case.  A column may refer to
    several tables by evidence of one step; weaker steps are then left out.
    """
    low = lambda c: F.lower(F.col(c))
    bare = lambda c: F.regexp_replace(low(c), r"^[a-z]+_", "")
    c = columns.select(F.col("table").alias("child"), F.col("name").alias("fk"), "meaning", low("name").alias("_n"), bare("name").alias("_bare"))
    keys = columns.where("is_key").select(F.col("table").alias("parent"), F.col("name").alias("to_column"), low("table").alias("_t"), bare("name").alias("_key"))
    foreign = constraints.where("kind = 'FOREIGN'").select(F.col("table").alias("child"), F.col("column").alias("fk"), "parent", F.col("parent_column").alias("to_column"), F.lit(0).alias("rank"))
    words = c.select("child", "fk", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("meaning", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lower))).alias("_t"))
    said = words.join(keys, "_t").select("child", "fk", "parent", "to_column", F.lit(1).alias("rank"))
    stem = c.withColumn("_t", F.regexp_extract("_n", r"^(.+)_(?:id|code)$", 1)).where("_t <> ''").join(keys, "_t")
    same = c.join(keys.where(~F.col("_key").isin(GENERIC)), F.col("_bare") == F.col("_key"))
    led = constraints.where("kind <> 'FOREIGN' AND at = 0").select(F.lower("table").alias("_lt"), F.lower("column").alias("_lc")).distinct()
    named = stem.select("child", "fk", "parent", "to_column").unionByName(same.select("child", "fk", "parent", "to_column")).distinct()
    named = named.join(led, (F.lower("child") == F.col("_lt")) & (F.lower("fk") == F.col("_lc")), "left").select("child", "fk", "parent", "to_column", F.when(F.col("_lt").isNotNull(), 2).otherwise(3).alias("rank"))
    ends = c.withColumn("_t", F.regexp_extract("_n", r"^(?:[a-z]+_)?([a-z0-9]+?)(?:_?name)?$", 1)).join(keys, "_t").select("child", "fk", "parent", "to_column", F.lit(4).alias("rank"))
    every = foreign.unionByName(said).unionByName(named).unionByName(ends).where(F.lower("child") != F.lower("parent"))
    best = every.groupBy("child", "fk").agg(F.min("rank").alias("best"))
    rows = every.join(best, ["child", "fk"]).where("rank = best").groupBy("child", "fk", "parent").agg(F.min("to_column").alias("to_column"), F.min("rank").alias("rank"))
    return rows.select("child", "fk", "parent", "to_column", F.element_at(F.array(*[F.lit(x) for x in STEPS]), F.col("rank") + 1).alias("step"))


def sketched(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bucket, least): of each of SKETCH buckets of a column's hashed values the least hash; sketches of parts merge by minimum."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.xxhash64(F.col(c).cast("string")).alias("h"), F.col(c).isNotNull().alias("some")) for c in columns]))
    return rows.select(each.alias("v")).select("v.*").where("some").groupBy("column", F.pmod("h", F.lit(SKETCH)).alias("bucket")).agg(F.min("h").alias("least"))


def tested_on_rows(candidates: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """candidates (child, fk, parent, to_column, ...) with `refuted_by` (sketch, rows or null) and n_missing, the rows of the child whose value no parent has.

    A value set that lies within another has in no bucket a lesser least hash, so sketches, one pass a table, refute most wrong
    candidates; n_missing is null for these.  Those left are settled by an anti join each.  Candidates are few: they come from names.
    """
    asked = candidates.select("child", "fk", "parent", "to_column").distinct().collect()
    wanted: dict[str, set[str]] = {}
    for r in asked:
        wanted.setdefault(r["child"], set()).add(r["fk"])
        wanted.setdefault(r["parent"], set()).add(r["to_column"])
    parts = [sketched(tables[t], sorted(cs)).select(F.lit(t).alias("table"), "*") for t, cs in sorted(wanted.items())]
    spark = candidates.sparkSession
    if not parts:
        return candidates.withColumns({"refuted_by": F.lit(None).cast("string"), "n_missing": F.lit(None).cast("long")})
    all_ = staged(reduce(DataFrame.unionByName, parts))
    ours = all_.select(F.col("table").alias("child"), F.col("column").alias("fk"), "bucket", F.col("least").alias("a"))
    theirs = all_.select(F.col("table").alias("parent"), F.col("column").alias("to_column"), "bucket", F.col("least").alias("b"))
    pairs = candidates.select("child", "fk", "parent", "to_column").distinct().join(ours, ["child", "fk"]).join(theirs, ["parent", "to_column", "bucket"], "left")
    broken = {(r["child"], r["fk"], r["parent"], r["to_column"]) for r in pairs.where("b IS NULL OR b > a").select("child", "fk", "parent", "to_column").distinct().collect()}
    found = []
    for r in asked:
        key = (r["child"], r["fk"], r["parent"], r["to_column"])
        n = None if key in broken else dangling(tables[r["child"]], r["fk"], tables[r["parent"]], r["to_column"]).count()
        found.append((*key, "sketch" if n is None else "rows" if n else None, n))
    tested = spark.createDataFrame(found, "child string, fk string, parent string, to_column string, refuted_by string, n_missing long")
    return candidates.join(F.broadcast(tested), ["child", "fk", "parent", "to_column"])  # a row a candidate


def bridge_cardinality(rows: DataFrame, a: str, b: str) -> DataFrame:
    """I-2: (cardinality, n_pairs) between the tables that columns a and b of a bridge refer to: N:M where values of both meet several of the other."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    most = lambda c: pairs.groupBy(c).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_pairs"))
    left, right = most(a).first(), most(b).first()
    kind = {(True, True): "N:M", (True, False): "1:N", (False, True): "N:1", (False, False): "1:1"}[left["most"] > 1, right["most"] > 1]
    return rows.sparkSession.createDataFrame([(kind, left["n_pairs"])], "cardinality string, n_pairs long")
