"""Search, facets, glossary, dictionary, audit and the three-level model (S-*, M-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import cut, found, found_all
from cairn.operators.dq import seeded_rules
from cairn.operators.lineage import NotFound
from cairn.operators.relations import relations_of

MOST_PAGE = 500


class RuleError(ValueError):
    """A reference or a name breaks a rule of the glossary or the dictionary."""


def _like(c: str, part: str | None) -> Column:
    return F.lit(True) if part is None or part == "" else F.contains(F.lower(c), F.lit(part.lower()))


def _same(c: str, value: str | None) -> Column:
    return F.lit(True) if value is None or value == "" else F.lower(c) == value.lower()


# ---------------------------------------------------------------- search


def search(assets: DataFrame, keyword: str | None = None, domain: str | None = None, grading: str | None = None, limit: int | None = 200) -> DataFrame:
    """S-1: assets by part of the name, domain and grading, by name; the limit comes after the filters, None is all."""
    rows = assets.where(_like("name", keyword) & _same("domain_code", domain) & _same("grading", grading)).orderBy("name")
    return rows if limit is None else rows.limit(limit)


def facets(assets: DataFrame) -> DataFrame:
    """S-2: (facet, value, n) by domain, by grading and in total; no value is `?`."""
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    base = assets.select(unknown("domain_code").alias("domain"), unknown("grading").alias("grading"))
    sets = base.groupingSets([["domain"], ["grading"], []], "domain", "grading").agg(F.count("*").alias("n"), F.grouping_id("domain", "grading").alias("g"))
    name = F.when(F.col("g") == 1, "domain").when(F.col("g") == 2, "grading").otherwise("total")
    return sets.select(name.alias("facet"), F.when(F.col("g") == 1, F.col("domain")).when(F.col("g") == 2, F.col("grading")).otherwise("total").alias("value"), "n")


def by_name(assets: DataFrame, name: str) -> DataFrame:
    return assets.where(F.lower("name") == name.lower())


def detail_columns(assets: DataFrame, columns: DataFrame, urn: str) -> DataFrame:
    """S-3: an asset's columns in order."""
    one = assets.where(F.col("asset_urn") == urn).select(F.col("id").alias("asset_id"))
    return columns.join(one, "asset_id").orderBy("ordinal")


def detail(assets: DataFrame, columns: DataFrame, edges: DataFrame, urn: str) -> dict[str, DataFrame]:
    """S-3: an asset's `summary`, its `columns` in order and its `relations` (both directions, with names); NotFound without it.

    The parts stay three frames: an asset may have any number of incoming edges.
    """
    own = assets.where(F.col("asset_urn") == urn)
    ids = own.select("id").take(1)
    if not ids:
        raise NotFound(urn)
    return {"summary": own, "columns": detail_columns(assets, columns, urn), "relations": relations_of(edges, assets, ids[0]["id"]).orderBy(F.desc("direction"), "id")}


# ---------------------------------------------------------------- glossary


def term_list(terms: DataFrame, refs: DataFrame, keyword: str | None = None, domain: str | None = None, status: str | None = None) -> DataFrame:
    """S-5: terms by name with ref_count."""
    counts = refs.groupBy("term_id").agg(F.count("*").alias("ref_count"))
    chosen = terms.where(_like("name", keyword) & _same("domain_code", domain) & _same("status", status))
    return chosen.join(counts, chosen["id"] == counts["term_id"], "left").drop("term_id").fillna(0, ["ref_count"]).orderBy("name")


def add_term(terms: DataFrame, name: str, users: DataFrame, owner_id: int | None = None, **fields: str) -> DataFrame:
    """S-6: terms with a new draft; its name has to be given and new, its owner a user."""
    if not name or not name.strip():
        raise RuleError("a term needs a name")
    if terms.where(F.col("name") == name).take(1):
        raise RuleError(f"{name} exists")
    if owner_id is not None and not users.where(F.col("id") == owner_id).take(1):
        raise RuleError(f"no user {owner_id}")
    top = terms.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    row = {"id": top + 1, "name": name, "owner_id": owner_id, "status": "DRAFT"} | fields
    known = [f for f in terms.schema if f.name in row]
    new = terms.sparkSession.createDataFrame([tuple(row[f.name] for f in known)], type(terms.schema)(known))
    return terms.unionByName(new, allowMissingColumns=True)


def update_term(terms: DataFrame, term_id: int, **fields: str) -> DataFrame:
    """S-6: terms with the given fields of one term replaced; it has to exist, and its name to be given and new."""
    if "name" in fields:
        if not (fields["name"] or "").strip():
            raise RuleError("a term needs a name")
        if terms.where((F.col("name") == fields["name"]) & (F.col("id") != term_id)).take(1):
            raise RuleError(f"{fields['name']} exists")
    if not terms.where(F.col("id") == term_id).take(1):
        raise RuleError(f"no term {term_id}")
    own = F.col("id") == term_id
    return terms.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)).cast(terms.schema[c].dataType) for c, v in fields.items()})


def delete_term(terms: DataFrame, refs: DataFrame, term_id: int) -> tuple[DataFrame, DataFrame]:
    """Terms and references without the term and what refers to it."""
    return terms.where(F.col("id") != term_id), refs.where(F.col("term_id") != term_id)


def bind(requests: DataFrame, refs: DataFrame, columns: DataFrame, assets: DataFrame) -> DataFrame:
    """S-7: requests (term_id, asset_id, column_id) with `outcome` and the filled-in asset_id and ref_type.

    A column brings its asset; another asset beside it, an unknown one, or neither is an error; equal references exist once.
    """
    own = columns.select(F.col("id").alias("column_id"), F.col("asset_id").alias("_own"))
    known = assets.select(F.col("id").alias("_asset"))
    rows = requests.join(own, "column_id", "left").withColumn("_a", F.coalesce("asset_id", "_own"))
    rows = rows.join(known, F.col("_a") == F.col("_asset"), "left").withColumn("ref_type", F.when(F.col("column_id").isNotNull(), "COLUMN").otherwise("TABLE"))
    there = refs.select(F.col("term_id").alias("_t"), F.col("asset_id").alias("_ra"), F.col("column_id").alias("_rc"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, (F.col("term_id") == F.col("_t")) & F.col("_a").eqNullSafe(F.col("_ra")) & F.col("column_id").eqNullSafe(F.col("_rc")), "left")
    outcome = (
        F.when(F.col("_a").isNull() & F.col("column_id").isNull(), "no_target").when(F.col("column_id").isNotNull() & F.col("_own").isNull(), "unknown_column")
        .when(F.col("_asset").isNull(), "unknown_asset").when(F.col("_own") != F.col("_a"), "column_of_another_asset").when(F.col("_there"), "exists").otherwise("bound")
    )
    return rows.select("term_id", F.col("_a").alias("asset_id"), "column_id", "ref_type", outcome.alias("outcome"))


def terms_for_asset(terms: DataFrame, refs: DataFrame, asset_id: int) -> DataFrame:
    """S-8: terms that refer to an asset or its columns, each once."""
    return terms.join(refs.where(F.col("asset_id") == asset_id).select("term_id").distinct(), F.col("id") == F.col("term_id"), "left_semi").orderBy("name")


# ---------------------------------------------------------------- dictionary and audit

#: Fields of a dictionary's entries, and the order in which they are listed.
DICTIONARIES = {
    "standard_field": (["field_name", "data_type", "length_val", "semantic", "enabled"], ["field_name", "id"]),
    "code_value": (["category", "code_value", "meaning", "ordinal"], ["category", "ordinal", "id"]),
    "naming_rule": (["name", "target", "pattern", "description", "enabled"], ["name", "id"]),
}

# Seeded naming rules (name, target, pattern, description), standard fields (field_name, data_type, length_val, semantic) and code values (category, code_value, meaning, ordinal).
NAMING = [("table-snake", "table", "^[a-z][a-z0-9_]*$", "表名全小写下划线"), ("column-snake", "column", "^[a-z][a-z0-9_]*$", "列名全小写下划线(对治 05 C类命名漂移)")]
FIELDS = [("id", "bigint", None, "主键，自增"), ("create_time", "datetime", None, "创建时间"), ("update_time", "datetime", None, "更新时间"), ("is_deleted", "tinyint", None, "逻辑删除标志 0/1"), ("remark", "varchar", 500, "备注")]
CODES = [
    ("confirm_status", "待确认", "推断关系未经人工确认（默认态）", 1), ("confirm_status", "已确认", "管家确认推断成立", 2), ("confirm_status", "已驳回", "管家确认推断不成立", 3),
    ("certification_status", "认证", "资产信息可信", 1), ("certification_status", "待审", "进入认证评审流程", 2), ("certification_status", "未认证", "默认态", 3),
    ("sensitivity_level", "PII", "含个人敏感信息", 1), ("sensitivity_level", "机密", "商业机密", 2), ("sensitivity_level", "内部", "仅限内部使用", 3), ("sensitivity_level", "公开", "可对外", 4),
]
TERMS = [("贸易商", "D08", "示例术语：与外部贸易往来主体的业务口径待 Owner 补录（R4）"), ("销售订单", "D01", "示例术语：销售下单主对象的业务口径待 Owner 补录（R4）")]
USERS = [("admin", "平台管理员", "ADMIN"), ("steward", "数据管家", "STEWARD"), ("viewer", "只读用户", "READONLY")]


def seeds(spark) -> dict[str, tuple[DataFrame, list[str]]]:
    """U-6: what a new catalog starts with, by table, and the columns that tell its rows apart."""
    on = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("enabled", F.lit(True))
    return {
        "dq_rule": (seeded_rules(spark), ["code"]),
        "naming_rule": (on(NAMING, "name string, target string, pattern string, description string"), ["name"]),
        "standard_field": (on(FIELDS, "field_name string, data_type string, length_val int, semantic string"), ["field_name"]),
        "code_value": (spark.createDataFrame(CODES, "category string, code_value string, meaning string, ordinal int"), ["category", "code_value"]),
        "term": (spark.createDataFrame(TERMS, "name string, domain_code string, note string").withColumn("status", F.lit("DRAFT")), ["name"]),
        "user": (spark.createDataFrame(USERS, "username string, display string, role string"), ["username"]),
    }


def dictionary_list(entries: DataFrame, kind: str, category: str | None = None) -> DataFrame:
    """S-9: a dictionary's entries in its order; of code values those of one category, if it is given and not blank."""
    if kind == "code_value" and category is not None and category.strip():
        return code_values(entries, category)
    return entries.orderBy(*DICTIONARIES[kind][1])


def _checked(entries: DataFrame, kind: str, fields: dict) -> dict:
    """The fields of an entry; those not given are null, but an entry is enabled unless it is said not to be."""
    names = DICTIONARIES[kind][0]
    if unknown := sorted(set(fields) - set(names)):
        raise RuleError(f"{kind} has no {', '.join(unknown)}")
    row = {n: fields.get(n) for n in names}
    if "enabled" in row and row["enabled"] is None:
        row["enabled"] = True
    if kind == "naming_rule":
        valid_pattern(row["pattern"], entries.sparkSession)
    return row


def _known(entries: DataFrame, kind: str, entry_id: int) -> Column:
    own = F.col("id") == entry_id
    if not entries.where(own).take(1):
        raise NotFound(f"{kind} {entry_id}")
    return own


def create_entry(entries: DataFrame, kind: str, **fields) -> DataFrame:
    """S-9: the dictionary with one entry more, under a new id; a naming rule's pattern has to be one, a code value's ordinal is 0 if not given.

    To keep the id safe from a second writer, commit it by `store.update(lambda s, base: ({kind: create_entry(s.read(kind, base), kind, ...)}, {}))`.
    """
    row = _checked(entries, kind, fields)
    if "ordinal" in row and row["ordinal"] is None:
        row["ordinal"] = 0
    top = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    given = {"id": top + 1} | row
    return entries.unionByName(entries.sparkSession.range(1).select(*[F.lit(given[f.name]).cast(f.dataType).alias(f.name) for f in entries.schema if f.name in given]), allowMissingColumns=True)


def update_entry(entries: DataFrame, kind: str, entry_id: int, **fields) -> DataFrame:
    """S-9: the dictionary with all fields of one entry replaced, by null where they are not given; only an ordinal that is not given stays."""
    own, row = _known(entries, kind, entry_id), _checked(entries, kind, fields)
    if "ordinal" in row and row["ordinal"] is None:
        del row["ordinal"]
    return entries.withColumns({c: F.when(own, F.lit(v).cast(entries.schema[c].dataType)).otherwise(F.col(c)) for c, v in row.items() if c in entries.columns})


def delete_entry(entries: DataFrame, kind: str, entry_id: int) -> DataFrame:
    """S-9: the dictionary without one entry, which has to exist."""
    return entries.where(~_known(entries, kind, entry_id))


def code_values(codes: DataFrame, category: str | None = None) -> DataFrame:
    """S-9: all by (category, ordinal), or those of a category by (ordinal, id)."""
    return codes.orderBy("category", "ordinal") if category is None else codes.where(F.col("category") == category).orderBy("ordinal", "id")


def valid_pattern(pattern: str, spark) -> str:
    """The pattern of a naming rule, if Java's regular expressions take it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise RuleError(f"pattern {pattern!r}") from e
    return pattern


def audit_rows(rows: DataFrame) -> DataFrame:
    """S-11: entries as they are stored, target and detail cut to length."""
    return rows.withColumns({"target": cut("target", 200), "detail": cut("detail", 1000)})


def audit_search(audit: DataFrame, username: str | None = None, action: str | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """S-10: entries by parts of user and action, the latest first, in pages of at most 500."""
    size = max(1, min(MOST_PAGE, size))
    return audit.where(_like("username", username) & _like("action", action)).orderBy(F.desc("at_ts"), F.desc("id")).offset(page * size).limit(size)


# ---------------------------------------------------------------- three-level model

# Fixed value: the basis of each mapping.
BASIS = "05 §二 三分类·名称经物理目录校验"


def tokens(expression: Column | str) -> Column:
    """M-1a: identifiers outside of parentheses, in order, in lower case."""
    e = F.col(expression) if isinstance(expression, str) else expression
    plain = F.regexp_replace(F.replace(e, F.lit("*"), F.lit("")), r"（[^）]*）|\([^)]*\)", " ")
    return F.transform(found_all(plain, "([A-Za-z][A-Za-z0-9_]+)"), F.lower)


def build_model(entities: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """M-1: bom, ldm, pdm and mapping from core entities (doc, line_no, ...) and the catalog (id, name, domain_code, asset_urn, column_count).

    Rows are told apart by (doc, line_no), so that a rebuild gives the same keys.  The first entity that
    names a table gives its description.
    """
    bom_key = F.concat_ws(":", "doc", F.col("line_no").cast("string"))
    rows = entities.withColumn("bom_key", bom_key).withColumn("tokens", tokens("expression"))
    catalog = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), F.lower("name").alias("_t"), F.col("domain_code").alias("asset_domain"), "asset_urn", "column_count")
    named = rows.select("bom_key", "doc", "line_no", "description", F.posexplode("tokens").alias("at", "_t")).join(catalog, "_t")
    first = Window.partitionBy("bom_key", "asset_id").orderBy("at")
    named = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    best = named.groupBy("bom_key").agg(F.min_by("asset_name", "at").alias("first_name"), F.count("*").alias("n_mapped"))
    label = F.coalesce(found("expression", "（([^）]*)）"), found("expression", r"\(([^)]*)\)"))
    bom = rows.join(best, "bom_key", "left").select(
        "bom_key", "category", cut("domain_code", 16).alias("domain_code"), cut("description", 1000).alias("description"), cut("expression", 500).alias("source_expr"), cut(label, 200).alias("label"),
        cut(F.coalesce("first_name", F.get("tokens", F.lit(0)), "expression"), 200).alias("name"), F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"),
    )
    once = Window.partitionBy("asset_id").orderBy("doc", "line_no")
    ldm = named.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(F.col("asset_name").alias("name"), F.col("asset_domain").alias("domain_code"), cut("description", 1000).alias("description"), "asset_id")
    pdm = named.select(F.col("asset_name").alias("name"), "asset_id", "asset_urn", "column_count").distinct()
    mapping = named.select("bom_key", "asset_id", F.col("asset_name").alias("ldm_name"), F.col("asset_name").alias("pdm_name"), F.lit(BASIS).alias("basis"))
    return {"bom": bom, "ldm": ldm, "pdm": pdm, "mapping": mapping}


def model_trace(model: dict[str, DataFrame], assets: DataFrame, bom_key: str) -> DataFrame:
    """M-3: (ldm_name, ldm_domain_code, pdm_name, asset_id, asset_urn, column_count, basis, resolved) of a business object; NotFound without it.

    A mapping is resolved where its physical table is in the model and its asset still in the catalog; the
    object's own domain stands in where the logical table is missing.
    """
    own = model["bom"].where(F.col("bom_key") == bom_key).select("bom_key", F.col("domain_code").alias("_own"))
    if not own.take(1):
        raise NotFound(bom_key)
    ldm = model["ldm"].select("asset_id", F.col("domain_code").alias("_ldm"), F.lit(True).alias("_logical"))
    pdm = model["pdm"].select("asset_id", "asset_urn", "column_count", F.lit(True).alias("_physical"))
    live = assets.select(F.col("id").alias("asset_id"), F.lit(True).alias("_live"))
    m = model["mapping"].join(own, "bom_key").join(ldm, "asset_id", "left").join(pdm, "asset_id", "left").join(live, "asset_id", "left")
    domain = F.when(F.col("_logical"), F.col("_ldm")).otherwise(F.col("_own"))
    resolved = F.coalesce(F.col("_physical") & F.col("_live"), F.lit(False))
    return m.select("ldm_name", domain.alias("ldm_domain_code"), "pdm_name", "asset_id", "asset_urn", "column_count", "basis", resolved.alias("resolved"))


def model_overview(model: dict[str, DataFrame]) -> DataFrame:
    """M-4: (item, n): totals, objects without table, and objects by category."""
    b = model["bom"]
    one = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")
    totals = one(b, "bom").unionByName(one(model["ldm"], "ldm")).unionByName(one(model["pdm"], "pdm")).unionByName(one(model["mapping"], "mapping")).unionByName(one(b.where("n_mapped = 0"), "unmapped"))
    return totals.unionByName(b.groupBy(F.col("category").alias("item")).agg(F.count("*").alias("n")))
