"""Model documents to records: logical models (P-2), diagrams (P-3), census (P-4), core entities (P-5), candidates (P-7).

Each takes lines (doc, line_no, line) and carries state along a document with one window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import carried, col, confidence_of, found, found_all, fully, level_of, trim

CANDIDATES = "array<struct<target:string,source:string,doc:string,why:string>>"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


# ---------------------------------------------------------------- logical models


def _basis_rank(basis: Column) -> Column:
    """P-2d: how strong the wording of a logical model is."""
    has = lambda x: F.contains(basis, F.lit(x))
    return F.when(has("注释明示"), 1).when(has("索引佐证"), 2).when(has("命名推断") | has("自关联"), 3).when(has("语义推断"), 4).otherwise(5)


def section_name(title: Column) -> Column:
    """P-2a: the table a heading names, else an empty string."""
    return F.regexp_extract(F.regexp_replace(title, r"^\d+\.\s*", ""), r"^([A-Za-z][A-Za-z0-9_]*)\s*(?:[—（(\-*†‡]|$)", 1)


def logical_relations(lines: DataFrame) -> DataFrame:
    """(doc, line_no, cell_no, mark_no, from_table, from_column, target_raw, basis_raw, to_column, evidence_level, confidence,
    cross_domain, discriminator): every FK[target·basis] of a table row below a heading that names a table.

    A heading that names none ends the table.  The first of equal (table, column, target) in a document stays.
    """
    heading = r"^#{2,4}\s+(.*)$"
    rows = lines.withColumn("line", trim("line"))
    marker = F.when(F.col("line").rlike(heading), section_name(F.regexp_extract("line", heading, 1)))
    rows = rows.withColumn("from_table", carried(marker)).where((F.col("from_table") != "") & F.col("line").startswith("|"))
    rows = rows.withColumn("cells", F.split("line", r"\|", -1)).where(F.size("cells") >= 6)
    rows = rows.withColumn("from_column", F.regexp_replace(trim(F.col("cells")[1]), r"[*`†‡\s]", "")).where(fully("from_column", IDENTIFIER))
    cells = rows.select("doc", "line_no", "from_table", "from_column", F.posexplode(F.slice("cells", 3, F.size("cells") - 3)).alias("cell_no", "cell"))
    marks = cells.select("doc", "line_no", "from_table", "from_column", "cell_no", F.posexplode(found_all("cell", r"FK\[([^\]]+)\]")).alias("mark_no", "mark"))
    dot = F.instr("mark", "·")
    basis = F.when(dot > 0, trim(F.replace(F.expr("substring(mark, instr(mark, '·') + 1)"), F.lit("·"), F.lit(" ")))).otherwise("")
    out = marks.withColumn("target_raw", trim(F.substring_index("mark", "·", 1))).withColumn("basis_raw", basis)
    once = Window.partitionBy("doc", "from_table", "from_column", "target_raw").orderBy("line_no", "cell_no", "mark_no")
    out = out.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("_r", _basis_rank(F.col("basis_raw")))
    return out.select(
        "doc", "line_no", "cell_no", "mark_no", "from_table", "from_column", "target_raw", "basis_raw", found("basis_raw", r"\(([a-z][a-z0-9_]*)\)").alias("to_column"), level_of(F.col("_r")).alias("evidence_level"),
        confidence_of(F.col("_r")).alias("confidence"), found("basis_raw", r"跨域\s*(D\d{2})").alias("cross_domain"), discriminator(F.concat_ws(" ", "target_raw", "basis_raw")).alias("discriminator"),
    )


def discriminator(text: Column | str) -> Column:
    """P-6: the column that a polymorphic reference is told apart by."""
    return found(text, r"[（(]\s*[按依]\s*([A-Za-z_][A-Za-z0-9_]*)")


def resolve_targets(relations: DataFrame, catalog: DataFrame) -> DataFrame:
    """P-2f, U-2a: relations with target_no, target and to_asset_id, one row for each target in the catalog (id, name).

    A self reference is the table itself; A/B gives each part that exists; else one row without target.
    """
    plain = trim(F.replace(F.col("target_raw"), F.lit("*"), F.lit("")))
    own = F.contains(plain, F.lit("自关联")) | (F.lower(plain) == F.lower("from_table"))
    parts = F.when(own, F.array("from_table")).otherwise(F.transform(F.split(plain, "/"), trim))
    names = catalog.select(F.col("id").alias("to_asset_id"), F.lower("name").alias("_known"))
    each = relations.select("*", F.posexplode(parts).alias("target_no", "target")).join(names, F.lower("target") == F.col("_known"), "left").drop("_known")
    edge = Window.partitionBy("doc", "line_no", "cell_no", "mark_no")
    each = each.withColumn("n_targets", F.count("to_asset_id").over(edge))
    each = each.where(F.col("to_asset_id").isNotNull() | ((F.col("n_targets") == 0) & (F.col("target_no") == 0)))
    return each.withColumn("target", F.when(F.col("to_asset_id").isNotNull(), F.col("target")))


# ---------------------------------------------------------------- diagrams


def symbol_kind(symbol: Column | str) -> Column:
    """P-3a: the kind of a relationship symbol; null where it is none."""
    s = col(symbol)
    sep = F.when(F.instr(s, "--") > 0, F.instr(s, "--")).otherwise(F.instr(s, ".."))
    left, right = F.substring(s, F.lit(1), sep - 1), F.substring(s, sep + 2, F.length(s))
    legal = (sep > 0) & fully(left, r"[|o}]*") & fully(right, r"[|o{]*")
    many_l, many_r = F.contains(left, F.lit("}")), F.contains(right, F.lit("{"))
    return (
        F.when(~legal, None).when((left == "") | (right == ""), "UNSUPPORTED_SYMBOL").when(many_l & many_r, "MANY_TO_MANY")
        .when(many_r, "ONE_TO_MANY").when(many_l, "MANY_TO_ONE").otherwise("ONE_TO_ONE")
    )


def cardinality_of(kind: Column | str) -> Column:
    k = col(kind)
    return F.when(k.isin("ONE_TO_MANY", "MANY_TO_ONE"), "1:N").when(k == "ONE_TO_ONE", "1:1").when(k == "MANY_TO_MANY", "N:M")


def _clashes(kind: Column, label: Column) -> Column:
    """P-3b: the label begins with a cardinality other than the symbol's."""
    pattern = r"^\s*([0-9MmNn.]+)\s*[:：]\s*([0-9MmNn.]+)"
    many = lambda g: F.regexp_extract(label, pattern, g).rlike("[MmNn]")
    l_sym, r_sym = kind.isin("MANY_TO_ONE", "MANY_TO_MANY"), kind.isin("ONE_TO_MANY", "MANY_TO_MANY")
    return (kind != "UNSUPPORTED_SYMBOL") & label.rlike(pattern) & ((many(1) != l_sym) | (many(2) != r_sym))


def _label_rank(token: Column) -> Column:
    """P-3d: the words of diagrams; they are not those of logical models."""
    has = lambda x: F.contains(token, F.lit(x))
    return F.when(has("注释明示"), 1).when(has("索引"), 2).when(has("命名推断") | has("字段命名"), 3).when(has("语义"), 4).otherwise(5)


def label_rank(label: Column | str) -> Column:
    """The strongest word in any bracket that doesn't speak of another domain."""
    brackets = F.filter(found_all(label, r"\[([^\]]+)\]"), lambda x: ~F.contains(x, F.lit("跨域")))
    return F.coalesce(F.array_min(F.transform(brackets, _label_rank)), F.lit(5))


def label_columns(label: Column) -> tuple[Column, Column]:
    """P-3f: the candidates for the child's column, and the parent's column."""
    separators = ["->", "↔", "＝", "="]
    at = F.least(*[F.nullif(F.instr(label, s), F.lit(0)) for s in separators])
    before = F.when(at.isNull(), label).otherwise(F.substring(label, F.lit(1), at - 1))
    after = F.when(at.isNotNull(), F.substring(label, at + F.when(F.substring(label, at, F.lit(2)) == "->", 2).otherwise(1), F.length(label)))
    dotted = r"([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]+)"
    named = F.array_distinct(F.filter(found_all(before, dotted, 2), lambda x: F.lower(x) != "id"))
    bare = F.array_distinct(found_all(before, r"(?i)\b([A-Za-z][A-Za-z0-9_]*_(?:id|code))\b"))
    return F.when(F.size(named) > 0, named).otherwise(bare), F.get(found_all(after, dotted, 2), F.lit(0))


def diagram_relations(lines: DataFrame) -> DataFrame:
    """(doc, line_no, left_table, right_table, kind, cardinality, evidence_level, confidence, cross_domain, from_columns, to_column, label)
    of the relationship lines inside mermaid fences."""
    relation = rf'^\s*({IDENTIFIER})\s+(\S+)\s+({IDENTIFIER})\s*:\s*"(.*)"\s*$'
    rows = lines.withColumn("line", trim("line"))
    fence = F.when(F.col("line").startswith("```"), F.col("line").rlike(r"^```\s*mermaid\s*\z"))
    rows = rows.withColumn("inside", carried(fence)).where(F.col("inside") & F.col("line").rlike(relation))
    part = lambda g: F.regexp_extract("line", relation, g)
    rows = rows.select("doc", "line_no", part(1).alias("left_table"), symbol_kind(part(2)).alias("kind"), part(3).alias("right_table"), part(4).alias("label")).where(F.col("kind").isNotNull())
    rows = rows.withColumn("kind", F.when(_clashes(F.col("kind"), F.col("label")), "AMBIGUOUS").otherwise(F.col("kind"))).withColumn("_r", label_rank("label"))
    cross = F.get(F.filter(F.transform(found_all("label", r"\[([^\]]+)\]"), lambda x: F.regexp_extract(x, r"跨域\s*[·\-]?\s*(D\d{2})", 1)), lambda x: x != ""), F.lit(0))
    candidates, target = label_columns(F.col("label"))
    return rows.select(
        "doc", "line_no", "left_table", "right_table", "kind", cardinality_of("kind").alias("cardinality"), level_of(F.col("_r")).alias("evidence_level"),
        confidence_of(F.col("_r")).alias("confidence"), cross.alias("cross_domain"), candidates.alias("from_columns"), target.alias("to_column"), "label",
    )


# ---------------------------------------------------------------- census and core entities


def domain_census(lines: DataFrame) -> DataFrame:
    """(doc, line_no, code, name, declared_count, tables): P-4.

    A section's first plain line is its list.  A heading before it leaves the list empty; where the next
    section comes first, or the document ends, the section is dropped.
    """
    section = r"^### (D\d{2}|OT)\s+(.+?)（(\d+)"
    rows = lines.withColumn("line", trim("line")).withColumn("opens", F.coalesce(F.col("line").rlike(section), F.lit(False)))
    rows = rows.withColumn("at", carried(F.when(F.col("opens"), F.col("line_no")))).where(F.col("at").isNotNull())
    ends = F.col("line").startswith("##")
    plain = (F.col("line") != "") & ~F.col("line").rlike("^[#>|]")
    first = F.min(F.when(~F.col("opens") & (ends | plain), F.struct("line_no", "line")))
    found_sections = rows.groupBy("doc", F.col("at").alias("line_no")).agg(F.max(F.when(F.col("opens"), F.col("line"))).alias("head"), first.alias("first")).where("first is not null")
    names = F.filter(F.transform(F.split("first.line", "、"), lambda x: F.replace(trim(x), F.lit("`"), F.lit(""))), lambda x: x != "")
    return found_sections.select(
        "doc", "line_no", F.regexp_extract("head", section, 1).alias("code"), trim(F.regexp_extract("head", section, 2)).alias("name"), F.regexp_extract("head", section, 3).cast("int").alias("declared_count"),
        F.when(F.col("first.line").startswith("##"), F.array().cast("array<string>")).otherwise(names).alias("tables"),
    )


def core_entities(lines: DataFrame) -> DataFrame:
    """(doc, line_no, category, expression, domain_code, description): P-5, the three-cell rows of section 二."""
    rows = lines.withColumn("line", trim("line"))
    rows = rows.withColumn("inside", F.coalesce(carried(F.when(F.col("line").startswith("## "), F.col("line").startswith("## 二"))), F.lit(False)))
    heading = F.col("inside") & F.col("line").startswith("### ")
    has = lambda x: F.contains("line", F.lit(x))
    category = F.when(has("2.1"), "MASTER").when(has("2.2"), "TRANSACTIONAL").when(has("2.3"), "CONFIG").otherwise("")
    rows = rows.withColumn("category", carried(F.when(heading, category))).where(F.col("inside") & ~F.col("line").startswith("#") & (F.col("category") != "") & F.col("line").startswith("|"))
    inner = F.regexp_replace(F.regexp_replace("line", r"^\|", ""), r"\|\z", "")
    rows = rows.withColumn("cells", F.transform(F.split(F.regexp_replace(inner, r"\|+\z", ""), r"\|"), trim)).where(F.size("cells") >= 3).withColumn("expression", F.col("cells")[0])
    rows = rows.where((F.col("expression") != "") & ~F.col("expression").rlike("^:-|^--") & ~F.contains("expression", F.lit("实体")))
    return rows.select("doc", "line_no", "category", "expression", F.col("cells")[1].alias("domain_code"), F.col("cells")[2].alias("description"))


# ---------------------------------------------------------------- candidates


def candidates_read(json: Column | str) -> Column:
    """P-7: a list of candidates; null, blank or malformed text is an empty one."""
    return F.coalesce(F.from_json(col(json), CANDIDATES), F.array().cast(CANDIDATES))


def candidates_write(c: Column | str) -> Column:
    """The list as JSON text; null where it is empty."""
    return F.when(F.size(col(c)) > 0, F.to_json(col(c)))


def candidates_upsert(c: Column, one: Column) -> Column:
    """P-7a: appended unless the same entry is there."""
    return F.when(F.array_contains(c, one), c).otherwise(F.array_append(c, one))


def candidates_replace(c: Column, source: str, fresh: Column) -> Column:
    """P-7b: all entries of a source go, the fresh ones come, once each."""
    kept = F.filter(c, lambda x: ~x["source"].eqNullSafe(F.lit(source)))
    return F.concat(kept, F.array_except(F.array_distinct(fresh), kept))
