"""Grading, domains and naming families of tables (G-1 to G-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import col

# Codes and names of the pseudo-domains of grades B and C.
DOMAIN_B, NAME_B = "B", "B级平台框架同构表"
DOMAIN_C, NAME_C = "C", "C级备份与测试表"

BACKUP = r"_bak_\d{6,}$"
PLATFORM = r"^lcap_|^[NP][0-9A-Fa-f]{7}_"


class LabelError(ValueError):
    """The census document contradicts itself."""


def grading(name: Column | str, a_domain: Column | str) -> Column:
    """G-1: C for backups and tests, then A for tables of the A list, B for platform tables, else null."""
    name = col(name)
    return F.when(name.rlike(BACKUP) | name.startswith("test_"), "C").when(col(a_domain).isNotNull(), "A").when(name.rlike(PLATFORM), "B")


def domain(name: Column | str, a_domain: Column | str) -> Column:
    g = grading(name, a_domain)
    return F.when(g == "A", col(a_domain)).when(g == "B", DOMAIN_B).when(g == "C", DOMAIN_C)


def prefix_family(name: Column | str) -> Column:
    """G-3: hex family, dated backup, copy, no prefix, or the first segment."""
    name = col(name)
    return (
        F.when(name.rlike(r"^[NP][0-9A-Fa-f]{7}_"), F.concat(F.substring(name, 1, 8), F.lit("(hex)")))
        .when(name.rlike(BACKUP), "*_bak(date)").when(name.rlike(r"_copy\d*$"), "*_copy")
        .when(~name.contains("_"), "(no-prefix)").otherwise(F.concat(F.substring_index(name, "_", 1), F.lit("_")))
    )


def key_hint(primary: Column, auto: Column) -> Column:
    """G-4: PK, AUTO, both, or null."""
    return F.nullif(F.concat_ws(",", F.when(primary, "PK"), F.when(auto, "AUTO")), F.lit(""))


def label(assets: DataFrame, domain_tables: DataFrame) -> DataFrame:
    """assets with grading and domain_code from the A list (name, code); names match with their case."""
    listed = domain_tables.select(F.col("name"), F.col("code").alias("_a"))
    return assets.drop("grading", "domain_code").join(listed, "name", "left").withColumns({"grading": grading("name", "_a"), "domain_code": domain("name", "_a")}).drop("_a")


def check_census(domains: DataFrame) -> None:
    """Raises where a list has not the declared length, or a table is in two lists (code, declared_count, tables)."""
    wrong = domains.where(F.size("tables") != F.col("declared_count")).select("code").take(1)
    if wrong:
        raise LabelError(f"domain {wrong[0][0]}: the list has not the declared length")
    twice = domains.select(F.explode("tables").alias("name")).groupBy("name").count().where("count > 1").take(1)
    if twice:
        raise LabelError(f"{twice[0][0]} is in two lists")


def labels_report(labelled: DataFrame) -> DataFrame:
    """G-2: total, a, b, c and unassigned tables, and how many domains they use."""
    g = F.col("grading")
    return labelled.agg(F.count("*").alias("total"), *[F.count_if(g == x).alias(x.lower()) for x in "ABC"], F.count_if(g.isNull()).alias("unassigned"), F.countDistinct("domain_code").alias("domains"))


def domain_registry(domains: DataFrame, labelled: DataFrame) -> DataFrame:
    """(code, name, grading, declared_count): the A domains, then B and C with as many tables as were graded so."""
    own = domains.select("code", "name", F.lit("A").alias("grading"), F.col("declared_count").cast("long").alias("declared_count"))
    spark = labelled.sparkSession
    pseudo = spark.createDataFrame([(DOMAIN_B, NAME_B, "B"), (DOMAIN_C, NAME_C, "C")], "code string, name string, grading string")
    counts = labelled.groupBy("grading").agg(F.count("*").alias("n"))
    return own.unionByName(pseudo.join(counts, "grading", "left").select("code", "name", "grading", F.coalesce("n", F.lit(0)).cast("long").alias("declared_count")))


def first_rule(names: DataFrame, rules: list[tuple[str, str]], unmatched: str = "UNMATCHED") -> DataFrame:
    """G-5: names with `domain`, that of the first (pattern, domain) rule whose pattern is found, ignoring case.

    Rules are a literal list of the caller, so one CASE evaluates them and nothing is joined.
    """
    out = F.lit(unmatched)
    for pattern, code in reversed(rules):
        out = F.when(F.col("name").rlike(f"(?i){pattern}"), code).otherwise(out)
    return names.withColumn("domain", out)
