"""Catalog queries on tables that look like those far larger ones give: numbers of edges that meet."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import upsert, versions
from cairn.plans import registry
from cairn.plans.tables import RAW, TABLES, Tables
from tests.test_oracles import SF, _rows, duck  # noqa: F401  a fixture


@pytest.mark.parametrize("name", ["er_overlay_counters", "er_overlay_new_edges", "rel_upsert_report", "rel_upsert_stored", "rel_dangling_sweep"])
def test_edges_of_one_number(spark, duck, tmp_path, monkeypatch, name):  # noqa: F811
    """From a million tables on, edges of the second kind have numbers that those of the first kind have too."""
    met = Tables(spark, SF).edge.selectExpr("CASE WHEN id > 1000000 THEN id - 1000000 + 14 ELSE id END AS id", "from_asset_id", "to_asset_id", "target", "from_column", "evidence_level", "confidence", "origin", "confirm_status", "cardinality", "conflict_flag")
    met.write.parquet(f"{tmp_path}/edge")
    monkeypatch.setattr(Tables, "edge", property(lambda t: t.spark.read.parquet(f"{tmp_path}/edge")))
    got = registry.QUERIES[name](spark, SF)
    text = TABLES["edge"].format(**{n: n for n in [*RAW, *TABLES]})
    assert text in registry.ORACLES[name]
    want = duck.sql(registry.ORACLES[name].replace(text, f"SELECT * FROM '{tmp_path}/edge/*.parquet'"))
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["impact_by_domain", "lineage_by_name", "lineage_capped"])
def test_a_slow_machine_changes_no_result(spark, duck, monkeypatch, name):  # noqa: F811
    """Traces of queries end by their budget, however long a level takes."""
    clock = iter(range(0, 10**9, 100))
    monkeypatch.setattr("cairn.operators.lineage.time.monotonic", lambda: next(clock))
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("least, most_affected", [(0, 1000), (1, 0)])
def test_impact_by_domain_counts_every_table(spark, duck, tmp_path, least, most_affected):  # noqa: F811
    """800 parts whose second edge leads to table 1, far more than a view shows; and a catalog without table 1, the root."""
    few = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 200")
    hub = few.crossJoin(spark.range(4)).withColumn("p_partkey", F.expr("4333 + 7000 * (p_partkey + 200 * id)")).drop("id")
    few.unionByName(hub).where(f"p_partkey >= {least}").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["impact_by_domain"](spark, str(tmp_path))
    want = duck.sql(registry.ORACLES["impact_by_domain"].replace("WITH RECURSIVE ", f"WITH RECURSIVE part AS (SELECT * FROM '{tmp_path}/part.parquet/*.parquet'), ", 1))
    rows = [tuple(r) for r in got.collect()]
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
    assert 0.8 * most_affected <= sum(n for _, n, _ in rows) <= most_affected


def test_a_version_header_is_made_once(spark, tmp_path):
    """Its counts go over whole catalogs, so what `get` has looked up is not computed again."""
    path = tmp_path / "headers"
    spark.createDataFrame([(1, "FULL"), (2, "INCREMENT")], "version_no long, kind string").write.parquet(str(path))
    one = versions.get(spark.read.parquet(str(path)), 2)
    path.rename(tmp_path / "moved")
    assert [tuple(r) for r in one.collect()] == [(2, "INCREMENT")]


def test_columns_meet_by_ids_of_their_tables(spark):
    """Columns of a table that goes, of one the store does not know, doubled ones, and one of the same name in another table."""
    facts = "ordinal int, type string, nullable string, default_val string, key_hint string, meaning string"
    rest = (None, None, None)
    assets, after = (spark.createDataFrame(x, "id long, name string") for x in ([(1, "A"), (2, "gone")], [(1, "A"), (3, "b")]))
    old = spark.createDataFrame([(7, 1, "X", 0, "int", "N", *rest, "note"), (8, 2, "x", 0, "int", "N", *rest, None), (9, 2, "y", 1, "int", "N", *rest, None)], f"id long, asset_id long, name string, {facts}, note string")
    new = spark.createDataFrame([("a", "x", 0, "json", "N", *rest), ("a", "X", 5, "text", "N", *rest), ("B", "x", 0, "int", "N", *rest), ("gone", "x", 0, "int", "N", *rest), ("nowhere", "x", 0, "int", "N", *rest)], f"table string, name string, {facts}")
    changes = upsert.owned_changes(old, new, assets, after)
    got = {tuple(r) for r in changes.select("change", "lives", "id", "asset_id", "name", "type", "note").collect()}
    assert got == {("updated", True, 7, 1, "X", "json", "note"), ("created", True, None, 3, "x", "int", None), ("unchanged", False, 8, 2, "x", "int", None), ("evicted", False, 9, 2, "y", "int", None), ("created", False, None, None, "x", "int", None)}
    assert sorted(tuple(r) for r in upsert.applied_columns(old, changes).select("id", "asset_id", "name", "type").collect()) == [(7, 1, "X", "json"), (10, 3, "x", "int")]
