"""Calls that raise, and plain cases that the registered queries do not meet."""

import random
import time

import pytest

from cairn.operators import catalog, dq, lineage, upsert, versions
from cairn.sources.sinks import Store

EDGES = "id long, from_asset_id long, to_asset_id long, from_column string, cardinality string, evidence_level string, confidence double, origin string"
ASSETS = "id long, name string, domain_code string, grading string"


def _edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, f"c{i}", "1:N", "x", 0.5, "o") for i, (a, b) in enumerate(pairs)], EDGES)


def _assets(spark, ids):
    return spark.createDataFrame([(i, f"T{i}", "D01", "A") for i in ids], ASSETS)


def test_lookup_errors_and_case(spark):
    edges, assets = _edges(spark, [(2, 1), (3, 2)]), _assets(spark, [1, 2, 3])
    assert [r.name for r in lineage.lookup(edges, assets, "t1").nodes.collect()] == ["T1", "T2", "T3"]
    assert [r.id for r in lineage.lookup(edges, assets, "T3", "UPSTREAM", depth=1).nodes.collect()] == [3, 2]
    with pytest.raises(lineage.NotFound):
        lineage.lookup(edges, assets, "nothing")
    with pytest.raises(ValueError):
        lineage.lookup(edges, assets, "T1", "SIDEWAYS")


def test_budget_of_paths_truncates(spark):
    # 12 ways from the root to each of two nodes: more paths than the budget, fewer nodes than the limit
    pairs = [(k, 1) for k in range(2, 14)] + [(20, k) for k in range(2, 14)] + [(21, 20)]
    assets = _assets(spark, [1, *range(2, 14), 20, 21])
    assert lineage.trace(_edges(spark, pairs), assets, 1, limit=200).truncated is False
    few = lineage.trace(_edges(spark, pairs[:13]), assets, 1, limit=13)
    assert few.truncated is True and few.nodes.count() == 13
    assert lineage.trace(_edges(spark, [(k, 1) for k in (2, 3)] + [(9, 2), (9, 3)] + [(30 + j, 9) for j in range(3)]), assets, 1, limit=1).truncated is True
    late = lineage.trace(_edges(spark, pairs), assets, 1, seconds=0)
    assert late.truncated is True and [r.id for r in late.nodes.collect()] == [1]


def test_a_dense_graph_ends(spark):
    n = 300
    edges = spark.range(n * n).selectExpr("id", "id div 300 + 1 AS from_asset_id", "id % 300 + 1 AS to_asset_id", "'c' AS from_column", "'1:N' AS cardinality", "'x' AS evidence_level", "0.5D AS confidence", "'o' AS origin")
    edges = edges.where("from_asset_id <> to_asset_id")
    began = time.monotonic()
    seen = lineage.trace(edges, _assets(spark, range(1, n + 1)), 1, depth=10)
    assert seen.truncated is True and [(r.id, r.depth) for r in seen.nodes.orderBy("depth", "id").collect()] == [(1, 0), *((i, 1) for i in range(2, 201))]
    assert lineage.tree(edges, 1, depth=10).groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, n - 1)]
    assert time.monotonic() - began < 20


def test_affected_has_no_limit(spark):
    # 300 tables below the root, one below all of these and three below that one: 1,500 paths
    pairs = [(k, 1) for k in range(2, 302)] + [(400, k) for k in range(2, 302)] + [(k, 400) for k in (401, 402, 403)]
    edges, ids = _edges(spark, pairs), [*range(2, 302), 400, 401, 402, 403]
    got = lineage.affected(edges, _assets(spark, [1, *ids, 500]), 1)
    assert sorted((r.id, r.depth, r.parent_id, r.edge_id) for r in got.collect()) == [*((k, 1, 1, k - 2) for k in range(2, 302)), (400, 2, 2, 300), *((k, 3, 400, k + 199) for k in (401, 402, 403))]
    assert lineage.affected(edges, _assets(spark, ids), 1).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_a_trace_keeps_the_first_paths_of_all(spark, seed):
    """Small random graphs: nodes, parents and truncation as from all simple paths, listed and cut afterwards."""
    rng, limit = random.Random(seed), 6
    pairs = [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(22)]
    every, ways = [(0, 1, -1, None)], [(1, (1,))]
    for d in range(1, 7):
        ways, found = [], [(b, path) for b, path in ways]
        for node, path in found:
            for e, (a, b) in enumerate(pairs):
                if b == node and a not in path:
                    every.append((d, a, e, node))
                    ways.append((a, (*path, a)))
    every.sort(key=lambda r: r[:3])
    budget, nodes = 4 * (limit + 1), {}
    for d, node, e, parent in every[:budget]:
        if len(nodes) < limit:
            nodes.setdefault(node, (d, parent, e if d else None))
    got = lineage.trace(_edges(spark, pairs), _assets(spark, range(1, 10)), 1, limit=limit)
    assert {r.id: (r.depth, r.parent_id, r.edge_id) for r in got.nodes.collect()} == nodes
    assert got.truncated == (len(every) > budget or len({r[1] for r in every[:budget]}) > limit)


def test_a_chain_broken_by_the_catalog(spark):
    edges = _edges(spark, [(2, 1), (3, 2), (4, 3)])
    rows = {r.affected_asset: r.impact_path for r in lineage.impact(edges, _assets(spark, [1, 3, 4]), 1).collect()}
    assert rows == {"T3": "T1… → T3", "T4": "T1… → T3 → T4"}


def test_versions_that_are_not_there(spark):
    items = spark.createDataFrame([("u", "a", "ADDED", "", "")], "asset_urn string, asset_name string, change_type string, signature string, schema_hash string")
    head = versions.header(items, 1, None)
    assert versions.get(head, 1).first().kind == "FULL" and versions.header(items, 2, items, before_algorithm=1).first().kind == "FULL"
    with pytest.raises(versions.NoVersion):
        versions.get(head, 2)


def test_terms_and_patterns(spark):
    terms = spark.createDataFrame([(1, "a", "D01", "DRAFT"), (2, "b", "D01", "DRAFT")], "id long, name string, domain_code string, status string")
    for fields in ({"name": "b"}, {"name": " "}):
        with pytest.raises(catalog.RuleError):
            catalog.update_term(terms, 1, **fields)
    with pytest.raises(catalog.RuleError):
        catalog.update_term(terms, 9, status="REVIEW")
    users = spark.createDataFrame([(1,)], "id long")
    for name, owner in (("a", None), ("", None), ("c", 5)):
        with pytest.raises(catalog.RuleError):
            catalog.add_term(terms, name, users, owner)
    assert catalog.valid_pattern("^[a-z]+$", spark) == "^[a-z]+$"
    with pytest.raises(catalog.RuleError):
        catalog.valid_pattern("[", spark)


def test_names_that_agree_leave_nothing(spark):
    names = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert dq.name_differences(names, names).count() == 0
    assert [tuple(r) for r in dq.name_differences(names, names.distinct()).collect()] == [("a", "documented")]


FIELD = "id long, field_name string, data_type string, length_val int, semantic string, enabled boolean"
NAMING = "id long, name string, target string, pattern string, description string, enabled boolean"
CODE = "id long, category string, code_value string, meaning string, ordinal int"


def test_dictionary_entries(spark):
    fields = spark.createDataFrame([(3, "b", "int", None, None, False), (5, "a", "int", 4, "x", True)], FIELD)
    assert [r.field_name for r in catalog.dictionary_list(fields, "standard_field").collect()] == ["a", "b"]
    made = catalog.create_entry(fields, "standard_field", field_name="c")
    assert tuple(made.where("id = 6").first()) == (6, "c", None, None, None, True) and made.count() == 3
    assert tuple(catalog.update_entry(fields, "standard_field", 5, field_name="z").where("id = 5").first()) == (5, "z", None, None, None, True)
    assert [r.id for r in catalog.delete_entry(fields, "standard_field", 3).collect()] == [5]
    with pytest.raises(catalog.RuleError):
        catalog.create_entry(fields, "standard_field", colour="red")
    for call in (lambda: catalog.update_entry(fields, "standard_field", 9), lambda: catalog.delete_entry(fields, "standard_field", 9)):
        with pytest.raises(lineage.NotFound):
            call()
    empty = spark.createDataFrame([], NAMING)
    assert catalog.create_entry(empty, "naming_rule", name="n", pattern="^a$").first().id == 1
    for pattern in ("[", None):
        with pytest.raises(catalog.RuleError):
            catalog.create_entry(empty, "naming_rule", name="n", pattern=pattern)


def test_code_values_in_order(spark):
    codes = spark.createDataFrame([(1, "b", "x", None, 1), (2, "a", "y", None, 2), (3, "a", "z", None, 1), (4, "a", "w", None, 1)], CODE)
    assert [r.id for r in catalog.dictionary_list(codes, "code_value").collect()] == [3, 4, 2, 1]
    assert [r.id for r in catalog.dictionary_list(codes, "code_value", "a").collect()] == [3, 4, 2]
    assert catalog.dictionary_list(codes, "code_value", " ").count() == 4
    assert catalog.update_entry(codes, "code_value", 2, category="c", code_value="q").where("id = 2").first().ordinal == 2
    assert catalog.create_entry(codes, "code_value", category="c", code_value="q").where("id = 5").first().ordinal == 0


def test_entries_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "dictionary"))
    kind = "code_value"
    store.commit({kind: spark.createDataFrame([(1, "a", "x", None, 1)], CODE)})
    for value in ("y", "z"):
        store.update(lambda s, base, v=value: ({kind: catalog.create_entry(s.read(kind, base), kind, category="a", code_value=v)}, {}))
    assert [tuple(r) for r in store.read(kind).select("id", "code_value").orderBy("id").collect()] == [(1, "x"), (2, "y"), (3, "z")]


def test_seeds_come_once(spark):
    """Into empty tables all seeds come; a second time nothing changes."""
    empty = {k: rows.limit(0).selectExpr("CAST(NULL AS BIGINT) AS id", "*") for k, (rows, _) in catalog.seeds(spark).items()}
    once = upsert.insert_seeds(empty)
    assert {k: v.count() for k, v in once.items()} == {"dq_rule": 5, "naming_rule": 2, "standard_field": 5, "code_value": 10, "term": 2, "user": 3}
    assert all(sorted(r.id for r in v.select("id").collect()) == list(range(1, v.count() + 1)) for v in once.values())
    again = upsert.insert_seeds(once)
    assert all(again[k].exceptAll(once[k]).count() == 0 and again[k].count() == once[k].count() for k in once)


def test_detail_and_trace_of_nothing(spark):
    assets = _assets(spark, [1, 2]).selectExpr("*", "concat('u', id) AS asset_urn", "1 AS column_count")
    columns = spark.createDataFrame([(11, 1, 1, "b"), (12, 1, 0, "a")], "id long, asset_id long, ordinal int, name string")
    d = catalog.detail(assets, columns, _edges(spark, [(1, 1), (2, 1)]), "u1")
    assert [r.name for r in d["columns"].collect()] == ["a", "b"] and d["summary"].first().name == "T1"
    assert [(r.direction, r.id) for r in d["relations"].collect()] == [("out", 0), ("in", 0), ("in", 1)]
    with pytest.raises(lineage.NotFound):
        catalog.detail(assets, columns, _edges(spark, [(1, 1)]), "u9")
    entities = spark.createDataFrame([("d", 1, "MASTER", "T1（x） / T2 / T1", "D09", "what")], "doc string, line_no int, category string, expression string, domain_code string, description string")
    model = catalog.build_model(entities, assets)
    rows = catalog.model_trace(model, assets.where("id = 2"), "d:1").orderBy("asset_id").collect()
    assert [(r.ldm_name, r.ldm_domain_code, r.asset_urn, r.resolved) for r in rows] == [("T1", "D01", "u1", False), ("T2", "D01", "u2", True)]
    lost = model | {"ldm": model["ldm"].where("asset_id = 2"), "pdm": model["pdm"].where("asset_id = 1")}
    rows = catalog.model_trace(lost, assets, "d:1").orderBy("asset_id").collect()
    assert [(r.ldm_domain_code, r.asset_urn, r.resolved) for r in rows] == [("D09", "u1", True), ("D01", None, False)]
    with pytest.raises(lineage.NotFound):
        catalog.model_trace(model, assets, "d:9")
