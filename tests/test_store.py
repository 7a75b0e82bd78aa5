"""Upserts, edge passes and the generation store: idempotence, pinned ids, surviving verdicts, ordered evidence."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import CONFIRMED, ORIGIN_LOGICAL, PENDING, REJECTED
from cairn.operators import documents, relations, upsert, versions
from cairn.operators.keys import numbered
from cairn.sources.lines import split_lines
from cairn.sources.sinks import Conflict, Store

CATALOG = [(1, "jf_order"), (2, "jf_customer"), (3, "jf_a"), (4, "jf_b"), (5, "jf_note")]
DOC = "## jf_order — x\n| customer_id | bigint | FK[jf_customer·注释明示] | x | y |\n| ref_id | bigint | FK[jf_a/jf_b·x] | x | y |\n| memo | text | FK[外部·x] | x | y |\n"


def edge(**values):
    base = dict.fromkeys(relations.NAMES) | {"origin": ORIGIN_LOGICAL, "is_inferred": True, "confirm_status": PENDING, "conflict_flag": False, "candidate_targets": [], "evidence_level": "待确认", "confidence": 0.3}
    return tuple((base | values)[c] for c in relations.NAMES)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), relations.EDGE)


def asked(spark, text, catalog):
    rows = split_lines(spark.createDataFrame([("03/d.md", text)], "doc string, text string"))
    return documents.resolve_targets(documents.logical_relations(rows), catalog)


def test_relations_are_pinned_and_verdicts_survive(spark):
    catalog = spark.createDataFrame(CATALOG, "id long, name string")
    want = asked(spark, DOC, catalog)
    first = relations.upsert_relations(frame(spark), want, catalog)
    assert relations.relation_report(first).first().asDict() | {} == {"edges": 4, "resolved": 3, "unresolved": 1, "created": 4, "reused": 0, "removed": 0, "stale_kept": 0, "dangling_removed": 0, "dangling_kept": 0}
    store = relations.remaining(first).withColumn("confirm_status", F.when(F.col("to_asset_id") == 2, CONFIRMED).otherwise(F.col("confirm_status"))).checkpoint() if spark.sparkContext.getCheckpointDir() else relations.remaining(first).withColumn("confirm_status", F.when(F.col("to_asset_id") == 2, CONFIRMED).otherwise(F.col("confirm_status")))
    again = relations.upsert_relations(store, want, catalog)
    key = lambda df: {(r["id"], r["from_column"], r["to_asset_id"], r["confirm_status"]) for r in df.collect()}
    assert key(relations.remaining(again)) == key(store)
    report = relations.relation_report(again).first()
    assert (report["created"], report["reused"], report["removed"]) == (0, 4, 0)
    less = relations.upsert_relations(store, want.where("from_column = 'memo'"), catalog)
    report = relations.relation_report(less).first()
    assert (report["reused"], report["removed"], report["stale_kept"]) == (1, 2, 1)
    kept = relations.remaining(less).where("to_asset_id = 2").first()
    assert kept["conflict_flag"] and kept["ingest_trace"] == relations.STALE


def line(n, left, right, kind, columns, to=None, level="注释明示", label="x"):
    return ("01/e.md", n, left, right, kind, {"ONE_TO_MANY": "1:N", "MANY_TO_ONE": "1:N", "ONE_TO_ONE": "1:1"}.get(kind), level, 0.8, None, columns, to, label)


LINE = "doc string, line_no int, left_table string, right_table string, kind string, cardinality string, evidence_level string, confidence double, cross_domain string, from_columns array<string>, to_column string, label string"


def test_overlay(spark):
    catalog = spark.createDataFrame(CATALOG, "id long, name string")
    columns = spark.createDataFrame([(1, "customer_id"), (1, "ref_id"), (1, "memo"), (1, "other_id"), (2, "id"), (2, "other_id"), (3, "x_id"), (4, "bad_id"), (5, "p_id"), (5, "q_id")], "asset_id long, name string")
    store = frame(
        spark,
        edge(id=1, from_asset_id=1, from_column="customer_id", to_asset_id=2, target_raw="jf_customer"),
        edge(id=2, from_asset_id=1, from_column="memo", target_raw="外部"),
        edge(id=3, from_asset_id=1, from_column="ref_id", to_asset_id=3, target_raw="jf_a"),
        edge(id=4, from_asset_id=4, from_column="bad_id", to_asset_id=2, confirm_status=REJECTED, target_raw="jf_customer"),
        edge(id=5, from_asset_id=5, from_column="p_id", target_raw="外部"),
        edge(id=6, from_asset_id=5, from_column="q_id", target_raw="外部"),
    )
    evidence = spark.createDataFrame([
        line(1, "jf_customer", "jf_order", "ONE_TO_MANY", ["Customer_ID"], "id"),
        line(2, "jf_order", "jf_a", "MANY_TO_ONE", ["memo"]),
        line(3, "jf_b", "jf_order", "ONE_TO_MANY", ["ref_id"]),
        line(4, "jf_customer", "jf_b", "ONE_TO_MANY", ["bad_id"]),
        line(5, "jf_customer", "jf_order", "ONE_TO_MANY", ["other_id"]),
        line(6, "jf_order", "jf_customer", "ONE_TO_MANY", ["other_id"]),
        line(7, "jf_a", "jf_note", "ONE_TO_MANY", ["p_id"], label="弱关联"),
        line(8, "jf_a", "jf_note", "ONE_TO_MANY", ["q_id"]),
        line(9, "jf_b", "jf_note", "ONE_TO_MANY", ["q_id"]),
        line(10, "jf_a", "jf_b", "ONE_TO_ONE", ["none_id"]),
        line(11, "jf_a", "jf_b", "ONE_TO_MANY", []),
        line(12, "jf_a", "jf_b", "ONE_TO_MANY", ["none_id"]),
        line(13, "jf_a", "no_table", "ONE_TO_MANY", ["x_id"]),
        line(14, "jf_a", "jf_b", "AMBIGUOUS", ["x_id"]), line(15, "jf_a", "jf_b", "MANY_TO_MANY", ["x_id"]), line(16, "jf_a", "jf_b", "UNSUPPORTED_SYMBOL", ["x_id"]),
    ], LINE)
    after, counts = relations.overlay(store, evidence, catalog, columns)
    assert {r["counter"]: r["n"] for r in counts.collect()} == {
        "matched": 5, "cardinality_filled": 2, "evidence_upgraded": 2, "resolved_prose": 1, "conflicts": 1, "new_edges": 1, "skipped_reverse": 1, "deferred_denial": 1, "deferred_multi": 2,
        "skipped_ambiguous": 1, "skipped_no_column": 1, "skipped_not_owned": 1, "skipped_endpoint": 1, "cardinality_clash": 1, "skipped_multi": 1, "skipped_unsupported": 1,
    }
    rows = {r["id"]: r for r in after.collect()}
    assert (rows[1]["cardinality"], rows[1]["to_column"], rows[1]["evidence_level"]) == ("1:N", "id", "注释明示")
    assert (rows[2]["to_asset_id"], rows[3]["conflict_flag"], rows[3]["candidate_targets"][0]["target"]) == (3, True, "jf_b")
    assert (rows[4]["cardinality"], rows[7]["from_column"], rows[7]["to_asset_id"]) == (None, "other_id", 2)
    assert (rows[5]["conflict_flag"], rows[6]["conflict_flag"], len(rows[6]["candidate_targets"])) == (False, True, 2)
    assert after.count() == 7


def test_upsert_keeps_ids_and_governance(spark):
    facts = "name string, prefix_family string, has_pk boolean, table_comment string, charset string, collate_name string, column_count int"
    old = spark.createDataFrame([(1, "A_x", "A_", True, "c", "u", None, 2, "owner", 9), (2, "gone", "g", True, None, None, None, 1, None, 9)], "id long, " + facts + ", steward string, source_id long")
    new = spark.createDataFrame([("a_X", "A_", True, "c" * 600, "u", None, 2), ("fresh", "f", None, None, None, None, 0)], facts)
    changes = upsert.asset_changes(old, new)
    assert {(r["key"], r["change"]) for r in changes.collect()} == {("a_x", "updated"), ("gone", "evicted"), ("fresh", "created")}
    after = {r["id"]: r for r in upsert.applied(old, changes, "db", 10).collect()}
    assert (after[1]["name"], after[1]["steward"], len(after[1]["table_comment"]), after[3]["name"], after[3]["source_id"]) == ("A_x", "owner", 500, "fresh", 10)


def test_guards(spark):
    columns = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 8, 0)], "id long, asset_id long, ordinal int")
    assert {(r["id"], r["ordinal"]) for r in upsert.reorder_columns(columns, 7, [2, 1]).collect()} == {(1, 1), (2, 0), (3, 0)}
    for wrong in ([1], [1, 3], [1, 2, 2]):
        with pytest.raises(upsert.GuardError):
            upsert.reorder_columns(columns, 7, wrong)


def test_numbers(spark):
    got = [r["id"] for r in numbered(spark.range(500).withColumnRenamed("id", "k"), ["k"], 10).collect()]
    assert sorted(got) == list(range(11, 511))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.generation() == 0 and store.tables() == {}
    store.commit({"t": spark.range(3), "u": spark.range(1)})
    store.commit({"t": store.read("t").where("id > 0")}, {"u": spark.range(5, 6)})
    store.commit({}, {"t": spark.range(9, 10)})
    assert store.generation() == 3 and ids(store.read("t")) == [1, 2, 9] and ids(store.read("u")) == [0, 5]
    assert ids(store.read("t", 1)) == [0, 1, 2] and ids(store.read("t", 2)) == [1, 2]


def test_a_commit_is_whole_or_not_there(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"t": spark.range(3), "u": spark.range(1)})
    with pytest.raises(Exception, match="no such row"):
        store.commit({"t": spark.range(7), "u": spark.range(5).selectExpr("if(id = 4, cast(raise_error('no such row') AS long), id) AS id")})
    assert store.generation() == 1 and ids(store.read("t")) == [0, 1, 2]
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(7)}, base=0)
    assert ids(store.read("t")) == [0, 1, 2] and [x.name for x in (tmp_path / "_manifest").iterdir() if not x.name.endswith(".crc")] == ["1.json"]


def test_eight_writers_get_eight_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assets = spark.createDataFrame([(1, "u:a", "a"), (2, "u:b", "b")], "id long, asset_urn string, name string")
    columns = spark.createDataFrame([(1, "x", "int", "N"), (2, "y", "int", "Y")], "asset_id long, name string, type string, nullable string")

    def write(i):
        return versions.create(Store(spark, str(tmp_path)), assets.where(f"id <= {1 + i % 2}"), columns, f"writer {i}", tries=40)

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(write, range(8)))
    heads = store.read("version").orderBy("version_no").collect()
    assert sorted(numbers) == [h["version_no"] for h in heads] == list(range(1, 9)) and len({h["note"] for h in heads}) == 8
    assert [h["kind"] for h in heads] == ["FULL"] + ["INCREMENT"] * 7
    # each version's items are those against the one before it
    items, held = store.read("version_item").collect(), set()
    for n in range(1, 9):
        own = {r["asset_urn"]: r["change_type"] for r in items if r["version_no"] == n}
        now = {u for u, c in own.items() if c != "DROPPED"}
        assert {u for u, c in own.items() if c == "ADDED"} == now - held and {u for u, c in own.items() if c == "DROPPED"} == held - now
        held = now
    with pytest.raises(Conflict):
        versions.create(_Behind(spark, str(tmp_path)), assets, columns, tries=2)


class _Behind(Store):
    """A writer that always comes too late."""

    def generation(self):
        return super().generation() - 1


def test_ddl_upsert_is_one_commit(spark, tmp_path):
    facts = "name string, prefix_family string, has_pk boolean, table_comment string, charset string, collate_name string, column_count int"
    columns = "id long, asset_id long, name string, ordinal int, type string, nullable string, default_val string, key_hint string, meaning string, note string"
    store = Store(spark, str(tmp_path))
    store.commit({
        "asset": spark.createDataFrame([(1, "A_x", "A_", True, "c", "u", None, 2, "owner", 9), (2, "gone", "g", True, None, None, None, 1, None, 9)], "id long, " + facts + ", steward string, source_id long"),
        "column": spark.createDataFrame([(1, 1, "Id", 0, "int", "N", None, None, None, "kept"), (2, 1, "old", 1, "int", "N", None, None, None, None), (3, 2, "lost", 0, "int", "N", None, None, None, None)], columns),
    })
    tables = spark.createDataFrame([("a_X", "A_", True, "c", "u", None, 2), ("fresh", "f", None, None, None, None, 1)], facts)
    new = spark.createDataFrame([("a_x", "ID", 0, "bigint", "N", None, None, None), ("a_x", "more", 1, "int", "Y", None, None, None), ("fresh", "id", 0, "int", "N", None, None, None)], "table string, name string, ordinal int, type string, nullable string, default_val string, key_hint string, meaning string")
    report = {(r["entity"], r["change"]): r["n"] for r in upsert.ddl_upsert(store, tables, new, "f.sql", "db").collect()}
    assert report == {("asset", "created"): 1, ("asset", "updated"): 0, ("asset", "unchanged"): 1, ("asset", "evicted"): 1, ("column", "created"): 2, ("column", "updated"): 1, ("column", "unchanged"): 0, ("column", "evicted"): 2}
    assert {(r["id"], r["name"], r["source_id"], r["steward"]) for r in store.read("asset").collect()} == {(1, "A_x", 1, "owner"), (3, "fresh", 1, None)}
    rows = {(r["id"], r["asset_id"], r["name"], r["type"], r["note"]) for r in store.read("column").collect()}
    assert {(1, 1, "Id", "bigint", "kept")} < rows and {r[1:] for r in rows} == {(1, "Id", "bigint", "kept"), (1, "more", "int", None), (3, "id", "int", None)} and {r[0] for r in rows} == {1, 4, 5}
    assert [tuple(r) for r in store.read("source").collect()] == [(1, "f.sql", "DDL", 2, 3)]
    again = upsert.ddl_upsert(store, tables, new, "f.sql", "db")
    assert {(r["entity"], r["change"]): r["n"] for r in again.collect() if r["n"]} == {("asset", "unchanged"): 2, ("column", "unchanged"): 3}
    assert {r["source_id"] for r in store.read("asset").collect()} == {2} and store.generation() == 3
