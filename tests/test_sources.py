"""Files, stores and sinks: what is read comes back as it was written, however it is cut up."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import ddl, lineage
from cairn.sources import lines, sinks
from cairn.streaming import audit


def test_lines_of_ranges_are_numbered_as_in_the_file(spark, tmp_path):
    rng = random.Random(1)
    texts = {name: "".join(f"{name} {i} {'x' * rng.randint(0, 60)}" + rng.choice(["\n", "\r\n", "\n\n"]) for i in range(300)) for name in ("b.md", "a.md")}
    (tmp_path / "m").mkdir()
    for name, text in texts.items():
        (tmp_path / "m" / name).write_bytes(text.encode())
    (tmp_path / "m" / "no.txt").write_text("x")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = lines.read_markdown(spark, str(tmp_path / "m")).collect()
        parts = spark.read.text(str(tmp_path / "m" / "a.md")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert parts > 5
    assert {(r["doc"], r["line_no"], r["line"]) for r in got} == {(f"m/{n}", i, x) for n, t in texts.items() for i, x in enumerate(t.replace("\r\n", "\n").split("\n")[:-1], 1)}


def test_places_are_tried_in_order(spark, tmp_path, monkeypatch):
    (tmp_path / "one.sql").write_text("x")
    (tmp_path / "model").mkdir()
    assert lines.locate_ddl(spark, str(tmp_path / "one.sql")) == str(tmp_path / "one.sql")
    monkeypatch.setenv(lines.DDL_VARIABLE, str(tmp_path / "one.sql"))
    assert lines.locate_ddl(spark) == str(tmp_path / "one.sql")
    with pytest.raises(lines.SourceNotFound):
        lines.locate_ddl(spark, str(tmp_path / "two.sql"))
    monkeypatch.setenv(lines.MODEL_VARIABLE, str(tmp_path / "model"))
    with pytest.raises(lines.SourceNotFound):
        lines.locate_model(spark)
    (tmp_path / "model" / lines.CENSUS_FILE).write_text("x")
    assert lines.locate_model(spark) == str(tmp_path / "model")


@pytest.mark.parametrize("chunk", [1, 3, 10**6])
def test_tables_across_chunks(spark, chunk):
    text = ["-- x", "CREATE TABLE `a` (", "  `i` int,", "  `j` varchar(9) DEFAULT 'it''s', ", ") COMMENT = 'A''s';", "create table b (", "  `k` int", "CREATE TABLE `c` (", "  `l` int,", " );", "stray `z`", "CREATE TABLE IF NOT EXISTS `d` (", "  `m` int"]
    rows = spark.createDataFrame([("f", n, x) for n, x in enumerate(text, 1)], "doc string, line_no int, line string")
    got = {(r["table"], r["line_no"]) for r in ddl.blocks(rows, chunk).collect()}
    assert got == {("a", n) for n in range(2, 6)} | {("b", n) for n in range(6, 11)} | {("c", n) for n in range(8, 11)} | {("d", 12), ("d", 13)}


def test_a_long_comment_needs_no_deep_stack(spark):
    text = "  `i` int COMMENT '" + "ab''" * 50 + "x" * 60_000 + "',"
    rows = spark.createDataFrame([("f", 1, "CREATE TABLE `a` ("), ("f", 2, text), ("f", 3, ")")], "doc string, line_no int, line string")
    assert len(ddl.columns(rows).first()["meaning"]) == 60_150


def test_a_store_is_read_by_key_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    # half of the keys crowd into a thousandth of their range, and some rows have none
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 1000).alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    rows = rows.withColumn("k", F.when(F.col("name") == "n7", None).otherwise(F.col("k")))
    lines.write_store(rows, url, "asset", "overwrite", 1, driver=driver)
    back = lines.read_store(spark, url, "asset", "k", 8, driver=driver)
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    assert lines.read_store(spark, url, "asset", driver=driver).count() == 4000


def catalog(spark):
    assets = spark.createDataFrame([(i, f"t{i % 7}_{i}", f"u:{i}", "D01" if i % 2 else "D02", "A") for i in range(40)], "id long, name string, asset_urn string, domain_code string, grading string")
    columns = spark.createDataFrame([(i, k, f"c{k}", 'va"r', "N") for i in range(0, 40, 3) for k in (1, 0)], "asset_id long, ordinal int, name string, type string, nullable string")
    edges = spark.createDataFrame([(i, i, (i + 3) % 40, "c0") for i in range(39, -1, -1)], "id long, from_asset_id long, to_asset_id long, from_column string")
    return assets, columns, edges


def test_a_document_of_parts_is_one_document(spark, tmp_path):
    sinks.catalog_document(*catalog(spark), f"{tmp_path}/doc", domain="d01")
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    tree, whole = json.loads(text), json.loads(sinks.catalog_text(*catalog(spark), domain="d01"))
    assert tree["assetCount"] == 20 and tree["assets"] == whole["assets"] and tree["relations"] == whole["relations"] and tree["schema"] == whole["schema"]
    names = [a["name"] for a in tree["assets"]]
    assert names == sorted(names) and [c["ordinal"] for c in tree["assets"][0].get("columns", [])] in ([], [0, 1])
    assert [r["id"] for r in tree["relations"]] == list(range(1, 40, 2))


def test_an_empty_slice_is_a_document_too(spark, tmp_path):
    sinks.catalog_document(*catalog(spark), f"{tmp_path}/doc", domain="D99")
    tree = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert (tree["assetCount"], tree["assets"], tree["relations"]) == (0, [], [])


def test_impact_files_and_side_files(spark, tmp_path):
    assets, _, edges = catalog(spark)
    facts = edges.withColumns({"cardinality": F.lit("1:N"), "evidence_level": F.lit("x"), "confidence": F.lit(0.5), "origin": F.lit(None).cast("string")})
    name, text = sinks.impact_file(facts, assets, " T5_5 ", 2)
    assert name == "impact-t5_5-d2.csv" and text.startswith("\ufeff" + ",".join(lineage.IMPACT) + "\n") and text.count("\n") == 3 and text.endswith("x,0.5,\n")
    name, text = sinks.impact_file(facts, assets, "t5_5", 99, "JSON")
    assert name == "impact-t5_5-d10.json" and json.loads(text)["total"] == 10 and json.loads(text)["rows"][0]["depth"] == 1
    with pytest.raises(ValueError):
        sinks.impact_file(facts, assets, "t5_5", form="xml")
    with pytest.raises(lineage.NotFound):
        sinks.impact_file(facts, assets, "nothing")
    sinks.side_file(assets.select("id", "name").where("id < 2").orderBy("id"), f"{tmp_path}/side")
    assert "".join(p.read_text() for p in sorted((tmp_path / "side").glob("part-*"))) == "0|t0_0\n1|t1_1\n"


def test_audit_entries_are_kept_and_failures_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "scan", None, None)], "id long, username string, action string, target string, detail string").withColumn("at_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert audit.record(rows, f"{tmp_path}/audit") and spark.read.parquet(f"{tmp_path}/audit").count() == 1
    (tmp_path / "file").write_text("x")
    assert audit.record(rows, f"{tmp_path}/file/below") is False


def test_the_stream_counts_once_across_restarts(spark, tmp_path):
    def put(*rows):
        data = [(i, "u", "scan", None, None, t) for i, t in rows]
        spark.createDataFrame(data, "id long, username string, action string, target string, detail string, at string").withColumn("at_ts", F.col("at").cast("timestamp")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        audit.write(audit.action_counts(audit.entries(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
        return {(str(r["window_start"]), r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    put((1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:50:00"), (1, "2024-01-01 00:05:00"), (3, "2024-01-01 01:05:00"))
    assert run() == set()  # the watermark, 00:55, is within the first hour
    put((2, "2024-01-01 00:50:00"), (9, "2024-01-01 00:58:00"), (4, "2024-01-01 02:30:00"))
    assert run() == {("2024-01-01 00:00:00", 3), ("2024-01-01 01:00:00", 1)}
    put((10, "2024-01-01 01:59:00"), (5, "2024-01-01 04:00:00"))  # the first comes after its hour was closed
    assert run() == {("2024-01-01 00:00:00", 3), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 1)}
