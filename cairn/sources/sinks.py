"""Exports (SNK-1 to SNK-5) and the generation store of a catalog's tables."""

from __future__ import annotations

import csv
import io
import json
import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.keys import staged
from cairn.operators.lineage import IMPACT, MOST_DEPTH, find_root, impact

SCHEMA_NAME = "cairn-meta/1"


# ---------------------------------------------------------------- catalog document


def asset_documents(assets: DataFrame, columns: DataFrame, domain: str | None = None, grading: str | None = None) -> DataFrame:
    """Assets of a slice with their columns nested in order."""
    chosen = assets
    for c, v in (("domain_code", domain), ("grading", grading)):
        if v:
            chosen = chosen.where(F.lower(c) == v.lower())
    nested = columns.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "type", "nullable"))).alias("columns"))
    return chosen.join(nested, chosen["id"] == nested["asset_id"], "left").drop("asset_id")


def relation_slice(edges: DataFrame, assets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges that start in the slice, with both ends' urns; external_target where the target lies outside."""
    start = chosen.select(F.col("id").alias("from_asset_id"), F.col("asset_urn").alias("from_urn"))
    end = assets.select(F.col("id").alias("to_asset_id"), F.col("asset_urn").alias("to_urn"))
    inside = chosen.select(F.col("id").alias("to_asset_id"), F.lit(True).alias("_in"))
    rows = edges.join(start, "from_asset_id").join(end, "to_asset_id", "left").join(inside, "to_asset_id", "left")
    return rows.withColumn("external_target", F.col("to_urn").isNotNull() & F.col("_in").isNull()).drop("_in")


def export_catalog(assets: DataFrame, columns: DataFrame, edges: DataFrame, path: str, domain: str | None = None, grading: str | None = None) -> None:
    """The catalog as JSON lines in path: one header, one line for each asset, then one for each edge, each in its folder.

    Written by the tasks, so that its size is not bound by the driver; `catalog_text` gives one document.
    """
    chosen = asset_documents(assets, columns, domain, grading)
    header = chosen.agg(F.lit(SCHEMA_NAME).alias("schema"), F.current_timestamp().alias("generatedAt"), F.count("*").alias("assetCount"))
    header.write.json(f"{path}/header")
    chosen.orderBy(F.lower("name")).write.json(f"{path}/assets")
    relation_slice(edges, assets, chosen).orderBy("id").write.json(f"{path}/relations")


def catalog_document(assets: DataFrame, columns: DataFrame, edges: DataFrame, path: str, domain: str | None = None, grading: str | None = None) -> None:
    """SNK-1: one JSON document of any size as text parts under path; the parts in order of their names, one behind the other, are the document.

    Its lines are sorted by range: the head, assets by name, the relations' head, relations by id, the end.  Tasks write them; the
    driver sees no line.
    """
    chosen = asset_documents(assets, columns, domain, grading)
    line = lambda part, rows, key: rows.select(F.lit(part).alias("part"), key.cast("string").alias("key"), F.col("id").alias("id"), F.to_json(F.struct(*rows.columns)).alias("text"))
    relations = relation_slice(edges, assets, chosen)
    body = staged(line(1, chosen, F.lower("name")).unionByName(line(3, relations, F.lpad(F.col("id").cast("string"), 20, "0"))))
    first = body.groupBy("part").agg(F.min(F.struct("key", "id")).alias("least"))
    comma = F.when((F.struct("key", "id") == F.col("least")), "").otherwise(",")
    lines = body.join(F.broadcast(first), "part").select("part", "key", "id", F.concat(comma, "text").alias("value"))
    head = chosen.agg(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(0).cast("long").alias("id"), F.concat(F.lit(f'{{"schema": "{SCHEMA_NAME}", "generatedAt": "'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", "assetCount": '), F.count("*").cast("string"), F.lit(', "assets": [')).alias("value"))
    rest = assets.sparkSession.createDataFrame([(2, "", 0, '], "relations": ['), (4, "", 0, "]}")], "part int, key string, id long, value string")
    head.unionByName(lines).unionByName(rest).orderBy("part", "key", "id").select("value").write.text(path)


def catalog_text(assets: DataFrame, columns: DataFrame, edges: DataFrame, domain: str | None = None, grading: str | None = None, form: str = "json", most: int = 10_000) -> str:
    """One JSON or YAML document of a slice of at most `most` assets; larger ones go through export_catalog."""
    chosen = asset_documents(assets, columns, domain, grading)
    rows = chosen.orderBy(F.lower("name")).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} assets: use export_catalog")
    relations = relation_slice(edges, assets, chosen).orderBy("id").toJSON().collect()
    now = assets.sparkSession.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t").first()["t"]
    tree = {"schema": SCHEMA_NAME, "generatedAt": now, "assetCount": len(rows), "assets": [json.loads(x) for x in rows], "relations": [json.loads(x) for x in relations]}
    return _text(tree, form)


def _text(tree: dict, form: str) -> str:
    if form == "json":
        return json.dumps(tree, ensure_ascii=False, indent=2)
    if form != "yaml":
        raise ValueError(f"form {form!r}")
    try:
        import yaml
    except ImportError as missing:
        raise ValueError("form 'yaml' needs the yaml package") from missing
    return yaml.safe_dump(tree, allow_unicode=True, sort_keys=False)


# ---------------------------------------------------------------- impact lists


def impact_text(rows: DataFrame, root: str, form: str = "csv") -> str:
    """An impact list, which holds no more rows than a trace's limit, as CSV (with a byte order mark), JSON or YAML."""
    found = [tuple(r) for r in rows.select(*IMPACT).orderBy("depth", "affected_asset").collect()]
    if form != "csv":
        return _text({"root": root, "total": len(found), "rows": [dict(zip(IMPACT, r)) for r in found]}, form)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([IMPACT, *[["" if v is None else v for v in r] for r in found]])
    return "﻿" + out.getvalue()


def impact_file(edges: DataFrame, assets: DataFrame, name: str, depth: int = 6, form: str = "csv") -> tuple[str, str]:
    """L-4: the file's name and text of the impact list of the asset of that name, whatever its case; NotFound, or ValueError for another form.

    The file is named after the asset as the catalog spells it, in lower case, and the depth that was used.
    """
    form = form.strip().lower()
    if form not in ("csv", "json", "yaml"):
        raise ValueError(f"form {form!r}")
    root, name = find_root(assets, name.strip())
    depth = max(1, min(MOST_DEPTH, depth))
    return f"impact-{name.lower()}-d{depth}.{form}", impact_text(impact(edges, assets, root, depth), name, form)


def side_file(rows: DataFrame, path: str) -> None:
    """SNK-5: a census or comparison as pipe-delimited text."""
    rows.write.csv(path, sep="|", header=False)


# ---------------------------------------------------------------- store


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit is visible."""


class Store:
    """Tables as Parquet under one folder, in generations that each commit several tables at once.

    Data goes to new folders <table>/<random name>.  Generation N is one file, _manifest/N.json, which lists the folders
    of every table; it is written aside and then takes its place in one step that fails where the place is
    taken (a hard link on local disks, elsewhere a rename as HDFS does it).  So readers see all of a
    generation or none of it, a write that fails leaves the old one, and of two writers one gets Conflict.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The number of the last commit; 0 before the first."""
        at = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([0, *(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())])

    def tables(self, generation: int | None = None) -> dict[str, list[str]]:
        """The folders of every table in a generation, the current one if none is named."""
        n = self.generation() if generation is None else generation
        if n == 0:
            return {}
        with_lines = self._fs.open(self._path(f"{self.root}/_manifest/{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_lines, "UTF-8"))
        finally:
            with_lines.close()

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{folder}" for folder in self.tables(generation)[table]))

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """The next generation: some tables replaced, some with more rows, all others as they are; its number.

        Rows may read the generation `base` (the current one), on which the commit rests: Conflict if there is a later one by now.
        """
        base = self.generation() if base is None else base
        now = self.tables(base)
        for table, rows in (replaced or {}).items():
            now[table] = [self._write(table, rows)]
        for table, rows in (appended or {}).items():
            now[table] = [*now.get(table, []), self._write(table, rows)]
        self._claim(base + 1, json.dumps(now))
        return base + 1

    def update(self, make: Callable[[Store, int], tuple[dict[str, DataFrame], dict[str, DataFrame]]], tries: int = 5, pause: float = 0.02) -> int:
        """Commits what make(store, base) gives (replaced, appended); after a Conflict it is made anew, up to `tries` times, after longer and longer pauses."""
        for turn in range(1, tries + 1):
            base = self.generation()
            try:
                return self.commit(*make(self, base), base=base)
            except Conflict:
                if turn == tries:
                    raise
                time.sleep(pause * 2**turn * random.uniform(0.5, 1.5))
        raise ValueError("tries has to be 1 or more")

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _claim(self, n: int, text: str) -> None:
        aside, place = (self._path(f"{self.root}/_manifest/{x}") for x in (f".{uuid.uuid4().hex}", f"{n}.json"))
        out = self._fs.create(aside, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        try:
            if self._fs.exists(place) or not self._take(aside, place):
                raise Conflict(f"generation {n} is there already")
        finally:
            self._fs.delete(aside, False)

    def _take(self, aside, place) -> bool:
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(aside, place)
        try:
            os.link(aside.toUri().getPath(), place.toUri().getPath())
        except FileExistsError:
            return False
        return True
