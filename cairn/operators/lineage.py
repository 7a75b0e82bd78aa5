"""Lineage traces and impact lists over edges (id, from_asset_id, to_asset_id) and assets (id, name) (L-1 to L-4)."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.keys import staged

#: Levels of a trace, nodes of a view, and seconds after which a call's trace ends.
MOST_DEPTH, NODE_LIMIT, SECONDS = 10, 200, 15.0


class NotFound(LookupError):
    """No asset of that name."""


@dataclass
class Trace:
    """nodes (id, name, depth, parent_id, edge_id), all edges among them, and whether nodes were left out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in ("DOWNSTREAM", "UPSTREAM"):
        raise ValueError(f"direction {direction!r}")
    here, there = ("to_asset_id", "from_asset_id") if direction == "DOWNSTREAM" else ("from_asset_id", "to_asset_id")
    return edges.where(F.col(here).isNotNull() & F.col(there).isNotNull()).select(F.col(here).cast("long").alias("here"), F.col(there).cast("long").alias("there"), F.col("id").cast("long").alias("edge_id"))


def tree(edges: DataFrame, root: int, direction: str = "DOWNSTREAM", depth: int = 6) -> DataFrame:
    """(node, depth, parent, edge_id): each node reached, by its shortest way and the least edge id of that.

    Goes from level to level and visits each node once, so the work follows the edges and not the paths.
    """
    steps, found = _steps(edges, direction), []
    seen = edges.sparkSession.createDataFrame([(int(root), 0, None, None)], "node long, depth int, parent long, edge_id long")
    front = seen.select(F.col("node").alias("here"))
    for d in range(1, max(1, min(MOST_DEPTH, depth)) + 1):
        best = steps.join(front, "here").groupBy(F.col("there").alias("node")).agg(F.min(F.struct("edge_id", F.col("here").alias("parent"))).alias("m"))
        new = staged(best.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "m.parent", "m.edge_id"))
        if not new.take(1):
            break
        found.append(new)
        seen, front = seen.unionByName(new), new.select(F.col("node").alias("here"))
    return seen


def _walk(steps: DataFrame, root: int, depth: int, budget: int, seconds: float | None) -> tuple[list[tuple], bool]:
    """(node, depth, parent, edge_id) of paths without repeated nodes, the first by (depth, node, edge_id), and whether there are more.

    A level's paths are as many as the budget leaves; the next level starts only from all of them, so a
    graph in which paths abound ends the walk and no level is ever larger.  Levels go to the tasks as
    a broadcast of at most `budget` paths: edges are scanned once a level and never shuffled.
    """
    spark, began = steps.sparkSession, time.monotonic()
    rows, front = [(root, 0, None, None)], [(root, [root])]
    for d in range(1, depth + 1):
        left = None if seconds is None else began + seconds - time.monotonic()
        if left is not None and left <= 0:
            return rows, True
        here = spark.createDataFrame(front, "here long, path array<long>")
        onward = steps.join(F.broadcast(here), "here").where(~F.array_contains("path", F.col("there"))).orderBy("there", "edge_id").limit(budget + 1 - len(rows))
        found = _within(spark, onward, left)
        if found is None:
            return rows, True
        rows += [(r["there"], d, r["here"], r["edge_id"]) for r in found]
        if len(rows) > budget:
            return rows[:budget], True
        front = [(r["there"], [*r["path"], r["there"]]) for r in found]
        if not front:
            break
    return rows, False


def _within(spark: SparkSession, df: DataFrame, seconds: float | None) -> list | None:
    """The rows of df, a bounded number; None where they take longer than so many seconds, if any are set, and their jobs are then ended."""
    if seconds is None:
        return df.collect()
    tag, late = f"trace-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


def trace(edges: DataFrame, assets: DataFrame, root: int, direction: str = "DOWNSTREAM", depth: int = 6, limit: int = NODE_LIMIT, seconds: float | None = None) -> Trace:
    """The first `limit` nodes by (depth, id), those of them in the catalog, and every edge among these.

    The limit counts ids before the catalog is asked.  It is the view's size, as the feature wants it.  A
    trace looks at 4 (limit + 1) paths, the shortest ones; it is truncated where there are more paths or
    nodes, or where it takes longer than `seconds`: then it holds the levels that have ended.  Without
    `seconds` a trace depends on the edges alone; calls that somebody waits for set them.
    """
    spark = edges.sparkSession
    rows, over = _walk(_steps(edges, direction), int(root), max(1, min(MOST_DEPTH, depth)), 4 * (limit + 1), seconds)
    first: dict[int, tuple] = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0], r[3] or 0)):
        first.setdefault(row[0], row)
    kept = spark.createDataFrame(list(first.values())[:limit], "id long, depth int, parent_id long, edge_id long")
    nodes = assets.select(F.col("id").cast("long").alias("id"), "name").join(F.broadcast(kept), "id").select("id", "name", "depth", "parent_id", "edge_id")
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)  # at most `limit` rows, so they are sent to the edges
    ends = lambda side: F.broadcast(nodes.select(F.col("id").alias(f"{side}_asset_id")))
    among = edges.join(ends("from"), "from_asset_id", "left_semi").join(ends("to"), "to_asset_id", "left_semi")
    return Trace(nodes.orderBy("depth", F.asc_nulls_last("name")), among.orderBy("id"), over or len(first) > limit)


def find_root(assets: DataFrame, name: str) -> tuple[int, str]:
    row = assets.where(F.lower("name") == name.lower()).orderBy("name").select("id", "name").first()
    if row is None:
        raise NotFound(name)
    return row["id"], row["name"]


def lookup(edges: DataFrame, assets: DataFrame, name: str, direction: str = "DOWNSTREAM", depth: int = 6, limit: int = NODE_LIMIT, seconds: float | None = SECONDS) -> Trace:
    """L-3: the trace of the asset of that name, whatever its case; NotFound or ValueError where name or direction is wrong."""
    return trace(edges, assets, find_root(assets, name)[0], direction, depth, limit, seconds)


def paths(nodes: DataFrame) -> DataFrame:
    """nodes with `path`, the names from the root along the parents; nodes are as few as a trace's limit.

    A chain that a node outside the catalog breaks begins with the root's name and an ellipsis.
    """
    rows = nodes.collect()
    by_id = {r["id"]: r for r in rows}
    start = next((r["name"] for r in rows if r["depth"] == 0), "")

    def path(r) -> str:
        names, at = [r["name"]], r["parent_id"]
        while at in by_id:
            names.append(by_id[at]["name"])
            at = by_id[at]["parent_id"]
        return " → ".join([*([f"{start}…"] if at is not None else []), *reversed(names)])

    return nodes.sparkSession.createDataFrame([(*r, path(r)) for r in rows], T.StructType([*nodes.schema.fields, T.StructField("path", T.StringType())]))


IMPACT = ["affected_asset", "domain_code", "grading", "depth", "via_parent", "via_column", "impact_path", "cardinality", "evidence_level", "confidence", "origin"]


def impact(edges: DataFrame, assets: DataFrame, root: int, depth: int = 6, limit: int = NODE_LIMIT) -> DataFrame:
    """L-2: one row for each table below the root, with the edge and the path it is reached by."""
    nodes = paths(trace(edges, assets, root, "DOWNSTREAM", depth, limit).nodes).where("depth > 0")
    facts = ["cardinality", "evidence_level", "confidence", "origin"]
    via = edges.select(F.col("id").alias("edge_id"), F.col("from_column").alias("via_column"), *facts)
    about = assets.select("id", "domain_code", "grading")
    up = assets.select(F.col("id").alias("parent_id"), F.col("name").alias("via_parent"))
    few = lambda key: F.broadcast(nodes.select(F.col(key).alias(f"_{key}")).distinct())  # noqa: E731  a trace's nodes
    only = lambda df, key: df.join(few(key), F.col(key) == F.col(f"_{key}"), "left_semi")
    rows = nodes.join(only(about, "id"), "id").join(only(up, "parent_id"), "parent_id", "left").join(only(via, "edge_id"), "edge_id", "left")
    return rows.select(F.col("name").alias("affected_asset"), "domain_code", "grading", "depth", "via_parent", "via_column", F.col("path").alias("impact_path"), *facts)


def affected(edges: DataFrame, assets: DataFrame, root: int, depth: int = 6) -> DataFrame:
    """assets with depth, parent_id and edge_id, of every table below the root: one row for each edge that has this edge_id, as in `impact`.

    For sums over all of them, so there is no limit and no budget of paths, and no rows go through the driver.
    A root outside the catalog has none.
    """
    found = tree(edges, root, "DOWNSTREAM", depth).where("depth > 0")
    nodes = staged(found.select(F.col("node").alias("id"), "depth", F.col("parent").alias("parent_id"), "edge_id"))
    known = F.broadcast(assets.where(F.col("id") == root).limit(1).select(F.lit(1).alias("_root")))
    return assets.join(nodes, "id").join(edges.select(F.col("id").alias("edge_id")), "edge_id").join(known, F.lit(True), "left_semi")
