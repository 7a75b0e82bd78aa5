"""Edges of logical models into the store (U-2) and diagram evidence over them (U-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import CONFIRMED, ORIGIN_DIAGRAM, ORIGIN_LOGICAL, PENDING, REJECTED, cut, rank_of
from cairn.operators.documents import CANDIDATES, candidates_replace
from cairn.operators.keys import numbered, staged

EDGE = (
    "id long, from_asset_id long, from_column string, to_asset_id long, to_column string, target_raw string, evidence_level string, origin string, is_inferred boolean, confidence double, "
    f"confirm_status string, cross_domain string, cardinality string, conflict_flag boolean, basis_raw string, ingest_trace string, source_doc string, candidate_targets {CANDIDATES}, discriminator string"
)
NAMES = [x.split(" ", 1)[0] for x in EDGE.replace(CANDIDATES, "x").split(", ")]

# Notes that a sweep leaves on confirmed edges, and words by which a label denies a key.
STALE, DANGLING = "｜文档证据消失待复核", "｜端点已不在目录待复核"
DENIALS = ["非id", "非 id", "无id", "无 id", "多值", "多单号串", "名称关联", "存名称", "存 名称", "弱关联", "报文匹配", "亦可能", "二选一", "待确认", "无 FK", "无FK"]


def _noted(trace: Column, note: Column) -> Column:
    """A note is appended once."""
    t = F.coalesce(trace, F.lit(""))
    return F.when(F.contains(t, note), t).otherwise(F.concat(t, note))


def _key(table: Column, column: str) -> Column:
    return F.concat_ws("\x01", F.lower(table), F.lower(F.coalesce(F.col(column), F.lit(""))), F.trim(F.coalesce(F.col("target_raw"), F.lit(""))))


def requests(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """The edges that the documents ask for; sections whose table is not in the catalog (id, name) ask for nothing."""
    owners = catalog.select(F.col("id").alias("from_asset_id"), F.lower("name").alias("_t"))
    rows = resolved.join(owners, F.lower("from_table") == F.col("_t")).drop("_t")
    self_named = F.col("to_asset_id").isNull() & F.col("target_raw").rlike("自关联|自引用")
    siblings = F.collect_list(F.struct("target_no", "target")).over(Window.partitionBy("doc", "line_no", "cell_no", "mark_no"))
    several = F.transform(F.array_sort(siblings), lambda x: F.struct(x["target"].alias("target"), F.lit(ORIGIN_LOGICAL).alias("source"), cut("doc", 200).alias("doc"), F.lit("多态A/B").alias("why")))
    return rows.select(
        F.concat_ws("\x01", "doc", F.lpad(F.col("line_no").cast("string"), 9, "0"), *[F.lpad(F.col(c).cast("string"), 4, "0") for c in ("cell_no", "mark_no", "target_no")]).alias("req"),
        _key(F.col("from_table"), "from_column").alias("key"), "from_asset_id", "from_column", F.when(self_named, F.col("from_asset_id")).otherwise(F.col("to_asset_id")).alias("to_asset_id"), "to_column", "target_raw",
        "evidence_level", "confidence", "cross_domain", "discriminator", cut("basis_raw", 300).alias("basis_raw"), cut("doc", 200).alias("source_doc"),
        F.when(F.col("n_targets") > 1, several).otherwise(F.array().cast(CANDIDATES)).alias("fresh"),
    )


def matches(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(req, id): which stored edge each request takes over (U-2c).

    Requests of one key resolve alike, all to targets or none, so the ordered choice is three rankings:
    the n-th request of a target takes the n-th edge to it; the others take edges without target in
    order of id; requests without target then take whatever is left.
    """
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    a = asked.select("req", "key", F.col("to_asset_id").alias("to"))
    p = pool.select("key", "id", F.col("to_asset_id").alias("to"))
    exact = a.where("to is not null").withColumn("n", nth(["key", "to"], ["req"])).join(p.where("to is not null").withColumn("n", nth(["key", "to"], ["id"])), ["key", "to", "n"]).select("req", "id")
    others = a.join(exact, "req", "left_anti").withColumn("n", nth(["key"], ["req"]))
    left = p.join(exact, "id", "left_anti").withColumn("n", nth(["key"], [F.col("to").isNotNull(), "id"]))
    loose = others.alias("a").join(left.alias("p"), ["key", "n"]).where("p.to is null or a.to is null").select("req", "id")
    return exact.unionByName(loose)


def upsert_relations(store: DataFrame, resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every edge before or after the pass, with `action` (reused, created, removed, stale_kept, untouched) and `dangling` (kept, removed or null).

    The next generation of the store is what `remaining` keeps.  Facts of the documents are refreshed;
    verdicts, flags and cardinalities stay, and no target is ever cleared.
    """
    asked = staged(requests(resolved, catalog))  # five plans read it
    names = catalog.select(F.col("id").alias("from_asset_id"), F.lower("name").alias("_t"))
    pool = staged(store.where(F.col("origin") == ORIGIN_LOGICAL).join(names, "from_asset_id").select("id", "to_asset_id", _key(F.col("_t"), "from_column").alias("key")))
    pairs = staged(matches(asked, pool))

    taken = asked.join(pairs, "req")
    t = lambda c: F.col(f"t.{c}")
    s = lambda c: F.col(f"s.{c}")
    refreshed = {c: t(c) for c in ("from_asset_id", "from_column", "target_raw", "evidence_level", "confidence", "cross_domain", "discriminator", "basis_raw", "source_doc")}
    refreshed["to_asset_id"] = F.coalesce(t("to_asset_id"), s("to_asset_id"))
    refreshed["to_column"] = F.coalesce(s("to_column"), t("to_column"))
    refreshed["candidate_targets"] = candidates_replace(F.coalesce(s("candidate_targets"), F.array().cast(CANDIDATES)), ORIGIN_LOGICAL, t("fresh"))
    stored = store.alias("s").join(taken.alias("t"), F.col("s.id") == F.col("t.id"), "left").join(pool.select(F.col("id").alias("_pool")), F.col("s.id") == F.col("_pool"), "left")
    confirmed = s("confirm_status") == CONFIRMED
    action = F.when(t("id").isNotNull(), "reused").when(F.col("_pool").isNull(), "untouched").when(F.coalesce(confirmed, F.lit(False)), "stale_kept").otherwise("removed")
    old = stored.select(*[(F.when(t("id").isNotNull(), refreshed[c]).otherwise(s(c)) if c in refreshed else s(c)).alias(c) for c in NAMES], action.alias("action"))
    stale = F.col("action") == "stale_kept"
    old = old.withColumn("conflict_flag", stale | F.col("conflict_flag")).withColumn("ingest_trace", F.when(stale, _noted(F.col("ingest_trace"), F.lit(STALE))).otherwise(F.col("ingest_trace")))

    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(asked.join(pairs, "req", "left_anti"), ["req"], top).withColumns(
        {"origin": F.lit(ORIGIN_LOGICAL), "is_inferred": F.lit(True), "confirm_status": F.lit(PENDING), "conflict_flag": F.lit(False), "cardinality": F.lit(None).cast("string"), "ingest_trace": F.lit(None).cast("string"), "candidate_targets": F.col("fresh"), "action": F.lit("created")}
    )
    return sweep_dangling(old.unionByName(new.select(*NAMES, "action")), catalog)


def sweep_dangling(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """U-2g: `dangling` is kept or removed for edges of any origin with an end outside the catalog, else null."""
    live = catalog.select(F.col("id").alias("_from")), catalog.select(F.col("id").alias("_to"))
    e = edges.join(live[0], F.col("from_asset_id") == F.col("_from"), "left").join(live[1], F.col("to_asset_id") == F.col("_to"), "left")
    gone = F.col("_from").isNull() | (F.col("to_asset_id").isNotNull() & F.col("_to").isNull())
    if "action" in edges.columns:
        gone = gone & (F.col("action") != "removed")
    verdict = F.when(F.coalesce(F.col("confirm_status") == CONFIRMED, F.lit(False)), "kept").otherwise("removed")
    e = e.withColumn("dangling", F.when(gone, verdict)).drop("_from", "_to")
    kept = F.coalesce(F.col("dangling") == "kept", F.lit(False))
    return e.withColumn("conflict_flag", kept | F.col("conflict_flag")).withColumn("ingest_trace", F.when(kept, _noted(F.col("ingest_trace"), F.lit(DANGLING))).otherwise(F.col("ingest_trace")))


def remaining(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("action") != "removed") & ~F.col("dangling").eqNullSafe("removed")).select(*NAMES)


def relation_report(changes: DataFrame) -> DataFrame:
    """One row of counts; resolved and unresolved are those of the store after the sweeps."""
    act = lambda x: F.count_if(F.col("action") == x)
    stays = (F.col("action") != "removed") & ~F.col("dangling").eqNullSafe("removed") & (F.col("origin") == ORIGIN_LOGICAL)
    return changes.agg(
        F.count_if(F.col("action").isin("created", "reused")).alias("edges"), F.count_if(stays & F.col("to_asset_id").isNotNull()).alias("resolved"), F.count_if(stays & F.col("to_asset_id").isNull()).alias("unresolved"),
        act("created").alias("created"), act("reused").alias("reused"), act("removed").alias("removed"), act("stale_kept").alias("stale_kept"),
        F.count_if(F.col("dangling") == "removed").alias("dangling_removed"), F.count_if(F.col("dangling") == "kept").alias("dangling_kept"),
    )


# ---------------------------------------------------------------- diagram evidence


def oriented(lines: DataFrame, catalog: DataFrame, columns: DataFrame) -> DataFrame:
    """Diagram lines with both ends in the catalog, one row an orientation: (doc, line_no, attempt, child, parent, parent_name, fk, to_col).

    fk is the first candidate that the child owns (null: none), to_col the named column if the parent owns it.
    """
    ids = lambda side: catalog.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.lower("name").alias(f"_{side}"))
    both = lines.join(ids("l"), F.lower("left_table") == F.col("_l")).join(ids("r"), F.lower("right_table") == F.col("_r")).drop("_l", "_r")
    end = lambda a, c, p: F.struct(F.lit(a).alias("attempt"), F.col(f"{c}_id").alias("child"), F.col(f"{p}_id").alias("parent"), F.col(f"{p}_name").alias("parent_name"))
    ways = F.when(F.col("kind") == "ONE_TO_MANY", F.array(end(0, "r", "l"))).when(F.col("kind") == "MANY_TO_ONE", F.array(end(0, "l", "r"))).when(F.col("kind") == "ONE_TO_ONE", F.array(end(0, "r", "l"), end(1, "l", "r")))
    rows = both.select("*", F.inline(ways)).select(*lines.columns, "attempt", "child", "parent", "parent_name")
    own = columns.select("asset_id", F.lower("name").alias("_c")).distinct()
    named = rows.select("doc", "line_no", "attempt", "child", F.posexplode("from_columns").alias("_at", "_cand"))
    first = named.join(own, (F.col("child") == F.col("asset_id")) & (F.lower("_cand") == F.col("_c"))).groupBy("doc", "line_no", "attempt").agg(F.min_by("_cand", "_at").alias("fk"))
    target = rows.join(own, (F.col("parent") == F.col("asset_id")) & (F.lower("to_column") == F.col("_c"))).select("doc", "line_no", "attempt", F.col("to_column").alias("to_col"))
    return rows.join(first, ["doc", "line_no", "attempt"], "left").join(target, ["doc", "line_no", "attempt"], "left")


def parents_at(ways: DataFrame) -> DataFrame:
    """U-3a: how many parents the clearly oriented lines give each (child, fk_key)."""
    return ways.where(F.col("kind").isin("ONE_TO_MANY", "MANY_TO_ONE") & F.col("fk").isNotNull()).groupBy("child", F.lower("fk").alias("fk_key")).agg(F.countDistinct("parent").alias("n_parents"))


def before_overlay(store: DataFrame) -> DataFrame:
    """U-3j: diagram candidates go, and notes that an earlier version kept in the basis move to the trace."""
    wiped = candidates_replace(F.coalesce("candidate_targets", F.array().cast(CANDIDATES)), ORIGIN_DIAGRAM, F.array().cast(CANDIDATES))
    at = F.instr("basis_raw", "｜ER")
    note = F.expr("substring(basis_raw, instr(basis_raw, '｜ER'))")
    return store.withColumn("candidate_targets", wiped).withColumns(
        {"ingest_trace": F.when(at > 0, _noted(F.col("ingest_trace"), note)).otherwise(F.col("ingest_trace")), "basis_raw": F.when(at == 1, None).when(at > 1, F.substring("basis_raw", F.lit(1), at - 1)).otherwise(F.col("basis_raw"))}
    )




def _positions(ways: DataFrame, store: DataFrame) -> DataFrame:
    """ways with what the store holds at their position (child, fk_key): rejected, n edges, the first of them, the first
    without target (prose) and how many such, and the one to the parent (exact)."""
    key = [F.col("from_asset_id").alias("child"), F.lower(F.coalesce("from_column", F.lit(""))).alias("fk_key")]
    edges = store.select(*key, "id", "to_asset_id", "confirm_status").join(ways.select("child", "fk_key").distinct(), ["child", "fk_key"], "left_semi")
    open_end = F.col("to_asset_id").isNull()
    held = edges.groupBy("child", "fk_key").agg(
        F.bool_or(F.coalesce(F.col("confirm_status") == REJECTED, F.lit(False))).alias("rejected"), F.count("*").alias("n"), F.min("id").alias("first"), F.min(F.when(open_end, F.col("id"))).alias("prose"), F.count_if(open_end).alias("n_prose"),
    )
    exact = edges.where(~open_end).groupBy("child", "fk_key", F.col("to_asset_id").alias("parent")).agg(F.min("id").alias("exact"))
    found = ways.join(held, ["child", "fk_key"], "left").join(exact, ["child", "fk_key", "parent"], "left")
    return found.withColumns({"rejected": F.coalesce("rejected", F.lit(False)), "n": F.coalesce("n", F.lit(0)), "n_prose": F.coalesce("n_prose", F.lit(0))})


def _resolving(placed: DataFrame) -> DataFrame:
    """(child, fk_key, event_at, target): the line that gives a position's first edge without target the position's only parent."""
    fit = ~F.col("rejected") & F.col("clear") & F.col("prose").isNotNull() & F.col("exact").isNull() & ~F.col("denied") & (F.col("n_parents") <= 1)
    first = placed.where(fit).groupBy("child", "fk_key").agg(F.min(F.struct("at", "parent")).alias("m"))
    return first.select("child", "fk_key", F.col("m.at").alias("event_at"), F.col("m.parent").alias("target"))


def _creating(placed: DataFrame, store: DataFrame, resolved: DataFrame) -> DataFrame:
    """(child, fk_key, event_at, target): the line that makes the first edge of each position without edges.

    A line is barred while an edge leads the other way, from its parent by the same column to its child.  Such
    an edge is stored, or comes from an earlier line; so in each round every position whose first line is
    barred by no line still open is settled.  The earliest open line always is one, so rounds end, and a
    position is open beyond the first only where lines disagree about its direction.
    """
    other = lambda df, name: df.select(F.col("child").alias("parent"), "fk_key", F.col("target").alias("child"), F.col("event_at").alias(name))
    stored = store.where(F.col("to_asset_id").isNotNull()).select(F.col("from_asset_id").alias("parent"), F.lower(F.coalesce("from_column", F.lit(""))).alias("fk_key"), F.col("to_asset_id").alias("child")).distinct()
    open_ = placed.where(F.col("fk").isNotNull() & F.col("clear") & (F.col("n") == 0)).select("child", "fk_key", "parent", "at").join(stored, ["parent", "fk_key", "child"], "left_anti")
    open_ = staged(open_.join(other(resolved, "barred"), ["parent", "fk_key", "child"], "left").where("barred IS NULL OR barred > at").drop("barred"))
    rounds = []
    while open_.take(1):
        head = open_.groupBy("child", "fk_key").agg(F.min(F.struct("at", "parent")).alias("m")).select("child", "fk_key", "m.at", "m.parent")
        against = open_.select(F.col("child").alias("parent"), "fk_key", F.col("parent").alias("child"), F.col("at").alias("before"))
        bars = head.where("child <> parent").join(against, ["child", "fk_key", "parent"]).where("before < at").select("child", "fk_key").distinct()
        new = staged(head.join(bars, ["child", "fk_key"], "left_anti").select("child", "fk_key", F.col("at").alias("event_at"), F.col("parent").alias("target")))
        rounds.append(new)
        left = open_.join(new.select("child", "fk_key"), ["child", "fk_key"], "left_anti").join(other(new, "barred"), ["parent", "fk_key", "child"], "left")
        open_ = staged(left.where("barred IS NULL OR barred > at").drop("barred"))
    return reduce(DataFrame.unionByName, rounds) if rounds else resolved.limit(0)


def _verdicts(placed: DataFrame, resolved: DataFrame, created: DataFrame) -> DataFrame:
    """One row a line, by the first orientation that its position takes up: verdict, and the edge it acts on (`edge`: a stored id, or null for the one made there).

    Whatever a position held before its one event (a target found for an open edge, or a first edge made), and after
    it, is known for each line by whether it comes later.  verdict: silent, exact, resolve, denied, several, seen,
    conflict, reverse, create; none where no orientation is taken up.
    """
    events = resolved.withColumn("made", F.lit(False)).unionByName(created.withColumn("made", F.lit(True)))
    x = placed.join(events, ["child", "fk_key"], "left")
    own, later = F.col("event_at") == F.col("at"), F.coalesce(F.col("event_at") < F.col("at"), F.lit(False))
    to_event = later & (F.col("target") == F.col("parent"))
    prose_left = F.col("n_prose") > F.when(later & ~F.col("made"), 1).otherwise(0)
    made_here = later & F.col("made")
    verdict = (
        F.when(F.col("fk").isNull(), "none").when(F.col("rejected"), "silent").when(own & F.col("clear"), F.when(F.col("made"), "create").otherwise("resolve"))
        .when(F.col("exact").isNotNull() | to_event, "exact").when(prose_left, F.when(~F.col("clear"), "seen").when(F.col("denied"), "denied").otherwise("several"))
        .when((F.col("n") > 0) | made_here, "conflict").when(F.col("clear"), "reverse").otherwise("none")
    )
    x = x.withColumn("verdict", verdict)
    exact = F.coalesce("exact", F.when(~F.col("made"), F.col("prose")))
    edge = F.when(F.col("verdict") == "exact", exact).when(F.col("verdict").isin("resolve", "denied", "several"), F.col("prose")).when(F.col("verdict") == "conflict", F.col("first"))
    taken = F.struct((F.col("verdict") == "none").alias("last"), "attempt")
    facts = ["verdict", "child", "fk_key", "fk", "parent", "parent_name", "to_col", "kind", "cardinality", "evidence_level", "confidence", "cross_domain", "label", "n_candidates", edge.alias("edge")]
    return x.groupBy("at").agg(F.min_by(F.struct(*facts), taken).alias("w")).select("at", "w.*")


def _effects(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (ref and the columns of an edge) after what lines (ref, at, verdict and facts) do to them, with how many facts each gained.

    Every effect of a line depends on the order of lines only through firsts: the first cardinality and column, the
    first line of each evidence level, the first place of each note.
    """
    gives = lines.where(F.col("verdict").isin("exact", "resolve", "create"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))
    base = edges.select("ref", rank_of("evidence_level").alias("had"))
    # a level counts where it is stronger than the stored one and none as strong came before it
    levels = gives.groupBy("ref", rank_of("evidence_level").alias("rank")).agg(F.min(F.struct("at", "evidence_level", "confidence")).alias("l")).join(base, "ref").where("rank < had")
    stronger = Window.partitionBy("ref").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("sooner", F.min("l.at").over(stronger)).where("sooner IS NULL OR l.at < sooner")
    best = levels.groupBy("ref").agg(F.min_by("l", "rank").alias("best"), F.count("*").alias("upgrades"))
    given = gives.groupBy("ref").agg(first("cardinality").alias("card"), first("to_col").alias("col"), F.min(F.when(F.col("verdict") == "resolve", F.struct("parent", "to_col"))).alias("found"))

    doc, name = F.col("at.doc"), F.col("parent_name")
    why = F.when(F.col("verdict") == "denied", "自证否认").when(F.col("verdict") == "several", "多父候选").otherwise("目标冲突")
    said = F.when(F.col("verdict") == "resolve", F.concat(F.lit("｜ER消解:"), name, F.lit("@"), doc)).when(F.col("verdict") == "conflict", F.concat(F.lit("｜ER冲突目标:"), name)).otherwise(F.concat(F.lit("｜ER候选:"), name, F.lit("("), why, F.lit(",未消解)")))
    open_ = lines.where(F.col("verdict").isin("denied", "several", "conflict"))
    notes = lines.where(F.col("verdict").isin("resolve", "denied", "several", "conflict")).select("ref", "at", F.lit(0).alias("nth"), said.alias("text"))
    notes = notes.unionByName(levels.select("ref", F.col("l.at").alias("at"), F.lit(1).alias("nth"), F.concat(F.lit("｜ER:"), F.col("l.at.doc")).alias("text")))
    notes = notes.groupBy("ref", "text").agg(F.min(F.struct("at", "nth")).alias("p")).groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("p", "text"))).alias("notes"))
    proposal = F.struct(name.alias("target"), F.lit(ORIGIN_DIAGRAM).alias("source"), F.when(F.col("verdict") != "conflict", cut(doc, 200)).alias("doc"), why.alias("why"))
    proposals = open_.groupBy("ref", proposal.alias("c")).agg(F.min("at").alias("at")).groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("proposals"))
    flags = open_.groupBy("ref").agg(F.bool_or(F.col("verdict") != "denied").alias("flag"))

    e = edges
    for more in (given, best, notes, proposals, flags):
        e = e.join(more, "ref", "left")
    noted = F.when(F.col("notes").isNull(), F.col("ingest_trace")).otherwise(F.aggregate("notes", F.col("ingest_trace"), lambda t, x: _noted(t, x["text"])))
    filled = F.col("cardinality").isNull() & F.col("card").isNotNull()
    return e.withColumns({
        "cardinality_filled": filled, "evidence_upgraded": F.coalesce("upgrades", F.lit(0)), "cardinality": F.coalesce("cardinality", F.col("card.v")), "to_asset_id": F.coalesce("to_asset_id", F.col("found.parent")),
        "to_column": F.coalesce(F.col("found.to_col"), "to_column", F.col("col.v")), "evidence_level": F.coalesce(F.col("best.evidence_level"), "evidence_level"), "confidence": F.when(F.col("best").isNotNull(), F.col("best.confidence")).otherwise(F.col("confidence")),
        "ingest_trace": noted, "candidate_targets": F.when(F.col("proposals").isNotNull(), F.concat("candidate_targets", F.transform("proposals", lambda x: x["c"]))).otherwise(F.col("candidate_targets")), "conflict_flag": F.coalesce("flag", F.lit(False)) | F.col("conflict_flag"),
    }).select("ref", *NAMES, "cardinality_filled", "evidence_upgraded")


def overlay(store: DataFrame, lines: DataFrame, catalog: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after the diagrams' evidence, and (counter, n) of the counters that are not 0.

    Lines act in order of (doc, line_no) on positions (child, column), later ones on what earlier ones left.  A position
    changes for others at most once, so lines are not replayed: the line that changes each position is found
    first, then every line is judged at once by what its position held before or after that, and effects are
    aggregated by edge.  Asset names are unique, whatever their case; of equal (doc, line_no) one line counts.
    """
    clean = staged(before_overlay(store).select(*NAMES).withColumn("conflict_flag", F.coalesce("conflict_flag", F.lit(False))))
    trusted = lines.where(F.col("kind").isin("ONE_TO_MANY", "MANY_TO_ONE", "ONE_TO_ONE")).dropDuplicates(["doc", "line_no"])
    ways = staged(oriented(trusted, catalog, columns).withColumn("fk_key", F.lower("fk")))
    denied = reduce(lambda a, b: a | b, [F.contains(F.coalesce("label", F.lit("")), F.lit(x)) for x in DENIALS])
    ways = ways.join(parents_at(ways), ["child", "fk_key"], "left").withColumns({"n_parents": F.coalesce("n_parents", F.lit(0)), "n_candidates": F.size("from_columns"), "clear": F.col("kind") != "ONE_TO_ONE", "denied": denied})
    placed = staged(_positions(ways.withColumn("at", F.struct("doc", "line_no")), clean))
    resolved = staged(_resolving(placed))
    created = _creating(placed, clean, resolved)
    made_key = F.concat_ws("\x01", F.lit("new"), F.col("child").cast("string"), "fk_key")
    judged = staged(_verdicts(placed, resolved, created).withColumn("ref", F.coalesce(F.col("edge").cast("string"), made_key)))

    make = {"id": None, "to_column": F.col("to_col"), "target_raw": F.col("parent_name"), "origin": F.lit(ORIGIN_DIAGRAM), "is_inferred": F.lit(True), "confirm_status": F.lit(PENDING), "conflict_flag": F.lit(False)}
    make |= {"basis_raw": cut("label", 300), "ingest_trace": F.concat(F.lit("｜ER:"), F.col("at.doc")), "source_doc": cut(F.col("at.doc"), 200), "candidate_targets": F.array().cast(CANDIDATES), "discriminator": None, "from_asset_id": F.col("child"), "from_column": F.col("fk"), "to_asset_id": F.col("parent")}
    kinds = {f.name: f.dataType for f in clean.schema.fields}
    fresh = judged.where("verdict = 'create'").select("ref", *[(F.lit(None) if c in make and make[c] is None else make.get(c, F.col(c))).cast(kinds[c]).alias(c) for c in NAMES])
    acted = judged.where(F.col("verdict").isin("exact", "resolve", "create", "denied", "several", "conflict"))
    touched = clean.withColumn("ref", F.col("id").cast("string")).join(acted.select("ref").distinct(), "ref", "left_semi").unionByName(fresh)
    changed = staged(_effects(acted, touched))

    rest = clean.join(changed.where("id IS NOT NULL").select("id"), "id", "left_anti")
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(changed.where("id IS NULL").select(*[c for c in NAMES if c != "id"]), ["from_asset_id", "from_column", "to_asset_id"], top)
    after = rest.unionByName(changed.where("id IS NOT NULL").select(*NAMES)).unionByName(new.select(*NAMES))
    return after, _counters(judged, changed).unionByName(_dropped(lines, ways)).groupBy("counter").agg(F.sum("n").alias("n")).where("n > 0")


def _counters(judged: DataFrame, changed: DataFrame) -> DataFrame:
    """(counter, n) of verdicts, of lines that nothing takes up, and of facts that edges gained."""
    v = F.col("verdict")
    left = F.when(F.col("kind") == "ONE_TO_ONE", "skipped_ambiguous").when(F.col("n_candidates") > 0, "skipped_not_owned").otherwise("skipped_no_column")
    names = {"resolve": "resolved_prose", "denied": "deferred_denial", "several": "deferred_multi", "conflict": "conflicts", "create": "new_edges", "reverse": "skipped_reverse"}
    named = reduce(lambda c, x: c.when(v == x, names[x]), names, F.when(v == "none", left))
    both = F.array_compact(F.array(named, F.when(v.isin("exact", "resolve", "denied", "several", "seen"), "matched")))
    of_lines = judged.select(F.explode(both).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))
    gains = changed.agg(F.count_if("cardinality_filled").alias("cardinality_filled"), F.coalesce(F.sum("evidence_upgraded"), F.lit(0)).alias("evidence_upgraded"))
    return of_lines.unionByName(gains.unpivot([], ["cardinality_filled", "evidence_upgraded"], "counter", "n"))


def _dropped(lines: DataFrame, ways: DataFrame) -> DataFrame:
    """Lines counted and left out before: untrusted kinds, and ends that the catalog lacks."""
    why = F.when(F.col("kind") == "UNSUPPORTED_SYMBOL", "skipped_unsupported").when(F.col("kind") == "AMBIGUOUS", "cardinality_clash").when(F.col("kind") == "MANY_TO_MANY", "skipped_multi").otherwise("skipped_endpoint")
    out = lines.join(ways.select("doc", "line_no").distinct(), ["doc", "line_no"], "left_anti")
    return out.groupBy(why.alias("counter")).agg(F.count("*").alias("n"))


def relations_of(edges: DataFrame, catalog: DataFrame, asset_id: int) -> DataFrame:
    """L-5: an asset's outgoing and incoming edges with both names; a self-loop is in both."""
    out = edges.where(F.col("from_asset_id") == asset_id).withColumn("direction", F.lit("out"))
    into = edges.where(F.col("to_asset_id") == asset_id).withColumn("direction", F.lit("in"))
    name = lambda side: catalog.select(F.col("id").alias(f"{side}_asset_id"), F.col("name").alias(f"{side}_name"))
    return out.unionByName(into).join(name("from"), "from_asset_id", "left").join(name("to"), "to_asset_id", "left")
