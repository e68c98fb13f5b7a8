"""Symbol search, definitions, references, callers, dependencies and context, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scoring import path_floor, symbol_rank
from brindle.operators.graph import LOCAL_EDGES, View
from brindle.workspace import Workspace


def find_symbol(v: View, needle: str, limit: int = 20, prefer_hub: bool = False) -> DataFrame:
    """(identity_id, revision_id, qualified_name, file_path, conf, rank) of the best hits; limit 0 is no limit.

    The order does not depend on confidence, so with a limit only the hits' confidence is looked up.
    """
    hit = v.on_chain(v.g.revisions).filter(F.contains("qualified_name", F.lit(needle))).select("identity_id").distinct()
    r = v.resolved_rows().filter(F.contains("t_qualified_name", F.lit(needle))).join(hit, "identity_id", "left_semi")
    # A renamed symbol is found under both identities; its revision is one hit.
    r = r.dropDuplicates(["revision_id"]).withColumn("rank", symbol_rank(F.col("t_qualified_name"), F.col("t_file_path"), needle, prefer_hub))
    r = r.select(F.col("t_identity_id").alias("identity_id"), "revision_id", F.col("t_qualified_name").alias("qualified_name"), F.col("t_file_path").alias("file_path"), "rank")
    order = ("rank", F.octet_length("qualified_name"), "qualified_name", "revision_id")
    ids = None
    if limit:
        top = r.orderBy(*order).limit(limit)
        rows = top.collect()
        ids = sorted({x["identity_id"] for x in rows})
        r = r.sparkSession.createDataFrame(rows, top.schema)
    return v.with_confidence(r, "identity_id", ids).select("identity_id", "revision_id", "qualified_name", "file_path", "conf", "rank").orderBy(*order)


def definitions(v: View) -> DataFrame:
    """(revision_id, target_revision_id): Extends before Imports in the order of edges, files only if nothing else resolves."""
    e = v.edge_targets().filter(F.col("ty").isin("Extends", "Imports") & F.col("target_revision_id").isNotNull())
    kinds = v.g.revisions.select(F.col("revision_id").alias("target_revision_id"), (F.col("kind") == "File").alias("is_file"))
    mine = v.on_chain(v.g.revisions).select(F.col("revision_id").alias("source_revision_id"))
    best = F.min_by("target_revision_id", F.struct("is_file", (F.col("ty") != "Extends").alias("late"), "edge_id"))
    return e.join(kinds, "target_revision_id").join(mine, "source_revision_id").groupBy("source_revision_id").agg(best.alias("target_revision_id")).withColumnRenamed("source_revision_id", "revision_id")


def references(v: View, ty: str | None = None, limit: int = 20, ids: list[int] | None = None) -> DataFrame:
    """(target_id, source_identity_id, source_revision_id, edge_id, conf): sources of each identity, one hit each, the first ``limit``.

    With ids only those of the given identities, whose edges alone are read.
    """
    e = v.inbound(ids)
    if ty:
        e = e.filter(F.col("ty") == ty)
    e = e.groupBy("target_id", "source_identity_id").agg(F.min(F.struct("via", "edge_id", "source_revision_id", "edge_conf")).alias("b")).select("target_id", "source_identity_id", "b.*")
    if limit:
        top = Window.partitionBy("target_id").orderBy("via", "edge_id")
        e = e.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= limit)
    return e.select("target_id", "source_identity_id", "source_revision_id", "edge_id", F.col("edge_conf").alias("conf"))


def dependencies(v: View, limit: int = 4096, revisions: list[int] | None = None) -> DataFrame:
    """(revision_id, target_revision_id, edge_id, conf): what each revision depends on, each target once, in edge order.

    With revisions only those of the given ones; confidence is then looked up for their targets alone.
    """
    mine = v.on_chain(v.g.revisions).select(F.col("revision_id").alias("source_revision_id"))
    e = v.edge_targets() if revisions is None else v.edge_targets().filter(F.col("source_revision_id").isin(revisions))
    e = e.filter(F.col("ty").isin(*LOCAL_EDGES) & F.col("target_revision_id").isNotNull()).join(mine, "source_revision_id")
    e = e.groupBy("source_revision_id", "target_revision_id").agg(F.min("edge_id").alias("edge_id"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("source_revision_id").orderBy("edge_id"))).filter(F.col("n") <= limit)
    t = v.g.revisions.select(F.col("revision_id").alias("target_revision_id"), F.col("identity_id").alias("t_identity_id"))
    e = e.join(t, "target_revision_id")
    ids = None if revisions is None else [r[0] for r in e.select("t_identity_id").distinct().collect()]
    return v.with_confidence(e, "t_identity_id", ids).select(F.col("source_revision_id").alias("revision_id"), "target_revision_id", "edge_id", "conf")


def file_hubs(v: View) -> DataFrame:
    """(file_path, revision_id): the file's own revision on the nearest branch that has one, whatever its status."""
    r = v.on_chain(v.g.revisions).filter("qualified_name = file_path")
    return r.groupBy("file_path").agg(F.min(F.struct("pos", "revision_id")).alias("p")).select("file_path", F.col("p.revision_id").alias("revision_id"))


def file_imports(v: View, limit: int = 256) -> DataFrame:
    """(file_path, target_revision_id, edge_id): what each file imports, each target once, in edge order."""
    e = v.edge_targets().filter("ty = 'Imports' AND target_revision_id IS NOT NULL").join(file_hubs(v).withColumnRenamed("revision_id", "source_revision_id"), "source_revision_id")
    e = e.groupBy("file_path", "target_revision_id").agg(F.min("edge_id").alias("edge_id"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("edge_id"))).filter(F.col("n") <= limit).drop("n")


def expand_context(v: View, starts: DataFrame, depth: int = 2, limit: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Context of each start revision: hits (start_id, revision_id, level, conf) and (start_id, pruned) counts.

    A start's hits, itself counted, are at most ``limit``; what is reached later is left out, and nothing is expanded from
    it. limit 0 is no limit.

    starts: start_id, revision ids on the chain. Breadth first, all starts at once, a join for each level; a revision is
    kept at its first arrival, by the order of its parent and the edge's id. Confidence is the product along the path, at
    least the floor of the weakest resolver. Stubs are reached but not passed. Each level is written, so lineage stays short.
    """
    ws = Workspace(starts.sparkSession, "expand")
    floor_min = v.g.policy.min_path_confidence
    rows = v.g.revisions.select("revision_id", "identity_id", "kind")
    s = v.on_chain(starts.select(F.col("start_id").alias("revision_id")).distinct().join(v.g.revisions.select("revision_id", "branch_id", "identity_id"), "revision_id"))
    s = v.with_confidence(s, "identity_id")
    level = s.select(F.col("revision_id").alias("start_id"), "revision_id", "conf", F.lit(1.0).alias("product"), F.lit("Ast").alias("least"), F.lit(0).cast("bigint").alias("ord"))
    edges = ws.write(v.edge_targets().filter(F.col("ty").isin(*LOCAL_EDGES)).select("source_revision_id", "edge_id", "resolver", "edge_conf", "target_revision_id"), "edges")
    level = ws.write(level, "level0")
    hits = level.select("start_id", "revision_id", F.lit(0).alias("level"), "conf")
    pruned = None
    had = level.groupBy("start_id").agg(F.count(F.lit(1)).alias("had"))
    for d in range(1, depth + 1):
        open_ = level.join(rows, "revision_id").filter("kind != 'Stub'")
        step = open_.join(edges, F.col("revision_id") == F.col("source_revision_id"))
        floors = {n: path_floor(F.col(n)) for n in ("least", "resolver")}
        step = step.withColumn("least2", F.when(floors["resolver"] < floors["least"], F.col("resolver")).otherwise(F.col("least"))).withColumn("product2", F.col("product") * F.col("edge_conf"))
        step = step.withColumn("conf2", F.greatest(path_floor(F.col("least2")), "product2"))
        lost = (F.col("conf2") < floor_min) | F.col("target_revision_id").isNull()
        cut = step.filter(lost).groupBy("start_id").agg(F.count(F.lit(1)).alias("pruned"))
        pruned = cut if pruned is None else pruned.unionByName(cut)
        first = Window.partitionBy("start_id", "target_revision_id").orderBy("ord", "edge_id")
        nxt = step.filter(~lost).withColumn("n", F.row_number().over(first)).filter("n = 1")
        nxt = nxt.join(hits.select("start_id", F.col("revision_id").alias("target_revision_id")), ["start_id", "target_revision_id"], "left_anti")
        nxt = nxt.withColumn("ord2", F.row_number().over(Window.partitionBy("start_id").orderBy("ord", "edge_id")).cast("bigint"))
        if limit:
            nxt = nxt.join(had, "start_id").filter(F.col("had") + F.col("ord2") <= limit)
        level = ws.write(nxt.select("start_id", F.col("target_revision_id").alias("revision_id"), F.col("conf2").alias("conf"), F.col("product2").alias("product"), F.col("least2").alias("least"), F.col("ord2").alias("ord")), f"level{d}")
        hits = hits.unionByName(level.select("start_id", "revision_id", F.lit(d).alias("level"), "conf"))
        had = hits.groupBy("start_id").agg(F.count(F.lit(1)).alias("had"))
    count = starts.select("start_id").distinct()
    total = count.withColumn("pruned", F.lit(0).cast("bigint")) if pruned is None else count.join(pruned.groupBy("start_id").agg(F.sum("pruned").alias("pruned")), "start_id", "left").select("start_id", F.coalesce("pruned", F.lit(0)).alias("pruned"))
    return hits, total


def why_no_definition(v: View, regex_mode: bool = False) -> DataFrame:
    """(revision_id, candidates, reasons): why a revision on the chain has no definition; reasons sorted, joined by commas."""
    mine = v.on_chain(v.g.revisions).select(F.col("revision_id").alias("source_revision_id"))
    e = v.edge_targets().filter(F.col("ty").isin("Extends", "Imports")).groupBy("source_revision_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("target_revision_id").isNull()).alias("unresolved"))
    j = mine.join(e, "source_revision_id", "left").select(F.col("source_revision_id").alias("revision_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("unresolved") > 0, "target_identity_without_active_revision"), F.when(F.col("candidates") == 0, "no_outbound_definition_edges"), F.when(F.lit(regex_mode), "index_mode_regex_limits_call_precision"))))
    return j.select("revision_id", "candidates", F.array_join(reasons, ",").alias("reasons"))


def explain_counts(v: View) -> DataFrame:
    """Per revision on the chain: outbound, inbound sources, unresolved definitions, and stale and orphaned of its identity."""
    r = v.on_chain(v.g.revisions)
    status = r.groupBy("identity_id").agg(F.count_if(F.col("status") == "Tombstone").alias("stale"), F.count_if(F.col("status") == "Orphaned").alias("orphaned"))
    out = v.edge_targets().groupBy(F.col("source_revision_id").alias("revision_id")).agg(F.count(F.lit(1)).alias("outbound"), F.count_if(F.col("ty").isin("Extends", "Imports") & F.col("target_revision_id").isNull()).alias("unresolved"))
    inn = v.inbound().groupBy(F.col("target_id").alias("identity_id")).agg(F.countDistinct("source_identity_id").alias("inbound"))
    j = r.select("revision_id", "identity_id").join(status, "identity_id").join(out, "revision_id", "left").join(inn, "identity_id", "left")
    return j.select("revision_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outbound", "inbound", "unresolved", "stale", "orphaned")])


