"""File events applied to the graph's tables: what is tombstoned, kept, replaced and new after a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scoring import stable_id
from brindle.operators.graph import LIVE, Policy
from brindle.operators.identity import renamed_from, resolve_or_create
from brindle.workspace import Workspace

GONE = ("Deleted",)
MOVED = ("Renamed", "Moved")
REVISION = ("branch_id", "identity_id", "revision_id", "status", "kind", "qualified_name", "file_path", "body_hash", "parent_revision_id", "rename_source_id", "tombstoned_at_ms", "ts_ms")


@dataclass
class Tables:
    """The tables a batch of events reads and replaces. Ids are strings."""

    branches: DataFrame  # branch_id, parent_id
    revisions: DataFrame  # REVISION
    edges: DataFrame  # edge_id, ty, source_revision_id, target_identity_id, resolver, last_validation_ms
    overrides: DataFrame  # branch_id, source_revision_id, edge_id, new_target
    bindings: DataFrame  # branch_id, identity_id, revision_id
    deletions: DataFrame  # branch_id, identity_id, deleted_at_ms
    bodies: DataFrame  # body_hash, body


def last_actions(events: DataFrame) -> DataFrame:
    """(branch_id, path, dead): what becomes of each path by its last event; the old path of a move is dead unless it comes back.

    events: branch_id, path, old_path, kind, seq. Repeated events and events of one path in any order count once, by seq.
    """
    now = events.select("branch_id", "path", F.col("kind").isin(*GONE).alias("dead"), "seq", F.lit(1).alias("late"))
    left = events.filter(F.col("kind").isin(*MOVED) & F.col("old_path").isNotNull()).select("branch_id", F.col("old_path").alias("path"), F.lit(True).alias("dead"), "seq", F.lit(0).alias("late"))
    return now.unionByName(left).filter("path IS NOT NULL").groupBy("branch_id", "path").agg(F.max_by("dead", F.struct("seq", "late")).alias("dead"))


def apply_events(t: Tables, events: DataFrame, symbols: DataFrame, calls: DataFrame, now_ms: int, policy: Policy | None = None, locked: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """(tables after the batch, events that must wait): events of branches that a merge has locked are put back.

    events: branch_id, path, old_path, kind, seq. symbols: path, symbol_id (the proposed identity), kind, qualified_name,
    body of the new contents; calls: edges of those (source_symbol, ty, target_identity_id, resolver). Applying a batch a
    second time changes nothing: ids come from contents, and what is as it should be is not touched.

    Symbols of dead paths, and those a new content lacks, become tombstones; where branches inherit them, they stay and get
    a deletion marker. A new symbol may take over a tombstone's identity, which an edge records. An equal body keeps its
    revision; a changed one retires it and links to it. Bindings follow, markers of what is there again are dropped, and
    edges to a renamed symbol's tombstone are turned to its successor.
    """
    policy = policy or Policy()
    spark = events.sparkSession
    ws = Workspace(spark, "apply")
    held = locked.select("branch_id").distinct() if locked is not None else spark.createDataFrame([], "branch_id bigint")
    waiting = events.join(held, "branch_id", "left_semi")
    last = ws.write(last_actions(events.join(held, "branch_id", "left_anti")), "last")
    parents = t.branches.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("branch_id"), F.lit(True).alias("inherited")).distinct()

    live = t.revisions.filter(F.col("status").isin(*LIVE))
    touched = live.join(last.withColumnRenamed("path", "file_path"), ["branch_id", "file_path"])
    parsed = last.filter("NOT dead").join(symbols, "path").select("branch_id", F.col("path").alias("file_path"), "symbol_id", "kind", "qualified_name", "body", F.md5("body").alias("body_hash"))
    parsed = ws.write(parsed.dropDuplicates(["branch_id", "symbol_id"]), "parsed")

    # A live symbol that was renamed in an earlier batch is found again under the identity it took over, by its name.
    there = parsed.select("branch_id", "file_path", "qualified_name", F.lit(True).alias("there")).distinct()
    lost = ws.write(touched.join(there, ["branch_id", "file_path", "qualified_name"], "left_anti").join(parents, "branch_id", "left").select(*REVISION, F.coalesce("inherited", F.lit(False)).alias("hide")), "lost")
    dying = lost.filter("NOT hide").select("revision_id", F.lit(True).alias("dying"))
    revisions = t.revisions.join(dying, "revision_id", "left").withColumn("tombstoned_at_ms", F.when(F.col("dying"), F.lit(now_ms).cast("bigint")).otherwise(F.col("tombstoned_at_ms"))).withColumn("status", F.when(F.col("dying"), "Tombstone").otherwise(F.col("status"))).select(*REVISION)
    revisions = ws.write(revisions, "tombstoned")

    # Known symbols by name on their branch; the others are new.
    first = F.row_number().over(Window.partitionBy("branch_id", "file_path", "qualified_name").orderBy(F.col("status") != "Active", "revision_id"))
    known = revisions.filter(F.col("status").isin(*LIVE)).withColumn("n", first).filter("n = 1").select("branch_id", "file_path", "qualified_name", F.col("identity_id").alias("known_id"), F.col("revision_id").alias("old_rev"), F.col("body_hash").alias("old_hash"))
    p = ws.write(parsed.join(known, ["branch_id", "file_path", "qualified_name"], "left"), "matched")
    tombs = revisions.filter("status = 'Tombstone'").join(last.select("branch_id").distinct(), "branch_id", "left_semi").join(t.bodies, "body_hash", "left")
    # A tombstone that a successor has taken over already is no candidate.
    tombs = tombs.join(t.edges.filter("ty = 'RenamedFrom'").select(F.col("source_revision_id").alias("revision_id")), "revision_id", "left_anti")
    found = ws.write(resolve_or_create(p.filter("known_id IS NULL"), tombs, policy, now_ms), "found")

    fresh_id = stable_id(F.col("branch_id").cast("string"), "identity_id", "body_hash")
    q = p.join(found.select("branch_id", "symbol_id", F.col("identity_id").alias("found_id"), "tomb_id"), ["branch_id", "symbol_id"], "left")
    q = q.withColumn("identity_id", F.coalesce("known_id", "found_id")).withColumn("same", F.coalesce(F.col("old_hash") == F.col("body_hash"), F.lit(False)))
    q = q.withColumn("revision_id", F.when(F.col("same"), F.col("old_rev")).otherwise(fresh_id))
    q = ws.write(q, "settled")
    retired = q.filter("old_rev IS NOT NULL AND NOT same").select(F.col("old_rev").alias("revision_id"), F.lit(True).alias("retired"))
    new = q.filter("NOT same").select(
        "branch_id", "identity_id", "revision_id", F.lit("Active").alias("status"), "kind", "qualified_name", "file_path", "body_hash", F.coalesce("old_rev", "tomb_id").alias("parent_revision_id"),
        F.when(F.col("tomb_id").isNotNull(), F.col("identity_id")).alias("rename_source_id"), F.lit(None).cast("bigint").alias("tombstoned_at_ms"), F.lit(now_ms).cast("bigint").alias("ts_ms"),
    )
    kept = revisions.join(retired, "revision_id", "left").withColumn("tombstoned_at_ms", F.when(F.col("retired"), F.lit(now_ms).cast("bigint")).otherwise(F.col("tombstoned_at_ms"))).withColumn("status", F.when(F.col("retired"), "Tombstone").otherwise(F.col("status")))
    # A body that comes back has its old revision's id: that row is replaced.
    out_revisions = kept.select(*REVISION).join(new.select("revision_id"), "revision_id", "left_anti").select(*REVISION).unionByName(new)

    bound = q.select("branch_id", "identity_id", "revision_id")
    unbound = bound.select("branch_id", "identity_id").unionByName(lost.select("branch_id", "identity_id")).distinct()
    bindings = t.bindings.join(unbound, ["branch_id", "identity_id"], "left_anti").select("branch_id", "identity_id", "revision_id").unionByName(bound)
    hidden = lost.filter("hide").select("branch_id", "identity_id").distinct().join(t.deletions.select("branch_id", "identity_id"), ["branch_id", "identity_id"], "left_anti").withColumn("deleted_at_ms", F.lit(now_ms).cast("bigint"))
    deletions = t.deletions.join(bound.select("branch_id", "identity_id"), ["branch_id", "identity_id"], "left_anti").select("branch_id", "identity_id", "deleted_at_ms").unionByName(hidden)

    src = q.select("symbol_id", F.col("revision_id").alias("source_revision_id"))
    made = calls.join(src, calls["source_symbol"] == src["symbol_id"]).select(stable_id("source_revision_id", "ty", F.col("target_identity_id").cast("string")).alias("edge_id"), "ty", "source_revision_id", "target_identity_id", "resolver", F.lit(now_ms).cast("bigint").alias("last_validation_ms"))
    links = renamed_from(found)
    mine = made.unionByName(links).dropDuplicates(["edge_id"])
    replaced = t.edges.filter("ty != 'RenamedFrom'").join(src.select("source_revision_id").distinct(), "source_revision_id", "left_semi").select("edge_id").unionByName(links.select("edge_id"))
    edges = t.edges.join(replaced, "edge_id", "left_anti").select(*mine.columns).unionByName(mine)
    # The proposed identity of a symbol that took over another one: edges to it lead to the one it has.
    other = q.filter("symbol_id != identity_id").select("branch_id", F.col("symbol_id").alias("target_identity_id"), F.col("identity_id").alias("new_target"))
    turned = mine.join(out_revisions.select(F.col("revision_id").alias("source_revision_id"), "branch_id"), "source_revision_id").join(other, ["branch_id", "target_identity_id"]).select("branch_id", "source_revision_id", "edge_id", "new_target")
    overrides = t.overrides.join(turned.select("branch_id", "source_revision_id", "edge_id"), ["branch_id", "source_revision_id", "edge_id"], "left_anti").select("branch_id", "source_revision_id", "edge_id", "new_target").unionByName(turned)
    bodies = t.bodies.select("body_hash", "body").unionByName(parsed.select("body_hash", "body")).filter("body_hash IS NOT NULL").dropDuplicates(["body_hash"])
    after = Tables(t.branches, *(ws.write(df, n) for n, df in (("revisions", out_revisions), ("edges", edges), ("overrides", overrides), ("bindings", bindings), ("deletions", deletions), ("bodies", bodies))))
    return after, waiting


def retarget_edge(t: Tables, branch_id: int, source_revision_id: str, edge_id: str, new_target: str) -> DataFrame:
    """The overrides with that edge turned; an edge that is not there raises KeyError."""
    if t.edges.filter((F.col("edge_id") == edge_id) & (F.col("source_revision_id") == source_revision_id)).isEmpty():
        raise KeyError(edge_id)
    row = t.edges.sparkSession.createDataFrame([(branch_id, source_revision_id, edge_id, new_target)], "branch_id bigint, source_revision_id string, edge_id string, new_target string")
    return t.overrides.filter(~((F.col("branch_id") == branch_id) & (F.col("source_revision_id") == source_revision_id) & (F.col("edge_id") == edge_id))).unionByName(row)
