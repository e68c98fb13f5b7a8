"""Merging of branches as joins: classification, promotion and reconciliation of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFLICTS = ("BothModifiedUnresolved", "BothNewDivergent", "TheirsDeletedOursModified", "OursDeletedTheirsModified")


def merge_class(base: Column, ours: Column, theirs: Column) -> Column:
    """The class of an identity by the bodies it is bound to on the three sides; null is absent."""
    b, o, t = base.isNotNull(), ours.isNotNull(), theirs.isNotNull()
    return (
        F.when(~b & ~o & ~t, "Clean")
        .when(~b & o & ~t, "OursNew")
        .when(~b & ~o & t, "TheirsNew")
        .when(~b & o & t, F.when(ours == theirs, "BothModifiedSame").otherwise("BothNewDivergent"))
        .when(b & o & t, F.when((ours == base) & (theirs == base), "Clean").when(ours == base, "TheirsOnly").when(theirs == base, "OursOnly").when(ours == theirs, "BothModifiedSame").otherwise("BothModifiedUnresolved"))
        .when(b & o & ~t, F.when(ours == base, "TheirsOnly").otherwise("TheirsDeletedOursModified"))
        .when(b & ~o & t, F.when(theirs == base, "OursOnly").otherwise("OursDeletedTheirsModified"))
        .otherwise("BothDeleted")
    )


def classify(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(identity_id, base_rev, ours_rev, theirs_rev, class). Sides: identity_id, revision_id, body_hash, rename_source_id.

    A new or changed identity whose revision was renamed from one that a side dropped becomes RenamedCandidate, and that
    one BothDeleted.
    """
    sides = []
    for name, df in (("base", base), ("ours", ours), ("theirs", theirs)):
        sides.append(df.select("identity_id", F.col("revision_id").alias(f"{name}_rev"), F.col("body_hash").alias(f"{name}_body"), F.col("rename_source_id").alias(f"{name}_from")))
    j = sides[0].join(sides[1], "identity_id", "full").join(sides[2], "identity_id", "full")
    j = j.withColumn("class", merge_class(F.col("base_body"), F.col("ours_body"), F.col("theirs_body")))
    gone = j.filter(F.col("class").isin("TheirsOnly", "OursOnly", "BothDeleted")).select(F.col("identity_id").alias("old_id"))
    fresh = j.filter(F.col("class").isin("OursNew", "TheirsNew", "BothNewDivergent", "BothModifiedUnresolved", "BothModifiedSame"))
    pairs = fresh.select("identity_id", F.explode(F.array_compact(F.array("ours_from", "theirs_from"))).alias("old_id")).filter("old_id != identity_id").join(gone, "old_id", "left_semi").distinct()
    new = pairs.select("identity_id").distinct().withColumn("renamed", F.lit(True))
    old = pairs.select(F.col("old_id").alias("identity_id")).distinct().withColumn("left", F.lit(True))
    j = j.join(new, "identity_id", "left").join(old, "identity_id", "left")
    cls = F.when(F.col("renamed"), "RenamedCandidate").when(F.col("left"), "BothDeleted").otherwise(F.col("class"))
    return j.select("identity_id", "base_rev", "ours_rev", "theirs_rev", cls.alias("class"))


def promote(classified: DataFrame, strategy: str | None = None) -> DataFrame:
    """(identity_id, class, winner, loser, action): bind the winner, unbind, or leave a conflict unresolved."""
    c = F.col("class")
    picked = F.coalesce("ours_rev", "theirs_rev") if strategy == "ours" else F.coalesce("theirs_rev", "ours_rev") if strategy == "theirs" else F.lit(None).cast("bigint")
    conflict = c.isin(*CONFLICTS)
    winner = (
        F.when(c == "Clean", F.coalesce("ours_rev", "base_rev"))
        .when(c.isin("OursNew", "OursOnly", "BothModifiedSame"), F.col("ours_rev"))
        .when(c.isin("TheirsNew", "TheirsOnly"), F.col("theirs_rev"))
        .when(c == "RenamedCandidate", F.coalesce("theirs_rev", "ours_rev"))
        .when(conflict, picked)
    )
    p = classified.withColumn("winner", winner)
    loser = F.when(conflict & F.col("winner").isNotNull(), F.when(F.col("winner") == F.col("ours_rev"), F.col("theirs_rev")).otherwise(F.col("ours_rev")))
    action = F.when(conflict & F.lit(strategy is None), "unresolved").when(F.col("winner").isNull(), "unbind").otherwise("bind")
    return p.select("identity_id", "class", "winner", loser.alias("loser"), action.alias("action"))


def upsert_bindings(target: DataFrame, promoted: DataFrame) -> DataFrame:
    """The target's bindings after promotion: (identity_id, revision_id)."""
    done = promoted.filter("action != 'unresolved'")
    kept = target.select("identity_id", "revision_id").join(done.select("identity_id"), "identity_id", "left_anti")
    return kept.unionByName(done.filter("action = 'bind'").select("identity_id", F.col("winner").alias("revision_id")))


def reconcile_edges(edges: DataFrame, bindings: DataFrame, overrides: DataFrame) -> DataFrame:
    """(edge_id, keep) for the edges of bound revisions: an edge stays if its target, after the target branch's own overrides, is bound."""
    mine = edges.join(bindings.select(F.col("revision_id").alias("source_revision_id")), "source_revision_id", "left_semi")
    o = overrides.groupBy("source_revision_id", "edge_id").agg(F.min("new_target").alias("new_target"))
    e = mine.join(o, ["source_revision_id", "edge_id"], "left").withColumn("eff", F.coalesce("new_target", "target_identity_id"))
    b = bindings.select(F.col("identity_id").alias("eff"), F.lit(True).alias("bound"))
    return e.join(b, "eff", "left").select("edge_id", F.coalesce("bound", F.lit(False)).alias("keep"))


def merge_report(classified: DataFrame) -> DataFrame:
    """(label, n): resolved, renamed and conflicting identities; deletions say which side deleted."""
    c = F.col("class")
    label = F.when(c == "RenamedCandidate", "rename").when(c == "TheirsDeletedOursModified", "conflict:theirs_deleted_ours_modified").when(c == "OursDeletedTheirsModified", "conflict:ours_deleted_theirs_modified").when(c.isin(*CONFLICTS), "conflict").otherwise("resolved")
    return classified.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
