"""Which identity a parsed symbol has: its own, or that of a symbol that was renamed or moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.operators.graph import Policy
from brindle.operators.retention import rename_candidates, settled_renames


def resolve_or_create(symbols: DataFrame, tombstones: DataFrame, policy: Policy, now_ms: int, bodies: DataFrame | None = None) -> DataFrame:
    """(branch_id, symbol_id, identity_id, tomb_id, confidence, resolver): the identity of each new symbol.

    symbols: branch_id, symbol_id (the proposed identity), file_path, kind, qualified_name, body. tombstones: branch_id,
    revision_id, identity_id, file_path, kind, qualified_name, body, tombstoned_at_ms. With bodies (body_id, body), both have
    a body_id instead of a body. A symbol takes over the identity of the best tombstone of its file, else of another file; each tombstone once, in the order of symbols. All others keep
    the proposed identity, and tomb_id, confidence and resolver are null. resolver is Textual if the name alone has that
    confidence, else Ast. Identities are deterministic, so that no allocation has to be guarded against a second writer.
    """
    old = rename_candidates(tombstones, now_ms, policy.rename_window_days).withColumn("id", F.col("revision_id"))
    new = symbols.withColumn("id", F.col("symbol_id"))
    won = settled_renames(old, new, policy, bodies).select("tomb_id", "symbol_id", "confidence", "cross_file")
    was = old.select(F.col("revision_id").alias("tomb_id"), F.col("identity_id").alias("old_identity"), F.col("qualified_name").alias("old_name"))
    near = S.name_proximity(F.col("old_name"), F.col("qualified_name"))
    named = ~F.col("cross_file") & (near >= policy.name_proximity) & (near >= F.col("confidence"))
    j = symbols.select("branch_id", "symbol_id", "qualified_name").join(won.join(was, "tomb_id"), "symbol_id", "left")
    return j.select("branch_id", "symbol_id", F.coalesce("old_identity", "symbol_id").alias("identity_id"), "tomb_id", "confidence", F.when(F.col("tomb_id").isNotNull(), F.when(named, "Textual").otherwise("Ast")).alias("resolver"))


def renamed_edge_id() -> Column:
    """Of a row of ``resolve_or_create`` with a tombstone, the id of its edge."""
    return S.stable_id(F.lit("renamed"), F.col("tomb_id").cast("string"), F.col("identity_id").cast("string"))


def renamed_from(resolved: DataFrame) -> DataFrame:
    """Edges from each tombstone taken over to its successor: edge_id, ty, source_revision_id, target_identity_id, resolver, last_validation_ms."""
    r = resolved.filter("tomb_id IS NOT NULL")
    return r.select(renamed_edge_id().alias("edge_id"), F.lit("RenamedFrom").alias("ty"), F.col("tomb_id").alias("source_revision_id"), F.col("identity_id").alias("target_identity_id"), "resolver", F.lit(0).cast("bigint").alias("last_validation_ms"))


def stabilized(symbols: DataFrame, live: DataFrame) -> DataFrame:
    """symbols with disambiguators such that a name's live symbol keeps the plain one.

    symbols: path, key, kind, disambiguator, ord; live: path, key, kind of the live symbol with the plain disambiguator. If
    the plain one would go to a symbol of another kind, the first symbol of the live kind takes it, and the others are told
    apart anew: fn:i, class, class:i, other:i. Groups of one symbol, and names without one of that kind, stay as they are.
    """
    had = live.select("path", "key", F.col("kind").alias("live_kind")).dropDuplicates(["path", "key"])
    group = Window.partitionBy("path", "key")
    s = symbols.join(had, ["path", "key"], "left").withColumn("n", F.count(F.lit(1)).over(group))
    plain = F.max(F.when(F.col("disambiguator") == "", F.col("kind"))).over(group)
    keep = F.min(F.when((F.col("kind") == F.col("live_kind")) & (F.col("disambiguator") != ""), F.col("ord"))).over(group)
    s = s.withColumn("plain", plain).withColumn("keep", keep)
    move = (F.col("n") > 1) & (F.col("key") != "$file") & F.col("live_kind").isNotNull() & (F.col("plain") != F.col("live_kind")) & F.col("keep").isNotNull()
    s = s.withColumn("move", F.coalesce(move, F.lit(False)))
    i = (F.row_number().over(Window.partitionBy("path", "key", "kind", F.col("ord") == F.coalesce("keep", F.lit(-1))).orderBy("ord")) - 1).cast("string")
    told = F.when(F.col("ord") == F.col("keep"), "").when(F.col("kind") == "Function", F.concat(F.lit("fn:"), i)).when(F.col("kind") == "Class", F.when(i == "0", "class").otherwise(F.concat(F.lit("class:"), i))).otherwise(F.concat(F.lit("other:"), i))
    return s.withColumn("disambiguator", F.when(F.col("move"), told).otherwise(F.col("disambiguator"))).select(*symbols.columns)
