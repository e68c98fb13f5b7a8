"""Queries of counts, integrity, metrics, merging, renames and retention, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.operators import identity as I
from brindle.operators import merge as M
from brindle.operators import quality as A
from brindle.operators import retention as R
from brindle.operators.graph import Graph, Policy
from brindle.plans.fixture import NOW_MS, SPARK_MS, graph, relation, with_sql
from brindle.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def bodies_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("body_hash"))


def full_revisions(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    """Revisions with body_hash, parent_revision_id (the one before on its branch), rename_source_id and tombstoned_at_ms."""
    r = g.revisions.join(bodies_of(spark, d), "doc_id", "left")
    w = Window.partitionBy("branch_id", "identity_id").orderBy("ts_ms", "revision_id")
    ren = g.edges.filter("ty = 'RenamedFrom'").join(g.revisions.select(F.col("revision_id").alias("source_revision_id"), F.col("identity_id").alias("old_id")), "source_revision_id").groupBy(F.col("target_identity_id").alias("identity_id")).agg(F.min("old_id").alias("rename_source_id"))
    return r.withColumn("parent_revision_id", F.lag("revision_id").over(w)).join(ren, "identity_id", "left").withColumn("tombstoned_at_ms", tombstoned_at_ms())


def tombstoned_at_ms() -> Column:
    return F.when((F.col("status") == "Tombstone") & (F.col("revision_id") % 7 != 0), F.col("ts_ms"))


def bindings_of(g: Graph) -> DataFrame:
    """The primaries as bindings, with faults: some point at a tombstone, some at nothing."""
    t = g.revisions.filter("status = 'Tombstone'").groupBy("branch_id", "identity_id").agg(F.min("revision_id").alias("tomb"))
    b = A.primaries(g.revisions).join(t, ["branch_id", "identity_id"], "left")
    to = F.when(F.col("identity_id") % 43 == 0, -F.col("identity_id") - 1).when(F.col("identity_id") % 41 == 0, F.coalesce("tomb", "revision_id")).otherwise(F.col("revision_id"))
    return b.select("branch_id", "identity_id", to.alias("revision_id"))


MORE = [
    "g_bodies AS (SELECT doc_id, md5(text) AS body_hash FROM documents WHERE text IS NOT NULL)",
    "g_ren AS (SELECT e.target_identity_id AS identity_id, min(r.identity_id) AS rename_source_id FROM g_edges e JOIN g_revisions r ON r.revision_id = e.source_revision_id WHERE e.ty = 'RenamedFrom' GROUP BY 1)",
    "g_full AS (SELECT r.*, b.body_hash, lag(r.revision_id) OVER (PARTITION BY r.branch_id, r.identity_id ORDER BY r.ts_ms, r.revision_id) AS parent_revision_id, n.rename_source_id, CASE WHEN status = 'Tombstone' AND r.revision_id % 7 <> 0 THEN ts_ms END AS tombstoned_at_ms FROM g_revisions r LEFT JOIN g_bodies b USING (doc_id) LEFT JOIN g_ren n USING (identity_id))",
    "g_prim AS (SELECT branch_id, identity_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY branch_id, identity_id ORDER BY CASE status WHEN 'Active' THEN 0 ELSE 1 END, revision_id) AS n FROM g_revisions WHERE status IN ('Active', 'Speculative')) WHERE n = 1)",
    "g_tomb AS (SELECT branch_id, identity_id, min(revision_id) AS tomb FROM g_revisions WHERE status = 'Tombstone' GROUP BY 1, 2)",
    "g_bind AS (SELECT p.branch_id, p.identity_id, CASE WHEN p.identity_id % 43 = 0 THEN -p.identity_id - 1 WHEN p.identity_id % 41 = 0 THEN coalesce(tomb, p.revision_id) ELSE p.revision_id END AS revision_id FROM g_prim p LEFT JOIN g_tomb t USING (branch_id, identity_id))",
]
W = with_sql(*MORE)


@query("a1_index_counts", W + "SELECT (SELECT count(*) FROM g_revisions WHERE status = 'Active') AS active_revisions, (SELECT count(DISTINCT file_path) FROM g_revisions WHERE status = 'Active' AND file_path LIKE '%.py') AS indexable_files, (SELECT count(*) FROM g_edges e JOIN g_revisions r ON r.revision_id = e.source_revision_id WHERE r.status = 'Active') AS active_edges, (SELECT count(*) FROM g_revisions) AS revisions, (SELECT count(*) FROM g_edges) AS edges")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.index_counts(g.revisions, g.edges)


@query("a2_status_counts", W + "SELECT identity_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("Active", "Speculative", "Tombstone", "Orphaned")) + " FROM g_revisions GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.status_counts(graph(spark, d).revisions)


@query("a3_identities_on_branch", W + "SELECT DISTINCT branch_id, identity_id FROM g_revisions")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).revisions.select("branch_id", "identity_id").distinct()


@query("a4_active_files", W + "SELECT DISTINCT branch_id, file_path FROM g_revisions WHERE status = 'Active'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).revisions.filter("status = 'Active'").select("branch_id", "file_path").distinct()


_CONSISTENCY = W + """
SELECT 'dangling_binding' AS "check", b.branch_id || ':' || b.identity_id AS key FROM g_bind b LEFT JOIN g_revisions r USING (revision_id) WHERE r.revision_id IS NULL
UNION ALL SELECT 'tombstone_bound', b.branch_id || ':' || b.identity_id FROM g_bind b JOIN g_revisions r USING (revision_id) WHERE r.status = 'Tombstone'
UNION ALL SELECT 'active_without_binding', CAST(revision_id AS VARCHAR) FROM g_revisions r WHERE status = 'Active' AND NOT EXISTS (SELECT 1 FROM g_bind b WHERE b.branch_id = r.branch_id AND b.identity_id = r.identity_id)
UNION ALL SELECT 'duplicate_active', branch_id || ':' || identity_id FROM g_revisions WHERE status = 'Active' GROUP BY branch_id, identity_id HAVING count(*) > 1
UNION ALL SELECT 'missing_body', CAST(revision_id AS VARCHAR) FROM g_full WHERE body_hash IS NOT NULL AND body_hash NOT IN (SELECT body_hash FROM g_bodies WHERE doc_id % 3 <> 0)
UNION ALL SELECT 'primary_desync', p.branch_id || ':' || p.identity_id FROM g_prim p JOIN g_bind b USING (branch_id, identity_id) WHERE p.revision_id <> b.revision_id AND EXISTS (SELECT 1 FROM g_revisions r WHERE r.status = 'Active' AND r.branch_id = p.branch_id AND r.identity_id = p.identity_id)
"""


@query("a5_consistency", _CONSISTENCY)
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.consistency(full_revisions(g, spark, d), bindings_of(g), bodies_of(spark, d).filter("doc_id % 3 != 0"))


@query("q22_graph_consistency", 'SELECT "check", count(*) AS n FROM (' + _CONSISTENCY + ") GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["a5_consistency"](spark, d).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def merge_records(spark: SparkSession, d: str) -> DataFrame:
    """A merge record for each user and day of events: the phases are event types, their durations the values' sums."""
    e = table(spark, d, "events").withColumn("day", F.floor(F.expr(SPARK_MS.format(x="ts")) / 86400000))
    p = e.groupBy("user_id", "day", "event_type").agg(F.floor(F.sum(F.floor(F.col("value") * 100))).cast("bigint").alias("ms"), F.count(F.lit(1)).alias("n"))
    m = p.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ms"))).alias("phase_durations_ms"), F.sum("n").alias("edges_regenerated"))
    return m.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("merge_id"), "phase_durations_ms", "edges_regenerated", F.map_contains_key("phase_durations_ms", F.lit("error")).alias("compensated"), F.when(F.map_contains_key("phase_durations_ms", F.lit("view")), "view").alias("resumed_from_phase"))


_MERGES = "WITH p AS (SELECT user_id, (epoch_us(ts) // 1000) // 86400000 AS day, event_type AS phase, CAST(sum(floor(value * 100)) AS BIGINT) AS ms, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id || '-' || day AS merge_id, sum(n) AS edges, bool_or(phase = 'error') AS comp, bool_or(phase = 'view') AS res, CAST(sum(ms) AS BIGINT) AS total_ms FROM p GROUP BY 1)"


@query("a6_merge_rollup", _MERGES + ", r AS (SELECT phase, ms, row_number() OVER (PARTITION BY phase ORDER BY ms) AS k, count(*) OVER (PARTITION BY phase) AS c FROM p) SELECT phase, count(*) AS n, round(avg(ms), 4) AS avg_ms, max(ms) FILTER (WHERE k = CAST(floor((c - 1) * 0.99 + 0.5) AS BIGINT) + 1) AS p99_ms FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_rollup(merge_records(spark, d)).withColumn("avg_ms", F.round("avg_ms", 4))


@query("q20_merge_metrics", _MERGES + " SELECT count(*) AS n, round(avg(CAST(comp AS INT)), 6) AS compensation_rate, round(avg(CAST(res AS INT)), 6) AS resume_rate, round(avg(edges), 6) AS avg_edges_regenerated FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = A.merge_summary(merge_records(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("compensation_rate", "resume_rate", "avg_edges_regenerated")])


@query("q20_slowest_merges", _MERGES + " SELECT merge_id, total_ms FROM m ORDER BY total_ms DESC, merge_id LIMIT 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.slowest_merges(merge_records(spark, d))


@query("q17_embedding_status", "WITH n AS (SELECT max((epoch_us(ts) // 1000)) AS now FROM events) SELECT count(*) AS drains_per_minute, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS embedded_per_minute FROM events, n WHERE event_type = 'purchase' AND (epoch_us(ts) // 1000) >= now - 3600000 AND value > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts_ms", F.expr(SPARK_MS.format(x="ts")))
    now = e.agg(F.max("ts_ms")).head()[0] or 0
    drains = e.filter("event_type = 'purchase'").select("ts_ms", F.col("value").alias("attempted"), F.floor("value").alias("embedded"))
    return A.recent_rate(drains, now, 3_600_000)


@query("a8_debounce_percentiles", "WITH g AS (SELECT event_type, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events), r AS (SELECT event_type, gap, row_number() OVER (PARTITION BY event_type ORDER BY gap) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM g WHERE gap IS NOT NULL) SELECT event_type, max(gap) FILTER (WHERE k = CAST(floor((c - 1) * 0.5 + 0.5) AS BIGINT) + 1) AS p50, max(gap) FILTER (WHERE k = CAST(floor((c - 1) * 0.99 + 0.5) AS BIGINT) + 1) AS p99 FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ms", F.expr(SPARK_MS.format(x="ts")))
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return A.delay_percentiles(e.withColumn("gap", gap).filter("gap IS NOT NULL"), "event_type", "gap", {"p50": 0.5, "p99": 0.99})


@query("a9_stale_workers", "SELECT 'w' || user_id AS worker, max((epoch_us(ts) // 1000)) AS last_ms, (SELECT max((epoch_us(ts) // 1000)) FROM events) - max((epoch_us(ts) // 1000)) > 7200000 AS stale FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker"), F.expr(SPARK_MS.format(x="ts")).alias("ts_ms"))
    now = e.agg(F.max("ts_ms")).head()[0] or 0
    return A.stale_workers(e, now, 3_600_000)


@query("a12_majority_dimension", "SELECT len(embedding) AS dim, count(*) AS n FROM vectors WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY n DESC, dim LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_dimension(table(spark, d, "vectors").filter("embedding IS NOT NULL").select(F.size("embedding").cast("bigint").alias("dim")))


@query("a14_edge_cardinality", W + "SELECT source_revision_id, ty, count(*) AS n, count(*) > CASE WHEN ty = 'RenamedFrom' THEN 1 ELSE 10000 END AS violates FROM g_edges GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_cardinality(graph(spark, d).edges)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr(SPARK_MS.format(x="ts")).alias("ts_ms"), F.col("user_id").alias("session_id"), F.col("event_type").alias("action"))


@query("st7_audit_epochs", "SELECT (epoch_us(ts) // 1000) // 86400000 AS epoch_id, count(*) AS n, count(*) || '|' || min((epoch_us(ts) // 1000)) || '|' || max((epoch_us(ts) // 1000)) || '|' || count(DISTINCT user_id) AS summary FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.seal_epochs(_audit(spark, d), 86_400_000)


@query("q21_verify_audit_chain", "SELECT false AS ok, count(*) AS chain_length, min(e) FILTER (WHERE e % 5 = 0) AS broken_at_epoch FROM (SELECT DISTINCT (epoch_us(ts) // 1000) // 86400000 AS e FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The chain with tampered summaries in every fifth epoch."""
    chain = A.chain_epochs(A.seal_epochs(_audit(spark, d), 86_400_000))
    return A.verify_chain(chain.withColumn("summary", F.when(F.col("epoch_id") % 5 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary"))))


@query("q21_verify_whole_chain", "SELECT true AS ok, count(DISTINCT (epoch_us(ts) // 1000) // 86400000) AS chain_length, CAST(NULL AS BIGINT) AS broken_at_epoch FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.verify_chain(A.chain_epochs(A.seal_epochs(_audit(spark, d), 86_400_000)), block=7)


def _wal(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower(F.trim("phase"))
    names = ("Pending", "GraphDone", "VectorDone", "Committed", "Failed")
    return table(spark, d, "wal").select("log_id", F.coalesce(*[F.when(p == n.lower(), n) for n in names]).alias("phase"), "affected_revisions")


_WAL = "WITH w AS (SELECT log_id, CASE lower(trim(phase)) WHEN 'pending' THEN 'Pending' WHEN 'graphdone' THEN 'GraphDone' WHEN 'vectordone' THEN 'VectorDone' WHEN 'committed' THEN 'Committed' WHEN 'failed' THEN 'Failed' END AS phase, affected_revisions FROM wal), o AS (SELECT *, CASE phase WHEN 'Pending' THEN 0 WHEN 'GraphDone' THEN 1 WHEN 'VectorDone' THEN 2 WHEN 'Failed' THEN 3 ELSE 4 END AS k FROM w), l AS (SELECT log_id, arg_max(phase, k) AS phase, any_value(affected_revisions) AS affected_revisions FROM o GROUP BY 1), x AS (SELECT DISTINCT unnest(affected_revisions) AS revision_id, log_id, phase FROM l WHERE phase IN ('Pending', 'GraphDone', 'VectorDone'))"


def _latest_wal(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d)
    return A.replayed(w).drop("action").join(w.groupBy("log_id").agg(F.any_value("affected_revisions", True).alias("affected_revisions")), "log_id")


@query("st8_wal_replay", _WAL + " SELECT log_id, phase, CASE phase WHEN 'Pending' THEN 'fail' WHEN 'GraphDone' THEN 'redo_vector' WHEN 'VectorDone' THEN 'finalize' ELSE 'none' END AS action FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.replayed(_wal(spark, d))


@query("r4_stale_revisions", _WAL + " SELECT revision_id, arg_max(phase, log_id) AS phase, arg_max(phase, log_id) IN ('Pending', 'GraphDone') AS stale FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.stale_revisions(_latest_wal(spark, d), True)


@query("r4_overlapping", _WAL + " SELECT revision_id, f AS first_log_id, log_id FROM (SELECT *, min(log_id) OVER (PARTITION BY revision_id) AS f FROM x) WHERE log_id <> f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.overlapping(_latest_wal(spark, d))


@query("r3_wal_compaction", _WAL + ", n AS (SELECT count(*) AS n FROM l), t AS (SELECT log_id, row_number() OVER (ORDER BY log_id) AS k FROM l WHERE phase IN ('Committed', 'Failed')) SELECT log_id, phase FROM l WHERE log_id NOT IN (SELECT log_id FROM t, n WHERE k <= greatest(0, n - 40960 // 100))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.compacted_wal(A.replayed(_wal(spark, d)).select("log_id", "phase"), 100, 40_960)


# --- merging


def _side(g: Graph, spark: SparkSession, d: str, branch: int, deleted: bool) -> DataFrame:
    r = full_revisions(g, spark, d).select("revision_id", "body_hash", "rename_source_id")
    b = A.primaries(g.revisions).filter(F.col("branch_id") == branch).select("identity_id", "revision_id")
    if deleted:
        b = b.join(g.deletions.filter(F.col("branch_id") == branch).select("identity_id"), "identity_id", "left_anti")
    return b.join(r, "revision_id").withColumn("body_hash", F.coalesce("body_hash", F.lit("")))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return M.classify(_side(g, spark, d, 0, False), _side(g, spark, d, 1, True), _side(g, spark, d, 2, True))


def _side_sql(n: str, b: int) -> str:
    gone = "" if b == 0 else f" AND p.identity_id NOT IN (SELECT identity_id FROM g_deletions WHERE branch_id = {b})"
    return f"{n} AS (SELECT p.identity_id, p.revision_id AS rev, coalesce(f.body_hash, '') AS body, f.rename_source_id AS src FROM g_prim p JOIN g_full f USING (revision_id) WHERE p.branch_id = {b}{gone})"


_MERGE = with_sql(
    *MORE, _side_sql("sb", 0), _side_sql("so", 1), _side_sql("st", 2),
    "ids AS (SELECT identity_id FROM sb UNION SELECT identity_id FROM so UNION SELECT identity_id FROM st)",
    """c0 AS (SELECT i.identity_id, b.rev AS base_rev, o.rev AS ours_rev, t.rev AS theirs_rev, o.src AS osrc, t.src AS tsrc, CASE
  WHEN b.rev IS NULL AND t.rev IS NULL THEN 'OursNew' WHEN b.rev IS NULL AND o.rev IS NULL THEN 'TheirsNew'
  WHEN b.rev IS NULL THEN CASE WHEN o.body = t.body THEN 'BothModifiedSame' ELSE 'BothNewDivergent' END
  WHEN o.rev IS NULL AND t.rev IS NULL THEN 'BothDeleted'
  WHEN o.rev IS NULL THEN CASE WHEN t.body = b.body THEN 'OursOnly' ELSE 'OursDeletedTheirsModified' END
  WHEN t.rev IS NULL THEN CASE WHEN o.body = b.body THEN 'TheirsOnly' ELSE 'TheirsDeletedOursModified' END
  WHEN o.body = b.body AND t.body = b.body THEN 'Clean' WHEN o.body = b.body THEN 'TheirsOnly' WHEN t.body = b.body THEN 'OursOnly'
  WHEN o.body = t.body THEN 'BothModifiedSame' ELSE 'BothModifiedUnresolved' END AS class
FROM ids i LEFT JOIN sb b USING (identity_id) LEFT JOIN so o USING (identity_id) LEFT JOIN st t USING (identity_id))""",
    "pr AS (SELECT identity_id, unnest([osrc, tsrc]) AS old FROM c0 WHERE class IN ('OursNew', 'TheirsNew', 'BothNewDivergent', 'BothModifiedUnresolved', 'BothModifiedSame'))",
    "pq AS (SELECT DISTINCT p.identity_id, p.old FROM pr p JOIN c0 g ON g.identity_id = p.old AND g.class IN ('TheirsOnly', 'OursOnly', 'BothDeleted') WHERE p.old <> p.identity_id)",
    "cl AS (SELECT identity_id, base_rev, ours_rev, theirs_rev, CASE WHEN identity_id IN (SELECT identity_id FROM pq) THEN 'RenamedCandidate' WHEN identity_id IN (SELECT old FROM pq) THEN 'BothDeleted' ELSE class END AS class FROM c0)",
    "pm AS (SELECT *, class IN ('BothModifiedUnresolved', 'BothNewDivergent', 'TheirsDeletedOursModified', 'OursDeletedTheirsModified') AS conf, CASE WHEN class = 'Clean' THEN coalesce(ours_rev, base_rev) WHEN class IN ('OursNew', 'OursOnly', 'BothModifiedSame') THEN ours_rev WHEN class IN ('TheirsNew', 'TheirsOnly') THEN theirs_rev WHEN class = 'BothDeleted' THEN NULL ELSE coalesce(theirs_rev, ours_rev) END AS winner FROM cl)",
    "bd AS (SELECT identity_id, winner AS revision_id FROM pm WHERE winner IS NOT NULL)",
)


@query("m1_merge_classes", _MERGE + "SELECT identity_id, base_rev, ours_rev, theirs_rev, class FROM cl")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


@query("m1_merge_report", _MERGE + "SELECT CASE class WHEN 'RenamedCandidate' THEN 'rename' WHEN 'TheirsDeletedOursModified' THEN 'conflict:theirs_deleted_ours_modified' WHEN 'OursDeletedTheirsModified' THEN 'conflict:ours_deleted_theirs_modified' WHEN 'BothModifiedUnresolved' THEN 'conflict' WHEN 'BothNewDivergent' THEN 'conflict' ELSE 'resolved' END AS label, count(*) AS n FROM cl GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_report(_classified(spark, d))


@query("m2_promoted", _MERGE + "SELECT identity_id, class, winner, CASE WHEN conf AND winner IS NOT NULL THEN CASE WHEN winner = ours_rev THEN theirs_rev ELSE ours_rev END END AS loser, CASE WHEN winner IS NULL THEN 'unbind' ELSE 'bind' END AS action FROM pm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.promote(_classified(spark, d), "theirs")


def _merged_bindings(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    target = A.primaries(g.revisions).filter("branch_id = 1").select("identity_id", "revision_id")
    return M.upsert_bindings(target, M.promote(_classified(spark, d), "theirs"))


@query("m2_merged_bindings", _MERGE + "SELECT * FROM bd UNION ALL SELECT identity_id, revision_id FROM g_prim WHERE branch_id = 1 AND identity_id NOT IN (SELECT identity_id FROM cl)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _merged_bindings(spark, d)


@query("m3_reconciled_edges", _MERGE + ", b2 AS (SELECT * FROM bd UNION ALL SELECT identity_id, revision_id FROM g_prim WHERE branch_id = 1 AND identity_id NOT IN (SELECT identity_id FROM cl)), o AS (SELECT source_revision_id, edge_id, min(new_target) AS nt FROM g_overrides WHERE branch_id = 1 GROUP BY 1, 2) SELECT e.edge_id, coalesce(nt, target_identity_id) IN (SELECT identity_id FROM b2) AS keep FROM g_edges e LEFT JOIN o USING (source_revision_id, edge_id) WHERE e.source_revision_id IN (SELECT revision_id FROM b2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return M.reconcile_edges(g.edges, _merged_bindings(spark, d), g.overrides.filter("branch_id = 1"))


@query("w14_create_branch", W + "SELECT CAST(99 AS BIGINT) AS branch_id, identity_id, revision_id FROM g_prim WHERE branch_id = 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.primaries(graph(spark, d).revisions).filter("branch_id = 2").withColumn("branch_id", F.lit(99).cast("bigint"))


@query("w7_purge_branch", W + "SELECT branch_id, identity_id, revision_id FROM g_bind WHERE branch_id <> 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bindings_of(graph(spark, d)).filter("branch_id != 4")


@query("w4_confirm_speculative", W + "SELECT revision_id, CASE WHEN status = 'Speculative' AND branch_id = 3 THEN 'Active' ELSE status END AS status FROM g_revisions")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = graph(spark, d).revisions
    over = r.filter("status = 'Speculative' AND branch_id = 3").select("revision_id", F.lit("Active").alias("status"))
    return overlay(r.select("revision_id", "status"), over, ["revision_id"])


def overlay(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``over``, and those of ``base`` whose key it lacks."""
    return over.unionByName(base.join(over.select(*key), key, "left_anti"))


# --- renames and retention


_RENAMES = with_sql(
    *MORE,
    "rr AS (SELECT r.revision_id AS id, r.file_path, r.kind, r.qualified_name, d.text AS body, r.status, string_split(string_split(r.qualified_name, '::')[-1], '.')[-1] AS leaf, r.branch_id, r.doc_id FROM g_revisions r LEFT JOIN documents d USING (doc_id) WHERE r.kind <> 'File' AND r.qualified_name <> r.file_path)",
    "tk AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(body), '[^a-z0-9_]+'), lambda x: x <> '' AND x NOT IN ('def', 'async', 'return', 'pass', 'none', 'true', 'false', 'self', 'cls', 'class'))) AS toks FROM rr WHERE body IS NOT NULL)",
    "pp AS (SELECT t.id AS tomb_id, s.id AS symbol_id, t.leaf AS x, s.leaf AS y, a.toks AS ta, b.toks AS tb, t.body IS NOT NULL AND s.body IS NOT NULL AS both_known FROM rr t JOIN rr s ON s.file_path = t.file_path AND s.branch_id = t.branch_id LEFT JOIN tk a ON a.id = t.id LEFT JOIN tk b ON b.id = s.id WHERE t.status = 'Tombstone' AND s.status = 'Active')",
    "p2 AS (SELECT *, CASE WHEN x = y THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(strlen(x), strlen(y), 1) END AS near, CASE WHEN len(ta) >= 1 AND len(tb) >= 1 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS body FROM pp)",
    "p3 AS (SELECT tomb_id, symbol_id, greatest(CASE WHEN near >= 0.85 THEN near ELSE 0 END, CASE WHEN body >= 0.4 THEN body ELSE 0 END) AS confidence FROM p2 WHERE NOT both_known OR body >= 0.4)",
)


@query("i3_rename_scores", _RENAMES + "SELECT tomb_id, symbol_id, round(confidence, 6) AS confidence FROM p3 WHERE confidence >= 0.55")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Within files, of every branch and kind."""
    return R.rename_scores(*_rename_sides(spark, d), Policy()).withColumn("confidence", F.round("confidence", 6))


def _rename_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    r = graph(spark, d).revisions.join(docs, "doc_id", "left").select("branch_id", F.col("revision_id").alias("id"), "file_path", "kind", "qualified_name", "body", "status")
    return r.filter("status = 'Tombstone'"), r.filter("status = 'Active'")


def _sides_and_bodies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with the ids of their bodies, and the bodies."""
    r = relation(spark, d, "g_revisions").select("branch_id", F.col("revision_id").alias("id"), "file_path", "kind", "qualified_name", F.col("doc_id").alias("body_id"), "status")
    return r.filter("status = 'Tombstone'"), r.filter("status = 'Active'"), _document_bodies(spark, d)


def _document_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("body_id"), F.col("text").alias("body"))


def _all_renames(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every branch and kind, within files and across them."""
    t, s, bodies = _sides_and_bodies(spark, d)
    return R.all_rename_scores(t, s, Policy(), bodies)


_STOP = "('def', 'async', 'return', 'pass', 'none', 'true', 'false', 'self', 'cls', 'class')"
_MOVED = f"""ft AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS toks FROM documents WHERE text IS NOT NULL),
f2 AS (SELECT * FROM ft WHERE len(list_filter(toks, lambda x: x NOT IN {_STOP})) >= 2),
f3 AS (SELECT doc_id, len(any_value(toks)) AS n, any_value(toks) AS toks, {", ".join(f"bit_xor(CASE WHEN hash(tok) % 4 = {i} THEN 1::UBIGINT << CAST(hash(tok) // 4 % 60 AS INT) ELSE 0::UBIGINT END) AS s{i}" for i in range(4))} FROM (SELECT *, unnest(toks) AS tok FROM f2) GROUP BY 1),
-- Of sets so alike few elements differ, and each differing one flips a bit.
d2 AS (SELECT a.doc_id AS da, b.doc_id AS db, a.toks AS ta, b.toks AS tb FROM f3 a JOIN f3 b ON {" + ".join(f"CAST(bit_count(xor(a.s{i}, b.s{i})) AS INT)" for i in range(4))} <= 0.1765 * (a.n + b.n) + 1e-6),
dj AS (SELECT da, db, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS j FROM d2),
mv AS (SELECT t.id AS tomb_id, s.id AS symbol_id, j FROM rr t JOIN dj ON dj.da = t.doc_id AND j >= 0.7 JOIN rr s ON s.doc_id = dj.db AND s.branch_id = t.branch_id AND s.file_path <> t.file_path WHERE t.status = 'Tombstone' AND s.status = 'Active')"""


@query("i3_rename_scores_all", _RENAMES + ", " + _MOVED + " SELECT tomb_id, symbol_id, round(confidence, 6) AS confidence, false AS cross_file FROM p3 WHERE confidence >= 0.55 UNION ALL SELECT tomb_id, symbol_id, round(j, 6), true FROM mv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _all_renames(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("i1_best_renames")
def _(spark: SparkSession, d: str) -> DataFrame:
    t, s, bodies = _sides_and_bodies(spark, d)
    return R.settled_renames(t, s, Policy(), bodies).select("symbol_id", "tomb_id", "confidence")


@query("i2_rename_candidates", W + f"SELECT revision_id FROM g_full WHERE status = 'Tombstone' AND tombstoned_at_ms >= {NOW_MS} - 2000 * 86400000::BIGINT")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = full_revisions(graph(spark, d), spark, d).filter("status = 'Tombstone'")
    return R.rename_candidates(r, NOW_MS, 2000).select("revision_id")


@query("i8_retained_symbols", W + "SELECT identity_id, CASE WHEN bool_or(status = 'Active') THEN 'keep' ELSE 'tombstone' END AS action FROM g_revisions WHERE branch_id = 1 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = graph(spark, d).revisions.filter("branch_id = 1")
    return R.retained(r, r.filter("status = 'Active'"), False)


@query("i8_hidden_symbols", W + "SELECT identity_id, CASE WHEN bool_or(status = 'Active') THEN 'keep' ELSE 'hide' END AS action FROM g_revisions WHERE branch_id = 1 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same where a branch inherits the symbols."""
    r = graph(spark, d).revisions.filter("branch_id = 1")
    return R.retained(r, r.filter("status = 'Active'"), True)


@query("i5_resolved_identities")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whose identity each Active revision's symbol takes over, if it were new, and the edge that says so."""
    r = relation(spark, d, "g_revisions").withColumn("tombstoned_at_ms", tombstoned_at_ms()).withColumnRenamed("doc_id", "body_id")
    found = I.resolve_or_create(r.filter("status = 'Active'").withColumn("symbol_id", F.col("revision_id")), r.filter("status = 'Tombstone'"), Policy(rename_window_days=2000, tombstone_retention_days=2000), NOW_MS, _document_bodies(spark, d))
    return found.select("tomb_id", "branch_id", "symbol_id", "identity_id", F.round("confidence", 6).alias("confidence"), "resolver", F.when(F.col("tomb_id").isNotNull(), I.renamed_edge_id()).alias("edge_id"))


@query("w5_reverted_patches", "WITH e AS (SELECT CAST(event_id AS VARCHAR) AS patch_id, 'src/m' || user_id || '.py' AS path, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_id AS seq, event_type FROM events) SELECT patch_id, path, CASE WHEN seq < last THEN 'superseded' WHEN before IS NULL THEN 'remove' ELSE 'restore' END AS action, CASE WHEN seq = last THEN before END AS content FROM (SELECT *, max(seq) OVER (PARTITION BY path) AS last FROM e) WHERE event_type = 'purchase'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every event is an edit of its user's file, whose text is the event's type; purchases are to be taken back."""
    from brindle.operators.patches import reverted

    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    p = e.select(F.col("event_id").cast("string").alias("patch_id"), F.concat(F.lit("src/m"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), "before", F.col("event_id").alias("seq"), "event_type")
    return reverted(p, p.filter("event_type = 'purchase'"))


@query("q16_index_status", W + "SELECT * FROM (SELECT (SELECT count(*) FROM g_revisions WHERE status = 'Active') AS active_revisions, (SELECT count(DISTINCT file_path) FROM g_revisions WHERE status = 'Active' AND file_path LIKE '%.py') AS indexable_files, (SELECT count(*) FROM g_edges e JOIN g_revisions r ON r.revision_id = e.source_revision_id WHERE r.status = 'Active') AS active_edges, (SELECT count(*) FROM g_revisions) AS revisions, (SELECT count(*) FROM g_edges) AS edges), (SELECT count(*) AS queued, count(*) FILTER (WHERE h NOT IN (SELECT body_hash FROM vectors WHERE lower(trim(model_id)) = 'stub/hashed-bow' AND embedding IS NOT NULL)) AS not_embedded FROM (SELECT DISTINCT body_hash AS h FROM chunks WHERE body_hash IS NOT NULL)), (SELECT count(*) AS watched_events, count(DISTINCT user_id) AS watched_paths FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the index, of what waits to be embedded and of what the watcher saw."""
    from brindle.operators.semantic import embedding_jobs

    g = graph(spark, d)
    jobs = embedding_jobs(table(spark, d, "chunks"), table(spark, d, "bodies"), table(spark, d, "vectors"), "stub/hashed-bow")
    e = table(spark, d, "events").agg(F.count(F.lit(1)).alias("watched_events"), F.countDistinct("user_id").alias("watched_paths"))
    return A.index_counts(g.revisions, g.edges).crossJoin(jobs.agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("state") != "cached").alias("not_embedded"))).crossJoin(e)


@query("r1_tombstones_to_collect", W + f"SELECT revision_id FROM g_full f WHERE status = 'Tombstone' AND (tombstoned_at_ms IS NULL OR {NOW_MS} - tombstoned_at_ms >= 90 * 86400000::BIGINT) AND revision_id NOT IN (SELECT revision_id FROM g_bind) AND revision_id NOT IN (SELECT revision_id FROM g_prim) AND revision_id NOT IN (SELECT source_revision_id FROM g_overrides) AND NOT (revision_id IN (SELECT source_revision_id FROM g_edges WHERE ty = 'RenamedFrom') AND identity_id IN (SELECT target_identity_id FROM g_edges WHERE ty <> 'RenamedFrom'))")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    in_flight = g.overrides.select(F.col("source_revision_id").alias("revision_id"))
    return R.tombstones_to_collect(full_revisions(g, spark, d), bindings_of(g), A.primaries(g.revisions), in_flight, g.edges, NOW_MS, 90)


@query("r5_body_refcounts", "SELECT body_hash, count(*) AS refs FROM (SELECT DISTINCT chunk_id, body_hash FROM chunks WHERE body_hash IS NOT NULL) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.body_refcounts(table(spark, d, "chunks"))


# --- scalar functions


@query("f2_structural_score", "SELECT p_partkey, CASE WHEN NOT contains(lower(p_name), 'a') THEN 0.0 ELSE round((length(p_name) - length(replace(lower(p_name), 'a', ''))) + 1.0 / strlen(lower(p_name)), 6) END AS score FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.structural_score(F.lit("A"), F.col("p_name")), 6).alias("score"))


@query("f5_edge_confidence", W + f"SELECT edge_id, round(CASE resolver WHEN 'Lsp' THEN 0.85 WHEN 'Ast' THEN 0.6 ELSE 0.3 END * CASE WHEN last_validation_ms <= 0 THEN 1.0 ELSE greatest(0.5, exp(-greatest({NOW_MS} - last_validation_ms, 0) / 2592000000.0)) END, 6) AS conf FROM g_edges")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).edges.select("edge_id", F.round(S.edge_confidence(F.col("resolver"), F.col("last_validation_ms"), NOW_MS, 30), 6).alias("conf"))


@query("f12_token_jaccard", "WITH t AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), k AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(a, '[^a-z0-9_]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(b, '[^a-z0-9_]+'), lambda x: x <> '')) AS b FROM t) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(S.token_jaccard(S.tokens(F.col("p_name")), S.tokens(F.col("p_type"))), 6).alias("jaccard"))


@query("f14_name_proximity", "SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0 ELSE 1.0 - levenshtein(p_name, p_type) / greatest(strlen(p_name), strlen(p_type), 1) END, 6) AS proximity FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.name_proximity(F.col("p_name"), F.col("p_type")), 6).alias("proximity"))


@query("f15_masked_names", "SELECT p_partkey, regexp_replace(p_type, '(^|[^A-Za-z0-9_])' || split_part(p_type, ' ', 1) || '($|[^A-Za-z0-9_])', '\\1__brindle_nm__\\2', 'g') AS masked FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.mask_identifier(F.col("p_type"), F.substring_index("p_type", " ", 1)).alias("masked"))


@query("f18_token_counts", "SELECT doc_id, (strlen(text) + 3) // 4 AS n_tokens FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", S.token_count(F.col("text")).alias("n_tokens"))


# --- further upkeep


@query("i6_retargeted_edges", W + "SELECT CAST(1 AS BIGINT) AS branch_id, e.source_revision_id, e.edge_id, n.nt AS new_target FROM g_edges e JOIN g_revisions s ON s.revision_id = e.source_revision_id AND s.branch_id = 1 AND s.status IN ('Active', 'Speculative') JOIN (SELECT t.identity_id AS old, min(x.target_identity_id) AS nt FROM g_edges x JOIN g_revisions t ON t.revision_id = x.source_revision_id AND t.branch_id = 1 AND t.status = 'Tombstone' WHERE x.ty = 'RenamedFrom' GROUP BY 1) n ON n.old = e.target_identity_id WHERE e.ty <> 'RenamedFrom' AND n.nt <> e.target_identity_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return R.retargeted(g.edges, g.revisions, 1)


@query("i9_finalized_deletions", W + "SELECT revision_id FROM g_revisions r WHERE status = 'Active' AND EXISTS (SELECT 1 FROM g_deletions x WHERE x.branch_id = r.branch_id AND x.identity_id = r.identity_id) AND branch_id NOT IN (SELECT parent_id FROM g_branches WHERE parent_id IS NOT NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return R.finalized_deletions(g.revisions, g.deletions, g.branches)


@query("r2_drained_edges", W + f", c AS (SELECT revision_id FROM g_full f WHERE status = 'Tombstone' AND (tombstoned_at_ms IS NULL OR {NOW_MS} - tombstoned_at_ms >= 90 * 86400000::BIGINT) AND revision_id NOT IN (SELECT revision_id FROM g_bind) AND revision_id NOT IN (SELECT revision_id FROM g_prim) AND revision_id NOT IN (SELECT source_revision_id FROM g_overrides) AND NOT (revision_id IN (SELECT source_revision_id FROM g_edges WHERE ty = 'RenamedFrom') AND identity_id IN (SELECT target_identity_id FROM g_edges WHERE ty <> 'RenamedFrom'))) SELECT ty, count(*) AS n FROM g_edges WHERE source_revision_id NOT IN (SELECT revision_id FROM c) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    _, e, _ = R.drained(g.revisions, g.edges, g.overrides, QUERIES["r1_tombstones_to_collect"](spark, d))
    return e.groupBy("ty").agg(F.count(F.lit(1)).alias("n"))


@query("q18_system_status", "SELECT v.n AS violations, w.n AS stale_workers, false AS audit_ok, false AS healthy, concat_ws(',', 'audit_chain_broken', CASE WHEN v.n > 0 THEN 'consistency_violations' END, CASE WHEN w.n > 0 THEN 'worker_stale' END) AS degraded_modes FROM (SELECT count(*) AS n FROM (" + _CONSISTENCY + ")) v, (SELECT count(*) AS n FROM (SELECT (SELECT max((epoch_us(ts) // 1000)) FROM events) - max((epoch_us(ts) // 1000)) > 7200000 AS s FROM events GROUP BY user_id) WHERE s) w")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.health(QUERIES["a5_consistency"](spark, d), QUERIES["q21_verify_audit_chain"](spark, d), QUERIES["a9_stale_workers"](spark, d))


@query("q18_status_of_whole_chain", "SELECT v.n AS violations, w.n AS stale_workers, true AS audit_ok, v.n + w.n = 0 AS healthy, concat_ws(',', CASE WHEN v.n > 0 THEN 'consistency_violations' END, CASE WHEN w.n > 0 THEN 'worker_stale' END) AS degraded_modes FROM (SELECT count(*) AS n FROM (" + _CONSISTENCY + ") WHERE \"check\" = 'dangling_body') v, (SELECT count(*) AS n FROM (SELECT (SELECT max((epoch_us(ts) // 1000)) FROM events) - max((epoch_us(ts) // 1000)) > 1728000000000 AS s FROM events GROUP BY user_id) WHERE s) w")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All is well: an untouched chain, no violation of a check that none is of, workers that may rest for decades."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("worker"), F.expr(SPARK_MS.format(x="ts")).alias("ts_ms"))
    now = e.agg(F.max("ts_ms")).head()[0] or 0
    return A.health(QUERIES["a5_consistency"](spark, d).filter("check = 'dangling_body'"), QUERIES["q21_verify_whole_chain"](spark, d), A.stale_workers(e, now, 864_000_000_000))


@query("a13_edge_landing", W + "SELECT ty, count(*) AS expected, count(*) FILTER (WHERE target_identity_id IN (SELECT identity_id FROM g_prim)) AS found, round(count(*) FILTER (WHERE target_identity_id IN (SELECT identity_id FROM g_prim)) / count(*), 6) AS recall FROM g_edges GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of the edges of each type, how many lead to an identity that is live on some branch."""
    g = graph(spark, d)
    live = A.primaries(g.revisions).select(F.col("identity_id").alias("target_identity_id")).distinct()
    return A.recall(g.edges, g.edges.join(live, "target_identity_id", "left_semi"), ["ty"], ["edge_id"]).withColumn("recall", F.round("recall", 6))


@query("a15_invariant_violations", "WITH e AS (SELECT 'src/m' || user_id || '.py' AS path, event_type FROM events), p AS (SELECT DISTINCT path FROM e WHERE event_type = 'purchase'), l AS (SELECT DISTINCT path FROM e WHERE event_type = 'signup'), " + W.removeprefix("WITH RECURSIVE ") + "SELECT 'patch_without_lease' AS \"check\", path AS key FROM p WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT 'lease_without_patch', path FROM l WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT DISTINCT 'speculative_without_patch', file_path FROM g_revisions WHERE status = 'Speculative' AND file_path NOT IN (SELECT path FROM p)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators.patches import invariant_violations

    e = table(spark, d, "events").select(F.concat(F.lit("src/m"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), "event_type")
    p, lease = (e.filter(F.col("event_type") == k).select("path").distinct() for k in ("purchase", "signup"))
    return invariant_violations(p, lease, graph(spark, d).revisions)
