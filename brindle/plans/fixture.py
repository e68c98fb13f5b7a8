"""The graph derived from the general test tables, with the same SQL for both engines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.graph import Graph
from brindle.sources.tables import table
from brindle.workspace import Workspace

NOW_MS = 1_007_164_800_000
USED = ("region", "customer", "orders", "lineitem", "documents")


def relations(ms: str, t: dict[str, str]) -> dict[str, str]:
    """Name and SQL of each relation; ms is the milliseconds of {x} in the dialect, t the tables' and relations' names."""

    def at(x: str) -> str:
        return ms.format(x=x)

    return {
        "g_branches": f"SELECT CAST(r_regionkey AS BIGINT) AS branch_id, r_name AS name, CASE WHEN r_regionkey = 0 THEN NULL ELSE CAST(r_regionkey - 1 AS BIGINT) END AS parent_id, CASE WHEN r_regionkey = 0 THEN NULL ELSE 800000000000 + 40000000000 * CAST(r_regionkey AS BIGINT) END AS fork_ts_ms FROM {t['region']}",
        "g_identities": f"SELECT c_custkey AS identity_id, CASE WHEN c_custkey % 20 = 0 THEN 'File' WHEN c_custkey % 20 = 1 THEN 'Stub' WHEN c_custkey % 20 < 5 THEN 'Class' ELSE 'Function' END AS kind, concat('src/m', c_custkey - c_custkey % 20, '.py') AS file_path, CASE WHEN c_custkey % 20 = 0 THEN concat('src/m', c_custkey, '.py') ELSE concat('src/m', c_custkey - c_custkey % 20, '.py::', lower(c_mktsegment), '_', c_custkey % 50) END AS qualified_name FROM {t['customer']}",
        "g_revisions": f"SELECT o.o_orderkey AS revision_id, i.identity_id, o.o_orderkey % 5 AS branch_id, CASE o.o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Speculative' ELSE CASE WHEN o.o_orderkey % 11 = 0 THEN 'Orphaned' ELSE 'Tombstone' END END AS status, i.qualified_name, i.file_path, i.kind, {at('o.o_orderdate')} AS ts_ms, o.o_orderkey % (SELECT count(*) FROM {t['documents']}) AS doc_id FROM {t['orders']} o JOIN {t['g_identities']} i ON i.identity_id = o.o_custkey",
        "g_edges": f"SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST({at('l_shipdate')} AS VARCHAR(20)))) AS edge_id, CASE WHEN l_linenumber <= 3 THEN 'Calls' WHEN l_linenumber = 4 THEN 'Imports' WHEN l_linenumber = 5 THEN 'Uses' WHEN l_linenumber = 6 THEN 'Extends' ELSE 'TestOf' END AS ty, l_orderkey AS source_revision_id, l_partkey % (SELECT count(*) FROM {t['customer']}) AS target_identity_id, CASE l_returnflag WHEN 'A' THEN 'Ast' WHEN 'N' THEN 'Lsp' ELSE 'Textual' END AS resolver, CASE WHEN l_linestatus = 'F' THEN {at('l_shipdate')} ELSE 0 END AS last_validation_ms FROM {t['lineitem']} UNION ALL SELECT md5(concat_ws('|', 'rn', CAST(revision_id AS VARCHAR(20)))), 'RenamedFrom', revision_id, (identity_id + 1) % (SELECT count(*) FROM {t['customer']}), 'Ast', 0 FROM {t['g_revisions']} WHERE status = 'Tombstone' AND revision_id % 3 = 0",
        "g_overrides": f"SELECT r.branch_id, e.source_revision_id, e.edge_id, (e.target_identity_id + 7) % (SELECT count(*) FROM {t['customer']}) AS new_target FROM {t['g_edges']} e JOIN {t['g_revisions']} r ON r.revision_id = e.source_revision_id WHERE e.ty <> 'RenamedFrom' AND (e.source_revision_id * 31 + e.target_identity_id) % 97 = 0",
        "g_deletions": f"SELECT CAST(c_nationkey % 5 AS BIGINT) AS branch_id, c_custkey AS identity_id, 800000000000 + 200000000 * ((c_custkey * 37) % 1000) AS deleted_at_ms FROM {t['customer']} WHERE c_acctbal < 0",
    }


SPARK_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({x} AS TIMESTAMP_NTZ))"


#: Relations and graphs stored so far, by session and folder.
_RELATIONS: dict[tuple, dict[str, DataFrame]] = {}
_STORED: dict[tuple, Graph] = {}


def _changed(d: str) -> tuple[float, ...]:
    """When the folder's files were written, where that is a local folder."""
    at = d.removeprefix("file://")
    return tuple(sorted(e.stat().st_mtime for e in os.scandir(at))) if os.path.isdir(at) else ()


def _key(spark: SparkSession, d: str) -> tuple:
    # A folder whose files have changed is another one.
    return (spark.sparkContext.applicationId, d, _changed(d))


def relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A relation of the graph of a data folder, stored once a session together with those that it is made of, and no others."""
    have = _RELATIONS.setdefault(_key(spark, d), {})
    names = {n: "{" + n + "}" for n in (*USED, "g_identities", "g_revisions", "g_edges")}
    sql = relations(SPARK_MS, names)[name]
    if name not in have:
        of = {n: table(spark, d, n) if n in USED else relation(spark, d, n) for n, x in names.items() if x in sql}
        have[name] = Workspace(spark, "graph", tidy=True).write(spark.sql(sql, **of), name)
    return have[name]


def graph(spark: SparkSession, d: str) -> Graph:
    """The graph of a data folder: derived and stored as tables once a session, as the engine's own tables would be."""
    key = _key(spark, d)
    if key not in _STORED:
        _STORED[key] = Graph(*(relation(spark, d, f"g_{n}") for n in ("branches", "identities", "revisions", "edges", "overrides", "deletions")), now_ms=NOW_MS)
    return _STORED[key]


def with_sql(*more: str) -> str:
    """WITH clause of the relations for the SQL check, and further common table expressions."""
    names = {n: n for n in (*USED, "g_identities", "g_revisions", "g_edges")}
    return "WITH RECURSIVE " + ",\n".join([*(f"{n} AS MATERIALIZED ({s})" for n, s in relations("epoch_ms({x})", names).items()), *more]) + "\n"


CONF = f"least(greatest(CASE {{r}} WHEN 'Lsp' THEN 0.85 WHEN 'Ast' THEN 0.6 WHEN 'Textual' THEN 0.3 ELSE 1.0 END * CASE WHEN {{t}} <= 0 THEN 1.0 ELSE greatest(0.5, exp(-greatest({NOW_MS} - {{t}}, 0) / 2592000000.0)) END, 0.0), 1.0)"


def view_sql(b: int) -> list[str]:
    """The graph seen from branch b, as common table expressions."""
    conf = CONF.format(r="e.resolver", t="e.last_validation_ms")
    return [
        f"chain AS (SELECT CAST({b} AS BIGINT) AS branch_id, 0 AS pos UNION ALL SELECT br.parent_id, c.pos + 1 FROM chain c JOIN g_branches br ON br.branch_id = c.branch_id WHERE br.parent_id IS NOT NULL AND c.pos < 10)",
        f"fork AS (SELECT fork_ts_ms AS f FROM g_branches WHERE branch_id = {b})",
        "marks AS (SELECT d.identity_id, c.pos, bool_or(c.pos = 0 OR f IS NULL OR d.deleted_at_ms <= f) AS honored FROM g_deletions d JOIN chain c USING (branch_id) CROSS JOIN fork GROUP BY 1, 2)",
        "rc AS (SELECT r.*, c.pos FROM g_revisions r JOIN chain c USING (branch_id))",
        "live AS (SELECT identity_id, pos, revision_id, row_number() OVER (PARTITION BY identity_id, pos ORDER BY CASE status WHEN 'Active' THEN 0 ELSE 1 END, revision_id) AS rn FROM rc WHERE status IN ('Active', 'Speculative'))",
        "tomb AS (SELECT identity_id, pos, min(revision_id) AS revision_id FROM rc WHERE status = 'Tombstone' GROUP BY 1, 2)",
        "ren AS (SELECT source_revision_id, target_identity_id AS succ, row_number() OVER (PARTITION BY source_revision_id ORDER BY edge_id) AS rn FROM g_edges WHERE ty = 'RenamedFrom')",
        "pts AS (SELECT identity_id, pos FROM rc UNION SELECT identity_id, pos FROM marks)",
        "ev AS (SELECT p.identity_id, p.pos, l.revision_id AS live, t.revision_id AS tomb, m.honored, r.succ FROM pts p LEFT JOIN live l ON l.identity_id = p.identity_id AND l.pos = p.pos AND l.rn = 1 LEFT JOIN tomb t ON t.identity_id = p.identity_id AND t.pos = p.pos LEFT JOIN marks m ON m.identity_id = p.identity_id AND m.pos = p.pos LEFT JOIN ren r ON r.source_revision_id = t.revision_id AND r.rn = 1)",
        "ev2 AS (SELECT *, CASE WHEN honored THEN 'h' WHEN live IS NOT NULL THEN 'l' WHEN tomb IS NOT NULL AND honored IS NULL THEN CASE WHEN succ IS NULL THEN 'h' ELSE 'r' END END AS what FROM ev)",
        "ev3 AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY pos) AS k FROM ev2 WHERE what IS NOT NULL)",
        "nearest AS (SELECT identity_id, revision_id, row_number() OVER (PARTITION BY identity_id ORDER BY pos) AS k FROM live WHERE rn = 1)",
        "res AS (SELECT identity_id, live AS revision_id FROM ev3 WHERE k = 1 AND what = 'l' UNION ALL SELECT e.identity_id, f.revision_id FROM ev3 e JOIN nearest f ON f.identity_id = e.succ AND f.k = 1 WHERE e.k = 1 AND e.what = 'r' AND e.succ NOT IN (SELECT identity_id FROM marks WHERE honored))",
        "ov AS (SELECT source_revision_id, edge_id, arg_min(new_target, pos) AS nt FROM g_overrides JOIN chain USING (branch_id) GROUP BY 1, 2)",
        f"ee AS (SELECT e.*, coalesce(nt, target_identity_id) AS eff, {conf} AS edge_conf FROM g_edges e LEFT JOIN ov USING (source_revision_id, edge_id))",
        "et AS (SELECT ee.*, res.revision_id AS target_revision_id FROM ee LEFT JOIN res ON res.identity_id = ee.eff)",
        "inb0 AS (SELECT e.eff AS target_id, e.edge_id, e.ty, e.source_revision_id, r.identity_id AS source_identity_id, e.edge_conf, 0 AS via FROM res s JOIN ee e ON e.source_revision_id = s.revision_id JOIN g_revisions r ON r.revision_id = e.source_revision_id WHERE EXISTS (SELECT 1 FROM g_edges x JOIN g_revisions y ON y.revision_id = x.source_revision_id WHERE y.identity_id = s.identity_id AND x.target_identity_id = e.eff) UNION ALL SELECT e.eff, e.edge_id, e.ty, e.source_revision_id, r.identity_id, e.edge_conf, 1 FROM (SELECT DISTINCT source_revision_id, edge_id, new_target FROM g_overrides JOIN chain USING (branch_id)) o JOIN ee e ON e.source_revision_id = o.source_revision_id AND e.edge_id = o.edge_id AND e.eff = o.new_target JOIN g_revisions r ON r.revision_id = e.source_revision_id JOIN chain c ON c.branch_id = r.branch_id WHERE r.identity_id NOT IN (SELECT identity_id FROM marks WHERE honored))",
        "inb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, edge_id ORDER BY via, source_revision_id) AS n FROM inb0) WHERE n = 1)",
        "nconf AS (SELECT target_id AS identity_id, max(edge_conf) AS conf FROM inb GROUP BY 1)",
    ]
