"""Queries of the graph's resolution and navigation, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import navigate as nav
from brindle.operators.graph import LOCAL_EDGES, View, branch_chain
from brindle.plans.fixture import graph, view_sql, with_sql

BRANCH = 3
NEEDLE = "machinery_1"
Q = dict[str, Callable[[SparkSession, str], DataFrame]]
QUERIES: Q = {}
SQL: dict[str, str] = {}
VIEW = with_sql(*view_sql(BRANCH))


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, d: f(View(graph(spark, d), BRANCH))
        SQL[name] = VIEW + sql
        return f

    return add


@query("j1_branch_chain", "SELECT branch_id, pos FROM chain")
def _(v: View) -> DataFrame:
    spark = v.g.branches.sparkSession
    return spark.createDataFrame([(b, i) for i, b in enumerate(branch_chain(v.g.branches, v.branch_id))], "branch_id bigint, pos int")


@query("j2_resolved", "SELECT identity_id, revision_id FROM res")
def _(v: View) -> DataFrame:
    return v.resolved()


@query("j3_deletions", "SELECT identity_id, pos, honored FROM marks")
def _(v: View) -> DataFrame:
    return v.honored()


@query("j4_effective_targets", "SELECT edge_id, eff FROM ee")
def _(v: View) -> DataFrame:
    return v.effective_edges().select("edge_id", "eff")


@query("j5_edge_targets", "SELECT edge_id, target_revision_id FROM et")
def _(v: View) -> DataFrame:
    return v.edge_targets().select("edge_id", "target_revision_id")


@query("j6_inbound", "SELECT target_id, edge_id, source_revision_id, via FROM inb")
def _(v: View) -> DataFrame:
    return v.inbound().select("target_id", "edge_id", "source_revision_id", "via")


@query("j7_node_confidence", "SELECT i.identity_id, round(coalesce(conf, 0.6), 6) AS conf FROM g_identities i LEFT JOIN nconf USING (identity_id)")
def _(v: View) -> DataFrame:
    return _round(v.with_confidence(v.g.identities.select("identity_id"), "identity_id").select("identity_id", "conf"), "conf")


@query("j8_rename_successors", "SELECT source_revision_id AS revision_id, succ AS successor FROM ren WHERE rn = 1")
def _(v: View) -> DataFrame:
    return v.g.edges.filter("ty = 'RenamedFrom'").groupBy(F.col("source_revision_id").alias("revision_id")).agg(F.min_by("target_identity_id", "edge_id").alias("successor"))


@query("j9_file_hubs", "SELECT file_path, arg_min(revision_id, CAST(pos AS BIGINT) * 1000000000 + revision_id) AS revision_id FROM rc WHERE qualified_name = file_path GROUP BY 1")
def _(v: View) -> DataFrame:
    return nav.file_hubs(v)


@query("j10_local_edges", "SELECT ty, count(*) AS n, count(DISTINCT source_revision_id) AS n_sources FROM g_edges WHERE ty IN ('Calls', 'Imports', 'Uses', 'Extends') GROUP BY 1")
def _(v: View) -> DataFrame:
    return v.g.edges.filter(F.col("ty").isin(*LOCAL_EDGES)).groupBy("ty").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_revision_id").alias("n_sources"))


@query("j11_raw_inbound", "SELECT e.edge_id, e.target_identity_id, r.identity_id AS source_identity_id FROM g_edges e JOIN g_revisions r ON r.revision_id = e.source_revision_id WHERE e.ty = 'Calls'")
def _(v: View) -> DataFrame:
    r = v.g.revisions.select(F.col("revision_id").alias("source_revision_id"), F.col("identity_id").alias("source_identity_id"))
    return v.g.edges.filter("ty = 'Calls'").join(r, "source_revision_id").select("edge_id", "target_identity_id", "source_identity_id")


_FIND = f"""SELECT t.identity_id, t.revision_id, t.qualified_name, t.file_path, round(coalesce(conf, 0.6), 6) AS conf,
  CASE WHEN t.qualified_name = t.file_path THEN {{hub}} {{rules}} END AS rank
FROM (SELECT DISTINCT s.revision_id FROM res s WHERE s.identity_id IN (SELECT identity_id FROM rc WHERE contains(qualified_name, '{NEEDLE}'))) x
JOIN g_revisions t ON t.revision_id = x.revision_id LEFT JOIN nconf c ON c.identity_id = t.identity_id WHERE contains(t.qualified_name, '{NEEDLE}')
ORDER BY rank, strlen(t.qualified_name), t.qualified_name, t.revision_id LIMIT 20"""


@query("q1_find_symbol", _FIND.format(hub=3, rules=f"WHEN split_part(t.qualified_name, '::', -1) = '{NEEDLE}' THEN 0 WHEN ends_with(t.qualified_name, '{NEEDLE}') THEN 1 ELSE 2"))
def _(v: View) -> DataFrame:
    return _round(nav.find_symbol(v, NEEDLE), "conf")


@query("q1_find_symbol_hub", _FIND.format(hub=0, rules=f"WHEN ends_with(t.qualified_name, '{NEEDLE}') THEN 1 ELSE 2"))
def _(v: View) -> DataFrame:
    return _round(nav.find_symbol(v, NEEDLE, prefer_hub=True), "conf")


@query("q3_go_to_definition", "SELECT revision_id, target_revision_id FROM (SELECT e.source_revision_id AS revision_id, e.target_revision_id, row_number() OVER (PARTITION BY e.source_revision_id ORDER BY CASE WHEN t.kind = 'File' THEN 1 ELSE 0 END, CASE e.ty WHEN 'Extends' THEN 0 ELSE 1 END, e.edge_id) AS n FROM et e JOIN rc s ON s.revision_id = e.source_revision_id JOIN g_revisions t ON t.revision_id = e.target_revision_id WHERE e.ty IN ('Extends', 'Imports')) WHERE n = 1")
def _(v: View) -> DataFrame:
    return nav.definitions(v)


_REF = "SELECT target_id, source_identity_id, source_revision_id, edge_id, round(edge_conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY via, edge_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY target_id, source_identity_id ORDER BY via, edge_id) AS m FROM inb {where}) WHERE m = 1) WHERE k <= 20"


@query("q4_find_references", _REF.format(where=""))
def _(v: View) -> DataFrame:
    return _round(nav.references(v), "conf")


@query("q5_get_callers", _REF.format(where="WHERE ty = 'Calls'"))
def _(v: View) -> DataFrame:
    return _round(nav.references(v, "Calls"), "conf")


#: The identity and the revisions asked for where a query answers for one.
ONE = 41
_CALLS = "WHERE ty = 'Calls'"


@query("q4_references_of_one", f"SELECT * FROM ({_REF.format(where='')}) WHERE target_id = {ONE}")
def _(v: View) -> DataFrame:
    return _round(nav.references(v, ids=[ONE]), "conf")


@query("q5_callers_of_one", f"SELECT * FROM ({_REF.format(where=_CALLS)}) WHERE target_id = {ONE}")
def _(v: View) -> DataFrame:
    return _round(nav.references(v, "Calls", ids=[ONE]), "conf")


@query("q6_get_dependencies", "SELECT d.revision_id, d.target_revision_id, d.edge_id, round(coalesce(conf, 0.6), 6) AS conf FROM (SELECT e.source_revision_id AS revision_id, e.target_revision_id, min(e.edge_id) AS edge_id FROM et e JOIN rc s ON s.revision_id = e.source_revision_id WHERE e.target_revision_id IS NOT NULL AND e.ty IN ('Calls', 'Imports', 'Uses', 'Extends') GROUP BY 1, 2) d JOIN g_revisions t ON t.revision_id = d.target_revision_id LEFT JOIN nconf c ON c.identity_id = t.identity_id")
def _(v: View) -> DataFrame:
    return _round(nav.dependencies(v), "conf")


@query("q6_dependencies_of_one", f"SELECT d.revision_id, d.target_revision_id, d.edge_id, round(coalesce(conf, 0.6), 6) AS conf FROM (SELECT e.source_revision_id AS revision_id, e.target_revision_id, min(e.edge_id) AS edge_id FROM et e JOIN rc s ON s.revision_id = e.source_revision_id WHERE s.identity_id = {ONE} AND e.target_revision_id IS NOT NULL AND e.ty IN ('Calls', 'Imports', 'Uses', 'Extends') GROUP BY 1, 2) d JOIN g_revisions t ON t.revision_id = d.target_revision_id LEFT JOIN nconf c ON c.identity_id = t.identity_id")
def _(v: View) -> DataFrame:
    mine = [r[0] for r in v.on_chain(v.g.revisions).filter(F.col("identity_id") == ONE).select("revision_id").collect()]
    return _round(nav.dependencies(v, revisions=mine), "conf")


@query("q7_file_imports", "SELECT h.file_path, e.target_revision_id, min(e.edge_id) AS edge_id FROM (SELECT file_path, arg_min(revision_id, CAST(pos AS BIGINT) * 1000000000 + revision_id) AS revision_id FROM rc WHERE qualified_name = file_path GROUP BY 1) h JOIN et e ON e.source_revision_id = h.revision_id WHERE e.ty = 'Imports' AND e.target_revision_id IS NOT NULL GROUP BY 1, 2")
def _(v: View) -> DataFrame:
    return nav.file_imports(v)


def _starts(v: View) -> DataFrame:
    return v.resolved().select(F.col("revision_id").alias("start_id")).distinct()


_FLOOR = "CASE {x} WHEN 'Lsp' THEN 0.4 WHEN 'Ast' THEN 0.25 WHEN 'Textual' THEN 0.1 ELSE 0.5 END"


def _level(k: int) -> list[str]:
    before = " UNION ALL ".join(f"SELECT start_id, revision_id FROM l{i}" for i in range(k))
    return [
        f"s{k} AS (SELECT l.start_id, l.ord, e.edge_id, e.target_revision_id, l.product * e.edge_conf AS product, CASE WHEN {_FLOOR.format(x='e.resolver')} < {_FLOOR.format(x='l.least')} THEN e.resolver ELSE l.least END AS least FROM l{k - 1} l JOIN g_revisions r ON r.revision_id = l.revision_id AND r.kind <> 'Stub' JOIN et e ON e.source_revision_id = l.revision_id AND e.ty IN ('Calls', 'Imports', 'Uses', 'Extends'))",
        f"t{k} AS (SELECT *, greatest({_FLOOR.format(x='least')}, product) AS conf FROM s{k})",
        f"f{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_id, target_revision_id ORDER BY ord, edge_id) AS n FROM t{k} WHERE conf >= 0.2 AND target_revision_id IS NOT NULL) WHERE n = 1)",
        f"l{k} AS (SELECT f.start_id, target_revision_id AS revision_id, conf, product, least, row_number() OVER (PARTITION BY f.start_id ORDER BY ord, edge_id) AS ord FROM f{k} f ANTI JOIN ({before}) b ON b.start_id = f.start_id AND b.revision_id = f.target_revision_id)",
    ]


_BFS = with_sql(
    *view_sql(BRANCH),
    "l0 AS (SELECT DISTINCT s.revision_id AS start_id, s.revision_id, coalesce(c.conf, 0.6) AS conf, 1.0::DOUBLE AS product, 'Ast' AS least, 0 AS ord FROM res s JOIN g_revisions r ON r.revision_id = s.revision_id LEFT JOIN nconf c ON c.identity_id = r.identity_id)",
    *_level(1), *_level(2),
)


@query("q8_expand_context", "")
def _(v: View) -> DataFrame:
    return _round(nav.expand_context(v, _starts(v), 2)[0], "conf")


SQL["q8_expand_context"] = _BFS + " UNION ALL ".join(f"SELECT start_id, revision_id, {k} AS level, round(conf, 6) AS conf FROM l{k}" for k in range(3))


@query("g4_pruned_neighbours", "")
def _(v: View) -> DataFrame:
    return nav.expand_context(v, _starts(v), 2)[1]


SQL["g4_pruned_neighbours"] = _BFS + "SELECT l0.start_id, CAST(coalesce(n, 0) AS BIGINT) AS pruned FROM l0 LEFT JOIN (SELECT start_id, count(*) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) WHERE conf < 0.2 OR target_revision_id IS NULL GROUP BY 1) USING (start_id)"


@query("q14_explain_context", "SELECT rc.revision_id, coalesce(o.outbound, 0) AS outbound, coalesce(n.inbound, 0) AS inbound, coalesce(o.unresolved, 0) AS unresolved, s.stale, s.orphaned FROM rc JOIN (SELECT identity_id, count(*) FILTER (WHERE status = 'Tombstone') AS stale, count(*) FILTER (WHERE status = 'Orphaned') AS orphaned FROM rc GROUP BY 1) s USING (identity_id) LEFT JOIN (SELECT source_revision_id, count(*) AS outbound, count(*) FILTER (WHERE ty IN ('Extends', 'Imports') AND target_revision_id IS NULL) AS unresolved FROM et GROUP BY 1) o ON o.source_revision_id = rc.revision_id LEFT JOIN (SELECT target_id, count(DISTINCT source_identity_id) AS inbound FROM inb GROUP BY 1) n ON n.target_id = rc.identity_id")
def _(v: View) -> DataFrame:
    return nav.explain_counts(v)


@query("q15_why_no_definition", "SELECT rc.revision_id, coalesce(o.c, 0) AS candidates, concat_ws(',', CASE WHEN o.c IS NULL THEN 'no_outbound_definition_edges' END, CASE WHEN o.u > 0 THEN 'target_identity_without_active_revision' END) AS reasons FROM rc LEFT JOIN (SELECT source_revision_id, count(*) AS c, count(*) FILTER (WHERE target_revision_id IS NULL) AS u FROM et WHERE ty IN ('Extends', 'Imports') GROUP BY 1) o ON o.source_revision_id = rc.revision_id")
def _(v: View) -> DataFrame:
    return nav.why_no_definition(v)


@query("q19_list_branches", f"SELECT name, branch_id, branch_id = {BRANCH} AS active FROM g_branches")
def _(v: View) -> DataFrame:
    return v.g.branches.select("name", "branch_id", (F.col("branch_id") == v.branch_id).alias("active")).orderBy("name")
