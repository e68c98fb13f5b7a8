"""Queries of vectors, hybrid search, contexts, time travel and lineage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.functions import snippets as N
from brindle.functions.snippets import backoff_ms, body_snippet, embed_text
from brindle.operators import quality as A
from brindle.operators import semantic as X
from brindle.operators.graph import Policy, View
from brindle.plans.fixture import graph, view_sql, with_sql
from brindle.plans.navigation import BRANCH
from brindle.plans.upkeep import MORE, bodies_of, full_revisions
from brindle.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NEEDLE = "machinery"
EPOCH_MS = 900_000_000_000
MODEL = "stub/hashed-bow"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").head()[0])


_TOP = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {score} AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20"


@query("v1_top_k", _TOP.format(score="least(greatest(list_dot_product(CAST(embedding AS DOUBLE[]), q), -1.0), 1.0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 20, "vec_id").withColumn("score", F.round("score", 6))


@query("v2_top_k_l2", _TOP.format(score="1.0 / (1.0 + list_distance(CAST(embedding AS DOUBLE[]), q))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 20, "vec_id", "l2inv").withColumn("score", F.round("score", 6))


@query("v3_restricted_top_k", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, least(greatest(list_dot_product(CAST(embedding AS DOUBLE[]), q), -1.0), 1.0) AS score FROM embeddings, q WHERE label = 1) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter("label = 1")
    return X.top_k(e, _query_vector(spark, d), 10, "vec_id").withColumn("score", F.round("score", 6))


@query("v4_vector_coverage", f"SELECT b.body_hash, CASE WHEN bool_or(m = '{MODEL}') THEN 'current' WHEN count(m) > 0 THEN 'other_model' ELSE 'missing' END AS state FROM (SELECT DISTINCT body_hash FROM bodies) b LEFT JOIN (SELECT body_hash, lower(trim(model_id)) AS m FROM vectors) v ON v.body_hash = b.body_hash GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.vector_coverage(table(spark, d, "bodies"), table(spark, d, "vectors"), MODEL)


@query("v5_embedding_jobs", f"SELECT c.body_hash, CASE WHEN c.body_hash IN (SELECT body_hash FROM vectors WHERE lower(trim(model_id)) = '{MODEL}' AND embedding IS NOT NULL) THEN 'cached' WHEN c.body_hash IN (SELECT body_hash FROM bodies WHERE bytes IS NOT NULL) THEN 'embed' ELSE 'requeue' END AS state FROM (SELECT DISTINCT body_hash FROM chunks WHERE body_hash IS NOT NULL) c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.embedding_jobs(table(spark, d, "chunks"), table(spark, d, "bodies"), table(spark, d, "vectors"), MODEL)


@query("a10_drain_report", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN c.body_hash IN (SELECT body_hash FROM vectors WHERE lower(trim(model_id)) = '{MODEL}' AND embedding IS NOT NULL) THEN 'cached' WHEN c.body_hash IN (SELECT body_hash FROM bodies WHERE bytes IS NOT NULL) THEN 'embed' ELSE 'requeue' END AS state FROM (SELECT DISTINCT body_hash FROM chunks WHERE body_hash IS NOT NULL) c) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["v5_embedding_jobs"](spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("f11_stub_embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.embedded(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("dim"), F.round(S.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query("f10_l2_normalize", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("u", S.l2_normalize(F.transform("embedding", lambda x: x * 3)))
    return e.select("vec_id", F.round(S.dot(F.col("u"), F.col("u")), 4).alias("norm"))


@query("q10_hybrid_search", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, least(greatest(list_dot_product(CAST(embedding AS DOUBLE[]), q), -1.0), 1.0) * 0.2 + (label + 1) / 4.0 * 0.4 AS score FROM embeddings, q WHERE label <> 3) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = e.select(F.col("vec_id").alias("id"), X.score_of(F.col("embedding"), _query_vector(spark, d)).alias("vector_score"), ((F.col("label") + 1) / 4.0).alias("structural_score"), (F.col("label") == 3).alias("speculative"))
    return X.hybrid_rank(c, Policy(), 10).select("id", F.round("score", 6).alias("score"))


@query("q9_semantic_search", with_sql(*view_sql(BRANCH), *MORE, "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)", "bv AS (SELECT b.body_hash, max(least(greatest(list_dot_product(CAST(e.embedding AS DOUBLE[]), q), -1.0), 1.0)) AS score FROM embeddings e JOIN g_bodies b ON b.doc_id = e.vec_id, qv GROUP BY 1)", "near AS (SELECT * FROM bv ORDER BY score DESC, body_hash LIMIT 200)", "hit AS (SELECT c.identity_id, max(n.score) AS vs FROM rc c JOIN g_bodies b USING (doc_id) JOIN near n USING (body_hash) GROUP BY 1)", "rk AS (SELECT s.revision_id, t.qualified_name, max(h.vs) AS vs FROM hit h JOIN res s USING (identity_id) JOIN g_revisions t ON t.revision_id = s.revision_id WHERE t.status IN ('Active', 'Speculative') GROUP BY 1, 2)") + f"SELECT revision_id, qualified_name, round(vs * 0.2 + CASE WHEN contains(qualified_name, '{NEEDLE}') THEN 1 + 1.0 / strlen(qualified_name) ELSE 0 END * 0.4, 6) AS score FROM rk ORDER BY vs * 0.2 + CASE WHEN contains(qualified_name, '{NEEDLE}') THEN 1 + 1.0 / strlen(qualified_name) ELSE 0 END * 0.4 DESC, revision_id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    bodies = bodies_of(spark, d)
    rb = v.g.revisions.join(bodies, "doc_id").select("revision_id", "body_hash")
    q = _query_vector(spark, d)
    vec = table(spark, d, "embeddings").withColumn("s", X.score_of(F.col("embedding"), q)).join(bodies, F.col("doc_id") == F.col("vec_id")).groupBy("body_hash").agg(F.max_by("embedding", "s").alias("embedding"))
    return X.semantic_search(v, rb, vec, q, NEEDLE).withColumn("score", F.round("score", 6))


_BUDGET = 64
# Bytes in hexadecimal: one whose first digit is 8 to B goes on with a character.
_BUILD = f"""WITH t AS (SELECT doc_id, text, (strlen(text) + 3) // 4 AS total, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, {4 * _BUDGET} - CASE WHEN substr(h, {8 * _BUDGET + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, {8 * _BUDGET - 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, {8 * _BUDGET - 3}, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS cut FROM t)
SELECT doc_id, CASE WHEN total > {_BUDGET} THEN decode(unhex(substr(h, 1, 2 * cut))) || chr(10) || '// ... [truncated, ' || (total - (cut + 3) // 4) || ' tokens omitted]' ELSE text END AS context, total > {_BUDGET} AS truncated, CASE WHEN total > {_BUDGET} THEN total - (cut + 3) // 4 ELSE 0 END AS omitted FROM c"""


@query("q11_build_context", _BUILD)
def _(spark: SparkSession, d: str) -> DataFrame:
    text, cut, omitted = X.truncated(F.col("text"), _BUDGET)
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("context"), cut.alias("truncated"), omitted.alias("omitted"))


# Spans over the texts: one line, or several.
_SPAN = "1 + doc_id % 5 AS a, 1 + doc_id % 5 + doc_id % 3 AS b"
_SNIP = f"""ln AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS lines, {_SPAN} FROM documents WHERE text IS NOT NULL),
rs AS (SELECT *, len(lines) AS n, lines[a + 1:len(lines)] AS rest, list_position(list_transform(lines[a + 1:len(lines)], lambda x: x <> '' AND NOT regexp_matches(x, '^[ \\t]')), true) AS stop FROM ln),
sn AS (SELECT doc_id, CASE WHEN a > n THEN '' WHEN b > a THEN array_to_string(lines[a:least(b, n)], chr(10)) ELSE array_to_string(list_concat(lines[a:a], CASE WHEN coalesce(stop, 0) > 0 THEN rest[1:stop - 1] ELSE rest END), chr(10)) END AS snippet FROM rs)"""


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (1 + F.col("doc_id") % 5).cast("int"), (1 + F.col("doc_id") % 5 + F.col("doc_id") % 3).cast("int")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", body_snippet(F.col("text"), a, b).alias("snippet"))


@query("f17_body_snippets", "WITH " + _SNIP + " SELECT doc_id, snippet FROM sn")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d).select("doc_id", "snippet")


@query("f27_embed_texts", with_sql(_SNIP) + "SELECT r.revision_id, md5(CASE WHEN r.kind = 'Stub' THEN snippet ELSE r.qualified_name || chr(10) || r.file_path || chr(10) || snippet END) AS text_md5 FROM g_revisions r JOIN sn USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of stubs the body alone."""
    r = graph(spark, d).revisions.join(_snippets(spark, d), "doc_id")
    name = F.when(F.col("kind") != "Stub", F.col("qualified_name"))
    return r.select("revision_id", F.md5(F.encode(embed_text(name, F.col("file_path"), F.col("snippet")), "UTF-8")).alias("text_md5"))


@query("f26_backoff", "SELECT p_partkey, CAST(least(250 * power(2, least(p_partkey % 16, 10)), 30000) AS BIGINT) AS wait_ms FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", backoff_ms(F.col("p_partkey") % 16).alias("wait_ms"))


@query("f19_stable_ids", with_sql() + "SELECT revision_id, " + ", ".join(f"md5(concat_ws(chr(31), {parts})) AS {n}" for n, parts in {"identity": "'id', file_path, qualified_name", "file": "'file', file_path", "slot": "'rev', CAST(branch_id AS VARCHAR), file_path, qualified_name", "content": "'revgen', CAST(branch_id AS VARCHAR), CAST(identity_id AS VARCHAR), CAST(doc_id AS VARCHAR)", "body": "'bh', file_path, qualified_name", "cas": "'cas', file_path, qualified_name", "chunk": "'chunk', CAST(identity_id AS VARCHAR), CAST(revision_id AS VARCHAR), '0'", "edge": "'edge', 'call', file_path, CAST(revision_id AS VARCHAR), qualified_name, '1', '2'"}.items()) + " FROM g_revisions")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, text = F.col, lambda n: F.col(n).cast("string")
    path, name = c("file_path"), c("qualified_name")
    return graph(spark, d).revisions.select(
        "revision_id", N.identity_id(path, name).alias("identity"), N.file_identity(path).alias("file"), N.revision_id(c("branch_id"), path, name).alias("slot"), N.content_revision_id(c("branch_id"), text("identity_id"), text("doc_id")).alias("content"),
        N.body_slot(path, name).alias("body"), N.allocation_key(path, name).alias("cas"), N.chunk_id(text("identity_id"), text("revision_id"), F.lit(0)).alias("chunk"), N.edge_id(F.lit("call"), path, text("revision_id"), name, F.lit(1), F.lit(2)).alias("edge"),
    )


@query("v8_vector_deletes", "WITH q AS (SELECT DISTINCT chunk_id, strpos('0123456789abcdef', left(chunk_id, 1)) - 1 AS f, 1000 * (strpos('0123456789abcdef', substr(chunk_id, 2, 1)) - 1) AS failed_at FROM chunks WHERE chunk_id IS NOT NULL), r AS (SELECT *, failed_at + least(250 * power(2, least(f, 10)), 30000) <= 12000 AS due, strpos('0123456789abcdef', substr(chunk_id, 3, 1)) > 8 AS again FROM q) SELECT chunk_id, CAST(f + CASE WHEN due THEN 1 ELSE 0 END AS INT) AS failures, CAST(CASE WHEN due THEN 12000 ELSE failed_at END AS BIGINT) AS failed_at_ms FROM r WHERE NOT due OR again")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A queue of all chunks: their digits tell how often and when each failed, and whether it does again."""
    digit = lambda i: F.conv(F.substring("chunk_id", i, 1), 16, 10).cast("int")
    q = table(spark, d, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id", digit(1).alias("failures"), (digit(2) * 1000).cast("bigint").alias("failed_at_ms"))
    return X.retried(q, q.filter(digit(3) >= 8), 12_000)


@query("q13_symbol_bodies", with_sql(*view_sql(BRANCH)) + "SELECT s.identity_id, md5(coalesce(nullif(d.text, ''), t.qualified_name || chr(10) || t.file_path || chr(10) || '// (body not available)' || chr(10))) AS body_md5, CASE WHEN nullif(d.text, '') IS NULL THEN 'stub' ELSE 'body' END AS source FROM res s JOIN g_revisions t ON t.revision_id = s.revision_id LEFT JOIN documents d USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    docs = table(spark, d, "documents").select("doc_id", "text")
    r = v.resolved().join(v.g.revisions.select("revision_id", "qualified_name", "file_path", "doc_id"), "revision_id").join(docs, "doc_id", "left")
    text, source = X.body_of(F.col("text"), F.lit(None).cast("string"), F.col("qualified_name"), F.col("file_path"))
    return r.select("identity_id", F.md5(F.encode(text, "UTF-8")).alias("body_md5"), source.alias("source"))


@query("q13_bodies_of_files", with_sql(*view_sql(BRANCH), _SNIP) + "SELECT s.identity_id, md5(CASE WHEN t.kind <> 'Function' OR snippet IS NULL OR snippet = '' THEN t.qualified_name || chr(10) || t.file_path || chr(10) || '// (body not available)' || chr(10) ELSE snippet END) AS body_md5, CASE WHEN t.kind <> 'Function' OR snippet IS NULL OR snippet = '' THEN 'stub' ELSE 'file' END AS source FROM res s JOIN g_revisions t ON t.revision_id = s.revision_id LEFT JOIN sn USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Where no body is stored: of functions the lines of the file, of all else a stub."""
    v = View(graph(spark, d), BRANCH)
    r = v.resolved().join(v.g.revisions.select("revision_id", "kind", "qualified_name", "file_path", "doc_id"), "revision_id").join(_snippets(spark, d), "doc_id", "left")
    part = F.when(F.col("kind") == "Function", F.col("snippet"))
    text, source = X.body_of(F.lit(None).cast("string"), part, F.col("qualified_name"), F.col("file_path"))
    return r.select("identity_id", F.md5(F.encode(text, "UTF-8")).alias("body_md5"), source.alias("source"))


# --- time travel: epoch k holds the primaries among the revisions up to a time


def _at(v: View, ms: int) -> DataFrame:
    return A.primaries(v.g.revisions.filter(F.col("ts_ms") <= ms)).filter(F.col("branch_id") == BRANCH)


_SNAP = f"snap AS (SELECT identity_id, revision_id FROM (SELECT identity_id, revision_id, row_number() OVER (PARTITION BY identity_id ORDER BY CASE status WHEN 'Active' THEN 0 ELSE 1 END, revision_id) AS n FROM g_revisions WHERE branch_id = {BRANCH} AND status IN ('Active', 'Speculative') AND ts_ms <= {EPOCH_MS}) WHERE n = 1)"
_OVER = "ovl AS (SELECT * FROM snap UNION ALL SELECT identity_id, revision_id FROM g_prim WHERE branch_id = 3 AND identity_id NOT IN (SELECT identity_id FROM snap))"


def _snapshot(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    ris = _at(v, EPOCH_MS).withColumn("epoch", F.lit(1))
    return X.snapshot_at(ris, A.primaries(v.g.revisions).filter(F.col("branch_id") == BRANCH), 1, strict)


@query("t2_snapshot", with_sql(*MORE, _SNAP, _OVER) + "SELECT identity_id, revision_id FROM ovl")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d, False)


@query("t2_snapshot_strict", with_sql(*MORE, _SNAP) + "SELECT identity_id, revision_id FROM snap")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d, True)


@query("t1_overlay_at_anchor", with_sql(*MORE, _SNAP, _OVER) + "SELECT identity_id, revision_id FROM ovl")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The overlay at the commit whose object id leads to log id 26 and so to the first epoch."""
    v = View(graph(spark, d), BRANCH)
    anchors = spark.createDataFrame([(BRANCH, 26, 1), (BRANCH, 27, 2), (0, 26, 2)], "branch_id bigint, log_id bigint, epoch int")
    commits = spark.createDataFrame([("AB" * 20, 26), ("cd" * 20, 27)], "oid string, log_id bigint")
    ris = _at(v, EPOCH_MS).withColumn("epoch", F.lit(1))
    return X.overlay_at(anchors, commits, "ab" * 20, BRANCH, ris, A.primaries(v.g.revisions).filter(F.col("branch_id") == BRANCH))


@query("t3_compacted_bindings", with_sql(*view_sql(BRANCH)) + f"SELECT CAST({BRANCH} AS BIGINT) AS branch_id, identity_id, revision_id FROM nearest WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.compacted(View(graph(spark, d), BRANCH))


@query("t3_bindings_on_chain", with_sql(*view_sql(BRANCH)) + "SELECT identity_id, revision_id FROM nearest WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    return v.primaries().groupBy("identity_id").agg(F.min_by("revision_id", "pos").alias("revision_id"))


@query("q2_find_symbol_at", with_sql(*view_sql(BRANCH), *MORE, _SNAP, _OVER) + f"SELECT o.identity_id, s.revision_id, t.qualified_name FROM ovl o JOIN res s USING (identity_id) JOIN g_revisions t ON t.revision_id = s.revision_id WHERE contains(t.qualified_name, '{NEEDLE}') ORDER BY t.qualified_name, s.revision_id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    hits = v.resolved_rows().join(_snapshot(spark, d, False).select("identity_id"), "identity_id", "left_semi").filter(F.contains("t_qualified_name", F.lit(NEEDLE)))
    return hits.select("identity_id", "revision_id", F.col("t_qualified_name").alias("qualified_name")).orderBy("qualified_name", "revision_id").limit(20)


@query("q12_build_context_at", with_sql(*MORE, _SNAP, _OVER) + f"SELECT o.identity_id, o.revision_id, (strlen(coalesce(nullif(d.text, ''), t.qualified_name || chr(10) || t.file_path || chr(10) || '// (body not available)' || chr(10))) + 3) // 4 AS n_tokens FROM ovl o JOIN g_revisions t ON t.revision_id = o.revision_id LEFT JOIN documents d USING (doc_id) WHERE contains(t.qualified_name, '{NEEDLE}')")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    r = _snapshot(spark, d, False).join(g.revisions.select("revision_id", "qualified_name", "file_path", "doc_id").filter(F.contains("qualified_name", F.lit(NEEDLE))), "revision_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left")
    text, _ = X.body_of(F.col("text"), F.lit(None).cast("string"), F.col("qualified_name"), F.col("file_path"))
    return r.select("identity_id", "revision_id", S.token_count(text).alias("n_tokens"))


_LINEAGE = with_sql(
    *view_sql(BRANCH), *MORE,
    "tb AS (SELECT identity_id, revision_id FROM (SELECT identity_id, revision_id, row_number() OVER (PARTITION BY identity_id ORDER BY pos, revision_id) AS n FROM rc WHERE status = 'Tombstone') WHERE n = 1)",
    "nx AS (SELECT f.revision_id, f.branch_id IN (SELECT branch_id FROM chain) AS onchain, coalesce(f.parent_revision_id, t.revision_id) AS nxt, CASE WHEN f.parent_revision_id IS NOT NULL THEN 'parent' ELSE 'rename' END AS how FROM g_full f LEFT JOIN tb t ON t.identity_id = f.rename_source_id)",
    "ln AS (SELECT s.revision_id AS head_id, 0 AS step, s.revision_id, 'start' AS link, [s.revision_id] AS seen FROM (SELECT DISTINCT revision_id FROM res) s UNION ALL SELECT l.head_id, l.step + 1, n.nxt, n.how, list_append(l.seen, n.nxt) FROM ln l JOIN nx n ON n.revision_id = l.revision_id JOIN nx m ON m.revision_id = n.nxt AND m.onchain WHERE NOT list_contains(l.seen, n.nxt) AND l.step < 31)",
)


@query("g2_lineage", _LINEAGE + "SELECT head_id, step, revision_id, link FROM ln")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = View(graph(spark, d), BRANCH)
    heads = v.resolved().select(F.col("revision_id").alias("head_id")).distinct()
    return X.lineage(full_revisions(v.g, spark, d), heads, v.chain)


@query("g3_merge_bases", _LINEAGE.replace("SELECT DISTINCT revision_id FROM res", "SELECT DISTINCT revision_id FROM live WHERE rn = 1 AND pos IN (0, 1)") + "SELECT o.identity_id AS pair_id, arg_min(b.revision_id, b.step) AS revision_id FROM live o JOIN live t ON t.identity_id = o.identity_id AND t.rn = 1 AND t.pos = 1 JOIN ln b ON b.head_id = t.revision_id JOIN ln a ON a.head_id = o.revision_id AND a.revision_id = b.revision_id WHERE o.rn = 1 AND o.pos = 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of each identity that the branch and its parent both have: the first revision of the parent's lineage in the branch's."""
    v = View(graph(spark, d), BRANCH)
    p = v.primaries().filter("pos IN (0, 1)").select(F.col("identity_id").alias("pair_id"), "pos", F.col("revision_id").alias("head_id"))
    steps = X.lineage(full_revisions(v.g, spark, d), p.select("head_id").distinct(), v.chain).join(p, "head_id").select("pair_id", "pos", "step", "revision_id")
    return X.merge_base(steps.filter("pos = 0"), steps.filter("pos = 1"))
