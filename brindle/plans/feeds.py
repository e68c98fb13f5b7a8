"""Queries of event feeds and of ingestion over the stored source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.ids import plain_id
from brindle.operators import ingest
from brindle.plans.fixture import SPARK_MS
from brindle.sources import parsers
from brindle.sources.tables import table
from brindle.sources.walk import language_of, normal_path
from brindle.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUIET_MS = 3_600_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def index_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit(0).alias("branch_id"), F.concat(F.lit("src/m"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.col("event_type").alias("kind"), F.expr(SPARK_MS.format(x="ts")).alias("ts_ms"), "event_id", "value")


_EVENTS = "WITH e AS (SELECT 'src/m' || user_id || '.py' AS path, event_type AS kind, epoch_us(ts) // 1000 AS ts_ms, event_id, value FROM events)"


@query("st1_debounced_events", _EVENTS + f", g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {QUIET_MS} THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts_ms, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts_ms, event_id) AS burst, row_number() OVER (PARTITION BY path ORDER BY ts_ms, event_id) AS k FROM g) SELECT path, arg_max(kind, k) AS kind, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS coalesced FROM b GROUP BY path, burst")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.debounced(index_events(spark, d), QUIET_MS).drop("branch_id")


@query("st3_changed_mtimes", _EVENTS + ", p AS (SELECT path, ts_ms, CAST(floor(value / 50) AS BIGINT) AS mtime, event_id FROM e), q AS (SELECT path, ts_ms, arg_max(mtime, event_id) AS mtime FROM p GROUP BY 1, 2), l AS (SELECT *, lag(mtime) OVER (PARTITION BY path ORDER BY ts_ms) AS b FROM q) SELECT path, ts_ms FROM l WHERE b IS NULL OR b <> mtime")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = index_events(spark, d).groupBy("path", "ts_ms").agg(F.max_by(F.floor(F.col("value") / 50), "event_id").alias("mtime"))
    return E.mtime_changes(p)


@query("st6_expired_patches", _EVENTS + ", n AS (SELECT max(ts_ms) AS now FROM e) SELECT event_id, path FROM e, n WHERE now - ts_ms > 86400000 AND kind = 'click'")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = index_events(spark, d)
    now = e.agg(F.max("ts_ms")).head()[0] or 0
    return E.expired(e.filter("kind = 'click'"), now, 86_400_000).select("event_id", "path")


@query("st2_routed_changes", _EVENTS + " SELECT c.path, CASE WHEN p.token THEN 'promote' WHEN p.path IS NOT NULL THEN 'revert' ELSE 'reindex' END AS action FROM (SELECT DISTINCT path FROM e WHERE kind = 'view') c LEFT JOIN (SELECT path, bool_or(value > 100) AS token FROM e WHERE kind = 'purchase' GROUP BY 1) p ON p.path = c.path")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = index_events(spark, d)
    return E.routed(e.filter("kind = 'view'"), e.filter("kind = 'purchase'").select("path", (F.col("value") > 100).alias("has_token")))


@query("v6_backlog_depth", "WITH e AS (SELECT epoch_us(ts) // 86400000000 AS day, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -3 ELSE 0 END) AS n FROM events GROUP BY 1) SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS depth FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _depths(spark, d).select((F.col("ts_ms") / 86_400_000).cast("bigint").alias("day"), "depth")


def _depths(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = index_events(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000))
    n = e.groupBy("day").agg(F.sum(F.when(F.col("kind") == "click", 1).when(F.col("kind") == "purchase", -3).otherwise(0)).alias("n"))
    # Days are few, whatever the number of events: one running sum over their totals.
    return n.select((F.col("day") * 86_400_000).alias("ts_ms"), F.sum("n").over(Window.orderBy("day")).alias("depth"))


@query("v7_degraded_states", """WITH RECURSIVE e AS (SELECT epoch_us(ts) // 86400000000 AS day, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -3 ELSE 0 END) AS n FROM events GROUP BY 1),
d AS (SELECT day * 86400000 AS ts_ms, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS depth, row_number() OVER (ORDER BY day) AS k FROM e),
s AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS depth, false AS degraded, CAST(NULL AS BIGINT) AS since UNION ALL
  SELECT d.k, d.ts_ms, d.depth, CASE WHEN d.depth >= 500 THEN true WHEN d.depth < 100 AND d.ts_ms - coalesce(s.since, d.ts_ms) >= 86400000 THEN false ELSE s.degraded END, CASE WHEN d.depth < 100 THEN coalesce(s.since, d.ts_ms) END FROM s JOIN d ON d.k = s.k + 1)
SELECT ts_ms, depth, degraded FROM s WHERE k > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.backlog_states(_depths(spark, d), 500, 100, 86_400_000)


# --- ingestion of the stored files


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """The latest content of each file by the revisions that stand for whole files."""
    r = table(spark, d, "revisions").filter("qualified_name = file_path").select(normal_path(F.col("file_path")).alias("path"), plain_id("body_hash", 64).alias("body_hash"), "ts_ms", "revision_id")
    last = r.filter("body_hash IS NOT NULL").groupBy("path").agg(F.max_by("body_hash", F.struct("ts_ms", "revision_id")).alias("body_hash"))
    b = table(spark, d, "bodies").filter("bytes IS NOT NULL").select("body_hash", "bytes").dropDuplicates(["body_hash"])
    text = F.regexp_replace(F.col("bytes").cast("string"), "\r\n?", "\n")
    files = last.join(b, "body_hash").select("path", language_of(F.col("path")).alias("language"), text.alias("content")).filter("language IS NOT NULL")
    # Parsing takes long for each byte: the partitions are not to be merged by size.
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


@query("n2_symbols")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ingest.symbols(parsers.facts(source_files(spark, d)))


@query("n2_edges")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ingest.edges(_facts(spark, d))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts written once: every way of resolving reads them."""
    from brindle.workspace import Workspace

    return Workspace(spark, "facts").write(parsers.facts(source_files(spark, d)), "facts")


@query("a11_ingest_report")
def _(spark: SparkSession, d: str) -> DataFrame:
    return parsers.facts(source_files(spark, d)).groupBy("language", "fact").agg(F.count(F.lit(1)).alias("n"))
