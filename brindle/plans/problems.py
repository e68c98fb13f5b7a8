"""The queries p1, p3 and p6 over the tables of the code graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.ids import month_of_ms, month_utc, plain_id
from brindle.operators.changefeed import apply_changes
from brindle.operators.hierarchy import descendants, hierarchy
from brindle.operators.orphans import orphan_references
from brindle.sources.tables import table

# --- p1: references to records that do not exist


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    ri, chunks, revisions, bodies = (table(spark, d, t) for t in ("ri", "chunks", "revisions", "bodies"))
    rev, body = F.lit("revision"), F.lit("body")
    refs = (
        ri.select(F.lit("ri").alias("src_table"), F.concat_ws(":", F.col("branch_id").cast("string"), "identity_id").alias("row_key"), rev.alias("space"), plain_id("revision_id", 32).alias("key"), month_utc("bound_at").alias("month"))
        .unionByName(chunks.select(F.lit("chunks").alias("src_table"), F.col("chunk_id").alias("row_key"), body.alias("space"), plain_id("body_hash", 64).alias("key"), month_utc("created_at").alias("month")))
        .unionByName(revisions.select(F.lit("revisions").alias("src_table"), F.col("revision_id").alias("row_key"), body.alias("space"), plain_id("body_hash", 64).alias("key"), month_of_ms("ts_ms").alias("month")))
    )
    parents = revisions.select(rev.alias("space"), F.col("revision_id").alias("key"), (F.col("status") == "Tombstone").alias("deleted"), month_utc("ingested_at").alias("month")).unionByName(
        bodies.select(body.alias("space"), F.col("body_hash").alias("key"), F.col("removed_at").isNotNull().alias("deleted"), month_utc("stored_at").alias("month"))
    )
    return orphan_references(refs, parents)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How many cases each table and period has, by fate."""
    return _orphans(spark, d).groupBy("src_table", "month_utc", "fate").agg(F.count(F.lit(1)).alias("n_refs"))


# --- p3: parent-child links to full hierarchies


def _links(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "revisions")
    return r.select(F.unhex("revision_id").alias("id"), F.unhex(plain_id("parent_revision_id", 32)).alias("parent"))


def _hex(col: str):
    return F.lower(F.hex(col))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_links(spark, d)).select(_hex("id").alias("revision_id"), _hex("root").alias("root_revision_id"), F.col("depth").cast("int").alias("depth"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of each revision, from itself to its root, and its length; null on or below a ring."""
    h = hierarchy(_links(spark, d), with_path=True)
    return h.select(_hex("id").alias("revision_id"), F.col("depth").cast("int").alias("depth"), F.lower(F.array_join(F.transform("path", lambda x: F.hex(x)), "/")).alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (revision, descendant) with the number of links between them."""
    x = descendants(_links(spark, d))
    return x.select(_hex("ancestor").alias("revision_id"), _hex("id").alias("descendant_id"), F.col("hops").cast("int").alias("hops"))


# --- p6: applying a feed of inserts, updates and deletes

#: The spellings of the operations in the feed.
OPS = {"insert": ("insert", "i", "put"), "update": ("update", "u", "set"), "delete": ("delete", "d", "del")}
PAYLOAD = "op string, branch_id bigint, identity_id string, revision_id string, mutation struct<op string, key struct<branch_id bigint, identity_id string>, set struct<revision_id string>>"


def decoded_changes(wal: DataFrame) -> DataFrame:
    """(branch_id, identity_id, seq, op, value) of each log_id of which any row reached Committed.

    A payload is undamaged if the CRC-32 of its text, before or after base64, is the row's checksum; others are passed over.
    """
    raw = F.when(F.col("payload").startswith("b64:"), F.expr("try_to_binary(substring(payload, 5), 'base64')")).otherwise(F.col("payload").cast("binary"))
    said = F.lower(F.trim("payload_checksum"))
    sound = (F.lpad(F.lower(F.hex(F.crc32(F.col("payload").cast("binary")))), 8, "0") == said) | (F.lpad(F.lower(F.hex(F.crc32(raw))), 8, "0") == said)
    j = F.from_json(F.when(sound, raw.cast("string")), PAYLOAD)
    m = wal.select("log_id", (F.lower(F.trim("phase")) == "committed").alias("committed"), j.alias("j")).select(
        "log_id", "committed", F.lower(F.trim(F.coalesce("j.mutation.op", "j.op"))).alias("said"),
        F.coalesce("j.mutation.key.branch_id", "j.branch_id").alias("branch_id"), plain_id(F.coalesce("j.mutation.key.identity_id", "j.identity_id"), 32).alias("identity_id"),
        plain_id(F.coalesce("j.mutation.set.revision_id", "j.revision_id"), 32).alias("value"),
    )
    op = F.coalesce(*[F.when(F.col("said").isin(*names), F.lit(name)) for name, names in OPS.items()])
    change = F.when(op.isNotNull(), F.struct(op.alias("op"), "branch_id", "identity_id", "value"))
    one = m.groupBy("log_id").agg(F.max("committed").alias("committed"), F.max(change).alias("c")).filter("committed and c is not null")
    return one.select("c.branch_id", "c.identity_id", F.col("log_id").alias("seq"), "c.op", "c.value")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nothing = spark.createDataFrame([], "branch_id bigint, identity_id string, value string")
    out = apply_changes(decoded_changes(table(spark, d, "wal")), nothing, ["branch_id", "identity_id"])
    return out.withColumnRenamed("value", "revision_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_paths, p3_descendants, p6_found)}

_ID = "CASE WHEN regexp_matches({c}, '[1-9a-f]') THEN {c} END"


def _plain(col: str, n: int) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({col})), '^[a-z_]+:', ''), '^0x|[^0-9a-f]', '', 'g')"
    return _ID.format(c=f"right({bare}, {n})")


_MONTH = "strftime(epoch_ms(epoch_ms({c})), '%Y-%m')"
_P1 = f"""
WITH refs AS (
  SELECT 'ri' AS src_table, branch_id || ':' || identity_id AS row_key, 'r' AS space, {_plain("revision_id", 32)} AS key, {_MONTH.format(c="bound_at")} AS month FROM ri
  UNION SELECT 'chunks', chunk_id, 'b', {_plain("body_hash", 64)}, {_MONTH.format(c="created_at")} FROM chunks
  UNION SELECT 'revisions', revision_id, 'b', {_plain("body_hash", 64)}, strftime(epoch_ms(ts_ms), '%Y-%m') FROM revisions),
parents AS (
  SELECT 'r' AS space, revision_id AS key, bool_and(status = 'Tombstone') AS deleted, min({_MONTH.format(c="ingested_at")}) AS first_month FROM revisions GROUP BY ALL
  UNION ALL SELECT 'b', body_hash, bool_and(removed_at IS NOT NULL), min({_MONTH.format(c="stored_at")}) FROM bodies GROUP BY ALL),
fates AS (
  SELECT src_table, coalesce(month, 'unknown') AS month_utc, row_key,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN first_month > month THEN 'late' END AS fate
  FROM refs r LEFT JOIN parents p ON p.space = r.space AND p.key = r.key WHERE r.key IS NOT NULL)
"""
_P3 = f"""
WITH RECURSIVE nodes AS (SELECT revision_id AS id, max({_plain("parent_revision_id", 32)}) AS parent FROM revisions GROUP BY 1),
links AS (SELECT c.id, c.parent, p.id IS NOT NULL AS known FROM nodes c LEFT JOIN nodes p ON p.id = c.parent WHERE c.parent IS NOT NULL),
up AS (
  SELECT id AS start_id, id AS cur, 0 AS depth, [id] AS path FROM links
  UNION ALL SELECT u.start_id, l.parent, u.depth + 1, list_append(u.path, l.parent) FROM up u JOIN links l ON l.id = u.cur AND l.known
  WHERE NOT list_contains(u.path[1:-2], u.cur)),
stops AS (SELECT *, list_contains(path[1:-2], cur) AS ring FROM up),
ended AS (SELECT start_id, arg_max(cur, depth) AS cur, max(depth) AS depth, bool_or(ring) AS ring, arg_max(path, depth) AS path FROM stops GROUP BY 1)
"""
_P3_RING = "(SELECT min(x) FROM (SELECT unnest(path[list_position(path, cur):]) AS x))"
_P6 = f"""
WITH raw AS (SELECT log_id, lower(trim(phase)) = 'committed' AS committed, CASE WHEN payload LIKE 'b64:%' THEN
    CASE WHEN (length(payload) - 4) % 4 = 0 AND regexp_full_match(payload[5:], '[A-Za-z0-9+/]*=*') THEN decode(from_base64(payload[5:])) END ELSE payload END AS p FROM wal),
j AS (SELECT log_id, committed, CASE WHEN json_valid(p) THEN p END AS p FROM raw),
c AS (SELECT log_id, bool_or(committed) AS committed, max(p) AS p FROM j GROUP BY 1),
x AS (SELECT log_id, lower(coalesce(p->>'$.mutation.op', p->>'$.op')) AS said, CAST(coalesce(p->>'$.mutation.key.branch_id', p->>'$.branch_id') AS BIGINT) AS branch_id,
    coalesce(p->>'$.mutation.key.identity_id', p->>'$.identity_id') AS identity_id, coalesce(p->>'$.mutation.set.revision_id', p->>'$.revision_id') AS revision_id FROM c WHERE committed),
o AS (SELECT *, CASE WHEN said IN ('insert', 'i', 'put') THEN 'i' WHEN said IN ('delete', 'd', 'del') THEN 'd' ELSE 'u' END AS op FROM x),
b AS (SELECT branch_id, identity_id, max(log_id) AS at FROM o WHERE op <> 'u' GROUP BY ALL)
SELECT o.branch_id, o.identity_id, arg_max(o.revision_id, o.log_id) FILTER (WHERE o.revision_id IS NOT NULL) AS revision_id
FROM o JOIN b ON b.branch_id = o.branch_id AND b.identity_id = o.identity_id AND o.log_id >= b.at
GROUP BY o.branch_id, o.identity_id HAVING bool_or(o.op = 'i')
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT DISTINCT src_table, month_utc, row_key, fate FROM fates WHERE fate IS NOT NULL",
    "p1_report": _P1 + "SELECT src_table, month_utc, fate, count(DISTINCT row_key) AS n_refs FROM fates WHERE fate IS NOT NULL GROUP BY ALL",
    "p3_found": _P3 + f"SELECT start_id AS revision_id, CASE WHEN ring THEN {_P3_RING} ELSE cur END AS root_revision_id, CAST(CASE WHEN ring THEN -1 ELSE depth END AS INT) AS depth FROM ended",
    "p3_paths": _P3 + "SELECT start_id AS revision_id, CAST(CASE WHEN ring THEN -1 ELSE depth END AS INT) AS depth, CASE WHEN NOT ring THEN array_to_string(path, '/') END AS path FROM ended",
    "p3_descendants": _P3 + "SELECT u.cur AS revision_id, u.start_id AS descendant_id, CAST(u.depth AS INT) AS hops FROM stops u JOIN ended e ON e.start_id = u.start_id AND NOT e.ring WHERE u.depth > 0",
    "p6_found": _P6,
}
