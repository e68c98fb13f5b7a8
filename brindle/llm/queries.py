"""The queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.ids import plain_id
from brindle.llm.bpe import encode_corpus
from brindle.llm.handwritten import not_handwritten
from brindle.llm.leaks import leaks
from brindle.llm.neighbors import nearest, similar_pairs
from brindle.llm.readability import reading_levels
from brindle.llm.splitting import LIMIT, split_bodies
from brindle.sources.tables import table, table_of_texts

# --- p2: most similar vectors


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "vectors"), 0.9).drop("cosine")


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of every vector whose body_hash, as a number, is divisible by 50."""
    digits = [F.conv(F.substring("body_hash", 8 * i + 1, 8), 16, 10).cast("bigint") * pow(2, 32 * (7 - i), 50) for i in range(8)]
    by_50 = F.pmod(sum(digits[1:], digits[0]), F.lit(50)) == 0
    return nearest(table(spark, d, "vectors"), by_50)


# --- p4: splitting oversized items at natural boundaries


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "bodies").filter(F.octet_length("bytes") > LIMIT)
    cut = split_bodies(large).groupBy("body_hash").agg(F.max("piece_no").alias("last_no"), F.max(F.col("forced").cast("int")).alias("forced"))
    return cut.filter("last_no > 0").drop("last_no")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every body, each under its own chunk_id."""
    return split_bodies(table(spark, d, "bodies")).dropDuplicates(["chunk_id"])


# --- p5: generated, minified and vendored files


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "revisions")
    own = F.when(F.col("qualified_name") == F.col("file_path"), plain_id("body_hash", 64))
    return not_handwritten(r.select("file_path", own.alias("body_hash")), table(spark, d, "bodies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select("file_path")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files are not hand-written, by kind."""
    return _not_handwritten(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))


# --- p7: encoding the corpus


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table_of_texts(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


# --- p8: evaluation texts in the corpus


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table_of_texts(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"), max_edits=1).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 words of an item with at most two wrong characters, and how many are wrong."""
    return leaks(table_of_texts(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"), max_edits=2, exact=False)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, each with the number of documents that hold them."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# --- p9: reading level


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table_of_texts(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_samples"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each kind have which level."""
    levels = p9_found(spark, d).join(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_id")
    return levels.groupBy("doc_kind", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_nearest, p4_found, p4_pieces, p5_found, p5_kinds, p7_ids, p8_found, p8_near, p8_report, p9_found, p9_profile)}

SQL: dict[str, str] = {
    "p2_found": """
WITH v AS (SELECT DISTINCT lower(trim(model_id)) AS model_id, body_hash, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE trim(model_id) <> '' AND len(embedding) > 0),
sizes AS (SELECT model_id, len(e) AS n, count(*) AS c FROM v GROUP BY ALL), usual AS (SELECT model_id, arg_max(n, c) AS n FROM sizes GROUP BY 1),
u AS (SELECT v.model_id, body_hash, e FROM v JOIN usual USING (model_id) WHERE len(e) = n AND NOT isnan(list_sum(e)) AND isfinite(list_sum(e)) AND list_dot_product(e, e) > 0),
s AS (SELECT a.model_id, a.body_hash AS x, b.body_hash AS y, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.model_id = b.model_id AND a.body_hash <> b.body_hash),
best AS (SELECT *, row_number() OVER (PARTITION BY model_id, x ORDER BY round(c, 7) DESC, y) AS no FROM s)
SELECT model_id, least(x, y) AS body_hash_a, greatest(x, y) AS body_hash_b FROM best WHERE no <= 10 AND c >= 0.9 GROUP BY ALL HAVING count(*) = 2""",
    "p4_found": """
WITH large AS (SELECT DISTINCT body_hash, bytes FROM bodies WHERE octet_length(bytes) > 4096),
lines AS (SELECT body_hash, unnest(string_split_regex(regexp_replace(hex(bytes), '(..)', '\\1 ', 'g'), '0D 0A |0A |0D ')) AS line FROM large)
SELECT body_hash, CAST(max(CASE WHEN length(line) > 3 * 4096 THEN 1 ELSE 0 END) AS INT) AS forced FROM lines GROUP BY 1""",
}
