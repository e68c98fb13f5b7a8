"""References to records that do not exist, were deleted, or came later.

Keys become integers first: the keys of parents and references are spread into buckets by a hash, and each
key's integer is its rank in the sorted bucket. Parents with consecutive ranks and the same state are compressed into
runs, and every referenced key is matched as of the preceding run start: a key beyond that run's end has no record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Far more buckets than tasks, whatever the keys look like; a bucket with few keys costs nothing.
BUCKETS = 1 << 16


def match_runs(parents: DataFrame, wanted: DataFrame, state: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Each wanted (space, key) with ``exists`` and the state of its parent, found by runs.

    ``parents`` (space, key, state...) and ``wanted`` (space, key, other columns...) have distinct (space, key). Keys are
    spread over buckets by a hash, so that keys with a common beginning share none, and sorted within each. No window holds
    more than a bucket of distinct keys, however often one of them is referred to. Null keys match nothing.
    """
    extra = [c for c in wanted.columns if c not in ("space", "key")]
    both = (
        parents.select("space", "key", F.lit(True).alias("is_parent"), *state, *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra], F.lit(False).alias("is_wanted"))
        .unionByName(wanted.select("space", "key", F.lit(False).alias("is_parent"), *[F.lit(None).cast(parents.schema[c].dataType).alias(c) for c in state], *extra, F.lit(True).alias("is_wanted")))
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    )
    w = Window.partitionBy("space", "bucket").orderBy("key")
    ranked = both.withColumn("rank", F.dense_rank().over(w))
    # Runs of one bucket: a parent opens a run unless the parent of the rank before has the same state.
    here = F.when(F.col("is_parent"), F.struct("rank", *state))
    before = F.last(here, ignorenulls=True).over(Window.partitionBy("space", "bucket").orderBy("rank", F.desc("is_parent")).rowsBetween(Window.unboundedPreceding, -1))
    same = F.coalesce(F.col("__before.rank") == F.col("rank") - 1, F.lit(False))
    for c in state:
        same = same & F.col(f"__before.{c}").eqNullSafe(F.col(c))
    upto = Window.partitionBy("space", "bucket").orderBy("rank", F.desc("is_parent")).rowsBetween(Window.unboundedPreceding, 0)
    opened = ranked.withColumn("__before", before).withColumn("run_start", F.when(F.col("is_parent") & ~same, F.col("rank")))
    run = F.struct(F.last("run_start", ignorenulls=True).over(upto).alias("start"), F.last(F.when(F.col("is_parent"), F.col("rank")), ignorenulls=True).over(upto).alias("end"), *[F.last(F.when(F.col("is_parent"), F.struct(c)), ignorenulls=True).over(upto)[c].alias(c) for c in state])
    matched = opened.withColumn("__run", run).filter("is_wanted")
    inside = F.coalesce(F.col("rank") <= F.col("__run.end"), F.lit(False))
    return matched.select("space", "key", *extra, inside.alias("exists"), *[F.when(inside, F.col(f"__run.{c}")).alias(c) for c in state])


def orphan_references(refs: DataFrame, parents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Distinct (src_table, month_utc, row_key, fate) of references whose record is missing, deleted or later.

    refs: src_table, row_key, space, key (plain, null if it refers to nothing), month (``YYYY-MM`` or null).
    parents: space, key, deleted (boolean), month (``YYYY-MM`` of the first arrival or null), any number of rows a key;
    a key is deleted only if ``deleted`` holds on all its rows, and its month is the least.

    A null key is no reference; a null month is ``unknown`` and never late; a null row_key, text of any length and
    repeated rows are kept as one distinct case each; empty tables give no rows. Extra columns are ignored.
    References are folded to distinct keys before anything is sorted, so one key that holds most references is one row
    in its bucket; the join back is one row a key on the right, which adaptive execution splits if the left is skewed.
    """
    known = parents.filter(F.col("key").isNotNull()).groupBy("space", "key").agg(F.min(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.min("month").alias("first_month"))
    refs = refs.filter(F.col("key").isNotNull())
    wanted = refs.groupBy("space", "key").agg(F.min("month").alias("least_month"))
    state = match_runs(known, wanted, ["deleted", "first_month"], buckets)
    bad = state.filter(~F.col("exists") | F.col("deleted") | (F.col("first_month") > F.col("least_month"))).select("space", "key", "exists", "deleted", "first_month")
    fate = F.when(~F.col("exists"), "missing").when(F.col("deleted"), "deleted").when(F.col("first_month") > F.col("month"), "late")
    return (
        refs.select("src_table", "row_key", "space", "key", "month")
        .join(bad, ["space", "key"])
        .select("src_table", F.coalesce("month", F.lit("unknown")).alias("month_utc"), "row_key", fate.alias("fate"))
        .filter(F.col("fate").isNotNull())
        .distinct()
    )
