"""A feed of inserts, updates and deletes applied to a table of one row a key, as a signed multiset.

Every effective change takes away the row as it was (-1) and adds the row as it is then (+1). The multiplicities, summed
with those of the base, leave exactly the rows that stand after the feed. What a row was before a change follows from the
changes of its key before it; these are cut into blocks of sequence numbers, so that a key which holds most of the feed
is many bounded windows whose carried-over states are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000
#: The block of the base, before all others.
BASE = -(1 << 62)


def _states(changes: DataFrame, part: list[str]) -> DataFrame:
    """Adds the state after each change as far as the block tells: __first_seg marks changes that lean on the state before it."""
    w = Window.partitionBy(*part).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    with_seg = changes.withColumn("__seg", F.sum(F.when(F.col("op") != "update", 1).otherwise(0)).over(upto))
    seg = Window.partitionBy(*part, "__seg").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.first(F.when(F.col("op") != "update", F.col("op") == "insert").otherwise(F.lit(None).cast("boolean"))).over(seg)
    value = F.last(F.when(F.col("op") != "delete", F.col("value")), ignorenulls=True).over(seg)
    return with_seg.withColumn("__bound", opening).withColumn("__value", value).withColumn("__first_seg", F.col("__seg") == 0)


def apply_changes(changes: DataFrame, base: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Rows (key..., value) that stand after ``changes`` are applied to ``base`` in the order of ``seq``.

    changes: key..., seq (bigint), op (insert, update, delete), value; one row a seq and key counts, repeated ones are
    dropped (of differing ones the greatest). base: key..., value, one row a key. An insert for a bound key replaces it;
    an update or delete for a key not bound at that point changes nothing; an update whose value is null leaves the value.
    Rows with a null seq, op or key column and with other ops are left out; empty tables are allowed; extra columns are
    ignored.
    """
    kind = base.schema["value"].dataType
    clean = changes.filter(F.col("op").isin("insert", "update", "delete") & F.col("seq").isNotNull())
    for k in key:
        clean = clean.filter(F.col(k).isNotNull())
    one = clean.groupBy(*key, "seq").agg(F.max(F.struct("op", F.col("value").cast(kind).alias("value"))).alias("c")).select(*key, "seq", "c.op", "c.value")
    # The base is a first change of each key.
    start = base.select(*key, F.lit(None).cast("bigint").alias("seq"), F.lit("insert").alias("op"), F.col("value"))
    feed = one.unionByName(start).withColumn("block", F.coalesce(F.floor(F.col("seq") / F.lit(block)), F.lit(BASE)))
    inner = _states(feed, [*key, "block"])

    # What a block does to the state before it: it opens anew (bound, value), or it only may set the value.
    w = Window.partitionBy(*key, "block").orderBy(F.desc("seq"))
    ends = inner.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*key, "block", F.when(~F.col("__first_seg"), F.col("__bound")).alias("opens"), F.col("__value").alias("sets"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    epoch = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # Blocks of one key are as many as its changes over the block size, at least: small rows, one for each block.
    numbered = ends.withColumn("__e", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(epoch))
    within = Window.partitionBy(*key, "__e").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    after = numbered.withColumn("__b", F.first("opens").over(within)).withColumn("__v", F.last("sets", ignorenulls=True).over(within))
    carry = after.select(*key, "block", F.last(F.coalesce("__b", F.lit(False))).over(before).alias("in_bound"), F.last(F.struct("__v")).over(before)["__v"].alias("in_value"))

    joined = inner.join(carry, [*key, "block"])
    bound = F.when(F.col("__first_seg"), F.coalesce("in_bound", F.lit(False))).otherwise(F.col("__bound"))
    value = F.when(F.col("__first_seg"), F.coalesce("__value", "in_value")).otherwise(F.col("__value"))
    state = joined.withColumn("now", F.struct(bound.alias("bound"), F.when(bound, value).alias("value")))
    w = Window.partitionBy(*key, "block").orderBy("seq")
    first = F.struct(F.coalesce("in_bound", F.lit(False)).alias("bound"), F.when(F.col("in_bound"), F.col("in_value")).alias("value"))
    state = state.withColumn("was", F.coalesce(F.lag("now").over(w), first))
    images = state.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*key, F.explode(F.array(F.struct(F.col("was.bound").alias("bound"), F.col("was.value").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("now.bound").alias("bound"), F.col("now.value").alias("value"), F.lit(1).alias("n")))).alias("i")).filter("i.bound").select(*key, "i.value", "i.n")
    return images.groupBy(*key, "value").agg(F.sum("n").alias("n")).filter("n > 0").select(*key, "value")
