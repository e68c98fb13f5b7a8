"""Counts, integrity checks and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import LIVE
from brindle.sources.walk import kept

#: Extensions of files that can be indexed, and the most edges of a type a revision may have.
INDEXABLE = "py|ts|tsx|js|jsx|mjs|cjs|rs|go|java|c|h|cc|cpp|cxx|hpp|hh|hxx|cs"
CARDINALITY = {"RenamedFrom": 1}
MOST_EDGES = 10_000


def is_indexable(path: Column) -> Column:
    """Whether a file is indexed: a known extension, and nothing on its path that is never indexed."""
    return path.rlike(rf"\.({INDEXABLE})$") & kept(path)


def primaries(revisions: DataFrame) -> DataFrame:
    """(branch_id, identity_id, revision_id): Active before Speculative, then the least id."""
    r = revisions.filter(F.col("status").isin(*LIVE))
    return r.groupBy("branch_id", "identity_id").agg(F.min(F.struct((F.col("status") != "Active").alias("late"), "revision_id")).alias("p")).select("branch_id", "identity_id", F.col("p.revision_id").alias("revision_id"))


def index_counts(revisions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: active revisions, edges from them, distinct indexable files of them, all revisions and all edges."""
    active = revisions.filter("status = 'Active'")
    a = active.agg(F.count(F.lit(1)).alias("active_revisions"), F.countDistinct(F.when(is_indexable(F.col("file_path")), F.col("file_path"))).alias("indexable_files"))
    e = edges.join(active.select(F.col("revision_id").alias("source_revision_id")), "source_revision_id", "left_semi").agg(F.count(F.lit(1)).alias("active_edges"))
    t = revisions.agg(F.count(F.lit(1)).alias("revisions"))
    n = edges.agg(F.count(F.lit(1)).alias("edges"))
    return a.crossJoin(e).crossJoin(t).crossJoin(n)


def status_counts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("identity_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Active", "Speculative", "Tombstone", "Orphaned")])


def edge_cardinality(edges: DataFrame) -> DataFrame:
    """(source_revision_id, ty, n, violates): edges of each type by source, against the most allowed."""
    most = F.lit(MOST_EDGES)
    for ty, n in CARDINALITY.items():
        most = F.when(F.col("ty") == ty, n).otherwise(most)
    return edges.groupBy("source_revision_id", "ty").agg(F.count(F.lit(1)).alias("n")).withColumn("violates", F.col("n") > most)


def consistency(revisions: DataFrame, bindings: DataFrame, bodies: DataFrame) -> DataFrame:
    """(check, key): every violation of the six checks of the graph against its bindings and bodies.

    revisions: revision_id, identity_id, branch_id, status, body_hash; bindings: branch_id, identity_id, revision_id;
    bodies: body_hash. Keys are the binding's branch:identity, or the revision's id. A null body_hash needs no body.
    """
    pair = F.concat_ws(":", F.col("branch_id").cast("string"), F.col("identity_id").cast("string"))
    known = revisions.select("revision_id", "status")
    b = bindings.join(known, "revision_id", "left")
    active = revisions.filter("status = 'Active'")
    bound = bindings.select("branch_id", "identity_id").distinct()
    first = primaries(revisions).withColumnRenamed("revision_id", "primary_id")
    parts = {
        "dangling_binding": b.filter("status IS NULL").select(pair.alias("key")),
        "tombstone_bound": b.filter("status = 'Tombstone'").select(pair.alias("key")),
        "active_without_binding": active.join(bound, ["branch_id", "identity_id"], "left_anti").select(F.col("revision_id").cast("string").alias("key")),
        "duplicate_active": active.groupBy("branch_id", "identity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(pair.alias("key")),
        "missing_body": revisions.filter("body_hash IS NOT NULL").join(bodies.select("body_hash").distinct(), "body_hash", "left_anti").select(F.col("revision_id").cast("string").alias("key")),
        "primary_desync": active.select("branch_id", "identity_id").distinct().join(first, ["branch_id", "identity_id"]).join(bindings, ["branch_id", "identity_id"]).filter("primary_id != revision_id").select(pair.alias("key")),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("check"), "key")
        out = df if out is None else out.unionByName(df)
    return out


def merge_rollup(records: DataFrame) -> DataFrame:
    """(phase, n, avg_ms, p99_ms) of each phase of merge records with a map phase -> ms."""
    x = records.select(F.explode("phase_durations_ms").alias("phase", "ms"))
    # Distinct values with counts stand in for the sorted list: nearest rank needs no list of all values.
    c = x.groupBy("phase", "ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("phase").orderBy("ms")
    n = F.sum("c").over(Window.partitionBy("phase"))
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", n).withColumn("at", F.floor((F.col("n") - 1) * F.lit(0.99) + 0.5) + 1)
    return c.groupBy("phase").agg(F.max("n").alias("n"), (F.sum(F.col("ms") * F.col("c")) / F.max("n")).alias("avg_ms"), F.min(F.when(F.col("upto") >= F.col("at"), F.col("ms"))).alias("p99_ms"))


def merge_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("compensated").cast("int")).alias("compensation_rate"), F.avg(F.col("resumed_from_phase").isNotNull().cast("int")).alias("resume_rate"), F.avg("edges_regenerated").alias("avg_edges_regenerated"))


def slowest_merges(records: DataFrame, k: int = 5) -> DataFrame:
    total = F.aggregate(F.map_values("phase_durations_ms"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return records.select("merge_id", total.alias("total_ms")).orderBy(F.desc("total_ms"), "merge_id").limit(k)


def recent_rate(events: DataFrame, now_ms: int, window_ms: int = 60_000) -> DataFrame:
    """Drains and embedded items of the last minute: events with ts_ms, attempted, embedded."""
    e = events.filter((F.col("ts_ms") >= now_ms - window_ms) & (F.col("ts_ms") <= now_ms) & (F.col("attempted") > 0))
    return e.agg(F.count(F.lit(1)).alias("drains_per_minute"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded_per_minute"))


def delay_percentiles(values: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of value by key: counts of distinct values stand in for the sorted list of all."""
    c = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    all_, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy(value)
    c = c.withColumn("__n", F.sum("__c").over(all_)).withColumn("__upto", F.sum("__c").over(upto))
    at = {n: F.floor((F.col("__n") - 1) * F.lit(p) + 0.5) + 1 for n, p in ps.items()}
    return c.groupBy(key).agg(*[F.min(F.when(F.col("__upto") >= at[n], F.col(value))).alias(n) for n in ps])


def stale_workers(heartbeats: DataFrame, now_ms: int, expected_ms: int) -> DataFrame:
    """(worker, last_ms, stale): workers whose last tick is older than twice the expected interval."""
    return heartbeats.groupBy("worker").agg(F.max("ts_ms").alias("last_ms")).withColumn("stale", F.lit(now_ms) - F.col("last_ms") > 2 * expected_ms)


def majority_dimension(vectors: DataFrame) -> DataFrame:
    """The most frequent dimension; of equally frequent ones the least."""
    return vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1)


def seal_epochs(records: DataFrame, width_ms: int) -> DataFrame:
    """(epoch_id, n, summary) of audit records (ts_ms, session_id, action) in tumbling epochs."""
    e = records.withColumn("epoch_id", F.floor(F.col("ts_ms") / F.lit(width_ms)))
    return e.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.min("ts_ms").cast("string"), F.max("ts_ms").cast("string"), F.countDistinct("session_id").cast("string")).alias("summary"))


def digest(epoch: Column, prev: Column, summary: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", epoch.cast("string"), prev, summary), 256)


#: Epochs whose digests are chained one by one on the driver.
MOST_EPOCHS = 1_000_000


def chain_epochs(epochs: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds prev and digest, each epoch's digest covering the one before: a chain is sequential by its nature.

    Epochs are stretches of time, a million of which are millennia of days; more than ``most`` are an error.
    """
    rows, prev = [], ""
    import hashlib

    for r in epochs.orderBy("epoch_id").limit(most + 1).toLocalIterator():
        if len(rows) == most:
            raise ValueError(f"more than {most} epochs: seal longer ones")
        d = hashlib.sha256("\x1f".join((str(r["epoch_id"]), prev, r["summary"])).encode()).hexdigest()
        rows.append((r["epoch_id"], prev, d, r["summary"]))
        prev = d
    return epochs.sparkSession.createDataFrame(rows, "epoch_id bigint, prev string, digest string, summary string")


def verify_chain(epochs: DataFrame, block: int = 4096) -> DataFrame:
    """(ok, chain_length, broken_at_epoch): every epoch links to the digest before it and has the digest of its contents.

    Links are checked within blocks of epoch ids; of each block the last digest is carried to the next one that has rows.
    """
    e = epochs.withColumn("block", F.floor(F.col("epoch_id") / block))
    ends = e.groupBy("block").agg(F.max_by("digest", "epoch_id").alias("end"))
    # One row a block: as many as the epochs divided by the block's size.
    carried = ends.withColumn("carried", F.lag("end").over(Window.orderBy("block"))).drop("end")
    before = F.coalesce(F.lag("digest").over(Window.partitionBy("block").orderBy("epoch_id")), "carried", F.lit(""))
    bad = (F.col("prev") != before) | (F.col("digest") != digest(F.col("epoch_id"), F.col("prev"), F.col("summary")))
    return e.join(carried, "block").withColumn("bad", bad).agg((F.count_if("bad") == 0).alias("ok"), F.count(F.lit(1)).alias("chain_length"), F.min(F.when(F.col("bad"), F.col("epoch_id"))).alias("broken_at_epoch"))


#: Phases that are still in flight.
IN_FLIGHT = ("Pending", "GraphDone", "VectorDone")


def stale_revisions(wal: DataFrame, vector_sensitive: bool) -> DataFrame:
    """(revision_id, phase, stale) by the latest mutation in flight of each affected revision."""
    x = wal.filter(F.col("phase").isin(*IN_FLIGHT)).select(F.explode("affected_revisions").alias("revision_id"), "log_id", "phase")
    last = x.groupBy("revision_id").agg(F.max_by("phase", "log_id").alias("phase"))
    return last.withColumn("stale", (F.col("phase") == "Pending") | (F.lit(vector_sensitive) & (F.col("phase") == "GraphDone")))


def overlapping(wal: DataFrame) -> DataFrame:
    """(revision_id, first_log_id, log_id): mutations in flight on a revision that an earlier one already holds."""
    x = wal.filter(F.col("phase").isin(*IN_FLIGHT)).select(F.explode("affected_revisions").alias("revision_id"), "log_id").distinct()
    first = x.groupBy("revision_id").agg(F.min("log_id").alias("first_log_id"))
    return x.join(first, "revision_id").filter("log_id != first_log_id").select("revision_id", "first_log_id", "log_id")


def compacted_wal(wal: DataFrame, record_bytes: int, max_bytes: int, merging: bool = False) -> DataFrame:
    """What stays of the log when the oldest terminal rows are dropped until the size is within the limit; all while a merge runs.

    How many must go is one count; which are the oldest is a global rank over their ids, taken in ranges of ids so that no
    task sorts all of them.
    """
    drop = 0 if merging else max(0, wal.count() - max_bytes // record_bytes)
    if not drop:
        return wal
    terminal = wal.filter(F.col("phase").isin("Committed", "Failed"))
    buckets = terminal.groupBy(F.floor(F.col("log_id") / 65536).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    at = buckets.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("log_id"))
    ranked = terminal.select("log_id", F.floor(F.col("log_id") / 65536).alias("b")).withColumn("r", rank).join(at, "b").withColumn("r", F.col("r") + F.col("before"))
    return wal.join(ranked.filter(F.col("r") <= drop).select("log_id"), "log_id", "left_anti")


def replayed(wal: DataFrame) -> DataFrame:
    """(log_id, phase, action): what a restart does with each mutation, by its latest phase."""
    order = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for i, p in enumerate((*IN_FLIGHT, "Failed", "Committed"))])
    last = wal.groupBy("log_id").agg(F.max_by("phase", order).alias("phase"))
    act = F.when(F.col("phase") == "Pending", "fail").when(F.col("phase") == "GraphDone", "redo_vector").when(F.col("phase") == "VectorDone", "finalize").otherwise("none")
    return last.withColumn("action", act)


def health(violations: DataFrame, chain: DataFrame, workers: DataFrame) -> DataFrame:
    """One row: whether all is well, and the degraded modes, sorted and joined by commas.

    violations: rows of consistency(); chain: the row of verify_chain(); workers: rows of stale_workers().
    """
    v = violations.agg(F.count(F.lit(1)).alias("violations"))
    w = workers.agg(F.count_if("stale").alias("stale_workers"))
    j = v.crossJoin(w).crossJoin(chain.select(F.col("ok").alias("audit_ok")))
    modes = F.array_compact(F.array(F.when(~F.col("audit_ok"), "audit_chain_broken"), F.when(F.col("violations") > 0, "consistency_violations"), F.when(F.col("stale_workers") > 0, "worker_stale")))
    return j.select("violations", "stale_workers", "audit_ok", (F.size(modes) == 0).alias("healthy"), F.array_join(modes, ",").alias("degraded_modes"))


def recall(expected: DataFrame, found: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by..., expected, found, recall): of the distinct expected rows, how many are among those found."""
    f = found.select(*by, *key).distinct().withColumn("hit", F.lit(1))
    j = expected.select(*by, *key).distinct().join(f, [*by, *key], "left")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("expected"))
