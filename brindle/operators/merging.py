"""Merging a branch into another as one run that can be repeated, resumed and taken back.

The state of a run is a row of the table ``merges`` in a versioned store, and every phase ends by publishing a version.
Nothing that readers see changes before the last phase, which publishes the merged tables and the end of the run at once;
a run that dies in between is carried on by calling it again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import merge as M
from brindle.sources.store import Store

MERGES = "merge_id string, source bigint, target bigint, phase string, strategy string, started_ms bigint, before bigint, conflicts bigint"
PROGRESS = "merge_id string, phase string, at_ms bigint, took_ms bigint"
OPEN = ("Classifying", "Conflicted", "Promoting", "Reconciling")


class Locked(RuntimeError):
    """Another merge holds the target branch."""


class Speculative(RuntimeError):
    """Paths that the merge would change have unconfirmed edits."""


@dataclass
class Merge:
    """What a run says: its phase, conflicts left, and the classes of the report."""

    merge_id: str
    phase: str
    conflicts: int
    report: dict[str, int]


def _now() -> int:
    return int(time.time() * 1000)


class Merges:
    """Merges over a store with the tables revisions (identity_id, revision_id, branch_id, status, file_path, body_hash,
    rename_source_id), bindings (branch_id, identity_id, revision_id), edges, overrides and deletions."""

    def __init__(self, store: Store, ttl_hours: float = 24.0):
        self.store, self.spark, self.ttl_ms = store, store.spark, int(ttl_hours * 3_600_000)

    def _table(self, name: str, fields: str, version: int | None = None) -> DataFrame:
        try:
            return self.store.read(name, version)
        except KeyError:
            return self.spark.createDataFrame([], fields)

    def runs(self) -> DataFrame:
        return self._table("merges", MERGES)

    def progress(self) -> DataFrame:
        """(merge_id, phase, at_ms, took_ms) of every phase that ended."""
        return self._table("merge_progress", PROGRESS)

    def _run(self, merge_id: str) -> dict | None:
        r = self.runs().filter(F.col("merge_id") == merge_id).head()
        return r.asDict() if r else None

    def _save(self, run: dict, began: int, phase: str, tables: dict[str, DataFrame] | None = None) -> dict:
        """Ends a phase: its tables, the run's row and the progress appear in one version."""
        head = self.store.current()[0]
        run = run | {"phase": phase}
        row = self.spark.createDataFrame([tuple(run[c.split()[0]] for c in MERGES.split(", "))], MERGES)
        done = self.spark.createDataFrame([(run["merge_id"], phase, _now(), _now() - began)], PROGRESS)
        merges = self.runs().filter(F.col("merge_id") != run["merge_id"]).unionByName(row)
        self.store.publish((tables or {}) | {"merges": merges, "merge_progress": self.progress().unionByName(done)}, expected=head)
        return run

    def _side(self, branch: int, deleted: bool, version: int | None = None) -> DataFrame:
        r = self.store.read("revisions", version)
        b = self.store.read("bindings", version).filter(F.col("branch_id") == branch).select("identity_id", "revision_id")
        if deleted:
            b = b.join(self.store.read("deletions", version).filter(F.col("branch_id") == branch).select("identity_id"), "identity_id", "left_anti")
        return b.join(r.select("revision_id", F.coalesce("body_hash", F.lit("")).alias("body_hash"), "rename_source_id"), "revision_id")

    def _begin(self, merge_id: str, source: int, target: int, base: str, speculative: DataFrame | None) -> dict:
        began = _now()
        other = self.runs().filter((F.col("target") == target) & F.col("phase").isin(*OPEN) & (F.col("merge_id") != merge_id)).head()
        if other:
            raise Locked(f"{other['merge_id']} holds branch {target}")
        before = self.store.current()[0]
        run = {"merge_id": merge_id, "source": source, "target": target, "phase": "", "strategy": None, "started_ms": began, "before": before, "conflicts": 0}
        b = self._side(target, False) if base == "target_snapshot" else self._fork_point(source)
        classified = M.classify(b, self._side(target, True), self._side(source, True))
        if speculative is not None:
            r = self.store.read("revisions")
            changed = classified.filter(~F.col("class").isin("Clean", "OursOnly", "OursNew")).select(F.explode(F.array_compact(F.array("ours_rev", "theirs_rev"))).alias("revision_id"))
            clash = r.join(changed.distinct(), "revision_id", "left_semi").select(F.col("file_path").alias("path")).join(speculative.select("path"), "path", "left_semi")
            hit = clash.select("path").distinct().orderBy("path").limit(10).collect()
            if hit:
                raise Speculative(", ".join(x[0] for x in hit))
        return self._save(run, began, "Classifying", {f"merge_{merge_id}": classified})

    def _fork_point(self, source: int) -> DataFrame:
        """What the source's parent had bound when the source was forked: the newest live revision up to that time."""
        br = self.store.read("branches").filter(F.col("branch_id") == source).head()
        r = self.store.read("revisions").filter((F.col("branch_id") == br["parent_id"]) & (F.col("ts_ms") <= (br["fork_ts_ms"] or 0)))
        at = r.groupBy("identity_id").agg(F.max_by("revision_id", F.struct("ts_ms", "revision_id")).alias("revision_id"))
        return at.join(r.select("revision_id", F.coalesce("body_hash", F.lit("")).alias("body_hash"), "rename_source_id"), "revision_id")

    def merge(self, merge_id: str, source: int, target: int, strategy: str | None = None, base: str = "target_snapshot", speculative: DataFrame | None = None, stop_after: str | None = None) -> Merge:
        """Merges source into target; called again with the same id it carries on, and a finished one is only reported.

        Without a strategy (ours, theirs) conflicts stop the run, which keeps holding the target until it is called with
        one or cancelled. speculative: paths with unconfirmed edits. stop_after ends after a phase, as a crash would.
        """
        run = self._run(merge_id) or self._begin(merge_id, source, target, base, speculative)
        classified = self.store.read(f"merge_{merge_id}")
        report = {r["label"]: r["n"] for r in M.merge_report(classified).collect()}
        told = lambda: Merge(merge_id, run["phase"], run["conflicts"], report)
        if run["phase"] in ("Committed", "Cancelled") or run["phase"] == stop_after:
            return told()
        if run["phase"] in ("Classifying", "Conflicted"):
            began = _now()
            n = sum(v for k, v in report.items() if k.startswith("conflict"))
            if n and strategy is None:
                run = self._save(run | {"conflicts": n}, began, "Conflicted") if run["phase"] != "Conflicted" else run
                return told()
            run = self._save(run | {"strategy": strategy, "conflicts": 0}, began, "Promoting", {f"promoted_{merge_id}": M.promote(classified, strategy or "theirs")})
            if stop_after == "Promoting":
                return told()
        promoted = self.store.read(f"promoted_{merge_id}")
        if run["phase"] == "Promoting":
            began = _now()
            mine = self.store.read("bindings").filter(F.col("branch_id") == run["target"])
            after = M.upsert_bindings(mine, promoted)
            own = self.store.read("overrides").filter(F.col("branch_id") == run["target"])
            touched = self.store.read("edges").join(promoted.filter("action = 'bind'").select(F.col("winner").alias("source_revision_id")), "source_revision_id", "left_semi")
            run = self._save(run, began, "Reconciling", {f"after_{merge_id}": after, f"edges_{merge_id}": M.reconcile_edges(touched, after, own)})
            if stop_after == "Reconciling":
                return told()
        run = self._commit(run, promoted)
        return told()

    def _commit(self, run: dict, promoted: DataFrame) -> dict:
        began, m, target = _now(), run["merge_id"], run["target"]
        after, kept = self.store.read(f"after_{m}"), self.store.read(f"edges_{m}")
        bindings = self.store.read("bindings").filter(F.col("branch_id") != target).unionByName(after.select(F.lit(target).cast("bigint").alias("branch_id"), "identity_id", "revision_id"))
        losers = promoted.filter("loser IS NOT NULL").select(F.col("loser").alias("revision_id"), F.lit(True).alias("lost"))
        r = self.store.read("revisions")
        revisions = r.join(losers, "revision_id", "left").withColumn("status", F.when(F.col("lost") & (F.col("status") == "Active"), "Orphaned").otherwise(F.col("status"))).select(*r.columns)
        d = self.store.read("deletions")
        gone = promoted.filter("action = 'unbind'").select(F.lit(target).cast("bigint").alias("branch_id"), "identity_id", F.lit(began).cast("bigint").alias("deleted_at_ms"))
        deletions = d.unionByName(gone.join(d.select("branch_id", "identity_id"), ["branch_id", "identity_id"], "left_anti"))
        edges = self.store.read("edges").join(kept.filter("NOT keep").select("edge_id"), "edge_id", "left_anti")
        o = self.store.read("overrides")
        renamed = promoted.filter("class = 'RenamedCandidate' AND winner IS NOT NULL").join(r.select(F.col("revision_id").alias("winner"), "rename_source_id"), "winner").filter("rename_source_id IS NOT NULL")
        turn = edges.join(renamed.select(F.col("rename_source_id").alias("target_identity_id"), F.col("identity_id").alias("new_target")), "target_identity_id").join(after.select(F.col("revision_id").alias("source_revision_id")), "source_revision_id", "left_semi")
        turned = turn.select(F.lit(target).cast("bigint").alias("branch_id"), "source_revision_id", "edge_id", "new_target")
        overrides = o.join(turned.select("branch_id", "source_revision_id", "edge_id"), ["branch_id", "source_revision_id", "edge_id"], "left_anti").select(*o.columns).unionByName(turned)
        return self._save(run, began, "Committed", {"bindings": bindings, "revisions": revisions, "deletions": deletions, "edges": edges, "overrides": overrides})

    def cancel(self, merge_id: str) -> Merge:
        """Takes a run back: an open one has changed nothing; of a committed one the target gets its tables of before.

        Only the target's rows go back, so that what others have done since stays.
        """
        run = self._run(merge_id)
        if run is None:
            raise KeyError(merge_id)
        began, tables = _now(), {}
        if run["phase"] == "Committed":
            for name in ("bindings", "deletions", "overrides"):
                now, was = self.store.read(name), self.store.read(name, run["before"])
                tables[name] = now.filter(F.col("branch_id") != run["target"]).unionByName(was.filter(F.col("branch_id") == run["target"]))
            was = self.store.read("edges", run["before"])
            dropped = self.store.read(f"edges_{merge_id}").filter("NOT keep").select("edge_id")
            tables["edges"] = self.store.read("edges").join(dropped, "edge_id", "left_anti").unionByName(was.join(dropped, "edge_id", "left_semi"))
            lost = self.store.read(f"promoted_{merge_id}").filter("loser IS NOT NULL").select(F.col("loser").alias("revision_id"))
            r = self.store.read("revisions")
            old = self.store.read("revisions", run["before"]).join(lost, "revision_id", "left_semi")
            tables["revisions"] = r.join(lost, "revision_id", "left_anti").select(*r.columns).unionByName(old.select(*r.columns))
        if run["phase"] != "Cancelled":
            run = self._save(run, began, "Cancelled", tables)
        return Merge(merge_id, run["phase"], run["conflicts"], {})

    def sweep(self, now_ms: int | None = None) -> list[str]:
        """Cancels the open runs that are older than their time to live; returns their ids."""
        old = [r["merge_id"] for r in self.runs().filter(F.col("phase").isin(*OPEN) & (F.lit(now_ms or _now()) - F.col("started_ms") > self.ttl_ms)).select("merge_id").collect()]
        for m in old:
            self.cancel(m)
        return old

