"""The code graph as DataFrames, and resolution of identities and edges seen from a branch.

Everything is set-based: one plan answers for all identities or edges at once, and a caller narrows it by a filter that
Catalyst pushes down. Only the branch chain (at most 11 rows) and deletions' fork times are small enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scoring import DAY_MS, edge_confidence, source_weight
from brindle.workspace import Workspace

LIVE = ("Active", "Speculative")
LOCAL_EDGES = ("Calls", "Imports", "Uses", "Extends")
MAX_CHAIN = 11


@dataclass
class Policy:
    """Tunables that have an effect on results. Thresholds are checked on construction."""

    semantic: float = 0.2
    structural: float = 0.4
    edge_type: float = 0.2
    recency: float = 0.2
    min_path_confidence: float = 0.20
    half_life_days: int = 30
    max_hops: int = 3
    rename_min_confidence: float = 0.55
    body_similarity: float = 0.70
    name_proximity: float = 0.85
    rename_window_days: int = 30
    tombstone_retention_days: int = 90
    hwm: int = 5000
    lwm: int = 1000

    def __post_init__(self) -> None:
        if abs(self.semantic + self.structural + self.edge_type + self.recency - 1) > 1e-6:
            raise ValueError("the axis weights must sum to 1")
        for name in ("min_path_confidence", "rename_min_confidence", "body_similarity", "name_proximity"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be within [0, 1]")
        if self.lwm >= self.hwm:
            raise ValueError("the low-water mark must be below the high-water mark")
        if not 0 < self.tombstone_retention_days >= self.rename_window_days:
            raise ValueError("tombstones must be kept as long as the rename window")

    @classmethod
    def from_mapping(cls, raw: dict) -> Policy:
        """From a parsed configuration; unknown names are an error."""
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**raw)

    @classmethod
    def from_text(cls, text: str) -> Policy:
        """From a configuration of lines ``name: value``, or of such lines below headings; # begins a comment."""
        raw: dict[str, int | float] = {}
        for line in text.splitlines():
            name, colon, value = line.split("#")[0].partition(":")
            if colon and value.strip():
                number = float(value)
                raw[name.strip()] = int(number) if cls.__dataclass_fields__.get(name.strip()) and isinstance(getattr(cls, name.strip()), int) else number
        return cls.from_mapping(raw)

    def reloaded(self, text: str) -> Policy:
        """The policy of a changed configuration; this one if that is not valid."""
        try:
            return Policy.from_text(text)
        except (ValueError, TypeError):
            return self


@dataclass
class Graph:
    """branches, identities, revisions, edges, overrides and deletions, and what is derived from them."""

    branches: DataFrame
    identities: DataFrame
    revisions: DataFrame
    edges: DataFrame
    overrides: DataFrame
    deletions: DataFrame
    now_ms: int
    policy: Policy = field(default_factory=Policy)
    #: What each branch's identities resolve to, written once however many views of the branch there are.
    resolved: dict[int, DataFrame] = field(default_factory=dict, repr=False)
    #: Each branch's chain and fork time.
    chains: dict[int, tuple[list[int], int | None]] = field(default_factory=dict, repr=False)


def branch_chain(branches: DataFrame, branch_id: int) -> list[int]:
    """Ancestors of a branch nearest first, itself included; stops at a cycle and after 11 entries.

    One row is read at each step, by the key; the table of branches may be of any size.
    """
    out: list[int] = []
    at: int | None = branch_id
    while at is not None and at not in out and len(out) < MAX_CHAIN:
        out.append(at)
        row = branches.filter(F.col("branch_id") == at).select("parent_id").head()
        at = row[0] if row else None
    return out


class View:
    """A graph seen from one branch."""

    def __init__(self, g: Graph, branch_id: int):
        self.g, self.branch_id = g, branch_id
        if branch_id not in g.chains:
            row = g.branches.filter(F.col("branch_id") == branch_id).select("fork_ts_ms").head()
            g.chains[branch_id] = branch_chain(g.branches, branch_id), row[0] if row else None
        self.chain, self.fork_ts = g.chains[branch_id]

    def pos(self, branch: Column) -> Column:
        """Place of a branch in the chain, null if it is not on it."""
        out = F.lit(None).cast("int")
        for i, b in reversed(list(enumerate(self.chain))):
            out = F.when(branch == b, F.lit(i)).otherwise(out)
        return out

    def on_chain(self, df: DataFrame, branch: str = "branch_id") -> DataFrame:
        return df.filter(F.col(branch).isin(self.chain)).withColumn("pos", self.pos(F.col(branch)))

    def honored(self) -> DataFrame:
        """(identity_id, pos, honored): deletion markers on the chain; those planted on an ancestor after the fork do not count."""
        before = F.lit(True) if self.fork_ts is None else F.col("deleted_at_ms") <= self.fork_ts
        d = self.on_chain(self.g.deletions)
        return d.groupBy("identity_id", "pos").agg(F.max((F.col("pos") == 0) | before).alias("honored"))

    def primaries(self) -> DataFrame:
        """The live primary of each (branch, identity) on the chain: Active before Speculative, then the least id."""
        r = self.on_chain(self.g.revisions).filter(F.col("status").isin(*LIVE))
        return r.groupBy("identity_id", "pos").agg(F.min(F.struct((F.col("status") != "Active").alias("late"), "revision_id")).alias("p")).select("identity_id", "pos", F.col("p.revision_id").alias("revision_id"))

    def resolved(self) -> DataFrame:
        """(identity_id, revision_id): what each identity resolves to; identities that resolve to nothing have no row.

        Written once for a branch: every walk reads it several times, and it is no larger than the table of identities.
        """
        if self.branch_id not in self.g.resolved:
            self.g.resolved[self.branch_id] = Workspace(self.g.revisions.sparkSession, "view").write(self._resolve(), "resolved")
        return self.g.resolved[self.branch_id]

    def _resolve(self) -> DataFrame:
        r = self.on_chain(self.g.revisions)
        live = F.when(F.col("status").isin(*LIVE), F.struct((F.col("status") != "Active").alias("late"), F.col("revision_id")))
        tomb = F.when(F.col("status") == "Tombstone", F.col("revision_id"))
        have = r.groupBy("identity_id", "pos").agg(F.min(live).alias("live"), F.min(tomb).alias("tomb"))
        marks = self.honored()
        c = have.join(marks, ["identity_id", "pos"], "full")
        renamed = self.g.edges.filter("ty = 'RenamedFrom'").groupBy(F.col("source_revision_id").alias("tomb")).agg(F.min_by("target_identity_id", "edge_id").alias("successor"))
        c = c.join(renamed, "tomb", "left")
        said = (
            F.when(F.col("honored"), F.struct(F.lit("hidden").alias("what"), F.lit(None).cast("bigint").alias("to")))
            .when(F.col("live").isNotNull(), F.struct(F.lit("live").alias("what"), F.col("live.revision_id").alias("to")))
            .when(F.col("tomb").isNotNull() & F.col("honored").isNull(), F.when(F.col("successor").isNotNull(), F.struct(F.lit("renamed").alias("what"), F.col("successor").alias("to"))).otherwise(F.struct(F.lit("hidden").alias("what"), F.lit(None).cast("bigint").alias("to"))))
        )
        first = c.withColumn("said", said).filter("said is not null").groupBy("identity_id").agg(F.min_by("said", "pos").alias("s")).select("identity_id", "s.what", "s.to")
        direct = first.filter("what = 'live'").select("identity_id", F.col("to").alias("revision_id"))
        gone = marks.filter("honored").select(F.col("identity_id").alias("to")).distinct()
        nearest = self.primaries().groupBy(F.col("identity_id").alias("to")).agg(F.min_by("revision_id", "pos").alias("revision_id"))
        bridged = first.filter("what = 'renamed'").join(gone, "to", "left_anti").join(nearest, "to").select("identity_id", "revision_id")
        return direct.unionByName(bridged)

    def resolved_rows(self) -> DataFrame:
        """resolved() with the columns of the revision it leads to, prefixed t_."""
        r = self.g.revisions.select(F.col("revision_id"), F.col("identity_id").alias("t_identity_id"), F.col("branch_id").alias("t_branch_id"), F.col("status").alias("t_status"), F.col("qualified_name").alias("t_qualified_name"), F.col("file_path").alias("t_file_path"), F.col("kind").alias("t_kind"), F.col("ts_ms").alias("t_ts_ms"))
        return self.resolved().join(r, "revision_id")

    def effective_edges(self, ids: list[int] | None = None) -> DataFrame:
        """edges with eff: the target after the nearest override on the chain; with ids only those that lead to one of them.

        ids are few (a caller's own, or the hits of a search), so that they reach the scan of the edges as a filter.
        """
        over, edges = self.on_chain(self.g.overrides), self.g.edges
        if ids is not None:
            turned = edges.join(over.filter(F.col("new_target").isin(ids)).select("source_revision_id", "edge_id").distinct(), ["source_revision_id", "edge_id"], "left_semi")
            edges = edges.filter(F.col("target_identity_id").isin(ids)).unionByName(turned.filter(~F.col("target_identity_id").isin(ids)))
        o = over.groupBy("source_revision_id", "edge_id").agg(F.min_by("new_target", "pos").alias("new_target"))
        e = edges.join(o, ["source_revision_id", "edge_id"], "left").withColumn("eff", F.coalesce("new_target", "target_identity_id"))
        e = e if ids is None else e.filter(F.col("eff").isin(ids))
        return e.withColumn("edge_conf", edge_confidence(F.col("resolver"), F.col("last_validation_ms"), self.g.now_ms, self.g.policy.half_life_days))

    def edge_targets(self) -> DataFrame:
        """effective_edges() with target_revision_id, null if the effective target does not resolve."""
        t = self.resolved().select(F.col("identity_id").alias("eff"), F.col("revision_id").alias("target_revision_id"))
        return self.effective_edges().join(t, "eff", "left")

    def inbound(self, ids: list[int] | None = None) -> DataFrame:
        """(target_id, edge_id, ty, source_revision_id, source_identity_id, edge_conf, via): edges into each identity, or into ids.

        Edges of resolved sources whose effective target it is and which, or whose source has others that, point at it as
        stored; and edges that an override on the chain turns to it. Each edge once.
        """
        eff = self.effective_edges(ids).withColumnRenamed("eff", "target_id").withColumn("turned", ~F.col("target_id").eqNullSafe(F.col("target_identity_id")))
        if ids is not None:
            # Read five times below: written once, it is small, and known to be.
            eff = Workspace(self.g.revisions.sparkSession, "asked").write(eff, "edges")
        r = self.g.revisions.select("revision_id", "identity_id", "branch_id")
        cols = ["target_id", "edge_id", "ty", "source_revision_id", "source_identity_id", "edge_conf"]
        src = self.resolved().withColumnRenamed("identity_id", "sid").join(r.select("revision_id", F.col("identity_id").alias("source_identity_id")), "revision_id").withColumnRenamed("revision_id", "source_revision_id")
        own = src.filter("sid = source_identity_id").select("source_revision_id", "source_identity_id")
        # An edge of an identity's own revision that no override turns is itself the stored edge asked for. Only turned
        # edges, and those of revisions that stand in for a renamed identity alone, need a look at what is stored.
        straight = eff.filter("NOT turned").join(own, "source_revision_id").select(*cols, F.lit(0).alias("via"))
        bridged = src.filter("sid != source_identity_id").join(own, "source_revision_id", "left_anti")
        asked = eff.filter("turned").join(src, "source_revision_id").unionByName(eff.filter("NOT turned").join(bridged, "source_revision_id"))
        pairs = asked.select("sid", "target_id").distinct()
        stored = pairs.join(r.select(F.col("identity_id").alias("sid"), F.col("revision_id").alias("source_revision_id")), "sid").join(self.g.edges.select("source_revision_id", F.col("target_identity_id").alias("target_id")), ["source_revision_id", "target_id"]).select("sid", "target_id").distinct()
        one = asked.join(stored, ["sid", "target_id"], "left_semi").select(*cols, F.lit(0).alias("via"))
        gone = self.honored().filter("honored").select(F.col("identity_id").alias("source_identity_id")).distinct()
        over = self.on_chain(self.g.overrides).select("source_revision_id", "edge_id", F.col("new_target").alias("target_id")).distinct()
        over = over if ids is None else over.filter(F.col("target_id").isin(ids))
        here = r.filter(F.col("branch_id").isin(self.chain)).select(F.col("revision_id").alias("source_revision_id"), F.col("identity_id").alias("source_identity_id"))
        turned = over.join(eff, ["source_revision_id", "edge_id", "target_id"]).join(here, "source_revision_id").join(gone, "source_identity_id", "left_anti")
        back = turned.filter("NOT turned").join(own, "source_revision_id", "left_anti")
        two = turned.filter("turned").unionByName(back).select(*cols, F.lit(1).alias("via"))
        rest = one.unionByName(two).groupBy("target_id", "edge_id").agg(F.min(F.struct("via", "ty", "source_revision_id", "source_identity_id", "edge_conf")).alias("b")).select("target_id", "edge_id", "b.ty", "b.source_revision_id", "b.source_identity_id", "b.edge_conf", "b.via")
        return straight.unionByName(rest)

    def node_confidence(self, ids: list[int] | None = None) -> DataFrame:
        """(identity_id, conf): the greatest confidence of the edges into each identity that has any, or into ids."""
        return self.inbound(ids).groupBy(F.col("target_id").alias("identity_id")).agg(F.max("edge_conf").alias("conf"))

    def with_confidence(self, df: DataFrame, identity: str, ids: list[int] | None = None) -> DataFrame:
        """df with conf; identities without edges into them have the weight of an AST producer. ids: all of df's, if few."""
        c = self.node_confidence(ids).withColumnRenamed("identity_id", identity)
        return df.join(c, identity, "left").withColumn("conf", F.coalesce("conf", source_weight(F.lit("Ast"))))


def age_cutoff(now_ms: int, days: int) -> int:
    return now_ms - days * DAY_MS
