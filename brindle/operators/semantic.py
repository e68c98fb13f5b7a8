"""Vector search, hybrid ranking, context assembly, time travel and lineage over the graph's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.functions.snippets import backoff_ms
from brindle.operators.graph import LIVE, Policy, View
from brindle.workspace import Workspace

DIM = 128


def embed(texts: pd.Series, dim: int = DIM) -> np.ndarray:
    """Offline vectors: hashed bags of words (64-bit FNV-1a of each lower-case word, modulo dim), of length 1."""
    import re

    dim = max(dim, 8)
    out = np.zeros((len(texts), dim), np.float32)
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        for w in re.split(r"[^\w]+", t or ""):
            if w:
                at = known.get(w)
                if at is None:
                    h = 0xCBF29CE484222325
                    for b in w.lower().encode():
                        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                    at = known[w] = h % dim
                out[i, at] += 1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embedded(df: DataFrame, text: str, into: str = "embedding", dim: int = DIM) -> DataFrame:
    """df with a vector of each text by the offline embedder; null and empty texts have the zero vector."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(embed(s, dim)), index=s.index)

    return df.withColumn(into, vectors(F.col(text)))


def score_of(embedding: Column, query: list[float], metric: str = "cosine") -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        return S.dot(embedding, q)
    gap = F.aggregate(F.zip_with(embedding, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(embedding) != len(query), 0.0).otherwise(1.0 / (1.0 + F.sqrt(gap)))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str, metric: str = "cosine") -> DataFrame:
    """The k rows most similar to one query vector: one scan and a bounded top-k, no shuffle of vectors."""
    return vectors.withColumn("score", score_of(F.col("embedding"), query, metric)).select(key, "score").orderBy(F.desc("score"), key).limit(k)


def hybrid_rank(candidates: DataFrame, policy: Policy, k: int) -> DataFrame:
    """The best max(k, 1) candidates (id, vector_score, structural_score, speculative), speculative ones left out."""
    score = F.col("vector_score") * policy.semantic + F.col("structural_score") * policy.structural
    return candidates.filter("NOT speculative").withColumn("score", score).orderBy(F.desc("score"), "id").limit(max(k, 1))


def semantic_search(v: View, revision_bodies: DataFrame, vectors: DataFrame, query: list[float], needle: str, limit: int = 20) -> DataFrame:
    """(revision_id, qualified_name, score): hits of a query vector among bodies, resolved on the branch and ranked with the name.

    revision_bodies: revision_id, body_hash; vectors: body_hash, embedding. The nearest max(10 limit, 50) bodies are taken;
    every identity that any revision on the chain ties to one of them is resolved.
    """
    near = top_k(vectors, query, max(10 * limit, 50), "body_hash")
    rb = v.on_chain(v.g.revisions).join(revision_bodies, "revision_id").select("identity_id", "body_hash")
    ids = rb.join(F.broadcast(near), "body_hash").groupBy("identity_id").agg(F.max("score").alias("vector_score"))
    hits = v.resolved_rows().filter(F.col("t_status").isin(*LIVE)).join(ids, "identity_id")
    hits = hits.groupBy("revision_id", "t_qualified_name").agg(F.max("vector_score").alias("vector_score"))
    c = hits.select(F.col("revision_id").alias("id"), "t_qualified_name", "vector_score", S.structural_score(F.lit(needle), F.col("t_qualified_name")).alias("structural_score"), F.lit(False).alias("speculative"))
    return hybrid_rank(c, v.g.policy, limit).select(F.col("id").alias("revision_id"), F.col("t_qualified_name").alias("qualified_name"), "score")


def truncated(text: Column, budget: int) -> tuple[Column, Column, Column]:
    """(text within the budget of tokens of 4 bytes, whether it was cut, tokens left out); cut between characters."""
    budget = max(budget, 1)
    total = S.token_count(text)
    raw = F.encode(text, "UTF-8")
    most = 4 * budget
    # Step back over the bytes of a character that the limit would split.
    cut = F.lit(most)
    for back in (3, 2, 1):
        lead = F.conv(F.hex(F.substring(raw, most - back + 1, 1)), 16, 10).cast("int")
        size = F.when(lead >= 240, 4).when(lead >= 224, 3).when(lead >= 192, 2).otherwise(1)
        cut = F.when(size > back, F.lit(most - back)).otherwise(cut)
    kept = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    over = total > budget
    omitted = F.when(over, total - S.token_count(kept)).otherwise(0)
    out = F.when(over, F.concat(kept, F.lit("\n// ... [truncated, "), omitted.cast("string"), F.lit(" tokens omitted]"))).otherwise(text)
    return out, over, omitted


def body_of(body: Column, file_slice: Column, qualified_name: Column, file_path: Column) -> tuple[Column, Column]:
    """(text, source): the stored body, else the file's slice, else a stub; empty texts fall through."""
    a, b = F.nullif(body, F.lit("")), F.nullif(file_slice, F.lit(""))
    stub = F.concat(qualified_name, F.lit("\n"), file_path, F.lit("\n// (body not available)\n"))
    return F.coalesce(a, b, stub), F.when(a.isNotNull(), "body").when(b.isNotNull(), "file").otherwise("stub")


# --- vector store


def vector_coverage(bodies: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(body_hash, state) of each body: current, other_model or missing."""
    m = vectors.select("body_hash", F.lower(F.trim("model_id")).alias("m")).filter("m IS NOT NULL").groupBy("body_hash").agg(F.max((F.col("m") == model).cast("int")).alias("is"))
    return bodies.select("body_hash").distinct().join(m, "body_hash", "left").select("body_hash", F.when(F.col("is") == 1, "current").when(F.col("is") == 0, "other_model").otherwise("missing").alias("state"))


def embedding_jobs(chunks: DataFrame, bodies: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(body_hash, state): what an embedding worker does with each queued body once: cached, requeue (no bytes) or embed."""
    jobs = chunks.filter("body_hash IS NOT NULL").select("body_hash").distinct()
    have = bodies.filter("bytes IS NOT NULL").select("body_hash").distinct().withColumn("has", F.lit(True))
    done = vectors.filter((F.lower(F.trim("model_id")) == model) & F.col("embedding").isNotNull()).select("body_hash").distinct().withColumn("done", F.lit(True))
    j = jobs.join(have, "body_hash", "left").join(done, "body_hash", "left")
    return j.select("body_hash", F.when(F.col("done"), "cached").when(F.col("has"), "embed").otherwise("requeue").alias("state"))


# --- time travel and lineage


def snapshot_at(ris: DataFrame, live: DataFrame, epoch: int, strict: bool = False) -> DataFrame:
    """(identity_id, revision_id): a branch's bindings at an epoch; unless strict, live bindings fill in what it lacks."""
    s = ris.filter(F.col("epoch") == epoch).select("identity_id", "revision_id")
    return s if strict else s.unionByName(live.select("identity_id", "revision_id").join(s.select("identity_id"), "identity_id", "left_anti"))


def parse_anchor(text: str) -> tuple[str, str | int]:
    """('git', oid) for 40 hex digits, else ('log', id): all-hex text is read as hex, so that '10' is 16."""
    t = text.strip().lower().removeprefix("0x")
    if len(t) == 40 and all(c in "0123456789abcdef" for c in t):
        return "git", t
    if t and all(c in "0123456789abcdef" for c in t):
        return "log", int(t, 16)
    if t.isdigit():
        return "log", int(t)
    raise ValueError(f"no commit anchor: {text!r}")


def overlay_at(anchors: DataFrame, commits: DataFrame, anchor: str, branch_id: int, ris: DataFrame, live: DataFrame, strict: bool = False) -> DataFrame:
    """(identity_id, revision_id) of a branch at a commit anchor; no rows if nothing was recorded under exactly that anchor.

    anchors: branch_id, log_id, epoch; commits: oid, log_id; ris: epoch, identity_id, revision_id of the branch's snapshots;
    live: its bindings now. An object id leads to its log id, that to an epoch, and that to a snapshot.
    """
    what, key = parse_anchor(anchor)
    logs = commits.filter(F.lower("oid") == key).select("log_id") if what == "git" else anchors.filter(F.col("log_id") == key).select("log_id")
    epoch = anchors.filter(F.col("branch_id") == branch_id).join(logs.distinct(), "log_id", "left_semi").agg(F.max("epoch")).head()[0]
    return live.select("identity_id", "revision_id").limit(0) if epoch is None else snapshot_at(ris, live, epoch, strict)


def compacted(v: View) -> DataFrame:
    """(branch_id, identity_id, revision_id): the bindings that a branch sees along its chain as its own, so that its chain can end there."""
    nearest = v.primaries().groupBy("identity_id").agg(F.min_by("revision_id", "pos").alias("revision_id"))
    return nearest.select(F.lit(v.branch_id).cast("bigint").alias("branch_id"), "identity_id", "revision_id")


def retried(queue: DataFrame, failed: DataFrame, now_ms: int, cap_ms: int = 30_000) -> DataFrame:
    """(chunk_id, failures, failed_at_ms): the queue of vectors to delete after a round.

    Those are due whose wait after their last failure is over. A due one that is not among the failed is done and leaves;
    one that failed again waits longer; the others stay. Repeated chunks are one.
    """
    q = queue.groupBy("chunk_id").agg(F.max("failures").alias("failures"), F.max("failed_at_ms").alias("failed_at_ms"))
    due = F.col("failed_at_ms").isNull() | (F.col("failed_at_ms") + backoff_ms(F.col("failures"), cap_ms) <= now_ms)
    j = q.join(failed.select("chunk_id", F.lit(True).alias("again")).distinct(), "chunk_id", "left").withColumn("due", due).filter("NOT due OR again")
    return j.select("chunk_id", (F.col("failures") + F.col("due").cast("int")).alias("failures"), F.when(F.col("due"), F.lit(now_ms).cast("bigint")).otherwise(F.col("failed_at_ms")).alias("failed_at_ms"))


def lineage(revisions: DataFrame, heads: DataFrame, chain: list[int], max_depth: int = 32, include_tombstones: bool = True, follow_renames: bool = True) -> DataFrame:
    """(head_id, step, revision_id, link): the revisions behind each head, newest first.

    revisions: revision_id, identity_id, branch_id, status, parent_revision_id, rename_source_id. A step goes to the parent
    if its row exists, else to the tombstone of the rename's source on the nearest branch; it stops off the chain, at a
    tombstone unless included, at a revision seen before, and after max_depth steps. All heads advance together, and each
    level is written: as many joins as the longest lineage has steps.
    """
    ws = Workspace(revisions.sparkSession, "lineage")
    pos = F.array_position(F.array(*[F.lit(b).cast("bigint") for b in chain]), F.col("branch_id"))
    r = revisions.withColumn("pos", pos)
    tomb = r.filter((F.col("status") == "Tombstone") & (F.col("pos") > 0)).groupBy(F.col("identity_id").alias("rename_source_id")).agg(F.min(F.struct("pos", "revision_id")).alias("t")).select("rename_source_id", F.col("t.revision_id").alias("renamed"))
    known = r.select(F.col("revision_id").alias("parent_revision_id"), F.col("revision_id").alias("parent"))
    nxt = r.join(known, "parent_revision_id", "left").join(tomb, "rename_source_id", "left")
    to = F.coalesce("parent", "renamed") if follow_renames else F.col("parent")
    nxt = ws.write(nxt.select("revision_id", "status", (F.col("pos") > 0).alias("on"), to.alias("next"), F.when(F.col("parent").isNotNull(), "parent").otherwise("rename").alias("how")), "next")
    cur = heads.select("head_id", F.col("head_id").alias("revision_id"), F.lit("start").alias("link"), F.array("head_id").alias("seen"))
    out = None
    for k in range(max_depth):
        keep = F.col("on") & (F.lit(k == 0 or include_tombstones) | (F.col("status") != "Tombstone"))
        step = ws.write(cur.join(nxt, "revision_id").filter(keep), f"step{k}")
        if step.isEmpty():
            break
        row = step.select("head_id", F.lit(k).alias("step"), "revision_id", "link")
        out = row if out is None else out.unionByName(row)
        cur = step.filter("next IS NOT NULL AND NOT array_contains(seen, next)").select("head_id", F.col("next").alias("revision_id"), F.col("how").alias("link"), F.concat("seen", F.array("next")).alias("seen"))
    return out if out is not None else cur.select("head_id", F.lit(0).alias("step"), "revision_id", "link").limit(0)


def merge_base(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(pair_id, revision_id): the first revision of their lineage that ours holds too. Both: pair_id, step, revision_id."""
    both = theirs.join(ours.select("pair_id", "revision_id").distinct(), ["pair_id", "revision_id"], "left_semi")
    return both.groupBy("pair_id").agg(F.min_by("revision_id", "step").alias("revision_id"))
