"""The most similar vectors of every vector, by vantage-point trees.

A vantage-point tree splits points by their distance to one of them; by the triangle inequality a side can be skipped if
the query is farther from the border than the radius searched. Here that radius is multiplied by a factor: 1 is exact,
less skips more and may miss some. Vectors are unit vectors and distances chords, so a cosine c is the distance
sqrt(2 - 2c).

Every vector is first sent to shards by the upper levels of a tree, fitted on a bounded sample. Shards that are expected
to be too large get a tree of their own, fitted on the executors, and so on down. A router travels with the rows of its
shard, so that nothing broadcast grows with the table. For a similarity join a vector nearer to a border than half the
relaxed radius goes to both sides, so that any two near enough meet in some shard. For a search, queries look in their own
shard first; what they find bounds how far across borders they must look in others.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
#: The first router is fitted on about so many vectors of a model, chosen by a hash of their ids; a shard has about so many rows.
SAMPLE, SHARD = 8_000, 1_500
#: Shards expected to have more than so many times that are split again, by a router fitted on about so many of their rows.
LARGE, REFIT = 4, 3_000
#: Rows of one shard that one task routes.
STRETCH = 1_000_000
#: Factors: of the join's router, of the join's search within shards, and of both for given queries.
ROUTE_FACTOR, JOIN_FACTOR, SEARCH_FACTOR = 0.15, 0.15, 0.3
#: Rows a shard where queries are given: the fewer shards, the less often a query must look across a border.
SEARCH_SHARD = 4_000
_LOW = (1 << 32) - 1


def chord(cosine: np.ndarray | float) -> np.ndarray | float:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.asarray(cosine, np.float64))).astype(np.float32)


@dataclass
class Node:
    vantage: np.ndarray | None = None
    border: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    leaf: int = -1


def _split(x: np.ndarray, margin: float, rng: np.random.RandomState, tries: int) -> tuple[np.ndarray, float] | None:
    """The vantage point and border with the fewest points near the border, neither side having less than a quarter."""
    best = None
    for v in x[rng.choice(len(x), min(tries, len(x)), replace=False)]:
        d = np.sort(chord(x @ v))
        lo, hi = len(d) // 4, len(d) - len(d) // 4 - 1
        at = np.unique(np.linspace(lo, hi, 17).astype(int))
        border = (d[at] + d[np.minimum(at + 1, len(d) - 1)]) / 2
        near = np.searchsorted(d, border + margin, "right") - np.searchsorted(d, border - margin, "left")
        for b, n, i in zip(border, near, at):
            if d[0] <= b < d[-1]:
                cost = (n / len(d), abs(i / len(d) - 0.5), b)
                if best is None or cost < best[0]:
                    best = (cost, v, float(b))
    return None if best is None else best[1:]


def build(x: np.ndarray, leaf: int, margin: float = 0.0, tries: int = 3, seed: int = 7) -> Node:
    """A tree over the rows of x (unit vectors) whose leaves have about ``leaf`` rows or cannot be split."""
    rng = np.random.RandomState(seed)
    root = Node(rows=np.arange(len(x)))
    todo, leaves = [root], 0
    while todo:
        node = todo.pop()
        cut = _split(x[node.rows], margin, rng, tries) if len(node.rows) > leaf else None
        if cut is not None:
            inside = chord(x[node.rows] @ cut[0]) <= cut[1]
        if cut is None or inside.all() or not inside.any():
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.vantage, node.border = cut
        node.inner, node.outer = Node(rows=node.rows[inside]), Node(rows=node.rows[~inside])
        node.rows = node.rows[:0]
        todo += [node.outer, node.inner]
    return root


def route(node: Node, x: np.ndarray, margin: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x) of all leaves that the rows reach, each going to both sides of a border within its margin."""
    rows = np.arange(len(x)) if rows is None else rows
    if not len(rows):
        return
    if node.vantage is None:
        yield node.leaf, rows
        return
    d = chord(x[rows] @ node.vantage)
    yield from route(node.inner, x, margin, rows[d <= node.border + margin[rows]])
    yield from route(node.outer, x, margin, rows[d > node.border - margin[rows]])


def leaf_counts(tree: Node) -> np.ndarray:
    """The rows of each leaf, which then are forgotten: a router is sent around without them."""
    counts, todo = {}, [tree]
    while todo:
        node = todo.pop()
        if node.vantage is None:
            counts[node.leaf] = len(node.rows)
        else:
            todo += [node.inner, node.outer]
        node.rows = node.rows[:0]
    return np.array([counts[i] for i in range(len(counts))], float)


class Searcher:
    """Batched search of one tree: all queries descend together, and leaves are compared by matrix products.

    Rows are in the order of their ids. Cosines count rounded to ``digits``, and equal ones rank by the smaller row: both
    are one integer, so that which rows are kept never depends on chance.
    """

    def __init__(self, x: np.ndarray, k: int, factor: float, floor: float = -2.0, leaf: int = LEAF, digits: int = 7):
        self.x, self.k, self.factor, self.scale = np.asarray(x, np.float64), k, factor, 10.0**digits
        self.floor = int(np.floor(floor * self.scale)) << 32
        self.tree = build(self.x, leaf)

    def search(self, q: np.ndarray, own: np.ndarray | None = None, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows) of the k most similar rows above the floor for each query, best first; row -1 fills up.

        own: each query's own row, which is left out. floors: each query's own floor, a cosine that may be reached.
        """
        self.q, self.own = np.asarray(q, np.float64), own
        floor = np.full(len(q), self.floor, np.int64) if floors is None else np.rint(floors * self.scale).astype(np.int64) << 32
        self.best = np.repeat(floor[:, None], self.k, axis=1)
        self._down(self.tree, np.arange(len(q)))
        best = -np.sort(-self.best, axis=1)
        return (best >> 32) / self.scale, np.where(best > floor[:, None], _LOW - (best & _LOW), -1)

    def _down(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.vantage is None:
            # A node that cannot be split is read in the order of ids: who has k equals of smaller ids is done with it.
            for c in range(0, len(node.rows), 2 * LEAF):
                cand = node.rows[c : c + 2 * LEAF]
                top = (int(self.scale) << 32) | (_LOW - int(cand[0]))
                rows = rows[self.best[rows].min(1) < top]
                for i in range(0, len(rows), 4096):
                    self._leaf(cand, rows[i : i + 4096])
            return
        d = chord(self.q[rows] @ node.vantage)
        inside = d <= node.border
        self._down(node.inner, rows[inside])
        self._down(node.outer, rows[~inside])
        # Half a unit of the last digit, as a row of a smaller id may tie with the worst one kept.
        reach = chord(((self.best[rows].min(1) >> 32) - 0.5) / self.scale) * self.factor + 1e-6
        self._down(node.outer, rows[inside & (node.border - d <= reach)])
        self._down(node.inner, rows[~inside & (d - node.border <= reach)])

    def _leaf(self, cand: np.ndarray, rows: np.ndarray) -> None:
        s = (np.rint(np.minimum(self.q[rows] @ self.x[cand].T, 1.0) * self.scale).astype(np.int64) << 32) | (_LOW - cand)
        if self.own is not None:
            s[self.own[rows][:, None] == cand[None, :]] = np.iinfo(np.int64).min
        hot = np.flatnonzero(s.max(1) > self.best[rows].min(1))
        if not len(hot):
            return
        both = np.concatenate((self.best[rows[hot]], s[hot]), 1)
        self.best[rows[hot]] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]


def unit_rows(embeddings: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (of double precision) of the lists that have the length, and which rows those are; zero and not finite ones are left out."""
    lengths = np.asarray(embeddings.value_lengths().fill_null(-1))
    ok = np.flatnonzero(lengths == length)
    flat = embeddings.take(pa.array(ok)).flatten()
    x = np.asarray(flat.fill_null(np.nan), np.float64).reshape(len(ok), length)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        return x[good] / norm[good, None], ok[good]


def _usable(vectors: DataFrame, is_query: Column) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Rows (model_id, body_hash, embedding, asks, h1, h2) with a model, an id and a vector, and each model's (length, rows)."""
    v = vectors.select(F.lower(F.trim("model_id")).alias("model_id"), "body_hash", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter("model_id is not null and model_id != '' and body_hash is not null and size(embedding) > 0")
    sizes = v.groupBy("model_id", F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    w = sizes.groupBy("model_id").agg(F.max_by("n", F.struct("rows", "n")).alias("n"), F.max("rows").alias("rows"))
    hashed = v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    return hashed, {r["model_id"]: (r["n"], r["rows"]) for r in w.collect()}


def _sample(v: DataFrame, models: dict[str, tuple[int, int]], size: int) -> dict[str, np.ndarray]:
    """About ``size`` vectors of each model, by a hash of their ids; of smaller models all."""
    share = F.create_map(*[x for m, (_, n) in models.items() for x in (F.lit(m), F.lit(min(1.0, size / n)))])
    rows = v.filter(F.pmod(F.xxhash64("body_hash", F.lit(11)), F.lit(1_000_000)) < share[F.col("model_id")] * 1_000_000).toArrow()
    out = {}
    for m, (n, _) in models.items():
        mine = rows.filter(pa.compute.equal(rows["model_id"], m))["embedding"].combine_chunks()
        out[m] = np.unique(unit_rows(mine, n)[0].astype(np.float32), axis=0) if len(mine) else np.zeros((0, n), np.float32)
    return out


class Shards:
    """The distinct vectors of a table, in shards.

    ``rows`` has shard, expected, model_id, h1, h2, id, asks, reach, vector: the least ids of each vector (h1, h2) that any
    task met, in every shard that the vector reaches. ``expected`` is about how many rows the shard has.
    """

    def __init__(self, v: DataFrame, models: dict[str, tuple[int, int]], margin: float, sample: int, shard_rows: int):
        from brindle.workspace import Workspace

        spark = v.sparkSession
        self.ws = Workspace(spark, "neighbors")
        self.shard_rows, self.margin, self.large = shard_rows, margin, LARGE * shard_rows
        # Single-precision vectors travel as they are; of them, the double-precision units are made anew.
        self.wide = v.schema["embedding"].dataType.elementType.typeName() != "float"
        self.kind = pa.float64() if self.wide else pa.float32()
        self.fields = f"shard bigint, expected double, model_id string, h1 bigint, h2 bigint, id string, asks boolean, reach double, vector array<{'double' if self.wide else 'float'}>"
        routers, first, deep = {}, 0, False
        for m, x in sorted(_sample(v, models, sample).items()):
            n, rows = models[m]
            tree = build(x, max(8, int(shard_rows * len(x) / max(1, rows))), margin, tries=24) if len(x) else Node(leaf=0)
            counts = leaf_counts(tree)
            expected = counts / max(1, len(x)) * rows
            deep |= bool((expected > self.large).any())
            routers[m] = (n, first, tree, expected)
            first += len(counts)
        self.sent = spark.sparkContext.broadcast(routers)
        self.levels: list[DataFrame] = []
        rows = v.withColumns({"id": F.col("body_hash"), "reach": F.lit(margin)})
        self.rows = self.top(rows)
        if deep:
            self._split_large()

    def top(self, v: DataFrame) -> DataFrame:
        """Rows (model_id, h1, h2, id, asks, reach, embedding) in the shards of the first routers that they reach."""
        sent, kind = self.sent, self.kind

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The least id so far of each vector, and whether it asked; a smaller one, or the first to ask, is sent after it.
            seen: dict[tuple[int, int, str], tuple[str, bool]] = {}
            for b in batches:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                names, h1, h2 = np.asarray(col["model_id"].to_pylist(), object), np.asarray(col["h1"]), np.asarray(col["h2"])
                for m in set(names):
                    n, base, tree, expected = sent.value[m]
                    mine = np.flatnonzero(names == m)
                    x, ok = unit_rows(col["embedding"].take(pa.array(mine)), n)
                    rows, fresh = mine[ok], []
                    ids, asks = col["id"].take(pa.array(rows)).to_pylist(), col["asks"].take(pa.array(rows)).to_pylist()
                    for i, key in enumerate(zip(h1[rows].tolist(), h2[rows].tolist(), [m] * len(rows))):
                        least, asked = seen.get(key, (None, False))
                        if least is None or ids[i] < least or asks[i] > asked:
                            seen[key] = (ids[i] if least is None else min(least, ids[i]), asked or asks[i])
                            fresh.append(i)
                    x, rows = x[fresh], rows[fresh]
                    for leaf, at in route(tree, x.astype(np.float32), np.asarray(col["reach"])[rows]):
                        yield _batch(base + leaf, expected[leaf], {k: c.take(pa.array(rows[at])) for k, c in col.items()}, kind)

        return v.select("model_id", "h1", "h2", "id", "asks", "reach", "embedding").mapInArrow(spread, self.fields)

    def deeper(self, rows: DataFrame, routers: DataFrame) -> DataFrame:
        """Rows in the shards within their shards, by the routers (shard, expected, router) of those."""
        kind = self.kind

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_shard, tree, inner = None, None, None
            for b in batches:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                shards = np.asarray(col["shard"])
                for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                    shard = int(shards[part[0]]) if len(part) else None
                    for i in part[np.asarray(col["turn"])[part] == 0] if len(part) else ():
                        at_shard, (tree, inner) = shard, pickle.loads(col["router"][int(i)].as_py())
                    part = part[np.asarray(col["turn"])[part] == 1] if len(part) else part
                    if not len(part):
                        continue
                    mine = {k: col[k].take(pa.array(part)) for k in col}
                    if shard != at_shard:  # none of its rows was in the sample
                        yield _batch(shard, 0.0, mine, kind)
                        continue
                    flat = np.asarray(mine["embedding"].flatten(), np.float64).reshape(len(part), -1)
                    x = (flat / np.sqrt((flat * flat).sum(1))[:, None]).astype(np.float32)
                    for leaf, at in route(tree, x, np.asarray(mine["reach"])):
                        yield _batch(_within(shard, leaf), inner[leaf], {k: c.take(pa.array(at)) for k, c in mine.items()}, kind)

        stretches = F.ceil(F.col("expected") / STRETCH).cast("int")
        asked = rows.select("shard", "model_id", "h1", "h2", "id", "asks", "reach", F.col("vector").alias("embedding"), F.pmod("h1", stretches).cast("int").alias("stretch"), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("router"))
        marks = routers.select("shard", "router", F.lit(0).alias("turn"), F.explode(F.sequence(F.lit(0), stretches - 1)).alias("stretch"))
        both = asked.unionByName(marks, allowMissingColumns=True)
        return both.repartition("shard", "stretch").sortWithinPartitions("shard", "stretch", "turn").mapInArrow(step, self.fields)

    def _split_large(self) -> None:
        shard_rows, margin = self.shard_rows, self.margin

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(part["vector"].to_list()).astype(np.float64)
            x = np.unique((x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32), axis=0)
            expected = float(part["expected"].iloc[0])
            tree = build(x, max(8, int(shard_rows * len(x) / expected)), margin, tries=24)
            inner = np.zeros(len(leaf_counts(tree)))
            for leaf, at in route(tree, x, np.full(len(x), margin, np.float32)):
                inner[leaf] = len(at) / len(x) * expected
            # What does not shrink is a knot of vectors nearer to each other than the margin: it stays one shard.
            inner[inner > 0.9 * expected] = 0.0
            return pd.DataFrame({"shard": part["shard"].iloc[:1], "expected": [expected], "router": [pickle.dumps((tree, inner))]})

        done, rows = [], self.ws.write(self.rows, "level0")
        for no in range(1, 16):
            large = rows.filter(F.col("expected") > self.large)
            if large.isEmpty():
                break
            some = large.filter(F.pmod(F.xxhash64("h1", "h2", F.lit(no)), F.lit(1_000_000)) < F.lit(1_000_000 * REFIT) / F.col("expected"))
            routers = self.ws.write(some.groupBy("shard").applyInPandas(fit, "shard bigint, expected double, router binary"), f"routers{no}")
            self.levels.append(routers)
            done.append(rows.filter(F.col("expected") <= self.large))
            rows = self.ws.write(self.deeper(large, routers), f"level{no}")
        self.rows = reduce(DataFrame.unionByName, [*done, rows])

    def visits(self, queries: DataFrame) -> DataFrame:
        """Queries in all shards that they reach; as rows."""
        rows, out = self.top(queries), []
        for routers in self.levels:
            out.append(rows.filter(F.col("expected") <= self.large))
            rows = self.deeper(rows.filter(F.col("expected") > self.large), routers)
        return reduce(DataFrame.unionByName, [*out, rows])


def _batch(shard: int, expected: float, col: dict[str, pa.Array], kind: pa.DataType) -> pa.RecordBatch:
    n = len(col["h1"])
    names = ["shard", "expected", "model_id", "h1", "h2", "id", "asks", "reach", "vector"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(np.full(n, expected)), *(col[c] for c in names[2:8]), col["embedding"].cast(pa.list_(kind))], names=names)


def _within(shard: int, leaf: int) -> int:
    """An id for a leaf within a shard; below 0, as those of the first routers are not."""
    x = (shard * 0x9E3779B97F4A7C15 + (leaf + 1) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & (1 << 64) - 1
    return (x >> 1) - (1 << 63)


def _points(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A shard's distinct vectors with the least id of each, in the order of those, and their units."""
    part = part.groupby(["h1", "h2"], sort=False).agg(model_id=("model_id", "first"), id=("id", "min"), asks=("asks", "max"), vector=("vector", "first")).reset_index().sort_values("id", kind="stable", ignore_index=True)
    x = np.stack(part["vector"].to_list()).astype(np.float64)
    return part, x / np.sqrt((x * x).sum(1))[:, None]


def _members(v: DataFrame, models: dict[str, tuple[int, int]]) -> DataFrame:
    """(model_id, h1, h2, body_hash, asks) of the vectors of use, repeated rows once."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    length = F.create_map(*[x for m, (n, _) in models.items() for x in (F.lit(m), F.lit(n))])
    sound = (F.size("embedding") == length[F.col("model_id")]) & norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < float("inf"))
    return v.filter(sound).groupBy("model_id", "h1", "h2", "body_hash").agg(F.max("asks").alias("asks"))


def _least_ids(members: DataFrame, k: int) -> DataFrame:
    """The k + 1 least ids of each vector: no other of them can be among the k most similar of any row."""
    w = Window.partitionBy("model_id", "h1", "h2").orderBy("body_hash")
    return members.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= k + 1).drop("no")


def similar_pairs(vectors: DataFrame, least_cosine: float, k: int = 10, route_factor: float = ROUTE_FACTOR, search_factor: float = JOIN_FACTOR, sample: int = SAMPLE, shard_rows: int = SHARD) -> DataFrame:
    """(model_id, body_hash_a, body_hash_b, cosine): pairs of one model with at least ``least_cosine`` that are among each
    other's ``k`` most similar; the smaller id first.

    vectors: model_id, body_hash, embedding. Models are trimmed and in lower case. Vectors without model or id, null, of
    another length than most of the model's, all zero or not finite take no part; repeated rows count once. Equal
    similarities rank by the smaller id. Empty tables give no rows; other columns are ignored.

    Equal vectors are one point; of each such group only the k + 1 smallest ids can be in a pair, so copies are never
    expanded. Vectors that differ in scale or in the last bits are points of their own, of which each keeps the k of the
    highest rounded cosines and, among ties, the smallest ids. With both factors 1 the result is exact. Models are few: one router each is built on the driver.
    """
    spark = vectors.sparkSession
    v, models = _usable(vectors, F.lit(False))
    if not models:
        return spark.createDataFrame([], "model_id string, body_hash_a string, body_hash_b string, cosine double")
    shards = Shards(v, models, route_factor * float(chord(least_cosine)) / 2 + 1e-6, sample, shard_rows)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        # Of a point that is among a query's k best ids, the least id is too, so k points do.
        part, x = _points(part)
        sim, at = Searcher(x, k, search_factor, least_cosine - 1e-5).search(x, np.arange(len(x)))
        q, c = np.nonzero(at >= 0)
        other = at[q, c]
        a, b = np.minimum(q, other), np.maximum(q, other)
        ab = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        a, b = ab[:, 0], ab[:, 1]
        cos = np.einsum("ij,ij->i", x[a], x[b])
        h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
        # The order of a shard's rows is not given; that of a pair must be.
        swap = (h1[a] > h1[b]) | ((h1[a] == h1[b]) & (h2[a] > h2[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"model_id": part["model_id"].to_numpy()[a] if len(part) else [], "a1": h1[a], "a2": h2[a], "b1": h1[b], "b2": h2[b], "cosine": np.round(cos, 7)})

    near = shards.rows.groupBy("shard").applyInPandas(pairs, "model_id string, a1 bigint, a2 bigint, b1 bigint, b2 bigint, cosine double").filter(F.col("cosine") >= least_cosine)
    # Each pair once, then both its directions from that one row.
    once = near.groupBy("model_id", "a1", "a2", "b1", "b2").agg(F.max("cosine").alias("cosine"))
    there = F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b1").alias("o1"), F.col("b2").alias("o2"))
    back = F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("a1").alias("o1"), F.col("a2").alias("o2"))
    both = once.select("model_id", "cosine", F.explode(F.array(there, back)).alias("d")).select("model_id", "cosine", "d.*")
    members = _least_ids(_members(v, models), k)
    mine = members.select("model_id", "h1", "h2", F.col("body_hash").alias("x"))
    theirs = members.select("model_id", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("body_hash").alias("y"))
    across = both.join(mine, ["model_id", "h1", "h2"]).join(theirs, ["model_id", "o1", "o2"]).select("model_id", "x", "y", "cosine")
    groups = members.groupBy("model_id", "h1", "h2").agg(F.collect_list("body_hash").alias("all")).filter(F.size("all") > 1)
    within = groups.select("model_id", F.explode("all").alias("x"), "all").select("model_id", "x", F.explode("all").alias("y"), F.lit(1.0).alias("cosine")).filter("x != y")
    best = across.unionByName(within).withColumn("no", F.row_number().over(Window.partitionBy("model_id", "x").orderBy(F.desc("cosine"), "y"))).filter(F.col("no") <= k)
    pair = best.select("model_id", F.least("x", "y").alias("body_hash_a"), F.greatest("x", "y").alias("body_hash_b"), "cosine")
    return pair.groupBy("model_id", "body_hash_a", "body_hash_b").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).filter("n = 2").drop("n")


def _streamed(rows: DataFrame, answer: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], pd.DataFrame], fields: str) -> DataFrame:
    """Answers of each shard's points to the queries that visit it (turn 1), however many those are: they pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for b in batches:
            df = b.to_pandas()
            edges = np.flatnonzero(np.diff(df["shard"].to_numpy())) + 1
            for at in np.split(np.arange(len(df)), edges):
                if not len(at):
                    continue
                part = df.iloc[at]
                if part["shard"].iloc[0] != shard:
                    shard, parts, index = part["shard"].iloc[0], [], None
                points, asked = part[part["turn"] == 0], part[part["turn"] == 1]
                if len(points):
                    parts.append(points)
                if len(asked) and parts:
                    if index is None:
                        index = _points(pd.concat(parts))
                    yield pa.RecordBatch.from_pandas(answer(*index, asked), preserve_index=False)

    return rows.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(run, fields)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = SEARCH_FACTOR, sample: int = SAMPLE, shard_rows: int = SEARCH_SHARD) -> DataFrame:
    """(model_id, query_hash, body_hash, rank, cosine): the k most similar vectors of the same model for each query row.

    is_query tells the query rows of vectors (model_id, body_hash, embedding); all rows are searched. Unusable vectors
    neither ask nor answer, repeated rows count once, equal similarities rank by the smaller id, and factor 1 is exact.
    Every vector lies in one shard. A query first looks in its own; the k-th similarity found there, times the factor, is
    how far it looks across borders, and of any other shard only what is at least as similar comes back, k rows at most.
    """
    spark = vectors.sparkSession
    v, models = _usable(vectors, is_query)
    if not models:
        return spark.createDataFrame([], "model_id string, query_hash string, body_hash string, rank int, cosine double")
    shards = Shards(v, models, 0.0, sample, shard_rows)
    points = shards.ws.write(shards.rows, "points")
    fields = "model_id string, h1 bigint, h2 bigint, o1 bigint, o2 bigint, cosine double, home bigint, floor double"

    def found(part: pd.DataFrame, asked: pd.DataFrame, sim: np.ndarray, at: np.ndarray, home: int, floor: np.ndarray) -> pd.DataFrame:
        # A query that finds nothing has one row without a cosine, so that it is known.
        none = (at < 0).all(1)
        i, j = np.nonzero((at >= 0) | (none[:, None] & (np.arange(at.shape[1]) == 0)))
        other, own = np.maximum(at[i, j], 0), asked.iloc[i]
        h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
        cols = (own["model_id"].to_numpy(object), own["h1"].to_numpy(), own["h2"].to_numpy(), h1[other], h2[other], np.where(none[i], np.nan, sim[i, j]), np.full(len(i), home), floor[i])
        return pd.DataFrame(dict(zip(("model_id", "h1", "h2", "o1", "o2", "cosine", "home", "floor"), cols)))

    def at_home(part: pd.DataFrame) -> pd.DataFrame:
        shard = part["shard"].iloc[0]
        part, x = _points(part)
        rows = np.flatnonzero(part["asks"])
        sim, at = Searcher(x, k, factor, digits=6).search(x[rows], rows)
        return found(part, part.iloc[rows], sim, at, shard, np.where(at[:, -1] >= 0, sim[:, -1], -1.0))

    def abroad(part: pd.DataFrame, x: np.ndarray, asked: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(asked["vector"].to_list()).astype(np.float64)
        q /= np.sqrt((q * q).sum(1))[:, None]
        floor = asked["expected"].to_numpy()
        sim, at = Searcher(x, k, factor, digits=6).search(q, floors=floor)
        return found(part, asked, sim, at, 0, floor)

    first = shards.ws.write(points.groupBy("shard").applyInPandas(at_home, fields), "first")
    bound = first.groupBy("model_id", "h1", "h2").agg(F.first("home").alias("home"), F.first("floor").alias("floor"))
    asking = points.filter("asks").groupBy("model_id", "h1", "h2").agg(F.min("id").alias("id"), F.first("vector").alias("embedding")).join(bound, ["model_id", "h1", "h2"])
    # Half a unit of the last digit, as ties count. The way there carries home and floor as one string.
    reach = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.col("floor") - 0.5e-6))) * factor + 1e-6
    sent_out = shards.visits(asking.select("model_id", "h1", "h2", F.concat_ws(":", "home", "floor").alias("id"), F.lit(True).alias("asks"), reach.alias("reach"), "embedding"))
    went = F.split("id", ":")
    visits = sent_out.withColumns({"home": went[0].cast("bigint"), "expected": went[1].cast("double"), "turn": F.lit(1)}).filter("shard != home").drop("home")
    second = _streamed(points.withColumn("turn", F.lit(0)).unionByName(visits), abroad, fields)
    near = first.unionByName(second).filter(~F.isnan("cosine")).select("model_id", "h1", "h2", "o1", "o2", "cosine")

    members = _members(v, models)
    asked = members.filter("asks").select("model_id", "h1", "h2", F.col("body_hash").alias("query_hash"))
    # Of a query's points only k can matter, before they are joined with their ids.
    best = near.join(points.groupBy("model_id", F.col("h1").alias("o1"), F.col("h2").alias("o2")).agg(F.min("id").alias("id")), ["model_id", "o1", "o2"])
    best = best.withColumn("no", F.row_number().over(Window.partitionBy("model_id", "h1", "h2").orderBy(F.desc("cosine"), "id"))).filter(F.col("no") <= k)
    own = asked.select("model_id", "h1", "h2").distinct().select("model_id", "h1", "h2", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.lit(1.0).alias("cosine"))
    theirs = _least_ids(members, k).select("model_id", F.col("h1").alias("o1"), F.col("h2").alias("o2"), "body_hash")
    rows = best.select("model_id", "h1", "h2", "o1", "o2", "cosine").unionByName(own).join(theirs, ["model_id", "o1", "o2"]).join(asked, ["model_id", "h1", "h2"])
    rows = rows.filter("query_hash != body_hash").groupBy("model_id", "query_hash", "body_hash").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("model_id", "query_hash").orderBy(F.desc("cosine"), "body_hash")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("model_id", "query_hash", "body_hash", "rank", "cosine")
