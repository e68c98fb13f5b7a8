"""Full hierarchies from parent links of unknown depth.

Splitters are chosen by a hash of the id. Every node walks to its next splitter (doubling its stride each round, so the
rounds grow with the logarithm of the gap between splitters, not with the depth), the splitters alone form a reduced
pointer graph that is solved by the same contraction until it is small, and the exact results are expanded from it.
Nodes whose way never meets a splitter or an end lead into a ring without splitters; they join the reduced graph as
they are, where another salt gives other splitters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brindle.workspace import Workspace

#: One node in 2**SPLITTER_BITS is a splitter. A reduced graph of SOLVE_ROWS rows or fewer (some 100 MB) is one task's work;
#: with paths, one whose paths can have so many elements in all.
SPLITTER_BITS = 2
SOLVE_ROWS = 500_000
SOLVE_ELEMENTS = 4_000_000
#: So few rows are one task's work however long their paths are.
SOLVE_ANYWAY = 1_000


def _splitter(col: Column, salt: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << SPLITTER_BITS)) == 0, F.lit(False))


def _walk(states: DataFrame, salt: int, ws: Workspace, with_path: bool, level: int) -> tuple[DataFrame, int]:
    """States (id, ptr, dist, low, stop) after every node has walked to a stop, and how many rows the reduced graph has.

    ptr is dist links above id and low the least id on the way, ptr left out. A node that stops is not moved again.
    """
    def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        kept = ws.write(df.observe(seen, F.count_if(~F.col("stop")).alias("active")), name)
        return kept, seen.get["active"]

    fresh, active = written(states, f"walk{level}-0")
    parts: list[DataFrame] = []
    k = 0
    # 2**(2 + SPLITTER_BITS + 5) links without one splitter do not happen by chance; what is left are rings, or solved as such.
    while active and k < SPLITTER_BITS + 7:
        moving = fresh.filter("not stop")
        parts.append(fresh.filter("stop"))
        table = moving
        for p in parts:
            table = table.unionByName(p)
        t = table.filter(~_splitter(F.col("id"), salt)).select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.col("stop").alias("s2"), *[F.col("seg").alias("g2")] * with_path)
        step = moving.join(t, "ptr", "left").select(
            "id", F.coalesce("to", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.least("low", "l2").alias("low"),
            F.coalesce("s2", F.lit(True)).alias("stop"), *[F.when(F.col("to").isNull(), F.col("seg")).otherwise(F.concat("seg", "g2")).alias("seg")] * with_path,
        )
        k += 1
        fresh, now = written(step, f"walk{level}-{k}")
        if now > 0.95 * active and k > SPLITTER_BITS + 3:
            active = now
            break
        active = now
    out = fresh
    for p in parts:
        out = out.unionByName(p)
    return out, active


def _solve_in_one(rows: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """(id, root, depth[, path]) of a small pointer graph by pointer doubling; ptr without a row is an end."""
    ids = rows["id"].to_numpy(object)
    n = len(ids)
    at = {x: i for i, x in enumerate(ids)}
    ptr = np.array([at.get(x, -1) for x in rows["ptr"]], np.int64)
    low = rows["low"].to_numpy(object)
    jump = np.append(np.where(ptr < 0, n, ptr), n)
    dist = np.append(rows["dist"].to_numpy(np.int64), 0)
    root = rows["ptr"].to_numpy(object).copy()
    last = np.arange(n + 1)
    end = np.where(ptr < 0, np.arange(n), -1)
    final = np.append(end, -1)
    depth = dist.copy()
    rank = {x: i for i, x in enumerate(sorted(set(low)))}
    least = np.append(np.array([rank[x] for x in low], np.int64), np.iinfo(np.int64).max)
    for _ in range(max(1, n.bit_length() + 1)):
        depth = depth + depth[jump]
        final = np.where(final >= 0, final, final[jump])
        last = jump[last]
        jump = jump[jump]
    ring = jump[:n] < n
    names = sorted(set(low))
    if ring.any():
        # Where a long stride lands is on the ring, and the landings are all of it: fold low along the ring only.
        on = np.unique(jump[:n][ring])
        pos = {int(x): i for i, x in enumerate(on)}
        hop = np.array([pos[int(ptr[x])] for x in on])
        m = least[on]
        for _ in range(max(1, len(on).bit_length() + 1)):
            m = np.minimum(m, m[hop])
            hop = hop[hop]
        for i in np.flatnonzero(ring):
            root[i] = names[m[pos[int(jump[i])]]]
    tree = np.flatnonzero(~ring)
    root[tree] = root[final[tree]]
    out = pd.DataFrame({"id": ids, "root": root, "depth": np.where(ring, -1, depth[:n])})
    if with_path:
        paths: list = [None] * n
        for i in np.argsort(np.where(ring, -1, depth[:n]), kind="stable"):
            if not ring[i]:
                seg = list(rows["seg"].iat[i])
                paths[i] = seg + (paths[ptr[i]] if ptr[i] >= 0 else [root[i]])
        out["path"] = paths
    return out


def _solve(graph: DataFrame, rows: int, level: int, ws: Workspace, with_path: bool) -> DataFrame:
    """(id, root, depth[, path]) of a weighted pointer graph of so many rows; ptr without a row is an end.

    The depths of a small graph tell how many elements its paths have, and so whether one task can hold those, too.
    """
    kind = graph.schema["id"].dataType.simpleString()
    fields = f"id {kind}, root {kind}, depth bigint" + f", path array<{kind}>" * with_path
    small = rows <= SOLVE_ROWS
    if small and with_path and rows > SOLVE_ANYWAY:
        depths = graph.drop("seg").coalesce(1).mapInPandas(_whole(False), f"id {kind}, root {kind}, depth bigint")
        small = (depths.agg(F.sum(F.greatest("depth", F.lit(0)))).head()[0] or 0) <= SOLVE_ELEMENTS
    if small:
        return graph.coalesce(1).mapInPandas(_whole(with_path), fields)
    salt = level + 1
    start = graph.alias("c").join(graph.select(F.col("id").alias("ptr"), F.lit(True).alias("known")), "ptr", "left")
    start = start.select("id", "ptr", "dist", "low", (F.col("known").isNull() | _splitter(F.col("ptr"), salt)).alias("stop"), *["seg"] * with_path)
    states, _ = _walk(start, salt, ws, with_path, level)
    return _expand(states, salt, level, ws, with_path)


def _whole(with_path: bool):
    def run(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            yield _solve_in_one(pd.concat(parts, ignore_index=True), with_path)

    return run


def _expand(states: DataFrame, salt: int, level: int, ws: Workspace, with_path: bool) -> DataFrame:
    """Exact results of all nodes from those of the reduced graph."""
    seen = Observation()
    reduced = ws.write(states.filter((~F.col("stop") | _splitter(F.col("id"), salt)) & (F.col("dist") > 0)).observe(seen, F.count(F.lit(1)).alias("n")), f"reduced{level}")
    solved = ws.write(_solve(reduced, seen.get["n"], level + 1, ws, with_path), f"solved{level}")
    # What the levels below have written is not read again, as their result is.
    ws.drop(f"reduced{level}", f"solved{level + 1}", *[n for n in ws.kept if n.startswith(f"walk{level + 1}-")])
    r = solved.select(F.col("id").alias("ptr"), F.col("root"), F.col("depth").alias("up"), *["path"] * with_path)
    joined = states.join(r, "ptr", "left")
    out = joined.select(
        "id", F.coalesce("root", "ptr").alias("root"), F.when(F.col("up") < 0, -1).otherwise(F.col("dist") + F.coalesce("up", F.lit(0))).cast("bigint").alias("depth"),
        *[F.when(F.col("up") < 0, F.lit(None)).otherwise(F.concat("seg", F.coalesce("path", F.array("ptr")))).alias("path")] * with_path,
    )
    return out


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, root, depth[, path]) of each distinct id whose parent is not null.

    links: id, parent (null for "no parent"), both of one orderable type; other columns are ignored. depth is the number
    of links up to the root; a parent that no row bears ends the climb. Nodes on a ring, or below one, have depth -1, the
    ring's least id as root and a null path; a node that is its own parent is a ring of one. path runs from the node to
    its root, both included. Repeated rows count once; of differing parents of one id the greatest holds; rows with a
    null id are left out; an empty table gives no rows.

    No step groups children under their parent, so a parent of a third of all rows is only a skewed join key on the left
    of joins whose right side has one row a key, which adaptive execution splits.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    salt = 0
    nodes = links.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent").alias("parent"))
    up = nodes.select(F.col("id").alias("parent"), F.col("parent").alias("grand"), F.lit(True).alias("known"))
    start = nodes.filter(F.col("parent").isNotNull()).join(up, "parent", "left")
    known = F.col("known").isNotNull()
    start = start.select(
        "id", F.when(known, F.col("parent")).otherwise(F.col("id")).alias("ptr"), F.when(known, 1).otherwise(0).cast("bigint").alias("dist"), F.col("id").alias("low"),
        (~known | F.col("grand").isNull() | _splitter(F.col("parent"), salt)).alias("stop"), *[F.when(known, F.array("id")).otherwise(F.array().cast(f"array<{links.schema['id'].dataType.simpleString()}>")).alias("seg")] * with_path,
    )
    states, _ = _walk(start, salt, ws, with_path, 0)
    return _expand(states, salt, 0, ws, with_path)


def ring_members(links: DataFrame) -> DataFrame:
    """(id, root) of the nodes on or below a ring."""
    return hierarchy(links).filter("depth < 0").select("id", "root")


def descendants(links: DataFrame) -> DataFrame:
    """(ancestor, id, hops) for each node and each of its ancestors, rings left out. As many rows as the depths' sum."""
    paths = hierarchy(links, with_path=True).filter("path is not null")
    return paths.select("id", F.posexplode("path").alias("hops", "ancestor")).filter("hops > 0").select("ancestor", "id", F.col("hops").cast("bigint").alias("hops"))
