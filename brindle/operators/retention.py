"""Identity matching across renames, and which old rows can go."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.operators.graph import DAY_MS, Policy
from brindle.workspace import Workspace


def rename_candidates(tombstones: DataFrame, now_ms: int, window_days: int) -> DataFrame:
    """Tombstones within the window; one without a time is only a candidate if there is no window."""
    if not window_days:
        return tombstones
    return tombstones.filter(F.col("tombstoned_at_ms") >= now_ms - window_days * DAY_MS)


def _no_hubs(symbols: DataFrame) -> DataFrame:
    return symbols.filter("qualified_name != file_path AND kind != 'File'")


def rename_scores(tombstones: DataFrame, symbols: DataFrame, policy: Policy) -> DataFrame:
    """(tomb_id, symbol_id, confidence): tombstones and new symbols of one file that may be one symbol renamed.

    Both: id, file_path, kind, qualified_name, body (null if unknown), and branch_id if they are of several branches; file
    hubs take no part. The pairs come from a join on file (and branch); kinds may differ. The name counts from its
    proximity's threshold; bodies, with the leaf names masked, from the body threshold (0.4 within a file at most) and need
    at least one meaningful token; where both bodies are known a body signal is required.
    """
    key = [c for c in ("branch_id", "file_path") if c in tombstones.columns]

    def side(df: DataFrame, as_id: str, as_name: str, as_body: str, as_toks: str) -> DataFrame:
        toks = S.tokens(S.mask_identifier(F.col("body"), S.name_leaf(F.col("qualified_name"))))
        told = F.array_except(S.meaningful(toks), F.array(F.lit(S.MASK)))
        return _no_hubs(df).select(*key, F.col("id").alias(as_id), F.col("qualified_name").alias(as_name), F.col("body").isNotNull().alias(as_body), told.alias(as_toks))

    p = side(tombstones, "tomb_id", "old_name", "old_body", "a").join(side(symbols, "symbol_id", "new_name", "new_body", "b"), key)
    p = p.withColumn("near", S.name_proximity(F.col("old_name"), F.col("new_name")))
    enough = (F.size("a") >= 1) & (F.size("b") >= 1)
    body = F.when(enough, S.token_jaccard(F.col("a"), F.col("b")))
    p = p.withColumn("alike", F.when(body >= min(policy.body_similarity, 0.4), body))
    name = F.when(F.col("near") >= policy.name_proximity, F.col("near"))
    both = F.col("old_body") & F.col("new_body")
    best = F.greatest(F.coalesce(name, F.lit(0.0)), F.coalesce("alike", F.lit(0.0)))
    return p.filter(~both | F.col("alike").isNotNull()).select("tomb_id", "symbol_id", best.alias("confidence")).filter(F.col("confidence") >= policy.rename_min_confidence)


#: Bits of a token set's sketch, and how many of the most frequent tokens are told apart when tokens are ordered by rarity.
SKETCH_BITS, FREQUENT_TOKENS = 256, 20_000
_WORDS = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: A join of all rows is made in so many parts at most, of this many rows or more, so that what is shuffled for one part lies on disk at a time.
PARTS, PART_ROWS = 8, 500_000


def _signed(least: float, held: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each set with its tokens as codes, those without a code as they are, its rarest tokens, hashed, of which one as similar has one among its own, and the parity of its tokens by hash."""
    code = {x: i for i, x in enumerate(held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, codes, rare, rarest, sketches = [], [], [], [], []
            for toks in b.column("toks").to_pylist():
                n, bits = len(toks), 0
                toks.sort(key=lambda x: (held.get(x, 0), x))
                hashes = [zlib.crc32(x.encode()) for x in toks]
                for h in hashes:
                    bits ^= 1 << h % SKETCH_BITS
                lengths.append(n)
                codes.append(sorted(code[x] for x in toks if x in code))
                rare.append([x for x in toks if x not in code])
                rarest.append([h - 2**31 for h in hashes[: n - math.ceil(n * least - 1e-9) + 1]])
                sketches.append(bits.to_bytes(SKETCH_BITS // 8, "little"))
            words = [pa.array([int.from_bytes(x[i * 8 : i * 8 + 8], "little", signed=True) for x in sketches], pa.int64()) for i in range(len(_WORDS))]
            arrays = [pa.array(lengths, pa.int32()), pa.array(codes, pa.list_(pa.int16())), pa.array(rare, pa.list_(pa.string())), pa.array(rarest, pa.list_(pa.int32())), *words]
            kept = [c for c in b.schema.names if c != "toks"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *arrays], [*kept, "n", "codes", "rare", "rarest", *_WORDS])

    return run


def _held(sets: DataFrame) -> dict[str, int]:
    """The most frequent tokens with how many sets hold them.

    Any order of the tokens finds the same pairs: one by how many sets hold them finds few others. Rarer tokens than these tie.
    """
    held = sets.select(F.explode("toks").alias("tok")).groupBy("tok").count().orderBy(F.desc("count"), "tok").limit(FREQUENT_TOKENS)
    return {r[0]: r[1] for r in held.collect()}


def _sign(sets: DataFrame, least: float, held: dict[str, int]) -> DataFrame:
    kept = [f"{c} {kind}" for c, kind in sets.dtypes if c != "toks"]
    return sets.mapInArrow(_signed(least, held), ", ".join([*kept, "n int", "codes array<smallint>", "rare array<string>", "rarest array<int>", *(f"{x} bigint" for x in _WORDS)]))


def _similar_sets(sets: DataFrame, least: float, ws: Workspace, parts: int = 1) -> DataFrame:
    """(branch_id, old_id, new_id) of different sets (branch_id, set_id, toks, old, new) of a branch that may be so alike: all that are, and few others.

    Two sets so alike share one of their rarest tokens, and at the first they share enough tokens are left in both; of their
    tokens few are in one set only, and each of those flips one bit of the sketch. So pairs are told by fixed columns while
    they are joined, and only those left are compared token by token. Sets may have what ``_sign`` gives instead of toks.
    """
    signed = ws.write(_sign(sets, least, _held(sets)), "signed") if "toks" in sets.columns else sets
    a_n, b_n = F.col("a_n"), F.col("b_n")
    left = F.least(a_n - F.col("a_at"), b_n - F.col("b_at"))
    flipped = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in _WORDS), F.lit(0))
    sizes = F.least(a_n, b_n) >= F.greatest(a_n, b_n) * least - 1e-9
    near = sizes & (left >= (a_n + b_n) * (least / (1 + least)) - 1e-9) & (flipped <= (a_n + b_n) * ((1 - least) / (1 + least)) + 1e-9)

    def pairs(k: int) -> DataFrame:
        def side(which: str, p: str) -> DataFrame:
            s = signed.filter(which).select("branch_id", F.col("set_id").alias(f"{which}_id"), F.col("n").alias(f"{p}_n"), *(F.col(x).alias(f"{p}_{x}") for x in _WORDS), F.posexplode("rarest").alias(f"{p}_at", "tok"))
            return s.filter(F.pmod("tok", F.lit(parts)) == k)

        p = side("old", "a").join(side("new", "b"), ["branch_id", "tok"]).filter(near & (F.col("old_id") != F.col("new_id")))
        return p.select("branch_id", "old_id", "new_id").distinct()

    found = ws.write(_in_parts(ws, "pairs", parts, pairs).distinct(), "pairs")
    ws.drop(*(f"pairs{k}" for k in range(parts)))
    return found


def _in_parts(ws: Workspace, name: str, parts: int, part: Callable[[int], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [ws.write(part(k), f"{name}{k}") for k in range(parts)])


def _jaccard(a: str, b: str) -> Column:
    """Of two sets that aren't empty."""
    shared = F.size(F.array_intersect(f"{a}_codes", f"{b}_codes")) + F.size(F.array_intersect(f"{a}_rare", f"{b}_rare"))
    return shared / (F.col(f"{a}_n") + F.col(f"{b}_n") - shared)


#: So many old and new rows of a file are compared at a time.
BLOCK = 128


def _entries(codes: pa.ListArray, rare: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows as numbers, and where each row's begin and end; a null has none."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (codes, rare)]
    values = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes[1].any():
        others = rare.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + FREQUENT_TOKENS
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        values = np.concatenate([values, others])[np.argsort(row, kind="stable")]
    return values, np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])


def _compared(least: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of an old and a new row of a file (rows in order of branch and file, the old ones first) whose sets are alike or of which one is unknown."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t.column(c).combine_chunks() for c in t.schema.names}
        values, at = _entries(col["codes"], col["rare"])
        known, old = (col[c].to_numpy(zero_copy_only=False) for c in ("known", "old"))
        place = np.full(int(values.max(initial=0)) + 1, -1)
        starts = [0, *(np.flatnonzero(_differs(col)) + 1), len(old)]
        left, right, score = [], [], []
        for s, e in zip(starts, starts[1:]):
            mid = s + int(old[s:e].sum())
            for i in range(s, mid, BLOCK):
                j = min(i + BLOCK, mid)
                there, own = np.unique(values[at[i] : at[j]], return_inverse=True)
                place[there] = np.arange(len(there))
                n = np.diff(at[i : j + 1])
                a = np.zeros((j - i, len(there)), np.float32)
                a[np.repeat(np.arange(j - i), n), own] = 1
                for k in range(mid, e, BLOCK):
                    h = min(k + BLOCK, e)
                    m = np.diff(at[k : h + 1])
                    b = np.zeros((h - k, len(there)), np.float32)
                    other = place[values[at[k] : at[h]]]
                    b[np.repeat(np.arange(h - k), m)[other >= 0], other[other >= 0]] = 1
                    shared = (a @ b.T).astype(np.float64)
                    body = shared / np.maximum(n[:, None] + m[None, :] - shared, 1)
                    alike = (np.minimum(n[:, None], m[None, :]) >= 1) & (body >= least)
                    x, y = np.nonzero(alike | ~(known[i:j, None] & known[None, k:h]))
                    left.append(x + i)
                    right.append(y + k)
                    score.append(np.where(alike, body, -1.0)[x, y])
                place[there] = -1
        if left:
            x, y, found = np.concatenate(left), np.concatenate(right), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([col["branch_id"].take(pa.array(x)), col["id"].take(pa.array(x)), col["id"].take(pa.array(y)), col["leaf"].take(pa.array(x)), col["leaf"].take(pa.array(y)), pa.array(found, mask=found < 0)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(_differs({c: b.column(c) for c in ("branch_id", "file_path")}))
            last = int(new[-1]) + 1 if len(new) else 0
            if waiting and not last and all(waiting[-1].column(c)[-1] == b.column(c)[0] for c in ("branch_id", "file_path")):
                waiting.append(b)
                continue
            # The last file of a batch may go on in the next.
            if waiting or last:
                yield from pairs(pa.Table.from_batches([*waiting, b.slice(0, last)]))
            waiting = [b.slice(last)]
        if waiting:
            yield from pairs(pa.Table.from_batches(waiting))

    return run


def _differs(col: dict[str, pa.Array]) -> np.ndarray:
    """Of each row but the first, whether it is of another branch or file than the one before."""
    n = len(col["branch_id"])
    return np.logical_or(*(pc.not_equal(col[c].slice(1), col[c].slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False).astype(bool) for c in ("branch_id", "file_path")))


class _Bodies:
    """The rows of both sides and the token sets of their bodies, each body read once however many rows have it.

    rows: branch_id, id, file_path, leaf, old, body_id (null if unknown), own (the meaningful tokens of a body that has the
    leaf's name in it, with that masked), set_id (null if a body has less than two meaningful tokens). sets: body_id, set_id
    and what ``_sign`` gives.
    """

    def __init__(self, tombstones: DataFrame, symbols: DataFrame, bodies: DataFrame | None, policy: Policy, ws: Workspace):
        self.policy, self.ws = policy, ws
        if bodies is None:
            tombstones, symbols = (x.withColumn("body_id", F.md5("body")) for x in (tombstones, symbols))
            bodies = tombstones.select("body_id", "body").unionByName(symbols.select("body_id", "body")).dropDuplicates(["body_id"])

        def side(df: DataFrame, old: bool) -> DataFrame:
            return _no_hubs(df).select("branch_id", "id", "file_path", S.name_leaf(F.col("qualified_name")).alias("leaf"), "body_id", F.lit(old).alias("old"))

        bodies = bodies.filter("body IS NOT NULL").select("body_id", "body")
        told = ws.write(bodies.select("body_id", F.sort_array(S.tokens(F.col("body"))).alias("toks")), "texts")
        set_id = F.when(F.size(S.meaningful(F.col("toks"))) >= 2, F.substring(F.unhex(F.sha2(F.concat_ws(" ", "toks"), 256)), 1, 16))
        sets = told.select("body_id", set_id.alias("set_id"), "toks")
        both = side(tombstones, True).unionByName(side(symbols, False))
        self.parts = min(PARTS, 1 + both.count() // PART_ROWS)
        masked = F.array_except(S.meaningful(S.tokens(S.mask_identifier(F.col("body"), F.col("leaf")))), F.array(F.lit(S.MASK)))
        own = F.when((F.length("leaf") > 0) & F.contains("body", "leaf"), F.sort_array(masked))
        few = math.ceil(self.parts / 4)

        def joined(k: int) -> DataFrame:
            mine = F.coalesce(F.pmod(F.hash(F.col("body_id").cast("string")), F.lit(few)), F.lit(0)) == k
            j = both.filter(mine).join(bodies.filter(mine), "body_id", "left").join(sets.filter(mine).select("body_id", "set_id"), "body_id", "left")
            return j.select("branch_id", "id", "file_path", "leaf", "old", F.when(F.col("body").isNotNull(), F.col("body_id")).alias("body_id"), own.alias("own"), "set_id")

        self.rows = _in_parts(ws, "rows", few, joined)
        self.held = _held(sets)
        self.sets = ws.write(_sign(sets, policy.body_similarity, self.held), "sets")
        ws.drop("texts")

    def within(self) -> DataFrame:
        """(branch_id, tomb_id, symbol_id, confidence) of the rows of ``rename_scores``."""
        policy, least = self.policy, min(self.policy.body_similarity, 0.4)
        own_id = F.sha2(F.concat_ws(" ", "own"), 256)
        own = self.rows.filter("own IS NOT NULL").select(F.concat(F.lit("own "), own_id).alias("key"), F.col("own").alias("toks")).dropDuplicates(["key"])
        own = self.ws.write(_sign(own, policy.body_similarity, self.held).select("key", "codes", "rare"), "own")
        dull = {*S.STOP_TOKENS, S.MASK}
        codes = F.array_except("codes", F.array(*(F.lit(i).cast("smallint") for i, x in enumerate(self.held) if x in dull)).cast("array<smallint>"))
        sets = self.sets.select(F.col("body_id").cast("string").alias("key"), codes.alias("codes"), F.array_except("rare", F.array(*map(F.lit, sorted(dull)))).alias("rare")).unionByName(own)
        key = F.when(F.col("own").isNotNull(), F.concat(F.lit("own "), own_id)).otherwise(F.col("body_id").cast("string"))
        at, kind = ["branch_id", "file_path"], dict(self.rows.dtypes)
        names, kinds = ["branch_id", "tomb_id", "symbol_id", "old_leaf", "new_leaf", "alike"], [kind["branch_id"], kind["id"], kind["id"], "string", "string", "double"]

        def scored(k: int) -> DataFrame:
            r = self.rows.filter("branch_id IS NOT NULL AND file_path IS NOT NULL").filter(F.pmod(F.xxhash64(*at), F.lit(self.parts)) == k)
            r = r.select(*at, "id", "leaf", "old", key.alias("key")).join(sets, "key", "left").select(*at, "id", "leaf", "old", F.col("key").isNotNull().alias("known"), "codes", "rare")
            p = r.repartition(*at).sortWithinPartitions(*at, F.desc("old")).mapInArrow(_compared(least, names), ", ".join(f"{c} {kind}" for c, kind in zip(names, kinds)))
            near = S.name_proximity(F.col("old_leaf"), F.col("new_leaf"))
            best = F.greatest(F.coalesce(F.when(near >= policy.name_proximity, near), F.lit(0.0)), F.coalesce("alike", F.lit(0.0)))
            return p.select("branch_id", "tomb_id", "symbol_id", best.alias("confidence")).filter(F.col("confidence") >= policy.rename_min_confidence)

        return _in_parts(self.ws, "within", self.parts, scored)

    def alike(self) -> DataFrame:
        """(branch_id, old_id, new_id, confidence) of token sets so alike, of a branch that has rows of one among the old ones and of the other among the new.

        The join is exact: those that ``_similar_sets`` finds are compared.
        """
        least, ws = self.policy.body_similarity, self.ws
        one = self.sets.filter("set_id IS NOT NULL").groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("n", "codes", "rare", "rarest", *_WORDS)))
        there = self.rows.filter("set_id IS NOT NULL").groupBy("branch_id", "set_id").agg(F.max("old").alias("old"), F.max(~F.col("old")).alias("new"))
        one, there = ws.write(one, "one"), ws.write(there, "there")
        signed = ws.write(there.join(one.drop("codes", "rare"), "set_id"), "signed")
        found = _similar_sets(signed, least, ws, self.parts)
        for as_id, p in (("old_id", "a"), ("new_id", "b")):
            found = found.join(one.select(F.col("set_id").alias(as_id), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "codes", "rare"))), as_id)
        found = found.select("branch_id", "old_id", "new_id", _jaccard("a", "b").alias("confidence"))
        same = there.filter("old AND new").select("branch_id", F.col("set_id").alias("old_id"), F.col("set_id").alias("new_id"), F.lit(1.0).alias("confidence"))
        out = ws.write(found.unionByName(same).filter(F.col("confidence") >= max(least, self.policy.rename_min_confidence)), "alike")
        ws.drop("one", "there", "signed", "pairs")
        return out


def cross_file_scores(tombstones: DataFrame, symbols: DataFrame, policy: Policy, bodies: DataFrame | None = None) -> DataFrame:
    """(tomb_id, symbol_id, confidence): tombstones and new symbols of one branch, but of different files, with similar bodies.

    Both: branch_id, id, file_path, kind, qualified_name, body; file hubs take no part. Each body needs two meaningful
    tokens, and the Jaccard similarity of all tokens must reach the body threshold. With bodies (body_id, body), rows have a
    body_id instead of a body.
    """
    found = _Bodies(tombstones, symbols, bodies, policy, Workspace(tombstones.sparkSession, "moved", tidy=True))
    t, s = found.rows.filter("old"), found.rows.filter("NOT old")
    t = t.select("branch_id", F.col("set_id").alias("old_id"), F.col("id").alias("tomb_id"), F.col("file_path").alias("old_path"))
    s = s.select("branch_id", F.col("set_id").alias("new_id"), F.col("id").alias("symbol_id"), F.col("file_path").alias("new_path"))
    return found.alike().join(t, ["branch_id", "old_id"]).join(s, ["branch_id", "new_id"]).filter("old_path != new_path").select("tomb_id", "symbol_id", "confidence")


def all_rename_scores(tombstones: DataFrame, symbols: DataFrame, policy: Policy, bodies: DataFrame | None = None) -> DataFrame:
    """(tomb_id, symbol_id, confidence, cross_file) of both kinds of pairs; columns as for ``cross_file_scores``."""
    whole = [df if bodies is None else df.join(bodies, "body_id", "left") for df in (tombstones, symbols)]
    within = rename_scores(*whole, policy).withColumn("cross_file", F.lit(False))
    return within.unionByName(cross_file_scores(tombstones, symbols, policy, bodies).withColumn("cross_file", F.lit(True)))


#: After so many rounds the symbols that still compete are settled one after the other.
ROUNDS = 6


def best_renames(scores: DataFrame) -> DataFrame:
    """(tomb_id, symbol_id, confidence): symbols in order take their best tombstone that no earlier symbol took.

    With a column cross_file, which the result keeps, any tombstone of the same file goes before those of others. The order
    only matters among symbols that compete for a tombstone, so it is settled in rounds: a symbol of whose tombstones no
    earlier one competes for any takes its best. What is left after ``ROUNDS`` is read in order by one task, which keeps
    the tombstones taken.
    """
    ws = Workspace(scores.sparkSession, "renames")
    order = [*(["cross_file"] if "cross_file" in scores.columns else []), F.desc("confidence"), "tomb_id"]
    left, won = ws.write(scores, "left0"), None
    for k in range(ROUNDS):
        # A symbol may win only if no earlier symbol still competes for any of its tombstones.
        first = left.groupBy("tomb_id").agg(F.min("symbol_id").alias("first"))
        mark = left.join(first, "tomb_id").groupBy("symbol_id").agg(F.max((F.col("first") < F.col("symbol_id")).cast("int")).alias("waits"))
        ready = left.join(mark.filter("waits = 0").select("symbol_id"), "symbol_id", "left_semi")
        w = Window.partitionBy("symbol_id").orderBy(*order)
        got = ws.write(ready.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n"), f"won{k}")
        if got.isEmpty():
            return won if won is not None else got
        won = got if won is None else won.unionByName(got)
        left = ws.write(left.join(got.select("symbol_id"), "symbol_id", "left_anti").join(got.select("tomb_id"), "tomb_id", "left_anti"), f"left{k + 1}")
        ws.drop(f"left{k}")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, settled = set(), None
        for b in batches:
            keep = []
            for i, (tomb, symbol) in enumerate(zip(b.column("tomb_id").to_pylist(), b.column("symbol_id").to_pylist())):
                if symbol != settled and tomb not in taken:
                    taken.add(tomb)
                    settled = symbol
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    rest = left.repartition(1).sortWithinPartitions("symbol_id", *order).mapInArrow(in_order, left.schema)
    return won.unionByName(ws.write(rest, "rest"))


def settled_renames(tombstones: DataFrame, symbols: DataFrame, policy: Policy, bodies: DataFrame | None = None) -> DataFrame:
    """``best_renames`` of ``all_rename_scores``, without the pairs of equal bodies, which grow as the square of their rows.

    With bodies (body_id, body), rows have a body_id instead of a body. Pairs within files are written; those across files
    stay pairs of token sets and the rows of each set. One task a branch reads its symbols in order and holds the tombstones
    of the sets that are alike.
    """
    ws = Workspace(tombstones.sparkSession, "settled", tidy=True)
    found = _Bodies(tombstones, symbols, bodies, policy, ws)
    within, alike, there = found.within(), found.alike(), found.rows
    ws.drop("sets", "own")
    kinds = dict(there.dtypes)
    fields = {"branch_id": kinds["branch_id"], "step": "int", "tomb_id": kinds["id"], "symbol_id": kinds["id"], "set_id": "binary", "old_id": "binary", "path": "string", "confidence": "double"}
    # Branches compete only if one of them has a symbol or tombstone of another.
    alone = there.groupBy("old", "id").agg((F.min("branch_id") < F.max("branch_id")).alias("several")).filter("several").isEmpty()

    def rows(df: DataFrame, step: int, **named: str) -> DataFrame:
        has = {"branch_id": F.col("branch_id"), "step": F.lit(step)} | {k: F.col(c) for k, c in named.items()}
        if not alone:
            has |= {k: F.concat(F.encode(F.concat(F.col("branch_id").cast("string"), F.lit(" ")), "UTF-8"), has[k]) for k in ("set_id", "old_id") if k in has}
        return df.select(*(has.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in fields.items()))

    pairs = rows(alike, 0, set_id="new_id", old_id="old_id", confidence="confidence")
    olds = rows(there.filter("old AND set_id IS NOT NULL"), 1, tomb_id="id", set_id="set_id", path="file_path")
    news = rows(there.filter("NOT old AND set_id IS NOT NULL"), 2, symbol_id="id", set_id="set_id", path="file_path")
    all_rows = pairs.unionByName(olds).unionByName(news).unionByName(rows(within, 2, tomb_id="tomb_id", symbol_id="symbol_id", confidence="confidence"))
    all_rows = all_rows.repartition("branch_id") if alone else all_rows.withColumn("branch_id", F.lit(0).cast(fields["branch_id"])).repartition(1)
    all_rows = all_rows.sortWithinPartitions("branch_id", "step", "symbol_id", F.desc("confidence"), "tomb_id").drop("step")
    won = ws.write(all_rows.mapInArrow(_settled, f"tomb_id {kinds['id']}, symbol_id {kinds['id']}, confidence double, cross_file boolean"), "won")
    ws.drop(*(x for x in [*ws.kept] if x != "won"))
    return won


class _Branch:
    """What the symbols of a branch, in order, have left to take."""

    def __init__(self) -> None:
        self.near: dict[bytes, list[tuple[float, bytes]]] = {}  # of a new set the old ones, the most alike first
        self.olds: dict[bytes, tuple[list[int], list[int]]] = {}  # of an old set its tombstones in order, and where the next is that may be left
        self.ids, self.paths, self.taken = [], [], set()

    def pair(self, new: bytes, old: bytes, confidence: float) -> None:
        self.near.setdefault(new, []).append((confidence, old))
        self.olds.setdefault(old, ([], []))

    def tombstone(self, tomb: object, own: bytes, path: str) -> None:
        if own in self.olds:
            at, after = self.olds[own]
            at.append(len(self.ids))
            after.append(len(after))
            self.ids.append(tomb)
            self.paths.append(path)

    def first(self, old: bytes, path: str) -> int | None:
        """The first tombstone of a set that is left and of another file."""
        at, after = self.olds[old]
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and (after[j] != j or self.ids[at[j]] in self.taken):
                if after[j] == j:
                    after[j] = j + 1
                j = after[j]
            while i < j:
                after[i], i = j, after[i]
            if j < len(at) and self.paths[at[j]] != path:
                return at[j]
            i = j + 1
        return None

    def best(self, within: list[tuple[object, float]], places: list[tuple[bytes, str]]) -> tuple[object, float, bool] | None:
        for tomb, confidence in within:
            if tomb not in self.taken:
                return tomb, confidence, False
        found = None
        for own, path in places:
            for confidence, old in self.near.get(own, ()):
                if found and confidence < found[0]:
                    break
                i = self.first(old, path)
                if i is not None and (not found or confidence > found[0] or i < found[1]):
                    found = confidence, i
        return (self.ids[found[1]], found[0], True) if found else None


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tombstone of each symbol that gets one, of branches one after the other: pairs of sets, then tombstones, then symbols, all in order."""
    state, branch, symbol, within, places, schema = _Branch(), None, None, [], [], None
    won: list[tuple] = []

    def settle() -> None:
        got = state.best(within, places) if symbol is not None else None
        if got:
            state.taken.add(got[0])
            won.append((got[0], symbol, got[1], got[2]))
        within.clear()
        places.clear()

    def told() -> pa.RecordBatch:
        columns = [[*x] for x in zip(*won)] or [[], [], [], []]
        won.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, schema)], ["tomb_id", "symbol_id", "confidence", "cross_file"])

    for b in batches:
        schema = [b.schema.field("tomb_id").type, b.schema.field("symbol_id").type, pa.float64(), pa.bool_()]
        for of, tomb, who, own, old, path, confidence in zip(*(b.column(c).to_pylist() for c in ("branch_id", "tomb_id", "symbol_id", "set_id", "old_id", "path", "confidence"))):
            if of != branch or who != symbol:
                settle()
                symbol = who
            if of != branch:
                state, branch = _Branch(), of
            if who is None and old is not None:
                state.pair(own, old, confidence)
            elif who is None:
                state.tombstone(tomb, own, path)
            elif own is not None:
                places.append((own, path))
            else:
                within.append((tomb, confidence))
        yield told()
    if schema:
        settle()
        yield told()


def tombstones_to_collect(revisions: DataFrame, bindings: DataFrame, snapshots: DataFrame, in_flight: DataFrame, edges: DataFrame, now_ms: int, days: int) -> DataFrame:
    """revision_id of tombstones old enough (or without a time) that no binding, snapshot, mutation or inbound edge needs.

    A tombstone is needed by inbound edges if another revision's edge points at its identity and it has a successor.
    """
    t = revisions.filter("status = 'Tombstone'").filter(F.col("tombstoned_at_ms").isNull() | (F.lit(now_ms) - F.col("tombstoned_at_ms") >= days * DAY_MS))
    for kept in (bindings, snapshots, in_flight):
        t = t.join(kept.select("revision_id").distinct(), "revision_id", "left_anti")
    bridged = edges.filter("ty = 'RenamedFrom'").select(F.col("source_revision_id").alias("revision_id")).distinct()
    aimed = edges.filter("ty != 'RenamedFrom'").select(F.col("target_identity_id").alias("identity_id")).distinct()
    needed = t.join(bridged, "revision_id", "left_semi").join(aimed, "identity_id", "left_semi").select("revision_id")
    return t.join(needed, "revision_id", "left_anti").select("revision_id")


def retained(old: DataFrame, fresh: DataFrame, has_children: bool) -> DataFrame:
    """(identity_id, action) of a file's symbols after a new parse: keep, tombstone, or hide where a child branch still inherits."""
    f = fresh.select("identity_id").distinct().withColumn("there", F.lit(True))
    gone = "hide" if has_children else "tombstone"
    return old.select("identity_id").distinct().join(f, "identity_id", "left").select("identity_id", F.when(F.col("there"), "keep").otherwise(gone).alias("action"))


def body_refcounts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "body_hash").distinct().filter("body_hash IS NOT NULL").groupBy("body_hash").agg(F.count(F.lit(1)).alias("refs"))


def retargeted(edges: DataFrame, revisions: DataFrame, branch_id: int) -> DataFrame:
    """(branch_id, source_revision_id, edge_id, new_target): overrides that turn the branch's live edges from renamed identities to their successors.

    Of several successors of an identity the least holds; an edge that already aims at it needs none.
    """
    mine = revisions.filter(F.col("branch_id") == branch_id).select("revision_id", "identity_id", "status")
    ren = edges.filter("ty = 'RenamedFrom'").join(mine.filter("status = 'Tombstone'").select(F.col("revision_id").alias("source_revision_id"), F.col("identity_id").alias("old_id")), "source_revision_id")
    ren = ren.groupBy(F.col("old_id").alias("target_identity_id")).agg(F.min("target_identity_id").alias("new_target"))
    live = mine.filter(F.col("status").isin("Active", "Speculative")).select(F.col("revision_id").alias("source_revision_id"))
    e = edges.filter("ty != 'RenamedFrom'").join(live, "source_revision_id", "left_semi").join(ren, "target_identity_id").filter("new_target != target_identity_id")
    return e.select(F.lit(branch_id).cast("bigint").alias("branch_id"), "source_revision_id", "edge_id", "new_target")


def finalized_deletions(revisions: DataFrame, deletions: DataFrame, branches: DataFrame) -> DataFrame:
    """revision_id of Active revisions hidden by a deletion marker on a branch that has no children: they become tombstones."""
    parents = branches.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("branch_id")).distinct()
    gone = deletions.select("branch_id", "identity_id").distinct().join(parents, "branch_id", "left_anti")
    return revisions.filter("status = 'Active'").join(gone, ["branch_id", "identity_id"], "left_semi").select("revision_id")


def drained(revisions: DataFrame, edges: DataFrame, overrides: DataFrame, collected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions, edges and overrides without the collected revisions and what starts at them."""
    c = collected.select("revision_id").distinct()
    s = c.withColumnRenamed("revision_id", "source_revision_id")
    return revisions.join(c, "revision_id", "left_anti"), edges.join(s, "source_revision_id", "left_anti"), overrides.join(s, "source_revision_id", "left_anti")
