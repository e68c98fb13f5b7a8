"""Scenarios of resolution, expansion, merging, renames, integrity, streaming and storage as small literal graphs."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.operators import merge as M
from brindle.operators import navigate as nav
from brindle.operators import patches as P
from brindle.operators import quality as A
from brindle.operators import retention as R
from brindle.operators import semantic as X
from brindle.operators.graph import Graph, Policy, View, branch_chain
from brindle.sources.store import Conflict, Store, convert, fingerprint
from brindle.sources.walk import changed_files, ignore_pattern, ignored, read_tree
from brindle.streaming import events as E

M_, F_ = 0, 1
REV = "revision_id bigint, identity_id bigint, branch_id bigint, status string, qualified_name string, file_path string, kind string, ts_ms bigint, doc_id bigint"
EDGE = "edge_id string, ty string, source_revision_id bigint, target_identity_id bigint, resolver string, last_validation_ms bigint"


def graph(spark, revisions, edges=(), overrides=(), deletions=(), fork=5, kinds=None):
    kinds = kinds or {}
    rows = [(r, i, b, s, f"f.py::n{i}", "f.py", kinds.get(i, "Function"), 0, 0) for r, i, b, s in revisions]
    return Graph(
        spark.createDataFrame([(M_, "main", None, None), (F_, "feature", M_, fork)], "branch_id bigint, name string, parent_id bigint, fork_ts_ms bigint"),
        spark.createDataFrame([(i, kinds.get(i, "Function")) for i in {r[1] for r in revisions}], "identity_id bigint, kind string"),
        spark.createDataFrame(rows, REV),
        spark.createDataFrame([(f"e{n}", ty, a, b, res, 0) for n, (ty, a, b, res) in enumerate(edges)], EDGE),
        spark.createDataFrame(list(overrides), "branch_id bigint, source_revision_id bigint, edge_id string, new_target bigint"),
        spark.createDataFrame(list(deletions), "branch_id bigint, identity_id bigint, deleted_at_ms bigint"),
        now_ms=0,
    )


def resolved(g, b=F_):
    return {r.identity_id: r.revision_id for r in View(g, b).resolved().collect()}


@pytest.mark.parametrize(
    ("revisions", "edges", "deletions", "want"),
    [
        ([(1, 1, M_, "Active")], (), (), {1: 1}),
        ([(1, 1, M_, "Active"), (2, 1, F_, "Speculative")], (), (), {1: 2}),
        ([(1, 1, F_, "Speculative"), (2, 1, F_, "Active")], (), (), {1: 2}),
        ([(1, 1, M_, "Active"), (2, 1, F_, "Tombstone")], (), (), {}),
        ([(1, 1, M_, "Active")], (), [(F_, 1, 99)], {}),
        ([(1, 1, M_, "Active")], (), [(M_, 1, 10)], {1: 1}),
        ([(1, 1, M_, "Active")], (), [(M_, 1, 4)], {}),
        ([(1, 1, M_, "Tombstone"), (2, 2, F_, "Active")], [("RenamedFrom", 1, 2, "Ast")], (), {1: 2, 2: 2}),
        ([(1, 1, M_, "Tombstone"), (2, 2, F_, "Active")], [("RenamedFrom", 1, 2, "Ast")], [(F_, 2, 1)], {}),
        ([(1, 1, M_, "Orphaned")], (), (), {}),
    ],
)
def test_resolution(spark, revisions, edges, deletions, want):
    assert resolved(graph(spark, revisions, edges, deletions=deletions)) == want


def test_chain_stops_at_cycles(spark):
    b = spark.createDataFrame([(0, 1), (1, 0), *((i, i + 1) for i in range(10, 40))], "branch_id bigint, parent_id bigint")
    assert branch_chain(b, 0) == [0, 1] and len(branch_chain(b, 10)) == 11 and branch_chain(b, 77) == [77]


def test_overrides_turn_edges(spark):
    revs = [(1, 1, M_, "Active"), (2, 2, M_, "Active"), (3, 3, M_, "Active")]
    g = graph(spark, revs, [("Calls", 1, 2, "Ast")], [(M_, 1, "e0", 3)])
    got = {(r.target_id, r.source_identity_id) for r in View(g, F_).inbound().collect()}
    assert got == {(3, 1)}
    g = graph(spark, revs, [("Calls", 1, 2, "Ast")], [(M_, 1, "e0", 3), (F_, 1, "e0", 2)])
    assert {(r.target_id, r.source_identity_id) for r in View(g, F_).inbound().collect()} == {(2, 1)}


def test_expansion_prunes_weak_paths_and_stops_at_stubs(spark):
    revs = [(i, i, M_, "Active") for i in range(1, 6)]
    edges = [("Calls", 1, 2, "Textual"), ("Calls", 2, 3, "Ast"), ("Calls", 1, 4, "Ast"), ("Calls", 4, 5, "Ast"), ("Imports", 1, 9, "Ast")]
    v = View(graph(spark, revs, edges, kinds={4: "Stub"}), M_)
    hits, pruned = nav.expand_context(v, spark.createDataFrame([(1,)], "start_id bigint"), 4)
    assert {r.revision_id: (r.level, round(r.conf, 3)) for r in hits.collect()} == {1: (0, 0.6), 2: (1, 0.3), 4: (1, 0.6)}
    assert [r.pruned for r in pruned.collect()] == [2]


def test_definition_prefers_symbols(spark):
    revs = [(i, i, M_, "Active") for i in range(1, 5)]
    v = View(graph(spark, revs, [("Extends", 1, 2, "Ast"), ("Imports", 1, 3, "Ast"), ("Calls", 1, 4, "Ast"), ("Imports", 4, 2, "Ast")], kinds={2: "File"}), M_)
    assert {r.revision_id: r.target_revision_id for r in nav.definitions(v).collect()} == {1: 3, 4: 2}


# --- merging


@pytest.mark.parametrize(
    ("b", "o", "t", "want"),
    [
        (None, None, None, "Clean"), (None, "x", None, "OursNew"), (None, None, "x", "TheirsNew"), (None, "x", "x", "BothModifiedSame"), (None, "x", "y", "BothNewDivergent"),
        ("x", "x", "x", "Clean"), ("x", "x", "y", "TheirsOnly"), ("x", "y", "x", "OursOnly"), ("x", "y", "y", "BothModifiedSame"), ("x", "y", "z", "BothModifiedUnresolved"),
        ("x", "x", None, "TheirsOnly"), ("x", "y", None, "TheirsDeletedOursModified"), ("x", None, "x", "OursOnly"), ("x", None, "y", "OursDeletedTheirsModified"), ("x", None, None, "BothDeleted"),
    ],
)
def test_merge_classes(spark, b, o, t, want):
    df = spark.createDataFrame([(b, o, t)], "b string, o string, t string")
    assert df.select(M.merge_class(F.col("b"), F.col("o"), F.col("t"))).head()[0] == want


def test_merge_with_rename_and_conflict(spark):
    side = "identity_id bigint, revision_id bigint, body_hash string, rename_source_id bigint"
    base = spark.createDataFrame([(1, 10, "a", None), (2, 20, "a", None)], side)
    ours = spark.createDataFrame([(1, 10, "a", None), (2, 21, "b", None)], side)
    theirs = spark.createDataFrame([(3, 30, "a", 1), (2, 22, "c", None)], side)
    c = M.classify(base, ours, theirs)
    assert {r.identity_id: r["class"] for r in c.collect()} == {1: "BothDeleted", 2: "BothModifiedUnresolved", 3: "RenamedCandidate"}
    assert {r.identity_id: (r.winner, r.action) for r in M.promote(c).collect()} == {1: (None, "unbind"), 2: (None, "unresolved"), 3: (30, "bind")}
    p = M.promote(c, "ours")
    assert {(r.identity_id, r.winner, r.loser) for r in p.collect()} == {(1, None, None), (2, 21, 22), (3, 30, None)}
    target = spark.createDataFrame([(1, 10), (2, 21), (4, 40)], "identity_id bigint, revision_id bigint")
    assert {tuple(r) for r in M.upsert_bindings(target, p).collect()} == {(2, 21), (3, 30), (4, 40)}
    assert {r.label: r.n for r in M.merge_report(c).collect()} == {"resolved": 1, "conflict": 1, "rename": 1}


# --- renames


def test_renames(spark):
    body = "def {}(a):\n    total = price * quantity\n    return round(total, digits)\n"
    t = [(1, "f.py", "Function", "f.py::get_total", body.format("get_total")), (2, "f.py", "Function", "f.py::f.py", None), (3, "g.py", "Function", "g.py::load", "open read close")]
    s = [(10, "f.py", "Function", "f.py::fetch_total", body.format("fetch_total")), (11, "f.py", "Function", "f.py::get_totals", body.format("get_totals")), (12, "g.py", "Function", "g.py::loads", "entirely different words here")]
    fields = "id bigint, file_path string, kind string, qualified_name string, body string"
    scores = R.rename_scores(spark.createDataFrame(t, fields), spark.createDataFrame(s, fields), Policy())
    assert {(r.tomb_id, r.symbol_id) for r in scores.collect()} == {(1, 10), (1, 11)}
    assert [(r.tomb_id, r.symbol_id) for r in R.best_renames(scores).collect()] == [(1, 10)]


def test_best_renames_follow_the_order_of_symbols(spark):
    import random

    rng = random.Random(1)
    rows = {(rng.randrange(12), rng.randrange(12)): rng.randrange(5) / 10 + 0.5 for _ in range(60)}
    want, taken = set(), set()
    for s in sorted({k[1] for k in rows}):
        free = sorted((-c, t) for (t, x), c in rows.items() if x == s and t not in taken)
        if free:
            taken.add(free[0][1])
            want.add((free[0][1], s))
    df = spark.createDataFrame([(t, s, c) for (t, s), c in rows.items()], "tomb_id bigint, symbol_id bigint, confidence double")
    assert {(r.tomb_id, r.symbol_id) for r in R.best_renames(df).collect()} == want


def _literal_renames(tombs, symbols):
    """Scores and assignment of literal rows (branch, id, path, kind, name, body) by plain loops, across files only."""
    import re

    stop = {"def", "async", "return", "pass", "none", "true", "false", "self", "cls", "class"}
    toks = lambda x: set(re.findall("[a-z0-9_]+", (x or "").lower()))
    out = {}
    for tb, ti, tp, tk, tn, tx in tombs:
        for sb, si, sp, sk, sn, sx in symbols:
            a, b = toks(tx), toks(sx)
            if tb == sb and tp != sp and tk != "File" and sk != "File" and len(a - stop) >= 2 and len(b - stop) >= 2 and len(a & b) >= 0.7 * len(a | b):
                out[ti, si] = len(a & b) / len(a | b)
    return out


def test_renames_across_files(spark):
    fields = "branch_id bigint, id bigint, file_path string, kind string, qualified_name string, body string"
    body = "def total(a):\n    return price * quantity + digits"
    t = [(1, 1, "f.py", "Function", "f.py::total", body), (1, 2, "f.py", "File", "f", body), (2, 3, "f.py", "Function", "f.py::total", body), (1, 4, "f.py", "Function", "f.py::stub", "def stub(): return self"), (1, 5, "h.py", "Class", "h.py::total", body)]
    s = [(1, 10, "g.py", "Class", "g.py::total", body), (1, 11, "h.py", "Function", "h.py::total", body), (1, 12, "g.py", "Function", "g.py::stub", "def stub(): return self"), (1, 13, "g.py", "Function", "g.py::x", "price quantity of other words altogether")]
    df = lambda x: spark.createDataFrame(x, fields)
    got = R.all_rename_scores(df(t), df(s), Policy())
    assert {(r.tomb_id, r.symbol_id, r.cross_file) for r in got.collect()} == {(1, 10, True), (5, 10, True), (1, 11, True), (5, 11, False)}
    assert {(r.tomb_id, r.symbol_id) for r in R.best_renames(got).collect()} == {(1, 10), (5, 11)}


def test_renames_across_files_at_random(spark):
    import random

    rng = random.Random(4)
    words = ["def", "return", *(f"w{i}" for i in range(7))]
    row = lambda i: (rng.randrange(2), i, f"f{rng.randrange(4)}.py", rng.choice(["Function", "Class"]), f"n{i}", " ".join(rng.sample(words, rng.randrange(1, 9))) if rng.random() < 0.95 else None)
    t, s = [row(i) for i in range(90)], [row(1000 + i) for i in range(90)]
    fields = "branch_id bigint, id bigint, file_path string, kind string, qualified_name string, body string"
    got = {(r.tomb_id, r.symbol_id): r.confidence for r in R.cross_file_scores(spark.createDataFrame(t, fields), spark.createDataFrame(s, fields), Policy()).collect()}
    want = _literal_renames(t, s)
    assert len(want) > 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_pairs_of_unlike_bodies_are_compared(spark):
    import random

    from brindle.workspace import Workspace

    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        toks = rng.sample(words, 60)
        rows.append((i % 2, b"a%d" % i, sorted(toks), True, False))
        rows.append((i % 2, b"b%d" % i, sorted(toks[rng.randrange(12) :] + rng.sample(words, rng.randrange(4))), False, True))
    rows = [(b, i, sorted(set(t)), old, new) for b, i, t, old, new in rows]
    sets = spark.createDataFrame(rows, "branch_id bigint, set_id binary, toks array<string>, old boolean, new boolean")
    got = {(bytes(r.old_id), bytes(r.new_id)) for r in R._similar_sets(sets, 0.7, Workspace(spark, "test")).collect()}
    alike = lambda x, y: len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y))
    want = {(i, j) for b, i, t, old, _ in rows for c, j, u, _, new in rows if old and new and b == c and alike(t, u)}
    assert len(want) > 100 and want <= got and len(got) < 2 * len(want)


def test_many_equal_bodies_are_settled_in_order(spark):
    df = spark.createDataFrame([(t, 100 + s, 1.0, s % 2 == 0) for t in range(20) for s in range(25)], "tomb_id bigint, symbol_id bigint, confidence double, cross_file boolean")
    assert {(r.tomb_id, r.symbol_id) for r in R.best_renames(df).collect()} == {(i, 100 + i) for i in range(20)}


# --- integrity, scores


def test_settled_renames_are_the_best_of_all_scores(spark):
    import random

    rng = random.Random(9)
    words = ["def", "return", *(f"w{i}" for i in range(6))]
    bodies = [" ".join(rng.sample(words, rng.randrange(2, 9))) for _ in range(12)]
    fields = "branch_id bigint, id bigint, file_path string, kind string, qualified_name string, body string"
    for shared in (False, True):  # whether a symbol may be new on two branches
        row = lambda i: (rng.randrange(2), i, f"f{rng.randrange(6)}.py", rng.choice(["Function", "Class"]), f"n{rng.randrange(30)}", rng.choice([*bodies, None]))  # noqa: B023, E731
        sides = [[row(i) for i in range(120)], [row(1000 + (i // 2 if shared else i)) for i in range(120)]]
        t, s = (spark.createDataFrame(x, fields) for x in sides)
        scores = {(r.tomb_id, r.symbol_id, r.cross_file, r.confidence) for r in R.all_rename_scores(t, s, Policy()).collect()}
        want, taken = set(), set()
        for who in sorted({x[1] for x in scores}):
            free = sorted((cross, -c, tomb) for tomb, x, cross, c in scores if x == who and tomb not in taken)
            if free:
                taken.add(free[0][2])
                want.add((free[0][2], who, -free[0][1], free[0][0]))
        assert {(r.tomb_id, r.symbol_id, r.confidence, r.cross_file) for r in R.settled_renames(t, s, Policy()).collect()} == want
        assert len(want) > 40 and {x[3] for x in want} == {False, True}


def test_pairs_of_equal_bodies_are_not_written(spark, monkeypatch):
    from brindle.operators import identity as I
    from brindle.workspace import Workspace

    written, write = {}, Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    body, n = "def total(a): return price * quantity + digits", 150
    t = spark.createDataFrame([(1, i, i, f"old{i}.py", "Function", f"old{i}.py::a", body, 0) for i in range(n)], "branch_id bigint, revision_id bigint, identity_id bigint, file_path string, kind string, qualified_name string, body string, tombstoned_at_ms bigint")
    s = spark.createDataFrame([(1, 1000 + i, f"new{i}.py", "Function", f"new{i}.py::b", body) for i in range(n)], "branch_id bigint, symbol_id bigint, file_path string, kind string, qualified_name string, body string")
    got = {(r.symbol_id, r.identity_id) for r in I.resolve_or_create(s, t, Policy(rename_window_days=0), 0).collect()}
    assert got == {(1000 + i, i) for i in range(n)} and max(written.values()) <= 2 * n


def test_resolved_identities_store_little(spark, monkeypatch):
    """Of the graph only what is read, and no text or tokens of a body for each row that has it."""
    import __spark_entry__ as entry
    from brindle.plans import fixture
    from brindle.workspace import Workspace

    written, write = {}, Workspace.write

    def noted(self, df, name):
        out = write(self, df, name)
        written[name] = out
        return out

    monkeypatch.setattr(Workspace, "write", noted)
    for kept in ("_STORED", "_RELATIONS"):
        monkeypatch.setattr(fixture, kept, {}, raising=False)
    d = "/root/testdata/sf0.001"
    n = entry.queries()["i5_resolved_identities"](spark, d).count()
    assert n == spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'O'").count()
    assert {x for x in written if x.startswith("g_")} == {"g_identities", "g_revisions"}
    assert all(not {"body", "toks"} & {*written[x].columns} for x in written if x.startswith(("old", "new", "rows", "within")))


def test_renames_in_parts_and_of_bodies_by_id(spark, monkeypatch):
    import random

    rng = random.Random(11)
    words = ["def", "Name", "return", *(f"w{i}" for i in range(7))]
    bodies = [*(" ".join(rng.sample(words, rng.randrange(1, 10))) for _ in range(25)), None]
    row = lambda i: (rng.randrange(2), i, f"f{rng.randrange(5)}.py", rng.choice(["Function", "Class"]), rng.choice(["x.Name", f"n{rng.randrange(30)}"]), rng.randrange(28))
    sides = [[row(i) for i in range(150)], [row(1000 + i) for i in range(150)]]
    fields = "branch_id bigint, id bigint, file_path string, kind string, qualified_name string, "
    t, s = (spark.createDataFrame([(*x[:5], bodies[x[5]] if x[5] < len(bodies) else None) for x in rows], fields + "body string") for rows in sides)
    scores = sorted(((r.symbol_id, r.cross_file, -r.confidence, r.tomb_id) for r in R.all_rename_scores(t, s, Policy()).collect()))
    want, taken, served = set(), set(), set()
    for who, cross, confidence, tomb in scores:
        if who not in served and tomb not in taken:
            served.add(who)
            taken.add(tomb)
            want.add((tomb, who, -confidence, cross))
    by_id = [spark.createDataFrame(rows, fields + "body_id bigint") for rows in sides]
    texts = spark.createDataFrame([*enumerate(bodies)], "body_id bigint, body string")
    told = lambda df: {(r.tomb_id, r.symbol_id, r.confidence, r.cross_file) for r in df.collect()}
    assert len(want) > 60 and told(R.settled_renames(*by_id, Policy(), texts)) == want
    for name, value in (("PART_ROWS", 40), ("BLOCK", 3), ("FREQUENT_TOKENS", 5)):
        monkeypatch.setattr(R, name, value)
    assert told(R.settled_renames(*by_id, Policy(), texts)) == want


def test_audit_chain(spark):
    rec = spark.createDataFrame([(i * 10, i % 2, "a") for i in range(9)], "ts_ms bigint, session_id bigint, action string")
    chain = A.chain_epochs(A.seal_epochs(rec, 30))
    assert tuple(A.verify_chain(chain).head()) == (True, 3, None)
    assert tuple(A.verify_chain(chain.withColumn("prev", F.when(F.col("epoch_id") == 1, "x").otherwise(F.col("prev")))).head()) == (False, 3, 1)
    assert tuple(A.verify_chain(chain.limit(0)).head()) == (True, 0, None)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("k", v) for v in (10, 20, 30, 40, 100)], "k string, v bigint")
    assert tuple(A.delay_percentiles(df, "k", "v", {"p50": 0.5, "p99": 0.99}).head()) == ("k", 30, 100)


def test_scores(spark):
    row = spark.range(1).select(
        S.structural_score(F.lit("AB"), F.lit("abab")).alias("a"), S.structural_score(F.lit(""), F.lit("x")).alias("b"), S.name_leaf(F.lit("a.py::C.m")).alias("c"), S.name_proximity(F.lit("x::load"), F.lit("y::loads")).alias("d"),
        S.mask_identifier(F.lit("get(get_x, get)"), F.lit("get")).alias("e"), S.token_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("f"), S.freshness(F.lit(0), 100, 30).alias("g"), S.token_count(F.lit("éé")).alias("h"),
        S.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("i"), S.freshness(F.lit(1), 10**13, 30).alias("j"),
    ).head()
    assert tuple(row) == (2.25, 0.0, "m", 0.8, "__brindle_nm__(get_x, __brindle_nm__)", 1.0, 1.0, 1, 0.0, 0.5)


def test_truncation_keeps_characters_whole(spark):
    df = spark.createDataFrame([("a" * 9,), ("é" * 9,), ("a" + "漢" * 5,), ("ab😀😀",), ("",), (None,)], "t string")
    out, cut, left = X.truncated(F.col("t"), 1)
    got = [(r[0].split("\n")[0] if r[0] else r[0], r[1], r[2]) for r in df.select(out, cut, left).collect()]
    assert got == [("aaaa", True, 2), ("éé", True, 4), ("a漢", True, 3), ("ab", True, 2), ("", False, 0), (None, None, 0)]


def test_anchors_and_snapshots(spark):
    assert X.parse_anchor("10") == ("log", 16) and X.parse_anchor("0xff") == ("log", 255) and X.parse_anchor("a" * 40) == ("git", "a" * 40)
    with pytest.raises(ValueError):
        X.parse_anchor("head")
    ris = spark.createDataFrame([(1, 1, 10), (2, 1, 11)], "epoch bigint, identity_id bigint, revision_id bigint")
    live = spark.createDataFrame([(1, 12), (2, 20)], "identity_id bigint, revision_id bigint")
    assert {tuple(r) for r in X.snapshot_at(ris, live, 1).collect()} == {(1, 10), (2, 20)}
    assert {tuple(r) for r in X.snapshot_at(ris, live, 1, strict=True).collect()} == {(1, 10)}


def test_policy():
    with pytest.raises(ValueError):
        Policy(semantic=0.5)
    with pytest.raises(ValueError):
        Policy(lwm=9000)
    with pytest.raises(ValueError):
        Policy.from_mapping({"colour": 1})
    assert Policy.from_mapping({"max_hops": 2}).max_hops == 2
    p = Policy.from_text("# tuned\nranking:\n  max_hops: 5  # far\n  semantic: 0.1\n  structural: 0.5\n")
    assert (p.max_hops, p.semantic, p.hwm) == (5, 0.1, 5000)
    assert p.reloaded("hwm: 9").hwm == 5000 and p.reloaded("colour: 1") is p and p.reloaded("max_hops: many") is p and p.reloaded("max_hops: 4").max_hops == 4


# --- patches, trees, storage


def test_patches(spark):
    before = "a\nb\nc\nd\n"
    assert P.apply_patch(before, "--- x\n+++ x\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n@@ -4 +4,2 @@\n d\n+e\n") == "a\nB\nc\nd\ne\n"
    assert P.apply_patch(before, "all new\n") == "all new\n"
    with pytest.raises(ValueError):
        P.apply_patch(before, "@@ -1,2 +1,2 @@\n a\n-x\n+y\n")
    r = spark.createDataFrame([(1, "p", "Speculative", None), (2, "p", "Active", None), (3, "q", "Speculative", None)], "revision_id bigint, file_path string, status string, tombstoned_at_ms bigint")
    p = spark.createDataFrame([("p",)], "path string")
    assert {(x.revision_id, x.status, x.tombstoned_at_ms) for x in P.settle(r, p, False, 7).collect()} == {(1, "Tombstone", 7), (2, "Active", None), (3, "Speculative", None)}
    assert {x.status for x in P.settle(r, p, True, 7).filter("revision_id = 1").collect()} == {"Active"}


def test_tree(spark, tmp_path):
    for name in ("src/a.py", "src/b.min.js", "node_modules/x.js", "docs/c.md", "gen/d.py", "gen/keep.py", "src/e.go"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    got = {r.path: r.language for r in read_tree(spark, str(tmp_path), ["gen/*", "!gen/keep.py", "# note", "*.go"]).collect()}
    assert got == {"src/a.py": "Python", "gen/keep.py": "Python"}
    (tmp_path / "src" / ".gitignore").write_text("# all but one\n*.py\n!a.py\n")
    (tmp_path / "src" / "c.py").write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("gen/\n")
    assert {r.path for r in read_tree(spark, str(tmp_path)).collect()} == {"src/a.py", "src/e.go"}
    assert {r.path for r in read_tree(spark, str(tmp_path), ignore_files=False).collect()} == {"src/a.py", "src/c.py", "src/e.go", "gen/d.py", "gen/keep.py"}
    rules = [ignore_pattern(r) for r in ("build/", "/top.py", "a/**/z.py", "?.js")]
    df = spark.createDataFrame([(p,) for p in ("x/build/a.py", "top.py", "x/top.py", "a/b/c/z.py", "a/z.py", "q/x.js", "xx.js", "builder/a.py")], "p string")
    assert {r.p for r in df.filter(ignored(F.col("p"), rules)).collect()} == {"x/build/a.py", "top.py", "a/b/c/z.py", "a/z.py", "q/x.js"}
    a, b = (spark.createDataFrame(x, "path string, modified bigint") for x in ([("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 2), ("d", 1)]))
    assert {tuple(r) for r in changed_files(a, b).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_store(spark, tmp_path, fmt):
    s = Store(spark, str(tmp_path / "s"), fmt)
    a, b = spark.createDataFrame([(1, "x")], "i bigint, t string"), spark.createDataFrame([(2, "y")], "i bigint, t string")
    assert s.current() is None and s.publish({"t": a, "u": b}) == 1 and s.publish({"t": b}) == 2
    assert [tuple(r) for r in s.read("t").collect()] == [(2, "y")] and [tuple(r) for r in s.read("t", 1).collect()] == [(1, "x")] and s.read("u").count() == 1
    with pytest.raises(KeyError):
        s.read("nothing")
    with pytest.raises(Conflict):
        s.publish({"t": a}, expected=1)
    assert s.publish({"t": a}, expected=2) == 3
    (tmp_path / "s" / "heads" / f"{4:020d}.json").write_text("")  # a writer that died
    assert s.current()[0] == 3 and s.publish({"t": b}) == 5
    s._last = lambda: 4  # a writer that has not seen the fifth version
    with pytest.raises(Conflict):
        s.publish({"t": a})
    other = Store(spark, str(tmp_path / "o"), "parquet")
    assert convert(spark, s, other, ["t"]) == 1 and other.read("t").schema == b.schema
    assert fingerprint(a.union(a)) != fingerprint(a) != fingerprint(b) and fingerprint(a.union(b)) == fingerprint(b.union(a))


# --- streams


def test_debounce(spark):
    rows = [(0, "a", "Created", 0, 1), (0, "a", "Modified", 200, 2), (0, "a", "Deleted", 900, 3), (0, "b", "Modified", 100, 4)]
    df = spark.createDataFrame(rows, "branch_id int, path string, kind string, ts_ms bigint, event_id bigint")
    assert {(r.path, r.kind, r.coalesced) for r in E.debounced(df).collect()} == {("a", "Modified", 2), ("a", "Deleted", 1), ("b", "Modified", 1)}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(0, "a", "Created", "2024-01-01 00:00:00.0"), (0, "a", "Modified", "2024-01-01 00:00:00.2"), (0, "a", "Deleted", "2024-01-01 00:00:09"), (0, "z", "Modified", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "branch_id int, path string, kind string, t string").select("branch_id", "path", "kind", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("branch_id int, path string, kind string, ts timestamp").parquet(src)
    q = E.debounce_stream(stream).writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.path, r.kind, r.coalesced) for r in spark.table("debounced").collect()} == {("a", "Modified", 2), ("a", "Deleted", 1)}
    seen = []
    E.ingest_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 4


def test_hysteresis(spark, tmp_path):
    d = spark.createDataFrame([(0, 10), (1, 60), (2, 30), (3, 5), (4, 6), (5, 4), (6, 30)], "ts_ms bigint, depth bigint")
    assert [r.degraded for r in E.backlog_states(d, 50, 10, 2).orderBy("ts_ms").collect()] == [False, True, True, True, True, False, False]
    src = str(tmp_path / "q")
    d.withColumn("queue", F.lit("q")).coalesce(1).write.parquet(src)
    s = E.hysteresis_stream(spark.readStream.schema("queue string, ts_ms bigint, depth bigint").parquet(src), 50, 10, 2)
    q = s.writeStream.outputMode("append").format("memory").queryName("hyst").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.degraded for r in spark.table("hyst").orderBy("ts_ms").collect()] == [False, True, True, True, True, False, False]


def test_missed_events_orphan_tokens_and_ttl(spark):
    disk = spark.createDataFrame([("a", 5_000), ("b", 5_000), ("c", 900)], "path string, mtime bigint")
    indexed = spark.createDataFrame([("a", 4_900), ("b", 1_000)], "path string, indexed_ms bigint")
    assert [tuple(r) for r in E.missed_events(disk, indexed).collect()] == [("b", 5_000), ("c", 900)]
    tokens, patches = spark.createDataFrame([("p1",), ("p2",)], "patch_id string"), spark.createDataFrame([("p1",)], "patch_id string")
    assert [r.patch_id for r in P.orphan_tokens(tokens, patches).collect()] == ["p2"]
    wal = spark.createDataFrame([(i, "Committed") for i in range(9)], "log_id bigint, phase string")
    assert A.compacted_wal(wal, 100, 300).count() == 3 and A.compacted_wal(wal, 100, 300, merging=True).count() == 9


def test_logs(spark, tmp_path):
    from brindle.sources.logs import MERGE_METRICS, append_log, last_records, read_log

    at = str(tmp_path / "log")
    rows = [(f"m{i}", i * 10, {"a": i, "b": 2 * i}, i, i == 3, "b" if i == 2 else None, []) for i in range(1, 6)]
    append_log(spark.createDataFrame(rows, MERGE_METRICS), at)
    with open(f"{at}/bad.json", "w") as f:
        f.write("{not json\n")
    log = read_log(spark, at, MERGE_METRICS)
    assert {r.merge_id for r in log.collect()} == {f"m{i}" for i in range(1, 6)}
    assert {r.merge_id for r in last_records(log, 2).collect()} == {"m5", "m4"}
    assert {r.merge_id for r in last_records(log, 0, 50).collect()} == {"m5"}
    assert {r.phase: (r.n, r.avg_ms, r.p99_ms) for r in A.merge_rollup(log).collect()} == {"a": (5, 3.0, 5), "b": (5, 6.0, 10)}
    assert [r.total_ms for r in A.slowest_merges(log, 2).collect()] == [15, 12]
    assert tuple(A.merge_summary(log).head()) == (5, 0.2, 0.2, 3.0)


def test_snippets(spark):
    from brindle.functions.snippets import body_snippet

    text = "def a():\n    x = 1\n\n\ty\nz\r\nend\n"
    rows = [(1, 1, "def a():\n    x = 1\n\n\ty"), (1, 2, "def a():\n    x = 1"), (5, 5, "z"), (6, 99, "end"), (0, 3, ""), (7, 7, ""), (3, 3, "\n\ty")]
    for a, b, want in rows:
        df = spark.createDataFrame([(text, a, b)], "t string, a int, b int")
        assert df.select(body_snippet(F.col("t"), F.col("a"), F.col("b"))).head()[0] == want
    df = spark.createDataFrame([(None, 1, 1), ("", 1, 2), ("x", None, 1)], "t string, a int, b int")
    assert [r[0] for r in df.select(body_snippet(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["", "", ""]


def test_edits_and_reverts(spark):
    files = spark.createDataFrame([("a.py", "one\ntwo\n")], "path string, content string")
    diff = "@@ -1,2 +1,2 @@\n one\n-two\n+three\n"
    edits = [("p1", "a.py", diff, 1), ("p2", "a.py", diff, 2), ("p3", "a.py", "whole", 3), ("p4", "../b.py", "x", 4), ("p5", "new.py", "x", 5), ("p6", "a.py", None, 6)]
    got = P.apply_edits(files, spark.createDataFrame(edits, "patch_id string, path string, text string, seq bigint"))
    by = {r.patch_id: r for r in got.collect()}
    assert by["p1"].after == "one\nthree\n" and by["p2"].error and by["p2"].after is None and (by["p3"].before, by["p3"].after) == ("one\nthree\n", "whole")
    assert by["p4"].error == "path outside the root" and by["p5"].before is None and by["p6"].error == "no text"
    done = got.filter("error IS NULL").join(spark.createDataFrame([(e[0], e[3]) for e in edits], "patch_id string, seq bigint"), "patch_id")
    back = {r.patch_id: (r.action, r.content) for r in P.reverted(done, done).collect()}
    assert back == {"p1": ("superseded", None), "p3": ("restore", "one\nthree\n"), "p5": ("remove", None)}
