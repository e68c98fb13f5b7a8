"""Operators that change tables: identities of new symbols, batches of file events, merges that stop, resume and are taken back."""

import pytest

from brindle.operators import applying as W
from brindle.operators import identity as I
from brindle.operators.graph import Policy
from brindle.operators.merging import Locked, Merges, Speculative
from brindle.sources.store import Store

DAY = 86_400_000
OLD = "branch_id bigint, revision_id string, identity_id string, file_path string, kind string, qualified_name string, body string, tombstoned_at_ms bigint"
NEW = "branch_id bigint, symbol_id string, file_path string, kind string, qualified_name string, body string"
SUM = "def total(rows):\n    amount = 0\n    for row in rows:\n        amount += row.price * row.count\n    return amount"
AREA = "def area(shape):\n    width = shape.right - shape.left\n    return width * shape.height"


def took(spark, old, new, window=30):
    tombs = spark.createDataFrame([(1, f"t{i}", f"old{i}", f, "Function", f"{f}::{n}", b, 99 * DAY) for i, (f, n, b) in enumerate(old)], OLD)
    syms = spark.createDataFrame([(1, f"s{i}", f, "Function", f"{f}::{n}", b) for i, (f, n, b) in enumerate(new)], NEW)
    return {r.symbol_id: (r.identity_id, r.resolver) for r in I.resolve_or_create(syms, tombs, Policy(rename_window_days=window), 100 * DAY).collect()}


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        # renamed within a file, with its body; by its name alone; moved to another file
        (("a.py", "total", SUM), ("a.py", "sum_up", SUM.replace("total", "sum_up")), ("old0", "Ast")),
        (("a.py", "load_table", None), ("a.py", "load_tables", None), ("old0", "Textual")),
        (("a.py", "total", SUM), ("b.py", "total", SUM), ("old0", "Ast")),
        # another body; another name without a body; a moved body with too few words; a moved body that only resembles; a hub
        (("a.py", "total", SUM), ("a.py", "total2", AREA), ("s0", None)),
        (("a.py", "total", None), ("a.py", "measure", None), ("s0", None)),
        (("a.py", "f", "def f(): return None"), ("b.py", "f", "def f(): return None"), ("s0", None)),
        (("a.py", "total", SUM), ("b.py", "total", SUM.replace("amount", "n").replace("price", "p").replace("row", "line")), ("s0", None)),
        (("a.py", "total", None), ("b.py", "total", None), ("s0", None)),
    ],
)
def test_identity_of_a_new_symbol(spark, old, new, want):
    assert took(spark, [old], [new]) == {"s0": want}


def test_a_tombstone_is_taken_once_and_its_own_file_comes_first(spark):
    got = took(spark, [("b.py", "total", SUM), ("a.py", "total", SUM)], [("a.py", "sum_up", SUM), ("c.py", "total", SUM), ("d.py", "total", SUM)])
    assert got == {"s0": ("old1", "Ast"), "s1": ("old0", "Ast"), "s2": ("s2", None)}
    assert took(spark, [("a.py", "total", SUM)], [("a.py", "sum_up", SUM)], window=0) == {"s0": ("old0", "Ast")}


def test_stable_disambiguators(spark):
    rows = [("a", "foo", "Class", "class", 1), ("a", "foo", "Function", "fn:0", 2), ("a", "foo", "Function", "", 3), ("a", "bar", "Function", "", 4), ("b", "foo", "Function", "fn:0", 1), ("b", "foo", "Function", "", 2)]
    s = spark.createDataFrame(rows, "path string, key string, kind string, disambiguator string, ord bigint")
    live = spark.createDataFrame([("a", "foo", "Class"), ("a", "bar", "Class"), ("b", "foo", "Function")], "path string, key string, kind string")
    assert {(r.path, r.key, r.ord): r.disambiguator for r in I.stabilized(s, live).collect()} == {("a", "foo", 1): "", ("a", "foo", 2): "fn:0", ("a", "foo", 3): "fn:1", ("a", "bar", 4): "", ("b", "foo", 1): "fn:0", ("b", "foo", 2): ""}


EVENT = "branch_id bigint, path string, old_path string, kind string, seq bigint"
SYMBOL = "path string, symbol_id string, kind string, qualified_name string, body string"
CALL = "source_symbol string, ty string, target_identity_id string, resolver string"


def empty(spark, branches=((1, None),)):
    df = lambda f: spark.createDataFrame([], f)
    rev = "branch_id bigint, identity_id string, revision_id string, status string, kind string, qualified_name string, file_path string, body_hash string, parent_revision_id string, rename_source_id string, tombstoned_at_ms bigint, ts_ms bigint"
    return W.Tables(spark.createDataFrame(list(branches), "branch_id bigint, parent_id bigint"), df(rev), df("edge_id string, ty string, source_revision_id string, target_identity_id string, resolver string, last_validation_ms bigint"), df("branch_id bigint, source_revision_id string, edge_id string, new_target string"), df("branch_id bigint, identity_id string, revision_id string"), df("branch_id bigint, identity_id string, deleted_at_ms bigint"), df("body_hash string, body string"))


def batch(spark, t, events, symbols=(), calls=(), now=DAY, locked=()):
    return W.apply_events(t, spark.createDataFrame(list(events), EVENT), spark.createDataFrame([(p, f"{p}:{n}", "Function", f"{p}::{n}", b) for p, n, b in symbols], SYMBOL), spark.createDataFrame(list(calls), CALL), now, locked=spark.createDataFrame([(b,) for b in locked], "branch_id bigint"))


def state(t):
    r = t.revisions.collect()
    bound = {(b.branch_id, b.identity_id): b.revision_id for b in t.bindings.collect()}
    assert {(x.branch_id, x.identity_id) for x in r if x.status == "Active"} >= set(bound) and len(r) == len({x.revision_id for x in r})
    assert all(next(x.status for x in r if x.revision_id == rev) == "Active" for rev in bound.values())
    return {k[1] for k in bound}, sorted(x.status for x in r)


def test_events_change_the_tables(spark):
    t, _ = batch(spark, empty(spark), [(1, "a.py", None, "Created", 1)], [("a.py", "total", SUM), ("a.py", "area", AREA)], [("a.py:total", "Calls", "a.py:area", "Ast")])
    assert state(t) == ({"a.py:total", "a.py:area"}, ["Active", "Active"]) and t.edges.count() == 1
    again, _ = batch(spark, t, [(1, "a.py", None, "Modified", 2)], [("a.py", "total", SUM), ("a.py", "area", AREA)], [("a.py:total", "Calls", "a.py:area", "Ast")])
    assert {tuple(r) for r in again.revisions.collect()} == {tuple(r) for r in t.revisions.collect()} and again.edges.count() == 1
    # a changed body retires its revision and links to it; a symbol that is gone is a tombstone
    t2, _ = batch(spark, t, [(1, "a.py", None, "Modified", 3)], [("a.py", "total", SUM + "\n    # more")])
    assert state(t2) == ({"a.py:total"}, ["Active", "Tombstone", "Tombstone"])
    new = t2.revisions.filter("status = 'Active'").head()
    assert new.parent_revision_id in {r.revision_id for r in t.revisions.collect()}
    # moved: the identity goes along, and an edge says so
    t3, _ = batch(spark, t2, [(1, "b.py", "a.py", "Renamed", 4)], [("b.py", "total", SUM + "\n    # more")], now=2 * DAY)
    assert state(t3)[0] == {"a.py:total"} and t3.bindings.count() == 1
    assert [(e.ty, e.source_revision_id, e.target_identity_id, e.resolver) for e in t3.edges.filter("ty = 'RenamedFrom'").collect()] == [("RenamedFrom", new.revision_id, "a.py:total", "Ast")]
    # applied again, nothing changes
    t4, _ = batch(spark, t3, [(1, "b.py", "a.py", "Renamed", 4)], [("b.py", "total", SUM + "\n    # more")], now=2 * DAY)
    for a, b in ((t3.revisions, t4.revisions), (t3.bindings, t4.bindings), (t3.edges, t4.edges)):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    # deleted, and the last event of a path counts
    t5, _ = batch(spark, t4, [(1, "b.py", None, "Deleted", 6), (1, "b.py", None, "Modified", 5)], [("b.py", "total", SUM)])
    assert state(t5)[0] == set()


def test_locked_branches_wait_and_inherited_symbols_are_hidden(spark):
    t, _ = batch(spark, empty(spark, ((1, None), (2, 1))), [(1, "a.py", None, "Created", 1)], [("a.py", "total", SUM)])
    same, waiting = batch(spark, t, [(1, "a.py", None, "Deleted", 2)], locked=[1])
    assert waiting.count() == 1 and state(same) == state(t)
    gone, waiting = batch(spark, t, [(1, "a.py", None, "Deleted", 2)])
    assert waiting.isEmpty() and gone.bindings.isEmpty() and [tuple(r) for r in gone.deletions.collect()] == [(1, "a.py:total", DAY)]
    assert [r.status for r in gone.revisions.collect()] == ["Active"]
    back, _ = batch(spark, gone, [(1, "a.py", None, "Created", 3)], [("a.py", "total", SUM)])
    assert back.deletions.isEmpty() and state(back) == state(t)


def test_retarget_edge(spark):
    t, _ = batch(spark, empty(spark), [(1, "a.py", None, "Created", 1)], [("a.py", "total", SUM), ("a.py", "area", AREA)], [("a.py:total", "Calls", "a.py:area", "Ast")])
    e = t.edges.head()
    assert [r.new_target for r in W.retarget_edge(t, 1, e.source_revision_id, e.edge_id, "other").collect()] == ["other"]
    with pytest.raises(KeyError):
        W.retarget_edge(t, 1, e.source_revision_id, "nothing", "other")


# --- merges


@pytest.fixture
def store(spark, tmp_path):
    """main (1) and feature (2): i1 changed on feature, i2 on both, i3 new there, i4 deleted there."""
    s = Store(spark, str(tmp_path / "s"))
    rev = [("i1", "m1", 1, "a"), ("i2", "m2", 1, "x"), ("i4", "m4", 1, "d"), ("i1", "f1", 2, "b"), ("i2", "f2", 2, "y"), ("i3", "f3", 2, "c")]
    s.publish({
        "branches": spark.createDataFrame([(1, None, None), (2, 1, 5)], "branch_id bigint, parent_id bigint, fork_ts_ms bigint"),
        "revisions": spark.createDataFrame([(i, r, b, "Active", f"{i}.py", h, None, 1 if r == "m4" else 9 if r == "m2" else 3) for i, r, b, h in rev] + [("i2", "m0", 1, "Tombstone", "i2.py", "w", None, 2)], "identity_id string, revision_id string, branch_id bigint, status string, file_path string, body_hash string, rename_source_id string, ts_ms bigint"),
        "bindings": spark.createDataFrame([(b, i, r) for i, r, b, _ in rev], "branch_id bigint, identity_id string, revision_id string"),
        "edges": spark.createDataFrame([("e1", "Calls", "f1", "i3"), ("e2", "Calls", "f3", "nowhere"), ("e3", "Calls", "m2", "i1")], "edge_id string, ty string, source_revision_id string, target_identity_id string"),
        "overrides": spark.createDataFrame([], "branch_id bigint, source_revision_id string, edge_id string, new_target string"),
        "deletions": spark.createDataFrame([(2, "i4", 7)], "branch_id bigint, identity_id string, deleted_at_ms bigint"),
    })
    return s


def bound(s, branch=1):
    return {r.identity_id: r.revision_id for r in s.read("bindings").filter(f"branch_id = {branch}").collect()}


def test_merge_commits_at_once_and_only_once(spark, store):
    m = Merges(store)
    got = m.merge("x", 2, 1)
    assert got.phase == "Committed" and bound(store) == {"i1": "f1", "i2": "f2", "i3": "f3"}
    assert {r.edge_id for r in store.read("edges").collect()} == {"e1", "e3"} and ("i4" in {r.identity_id for r in store.read("deletions").filter("branch_id = 1").collect()})
    before = store.current()[0]
    assert m.merge("x", 2, 1).report == got.report and store.current()[0] == before
    assert [r.phase for r in m.progress().orderBy("at_ms").collect()] == ["Classifying", "Promoting", "Reconciling", "Committed"]
    m.cancel("x")
    assert bound(store) == {"i1": "m1", "i2": "m2", "i4": "m4"} and store.read("edges").count() == 3 and store.read("deletions").filter("branch_id = 1").isEmpty()


@pytest.mark.parametrize("phase", ["Classifying", "Promoting", "Reconciling"])
def test_merge_resumes_after_any_phase(spark, store, phase):
    m = Merges(store)
    assert m.merge("x", 2, 1, stop_after=phase).phase == phase and bound(store) == {"i1": "m1", "i2": "m2", "i4": "m4"}
    with pytest.raises(Locked):
        m.merge("y", 2, 1)
    assert Merges(store).merge("x", 2, 1).phase == "Committed" and bound(store) == {"i1": "f1", "i2": "f2", "i3": "f3"}


def test_conflicts_hold_the_branch_until_a_strategy_or_cancel(spark, store):
    m = Merges(store)
    got = m.merge("x", 2, 1, base="fork_point")
    assert (got.phase, got.conflicts) == ("Conflicted", 1) and bound(store)["i2"] == "m2"
    assert m.merge("x", 2, 1).phase == "Conflicted"
    assert m.merge("x", 2, 1, strategy="ours").phase == "Committed" and bound(store) == {"i1": "f1", "i2": "m2", "i3": "f3"}
    assert store.read("revisions").filter("revision_id = 'f2'").head().status == "Orphaned"


def test_speculative_paths_and_old_locks(spark, store):
    m = Merges(store, ttl_hours=1)
    with pytest.raises(Speculative):
        m.merge("x", 2, 1, speculative=spark.createDataFrame([("i1.py",)], "path string"))
    assert m.runs().isEmpty()
    m.merge("x", 2, 1, base="fork_point")
    assert m.sweep() == [] and m.sweep(now_ms=2**50) == ["x"] and m.merge("y", 2, 1).phase == "Committed"
