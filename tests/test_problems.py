"""References without records, hierarchies and change feeds: edge cases and random inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.ids import month_of_ms, month_utc, plain_id
from brindle.operators import hierarchy as H
from brindle.operators.changefeed import apply_changes
from brindle.operators.orphans import orphan_references
from brindle.plans.problems import decoded_changes

REF = "src_table string, row_key string, space string, key string, month string, noise int"
PARENT = "space string, key string, deleted boolean, month string, src_table string"


# --- ids


def test_plain_id(spark):
    k = "ab" * 16
    cases = {k: k, k.upper(): k, "rev:" + k: k, "REV:" + k.upper(): k, "0x" + k: k, k + "\n": k, " " + k + " ": k, "00" + k: k, "0" * 32: None, "rev:" + "0" * 32: None, "": None, "  ": None, None: None, "0": None, "1f": "1f"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", plain_id("c", 32).alias("p"))
    assert {r.i: r.p for r in df.collect()} == dict(enumerate(cases.values()))


def test_months_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = spark.range(1).select(month_of_ms(F.lit(1704067200000)).alias("a"), month_utc(F.timestamp_millis(F.lit(1704067199999))).alias("b"), month_of_ms(F.lit(None).cast("bigint")).alias("c")).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.a, r.b, r.c) == ("2024-01", "2023-12", None)


# --- p1


def test_orphans(spark):
    parents = [("a", "01", False, "2024-01", "x"), ("a", "02", True, "2024-01", "x"), ("a", "03", False, "2024-03", "x"), ("a", "03", False, "2024-05", "x"), ("b", "01", True, "2024-01", "x"), ("b", "01", False, "2024-02", "x"), ("a", None, False, "2024-01", "x")]
    refs = [
        ("t", "r1", "a", "01", "2024-01", 1), ("t", "r1", "a", "01", "2024-01", 2), ("t", "r2", "a", "02", None, 1), ("t", "r3", "a", "03", "2024-02", 1), ("t", "r4", "a", "03", "2024-03", 1),
        ("t", "r5", "a", "0g", "2024-01", 1), ("t", "r5", "a", "0g", "2024-01", 1), ("t", "r6", "a", None, "2024-01", 1), ("t", "r7", "a", "03", None, 1), ("t", None, "a", "ff", None, 1), ("u", "r8", "b", "01", "2024-01", 1), ("u", "r9", "b", "02", "2024-01", 1),
    ]
    got = {tuple(r) for r in orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT)).collect()}
    assert got == {("t", "unknown", "r2", "deleted"), ("t", "2024-02", "r3", "late"), ("t", "2024-01", "r5", "missing"), ("t", "unknown", None, "missing"), ("u", "2024-01", "r9", "missing")}


def test_orphans_of_empty_tables(spark):
    refs, parents = spark.createDataFrame([("t", "r", "a", "01", "2024-01", 1)], REF), spark.createDataFrame([], PARENT)
    assert [tuple(r) for r in orphan_references(refs, parents).collect()] == [("t", "2024-01", "r", "missing")]
    assert orphan_references(refs.limit(0), parents).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_orphans_at_random(spark, seed):
    rng = random.Random(seed)
    key = lambda: f"{rng.randrange(60):02x}"
    month = lambda: rng.choice([None, "2024-01", "2024-02", "2024-03"])
    parents = [(rng.choice("ab"), key(), rng.random() < 0.3, month(), "") for _ in range(60)]
    # One key holds a third of the references.
    refs = [(rng.choice("tu"), str(i), rng.choice("ab"), "07" if i % 3 == 0 else key(), month(), i) for i in range(300)]
    want = set()
    for t, row, space, k, m, _ in refs:
        mine = [p for p in parents if p[0] == space and p[1] == k]
        months = [p[3] for p in mine if p[3]]
        fate = "missing" if not mine else "deleted" if all(p[2] for p in mine) else "late" if m and months and min(months) > m else None
        if fate:
            want.add((t, m or "unknown", row, fate))
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), buckets=3)
    assert {tuple(r) for r in got.collect()} == want


# --- p3


def climb(links: dict) -> dict:
    out = {}
    for x in links:
        path, at = [x], x
        while links.get(at) is not None and links[at] in links and links[at] not in path:
            at = links[at]
            path.append(at)
        nxt = links.get(at)
        if links[x] is None:
            continue
        if nxt is not None and nxt in links:
            ring = path[path.index(nxt) :]
            out[x] = (min(ring), -1, None)
        else:
            out[x] = (at, len(path) - 1, path)
    return out


def check_tree(spark, links, **more):
    df = spark.createDataFrame([(k, v, "x") for k, v in links.items()], "id string, parent string, root string")
    got = {r.id: (r.root, r.depth, list(r.path) if r.path is not None else None) for r in H.hierarchy(df, with_path=True).collect()}
    want = climb(links)
    assert got == want
    assert {r.id: (r.root, r.depth) for r in H.hierarchy(df).collect()} == {k: v[:2] for k, v in want.items()}


def test_small_trees(spark):
    check_tree(spark, {"r": None, "a": "r", "b": "a", "lost": "nowhere", "c": "lost", "self": "self", "x": "self", "m": "n", "n": "o", "o": "m", "p": "n", "q": "p"})


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), (None, "a"), ("b", None), ("", "a")], "id string, parent string")
    assert {(r.id, r.root, r.depth) for r in H.hierarchy(df).collect()} == {("a", "b", 1), ("", "b", 2)}
    assert H.hierarchy(df.limit(0)).isEmpty()


@pytest.mark.parametrize("solve_rows", [500_000, 20])
def test_long_chains_rings_and_hot_parents(spark, monkeypatch, solve_rows):
    monkeypatch.setattr(H, "SOLVE_ROWS", solve_rows)
    rng = random.Random(solve_rows)
    links = {f"c{i:04d}": f"c{i - 1:04d}" if i else None for i in range(400)}
    links |= {f"h{i:04d}": "c0200" for i in range(200)}  # a third of all rows under one parent
    for size in (1, 2, 3, 5, 40):
        links |= {f"o{size:02d}-{i:02d}": f"o{size:02d}-{(i + 1) % size:02d}" for i in range(size)}
        links |= {f"t{size:02d}-{i:02d}": f"t{size:02d}-{i - 1:02d}" if i else f"o{size:02d}-00" for i in range(7)}
    links |= {f"z{i:03d}": rng.choice([None, "gone", f"z{rng.randrange(120):03d}"]) for i in range(120)}
    check_tree(spark, links)


def test_long_paths_are_not_one_task_s_work(spark, monkeypatch):
    monkeypatch.setattr(H, "SOLVE_ELEMENTS", 10)
    monkeypatch.setattr(H, "SOLVE_ANYWAY", 5)
    check_tree(spark, {f"c{i:05d}": f"c{i - 1:05d}" if i else None for i in range(200)})


def test_descendants(spark):
    df = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("s", "s")], "id string, parent string")
    assert {tuple(r) for r in H.descendants(df).collect()} == {("r", "a", 1), ("a", "b", 1), ("r", "b", 2)}
    assert {tuple(r) for r in H.ring_members(df).collect()} == {("s", "s")}


# --- p6


def fold(changes, base):
    state = dict(base)
    for seq, key, op, value in sorted(set(changes), key=lambda c: c[0]):
        if op == "insert":
            state[key] = value
        elif key in state:
            if op == "delete":
                del state[key]
            elif value is not None:
                state[key] = value
    return state


@pytest.mark.parametrize(("seed", "block"), [(0, 100_000), (1, 3), (2, 7), (3, 1)])
def test_changes_at_random(spark, seed, block):
    rng = random.Random(seed)
    base = {f"k{i}": f"b{i}" for i in range(0, 12, 2)}
    changes = [(s, "k0" if s % 3 == 0 else f"k{rng.randrange(12)}", rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, "v1", "v2", f"v{s}"])) for s in range(120)]
    rows = [(k, s, op, v, 1) for s, k, op, v in changes]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:40], "k string, seq bigint, op string, value string, n int")
    got = {r.k: r.value for r in apply_changes(df, spark.createDataFrame(list(base.items()), "k string, value string"), ["k"], block).collect()}
    assert got == fold(changes, base)


def test_changes_left_out(spark):
    rows = [(None, 1, "insert", "v"), ("a", None, "insert", "v"), ("a", 2, "merge", "v"), ("b", 3, None, "v"), ("c", 4, "insert", None), ("", 5, "insert", "x" * 10_000)]
    df = spark.createDataFrame(rows, "k string, seq bigint, op string, value string")
    none = spark.createDataFrame([], "k string, value string")
    assert {r.k: r.value for r in apply_changes(df, none, ["k"]).collect()} == {"c": None, "": "x" * 10_000}
    assert apply_changes(df.limit(0), none, ["k"]).isEmpty()


def test_payloads(spark):
    import base64
    import json
    import zlib

    i, r = "ab" * 16, "cd" * 16
    flat = json.dumps({"op": "I", "branch_id": 3, "identity_id": i, "revision_id": r})
    deep = json.dumps({"mutation": {"op": "set", "key": {"branch_id": 3, "identity_id": i}, "set": {}}, "origin": "x"})
    b64 = "b64:" + base64.b64encode(deep.encode()).decode()
    crc = lambda s: f"{zlib.crc32(s.encode()):08x}"
    rows = [
        (1, "Pending", flat, crc(flat)), (1, " COMMITTED", flat[:20], crc(flat)), (2, "committed", b64, crc(b64)), (3, "Committed", b64, crc(deep)), (4, "GraphDone", flat, crc(flat)),
        (5, "Committed", "b64:!!", "00000000"), (6, "Committed", None, None), (7, "Committed", "", "00000000"), (8, "Committed", flat.replace('"I"', '"D"'), crc(flat)),
    ]
    got = {(x.seq, x.branch_id, x.identity_id, x.op, x.value) for x in decoded_changes(spark.createDataFrame(rows, "log_id bigint, phase string, payload string, payload_checksum string")).collect()}
    assert got == {(1, 3, i, "insert", r), (2, 3, i, "update", None), (3, 3, i, "update", None)}
