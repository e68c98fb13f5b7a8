"""The operators for training data: edge cases, brute force, round trips and held-out accuracy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, handwritten, leaks, neighbors, readability, splitting

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# --- p2


def vectors(n, d, seed, near=0):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, d))
    for i in range(near):
        x[n - 1 - i] = x[i] + 0.15 * rng.normal(size=d) * rng.rand()
    return x


def brute(x, ids, least, k=10):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u.astype(np.float32).astype(np.float64) @ u.astype(np.float32).astype(np.float64).T), 7)
    best = []
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))
        best.append(set(order[:k]))
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in best[i] if i in best[j]}


SCHEMA = "model_id string, body_hash string, embedding array<float>, shard string"


def frame(spark, x, ids, model="m"):
    return spark.createDataFrame([(model, i, [float(v) for v in row], "s") for i, row in zip(ids, x)], SCHEMA)


def test_similar_pairs_recall(spark):
    x = vectors(1200, 32, 1, near=300)
    ids = [f"{i:04d}" for i in range(len(x))]
    want = brute(x.astype(np.float32), ids, 0.9)
    got = {(r[1], r[2]) for r in neighbors.similar_pairs(frame(spark, x, ids), 0.9, shard_rows=150).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.95 * len(want)
    exact = {(r[1], r[2]) for r in neighbors.similar_pairs(frame(spark, x, ids), 0.9, route_factor=1.0, search_factor=1.0, shard_rows=150).collect()}
    assert exact == want


def test_copies_are_not_expanded(spark):
    x = np.concatenate([np.ones((40, 8)), vectors(10, 8, 2)])
    ids = [f"{i:03d}" for i in range(50)]
    got = {(r[1], r[2]) for r in neighbors.similar_pairs(frame(spark, x, ids), 0.999).collect()}
    assert got == brute(x, ids, 0.999)
    assert max(max(p) for p in got) == "010"  # only the eleven least ids of equal vectors are among each other's ten


def test_scaled_copies_rank_by_id(spark):
    x = np.concatenate([np.outer(np.arange(1, 601) / 7, vectors(1, 16, 5)[0]), vectors(60, 16, 6)]).astype(np.float32)
    order = np.random.RandomState(2).permutation(len(x))
    x, ids = x[order], [f"{i:04d}" for i in order]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 7)
    best = [set(sorted((j for j in range(len(x)) if j != i and s[i, j] >= 0.9), key=lambda j: (-s[i, j], ids[j]))[:10]) for i in range(len(x))]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in best[i] if i in best[j]}
    assert {("0000", "0010"), ("0000", "0001")} <= want
    assert {(r[1], r[2]) for r in neighbors.similar_pairs(frame(spark, x, ids), 0.9, route_factor=1.0, search_factor=1.0, shard_rows=100).collect()} == want


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (" M ", "a", [1.0, 0.0, 0.0]), ("m", "b", [2.0, 0.0, 0.0]), ("m", "b", [2.0, 0.0, 0.0]), ("m", "c", [1.0, 0.0]), ("m", "d", [0.0, 0.0, 0.0]), ("m", "e", [nan, 0.0, 1.0]),
        ("m", "f", [inf, 0.0, 1.0]), ("m", "g", None), ("m", "h", []), (None, "i", [1.0, 0.0, 0.0]), ("", "j", [1.0, 0.0, 0.0]), ("m", None, [1.0, 0.0, 0.0]), ("x", "k", [1.0, 0.0, 0.0]), ("m", "l", [None, 0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    assert [(r[0], r[1], r[2]) for r in neighbors.similar_pairs(df, 0.9).collect()] == [("m", "a", "b")]
    assert {(r.query_hash, r.body_hash) for r in neighbors.nearest(df, F.col("body_hash").isin("a", "d")).collect()} == {("a", "b")}
    assert neighbors.similar_pairs(df.limit(0), 0.9).isEmpty() and neighbors.nearest(df.limit(0), F.lit(True)).isEmpty()


def test_nearest_recall(spark):
    x = vectors(1500, 24, 3)
    ids = [f"{i:04d}" for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    asked = [i for i in range(len(x)) if i % 50 == 0]
    want = {(ids[i], ids[j]) for i in asked for j in np.argsort(-s[i])[:10]}
    q = F.col("body_hash").cast("int") % 50 == 0
    got = neighbors.nearest(frame(spark, x, ids), q, shard_rows=150).collect()
    assert len(got) == 10 * len(asked)
    assert len({(r.query_hash, r.body_hash) for r in got} & want) >= 0.9 * len(want)
    exact = {(r.query_hash, r.body_hash) for r in neighbors.nearest(frame(spark, x, ids), q, factor=1.0, shard_rows=150).collect()}
    assert exact == want


def test_large_shards_are_split_again(spark):
    """A sample far too small for the table: the shards it gives are split on the executors until they are small."""
    rng = np.random.RandomState(11)
    n, rows, sample = 50_000, 300, 200
    x = np.repeat(rng.normal(size=(n // 50, 16)), 50, axis=0) + 0.25 * rng.normal(size=(n, 16))
    ids = [f"{i:06d}" for i in range(n)]
    df = frame(spark, x, ids).repartition(4)
    v, models = neighbors._usable(df, F.col("body_hash").cast("int") % 50 == 0)
    margin = 0.15 * float(neighbors.chord(0.99)) / 2
    cut = neighbors.Shards(v, models, margin, sample, rows)
    sizes = [r["count"] for r in cut.rows.groupBy("shard").count().collect()]
    assert cut.levels and max(sizes) <= 2 * neighbors.LARGE * rows and cut.rows.select("id").distinct().count() == n
    got = {(r.query_hash, r.body_hash) for r in neighbors.nearest(df, F.col("body_hash").cast("int") % 500 == 0, sample=sample, shard_rows=rows).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for i in range(0, n, 500):
        s = u @ u[i]
        s[i] = -2
        want |= {(ids[i], ids[j]) for j in np.argsort(-s)[:10]}
    assert len(got & want) >= 0.9 * len(want)
    pairs = {(r[1], r[2]) for r in neighbors.similar_pairs(df, 0.99, sample=sample, shard_rows=rows).collect()}
    whole = {(r[1], r[2]) for r in neighbors.similar_pairs(df, 0.99).collect()}
    assert len(whole) > 500 and len(pairs & whole) >= 0.9 * len(whole)

def test_nearest_counts_repeated_rows_once(spark):
    x = vectors(60, 12, 8)
    x[40:] = np.outer(np.arange(1, 21) / 3, x[0])  # equal but for the scale
    ids = [f"{i:03d}" for i in range(60)]
    s = np.round((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 6)
    want = {(ids[i], ids[j]) for i in (1, 2, 0, 45) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:10]}
    order = np.random.RandomState(3).permutation([*range(60), *[3] * 90, *[50] * 30])
    df = frame(spark, x[order], [ids[i] for i in order]).repartition(3)
    got = neighbors.nearest(df, F.col("body_hash").isin("001", "002", "000", "045"), factor=1.0).collect()
    assert len(got) == 40 and {(r.query_hash, r.body_hash) for r in got} == want


# --- p4


def reassemble(raw, pieces):
    out = b""
    for s, e, _ in pieces:
        assert s <= len(out) <= e
        out = out[:s] + raw[s:e]
    return out


def test_cuts_at_random():
    rng = random.Random(5)
    for _ in range(300):
        raw = b"".join(rng.choice([b"word ", b"x" * rng.randrange(90), b"\n", b"\r\n", b"\r", "é".encode(), "漢字".encode(), b"\xff\xfe", b"\n\n"]) for _ in range(rng.randrange(160)))
        pieces = splitting.cuts(raw, 64, 16)
        assert all(0 < e - s <= 64 for s, e, _ in pieces) and reassemble(raw, pieces) == raw
        for (_, e, kind), (s, _, _) in zip(pieces, pieces[1:]):
            assert 16 <= e - s <= 19
            if kind in ("line", "paragraph"):
                assert raw[e - 1 : e] in (b"\n", b"\r") and raw[e - 1 : e + 1] != b"\r\n"
        if not pieces:
            assert raw == b""


def test_pieces_end_at_the_highest_boundary_that_leaves_them_half_full():
    def kinds(raw, **levels):
        return [(raw[s:e], k) for s, e, k in splitting.cuts(raw, 40, 0, **levels)]

    assert kinds(b"one two three.\nfour five\n\nsix. seven eight\nnine ten")[0] == (b"one two three.\nfour five\n\n", "paragraph")
    assert kinds(b"a\n \t\nb c d e f g h. i j\nk l m n o p q r s t u v w")[0] == (b"a\n \t\nb c d e f g h. i j\n", "line")
    assert kinds(b"one two three four five. Six seven eight nine ten eleven")[0] == (b"one two three four five. ", "sentence")
    assert kinds(b"one two three four five six seven eight nine ten")[0] == (b"one two three four five six seven eight ", "word")
    assert kinds("漢字。".encode() * 9)[0] == ("漢字。".encode() * 4, "sentence")
    assert kinds(b"a\n" + b"x" * 90)[0] == (b"a\n", "line") and kinds(b"x" * 90)[0] == (b"x" * 40, "hard")


def test_forced_at_random():
    rng = random.Random(6)
    for _ in range(2000):
        raw = b"".join(rng.choice([b"x" * rng.randrange(25), b"\n", b"\r\n", b"\r", b"y "]) for _ in range(rng.randrange(30)))
        assert splitting.forced(raw, 20) == (max(map(len, raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n"))) > 20)


def test_lines_decide_what_is_forced(spark):
    big = splitting.LIMIT
    bodies = {
        "crlf": b"a" * big + b"\r\n" + b"b" * 9, "cr": b"a" * big + b"\r" + b"b" * big, "long": b"a" * (big + 1) + b"\n", "last": b"x\n" + b"a" * (big + 1), "edge": b"a" * big, "none": None, "empty": b"", "short": b"a\nb",
        "utf": ("é" * big).encode(), "latin": b"\xe9\n" * big,
    }
    rows = [(k, v, 1) for k, v in bodies.items()] + [("long", bodies["long"], 2), (None, b"abc", 3)]
    df = splitting.split_bodies(spark.createDataFrame(rows, "body_hash string, bytes binary, chunk_id int"), with_bytes=True)
    got = {r.body_hash: r.f for r in df.groupBy("body_hash").agg(F.max("forced").alias("f")).collect()}
    assert got == {"crlf": False, "cr": False, "long": True, "last": True, "edge": False, "short": False, "utf": True, "latin": False, "": False}
    pieces = df.collect()
    assert all(len(p.piece) <= big and p.end_byte - p.start_byte == len(p.piece) for p in pieces)
    for p in pieces:
        if p.body_hash == "utf":
            p.piece.decode()
    assert len({p.chunk_id for p in pieces}) == len({(p.body_hash, p.start_byte) for p in pieces})


# --- p5


@pytest.mark.parametrize(
    ("path", "text", "found"),
    [
        ("src/a.py", "def f(x):\n    return x\n", False),
        ("src/a.py", "# Code generated by mill. DO NOT EDIT.\nx = f(1)\n", True),
        ("src/a.py", "x = 1\n# Code generated by mill. DO NOT EDIT.\n", False),
        ("src/a.js", "// the writer below puts a banner on its output\nconst banner = \"@generated DO NOT EDIT\";\n", False),
        ("src/a.js", "/*\n * Vendored from zed 1.2.3; do not change locally\n */\nfoo();\n", True),
        ("src/a.js", "// idea taken from zed, but written anew for our own trees\nfoo();\n", False),
        ("src/a.js", "// unlike the generated stubs, this file is edited by hand; please do edit it\nfoo();\n", False),
        ("src\\Vendor\\zed\\a.c", "int f() { return 1; }\n", True),
        ("src/vendor_portal/a.c", "int f() { return 1; }\n", False),
        ("src/generated_report.py", "def f(x):\n    return x\n", False),
        ("src/a_pb2.py", "", True),
        ("web/a.min.js", "f()", True),
        ("web/minimum.js", "f()", False),
        ("web/a.js", "!function(e,t){" + "var a=t[1]||{};a.b=function(e){return e&&e.c?e:{d:e}};" * 30 + "}();", True),
        ("src/t.c", "static unsigned char t[] = {\n" + "0x12, 0x9f, 0xa0, 0x33, 0x7c, 0x00,\n" * 40 + "};\n", True),
        ("src/t.py", "BLOB = \"" + "aGVsbG8gd29ybGQh" * 60 + "\"\n", True),
        ("src/t.py", None, False),
    ],
)
def test_handwritten_rules(spark, path, text, found):
    files = spark.createDataFrame([(path, "h1", 1), (path, "h1", 2), (None, "h1", 3)], "file_path string, body_hash string, kind int")
    bodies = spark.createDataFrame([("h1", None if text is None else text.encode(), "k")] * 2, "body_hash string, bytes binary, said string")
    assert [r.file_path for r in handwritten.not_handwritten(files, bodies).collect()] == ([path] if found else [])


def code_line(rng, word):
    """A line of code of no common shape, so that token composition tells nothing."""
    return f"{word}{rng.randrange(10**6)} = " + " ".join(rng.choice(["a", "+", "7", "(b)", "c.d", "*", "[e]", "f(9)", "!", "- 2"]) for _ in range(rng.randrange(4, 12))) + ";"


def test_edited_copies_are_found_by_lines(spark):
    rng = random.Random(3)
    line = lambda w: code_line(rng, w)
    lines, own = [line("value_") for _ in range(30)], [line("other_") for _ in range(30)]
    files = spark.createDataFrame([("vendor/z/a.c", "v"), ("src/copy.c", "c"), ("src/own.c", "o"), ("src/little.c", "l")], "file_path string, body_hash string")
    text = {"v": lines, "c": lines[:15] + own[:6] + lines[15:], "o": own, "l": own[6:] + lines[:4]}
    bodies = spark.createDataFrame([(k, "\n".join(["void f() {", *v, "}"]).encode()) for k, v in text.items()], "body_hash string, bytes binary")
    assert {r.file_path: r.kind for r in handwritten.not_handwritten(files, bodies).collect()} == {"vendor/z/a.c": "vendored", "src/copy.c": "vendored"}
    assert handwritten.not_handwritten(files.limit(0), bodies).isEmpty() and handwritten.not_handwritten(files, bodies.limit(0)).count() == 1


def test_copies_of_a_library_held_by_many_contents_are_found(spark):
    rng = random.Random(9)
    line = lambda w: code_line(rng, w)
    lib, text = [line("lib_") for _ in range(40)], {}
    for i in range(90):  # every version lacks some lines and has some of its own
        text[f"vendor/z{i}/a.c"] = [x for x in lib if rng.random() < 0.9] + [line("version_") for _ in range(4)]
        text[f"src/copy{i}.c"] = [x for x in lib if rng.random() < 0.9] + [line("own_") for _ in range(4)]
    text["src/own.c"] = lib[:10] + [line("hand_") * (1 + i % 3) for i in range(30)]
    files = spark.createDataFrame([(k, k) for k in text], "file_path string, body_hash string")
    bodies = spark.createDataFrame([(k, "\n".join(v).encode()) for k, v in text.items()], "body_hash string, bytes binary")
    assert {r.file_path for r in handwritten.not_handwritten(files, bodies).collect()} == text.keys() - {"src/own.c"}


def test_edited_copies_without_any_mark_are_found_by_their_spread(spark):
    rng = random.Random(10)
    line = lambda w: code_line(rng, w)
    lib, common, text = [line("lib_") for _ in range(60)], [line("idiom_") for _ in range(9)], {}
    for i in range(100):  # nothing names the original, and no two copies are equal
        text[f"team{i}/util/a{i}.c"] = [line("own_") if rng.random() < 0.08 else x for x in lib]
    own = {f"team{i}/src/own{i}.c": [line("hand_") for _ in range(30)] + common[: i % 9] for i in range(40)}
    twin = [line("two_") for _ in range(30)]
    two = {f"team{i}/src/two.c": twin[i:] for i in range(2)}
    files = spark.createDataFrame([(k, k, k.split("/")[0]) for k in text | own | two], "file_path string, body_hash string, owner string")
    bodies = spark.createDataFrame([(k, "\n".join(v).encode()) for k, v in (text | own | two).items()], "body_hash string, bytes binary")
    assert {r.file_path: r.kind for r in handwritten.not_handwritten(files, bodies).collect()} == dict.fromkeys(text, "vendored")
    assert {r.file_path for r in handwritten.not_handwritten(files, bodies, repository="owner").collect()} == text.keys()
    assert handwritten.not_handwritten(files.withColumn("owner", F.lit("one")), bodies, repository="owner").isEmpty()
    assert handwritten.not_handwritten(files, bodies, spread_share=2.0).isEmpty()


def test_switching_the_line_index_off_loses_copies(spark):
    rng = random.Random(11)
    line = lambda w: code_line(rng, w)
    lib = [line("lib_") for _ in range(40)]
    text = {"vendor/z/a.c": lib, "src/copy.c": lib[:30] + [line("own_") for _ in range(9)]}
    files = spark.createDataFrame([(k, k) for k in text], "file_path string, body_hash string")
    bodies = spark.createDataFrame([(k, "\n".join(v).encode()) for k, v in text.items()], "body_hash string, bytes binary")
    assert handwritten.not_handwritten(files, bodies).count() == 2 and handwritten.not_handwritten(files, bodies, contained=2.0).count() == 1


def test_short_contents_are_judged_by_their_tokens():
    assert handwritten.inspect(b"T = [0x12, 0x34, 0x9a, 0x77, 0x01, 0x02]\n")[0] == "data"
    assert handwritten.inspect(b"x = 1\n")[0] is None and handwritten.inspect(b"from a import b\n\nVERSION = '1.2'\n")[0] is None


def test_long_heads_are_read_whole():
    head = [f"// licence, line {i}" for i in range(90)]
    assert handwritten.inspect("\n".join([*head, "// Code generated by x. DO NOT EDIT.", "int a;"]).encode())[0] == "tool"
    assert handwritten.inspect("\n".join([*head, "int a;", "// Code generated by x. DO NOT EDIT."]).encode())[0] is None


# --- p7

needs_words = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@needs_words
def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    odd = [chr(c) for c in [*range(0x250), 0x85, 0x2028, 0x3000, 0x200D, 0x1F469, 0x5D0, 0x4E2D, 0x1D4D0]]
    texts = ["", "<|endoftext|> a<|endoftext|>", "x" * 5000, "ab " * 2000, "\n" * 900, "don't WE'LL", *("".join(rng.choice(odd) for _ in range(60)) for _ in range(200))]
    texts += ["".join(rng.choice("etaoin") for _ in range(700))]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate([None, *texts, texts[1]])], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).select("doc_id", "ids").collect()}
    want = [[]] + [e.ids for e in t.encode_batch([*texts, texts[1]], add_special_tokens=False)]
    assert got == dict(enumerate(want))
    assert bpe.encode_corpus(df.limit(0)).isEmpty()


@needs_words
def test_short_and_long_words_merge_alike():
    ranks = bpe.read_ranks(open(bpe.VOCABULARY, "rb").read())
    rng = random.Random(2)
    for _ in range(60):
        w = bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randrange(1, 150)))
        assert bpe.merge_short(w, ranks) == bpe.merge_long(w, ranks)
        assert b"".join(next(k for k, v in ranks.items() if v == i) for i in bpe.merge_short(w[:6], ranks)) == w[:6]


# --- p8


def test_myers():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert leaks.myers(p, t) == plain(p, t)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def test_leaks(spark):
    item = " ".join(WORDS)
    fancy = "".join(chr(0xFF41 + ord(c) - 97) if c.isalpha() else c for c in " ".join(WORDS[:12]))
    docs = {
        1: "see: " + item + ".", 2: "> **Alpha** beta,\r\n> gamma; DELTA (epsilon) zeta\n> _eta_ theta iota kappa—lambda “mu”", 3: " ".join(WORDS[:11]) + " other", 4: fancy, 5: " ".join(WORDS[1:13]), 6: " ".join(reversed(WORDS)),
        7: " ".join(WORDS[:6]) + " x " + " ".join(WORDS[6:]), 8: None, 9: "", 10: " ".join(WORDS[:11]) + " muse", 11: "zz" + " ".join(WORDS[:11]), 12: " ".join(WORDS[:12]).replace("delta", "del​ta"), 13: ("pad " * 40_000) + item, 14: " ".join(WORDS[:11]) + " mv nu",
    }
    rows = [(i, t, 0) for i, t in docs.items()]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(70, item, 1), (70, item, 1), (71, "too short to leak", 1), (72, None, 1), (73, "intro words here " + " ".join(WORDS[2:]), 1)], "item_id bigint, text string, doc_id int")
    want = {(i, 70) for i in (1, 2, 4, 5, 12, 13)} | {(1, 73), (13, 73)}
    for k, block in ((0, 10**6), (1, 10**6), (1, 60)):
        assert {tuple(r) for r in leaks.leaks(df, items, max_edits=k, block_chars=block).collect()} == {(*w, 0) for w in want}
    near = {tuple(r) for r in leaks.leaks(df, items, max_edits=1, exact=False).collect()}
    assert near >= {(*w, 0) for w in want} | {(14, 70, 1)} and not any(n[:2] == (6, 70) for n in near)
    assert leaks.leaks(df.limit(0), items).isEmpty() and leaks.leaks(df, items.limit(0)).isEmpty()


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(6)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(30)]
        if d % 3:
            src = rng.choice(items)[1].split()
            at, n = rng.randrange(len(src)), rng.randrange(6, 20)
            words[10:10] = src[at : at + n]
        docs.append((d, " ".join(words)))

    def holds(text, item):
        t, s = text.split(), item.split()
        return any(t[i : i + 12] == s[j : j + 12] for i in range(len(t) - 11) for j in range(len(s) - 11))

    want = {(d, i) for d, t in docs for i, s in items if holds(t, s)}
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_edits=1)
    assert want and {tuple(r) for r in got.collect()} == {(*w, 0) for w in want}


def test_near_leaks_against_brute_force(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(4)]

    def spoil(text, edits):
        for _ in range(edits):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "x", "x" + text[at]]) + text[at + 1 :]
        return text

    docs = []
    for d in range(60):
        src = rng.choice(items)[1].split()
        at = rng.randrange(len(src) - 12)
        docs.append((d, " ".join([rng.choice(vocab) for _ in range(8)] + [spoil(" ".join(src[at : at + rng.choice([11, 12, 13])]), d % 5)] + [rng.choice(vocab) for _ in range(8)])))

    def least(text, item):
        t, s = "".join(text.split()), item.split()
        return min(leaks.myers("".join(s[j : j + 12]), t) for j in range(len(s) - 11))

    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    edits = {(d, i): least(t, s) for d, t in docs for i, s in items}
    for k in (0, 1, 2):
        got = {tuple(r) for r in leaks.leaks(*frames, max_edits=k, exact=False).collect()}
        assert got == {(*p, e) for p, e in edits.items() if e <= k} and any(e == k for *_, e in got)


# --- p9


def test_isotonic():
    assert list(readability.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0]))) == [1.0, 7 / 3, 7 / 3, 7 / 3, 5.0]


@needs_data
def test_held_out_accuracy():
    import pyarrow.parquet as pq

    s = pq.read_table(f"{DATA}/reading_samples.parquet").to_pylist()
    y = np.array([r["reading_level"] for r in s])
    fold = np.random.RandomState(0).permutation(len(s)) % 5
    right = 0
    for k in range(5):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        m = readability.fit([s[i]["text"] for i in train], [int(y[i]) for i in train])
        x = np.array([readability.features(readability.english(s[i]["text"], m.letters), m.lexicon) for i in test])
        right += int((m.level(x) == y[test]).sum())
    assert right >= 0.95 * len(s)


def test_pairs_in_blocks_give_the_weights_of_all_pairs():
    rng = np.random.RandomState(4)
    y = rng.randint(1, 5, 90).astype(float)
    z = rng.normal(size=(90, 4)) + y[:, None] * [0.5, 0.2, 0.0, -0.3]
    hi, lo = np.nonzero(y[:, None] > y[None, :])
    d, w = z[hi] - z[lo], np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.eye(4) / 90, d.T @ (1 - p) / len(d) - w / 90)
    for block in (7, 90, 512):
        assert np.allclose(readability.pairwise_weights(z, y, 1.0, block), w, atol=1e-6)


@needs_data
def test_a_fit_at_its_bound_stays_small():
    import tracemalloc

    import pyarrow.parquet as pq

    s = pq.read_table(f"{DATA}/reading_samples.parquet").to_pylist() * 32
    x = np.random.RandomState(1).normal(size=(readability.MAX_SAMPLES, len(readability.FEATURES)))
    tracemalloc.start()
    readability.pairwise_weights(x, np.array([r["reading_level"] for r in s][: len(x)], float), 1.0)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


@needs_data
def test_the_gate_keeps_english_and_leaves_out_other_languages():
    import pyarrow.parquet as pq

    s = pq.read_table(f"{DATA}/reading_samples.parquet").to_pylist()
    letters = readability.fit([r["text"] for r in s], [r["reading_level"] for r in s]).letters
    foreign = [
        "De wet is in de maand van mei door de kamer aangenomen en we moeten over de gevolgen daarvan nog spreken.", "O livro que a menina leu no domingo fala de uma casa no campo onde as pessoas do lugar se encontram.",
        "Il ramo viene chiuso quando i dati sono stati salvati e la revisione torna visibile in ogni copia.",
        "Der Zweig wird danach geschlossen und die Revision bleibt in jedem Fall erhalten.", "La rama se cierra cuando los datos se guardan y la revisión vuelve a ser visible.", "Galaz zostaje zamknieta gdy dane sa zapisane w pliku i w bazie.",
    ]
    assert all(not readability.english(t, letters) for t in foreign)
    plain = ["Copy the active folder in this module.", "Heavy rain fell over southern hills while farmers waited inside old barns.", "Jazz music spread quickly along the rivers, carried by bands."]
    assert all(readability.english(t, letters) for t in plain)


EASY = "The cat sees a dog. We take the key now. A box can be red. You can get the big map. Then the man is at the door. It has a new lid. "
HARD = "Notwithstanding the considerable heterogeneity attributed to institutional identities, the characteristic authoritativeness that corroborates such confidentiality remains contingent upon an antecedent reproducibility. "


def test_levels_and_who_has_none(spark):
    samples = spark.createDataFrame([(i, 1 if i % 2 else 4, (EASY if i % 2 else HARD) * (2 + i % 3), 0) for i in range(20)] + [(99, None, "x", 0), (98, 1, None, 0)], "sample_id bigint, reading_level int, text string, doc_id int")
    code = "```\n" + "def f(x):\n    return the_value(x)\n" * 30 + "```\n"
    docs = {1: EASY * 3, 2: HARD * 3, 3: EASY, 4: None, 5: "", 6: code, 7: "Der Hund liest das Buch und die Katze schreibt den Brief mit der Hand. " * 9, 8: code + EASY * 3, 9: "- " + "\n- ".join((EASY * 3).split(". ")), 10: (EASY * 3).replace("now.", "now, cf. `a/b/c.rs`."), 11: HARD * 4000}
    df = spark.createDataFrame([(i, t, 7) for i, t in docs.items()] + [(None, EASY * 3, 7)], "doc_id bigint, text string, reading_level int")
    got = {r.doc_id: r.reading_level for r in readability.reading_levels(df, samples).collect()}
    assert got == {1: 1, 2: 4, 8: 1, 9: 1, 10: 1, 11: 4}
    assert readability.reading_levels(df.limit(0), samples).isEmpty()
    with pytest.raises(ValueError):
        readability.reading_levels(df, samples.filter("reading_level = 1"))
