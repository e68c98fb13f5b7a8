"""Source files that nobody wrote by hand: output of tools, minified scripts, third-party copies and data saved as code.

Paths and the comments at the head of a file tell many of them. What is left is compared over inverted indexes of hashes
of lines: a file most of whose lines stand in one third-party file is an edited copy of it, and a file most of whose runs
of lines stand in several repositories is third-party code, although nothing says so anywhere. A run of three lines is so
rare that it hardly ever occurs twice by chance. The composition of the tokens of what remains tells minified scripts,
data and repetitive output of tools.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shorter lines say nothing about where a file is from.
LINE_CHARS = 12
#: A copy is first looked for among so many third-party contents of each line; what is not found so is looked for among all.
NEAR = 8
CONTAINED, LEAST_LINES = 0.6, 5
#: Lines a run, the share of a content's runs that must stand in so many repositories, its own counted. A run outlives an
#: edit if its three lines do, so that of a copy with three quarters of its lines left about 0.4 of the runs are.
RUN, SPREAD_SHARE, REPOSITORIES = 3, 0.4, 3

#: Directories and names, in lower case, of third-party copies and of what tools write.
VENDOR_DIRS = "vendor|_vendor|third_party|third-party|thirdparty|3rdparty|3rd_party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|external|extern|\\.venv|venv|pods|carthage|godeps"
TOOL_DIRS = "gen|generated|__generated__|auto_generated|autogen|build|dist|target|obj"
TOOL_NAMES = r"_pb2(_grpc)?\.pyi?$|\.pb(\.\w+)?\.\w+$|[._-](gen|generated|autogen)\.\w+$|\.moc\.\w+$|(^|/)moc_\w+\.\w+$|\.g\.(cs|dart)$|\.designer\.cs$|(^|/)zz_generated"
SMALL_NAMES = r"[._-](min|bundle|packed)\.\w+$"
#: What the head of a file says if a tool wrote it, or a third party.
TOOL_WORDS = re.compile(
    r"auto-?\s?generated|@generated|machine[- ](?:made|generated)|\b(?:code |file |this file (?:was|is) |automatically )?generated (?:by|from|with|using)\b|do not (?:edit|modify)|"
    r"(?:any|all|your) changes? (?:will|would) be (?:lost|overwritten)|edits? (?:are|will be|get) (?:overwritten|lost)|"
    r"automatisch (?:erzeugt|erstellt|generiert)|nicht (?:bearbeiten|ändern)|généré (?:automatiquement|par)|ne pas (?:modifier|éditer)|"
    r"generado (?:automáticamente|por)|no (?:editar|modificar)|gerado automaticamente|não edit|自動生成|自动生成|請勿編輯|请勿编辑|編集しない|не редактировать|сгенерирован",
    re.I,
)
VENDOR_WORDS = re.compile(
    r"vendored (?:from|copy)|copied (?:verbatim|unchanged) from|copied from \S+ (?:release|version|v?\d)|^\W*upstream\s*:|(?:patches|changes|fixes) go upstream|imported (?:by the sync|from upstream)|bundled (?:copy|version) of|"
    r"(?:\(c\)|©|copyright)\W+(?:\d{4}\S*\s+)?(?:the )?\S+ (?:contributors|authors|developers)",
    re.I | re.M,
)
HAND_WORDS = re.compile(r"(?:edited|written|maintained|kept) by hand|hand-?written|written (?:anew|from scratch)|unlike the generated|not (?:generated|vendored|copied)", re.I)

_LINES = re.compile(r"\r\n|\n|\r")
_COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|pragma|!?\[))|/\*|\*|--|;|<!--|%|\"\"\"|''')")
_TOKEN = re.compile(r"(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<number>\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)\w?\b)|(?P<ident>[A-Za-z_$]\w*)|(?P<other>[^\sA-Za-z_$\d\"'])")
_BLOB = re.compile(r"^[\s\"'`+,]*[A-Za-z0-9+/=_-]{48,}[\s\"'`+,;)]*$")
_NOTES = re.compile(r"/\*.*?\*/|(?:^|(?<=\s))//[^\n]*|^\s*#(?!include|define)[^\n]*", re.S | re.M)


def head_comments(lines: list[str]) -> str:
    """The comments before a file's first line of code."""
    out, inside = [], False
    for line in lines:
        if not line.strip():
            continue
        if not inside and not _COMMENT.match(line):
            break
        out.append(line)
        opened, closed = line.rfind("/*"), line.rfind("*/")
        inside = opened > closed if max(opened, closed) >= 0 else inside
    return "\n".join(out)


def composition(text: str, lines: list[str]) -> str | None:
    """minified, data or tool, if the tokens of the text tell it; else null."""
    body = "\n".join(lines)
    bulk = sum(len(x) for x in lines)
    code = _NOTES.sub(" ", body)
    size: Counter[str] = Counter()
    for line in code.split("\n"):
        if _BLOB.match(line):
            size["string"] += len(line)
        else:
            for m in _TOKEN.finditer(line):
                size[m.lastgroup or "other"] += m.end() - m.start()
    solid = sum(size.values()) or 1
    if size["ident"] < 0.06 * solid and size["string"] + size["number"] > 0.35 * solid:
        return "data"
    wide = [x for x in lines if len(x) > 300]
    if sum(map(len, wide)) > 0.6 * bulk:
        packed = "".join(wide)
        spaces = sum(c.isspace() for c in packed) / len(packed)
        if size["string"] > 0.8 * solid:
            return "data"
        if spaces < 0.12:
            return "minified"
    shapes: Counter[str] = Counter()
    for line in code.split("\n"):
        shape = re.sub(r"\d+|0x[0-9a-fA-F]+", "#", re.sub(r"[A-Za-z_$][\w$]*", "w", line.strip()))
        if "w" in shape:
            shapes[shape] += 1
    n = sum(shapes.values())
    if n >= 12 and sum(c for _, c in shapes.most_common(2)) >= 0.9 * n:
        return "tool"
    return None


def inspect(data: bytes) -> tuple[str | None, list[int], list[int]]:
    """(what the content tells: tool, vendored, minified, data or null; hashes of its telling lines, and of their runs)."""
    import xxhash

    text = data.decode("utf-8", "replace")
    lines = _LINES.split(text)
    head = "\n".join(x for x in head_comments(lines).split("\n") if not HAND_WORDS.search(x))
    kind = "tool" if TOOL_WORDS.search(head) else "vendored" if VENDOR_WORDS.search(head) else composition(text, lines)
    telling = [xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63) for x in lines if len(s := x.strip()) >= LINE_CHARS and not _COMMENT.match(s)]
    runs = {xxhash.xxh64_intdigest(repr(telling[i : i + RUN])) - (1 << 63) for i in range(len(telling) - RUN + 1)}
    return kind, sorted(set(telling)), sorted(runs)


def tree_root(path: Column) -> Column:
    """The folder at the top of a path, in lower case: a file's repository where none is named. '' for a bare name."""
    return F.regexp_extract(F.lower(F.translate(path, "\\", "/")), r"^(?:\.?/)*([^/]+)/", 1)


def spread_out(contents: DataFrame, places: DataFrame, share: float, repositories: int, least: int) -> DataFrame:
    """(body_hash) of the contents (body_hash, runs) of which ``share`` of the runs, and ``least``, each stand in as many repositories.

    places: body_hash, repository. Runs are counted, never paired, so that no number of copies makes more than a row each.
    """
    held = contents.join(places.distinct(), "body_hash").select(F.explode("runs").alias("run"), "repository")
    wide = held.groupBy("run", "repository").agg(F.lit(1).alias("one")).groupBy("run").agg(F.count("one").alias("n")).filter(F.col("n") >= repositories).select("run")
    needed = F.greatest(F.lit(least), F.ceil(F.col("total") * share - 1e-9))
    mine = contents.select("body_hash", F.size("runs").alias("total"), F.explode("runs").alias("run")).join(wide, "run", "left_semi")
    return mine.groupBy("body_hash", "total").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= needed).select("body_hash")


def path_kind(path: Column) -> Column:
    """vendored, minified or tool, if the path tells it; else null. Case and the kind of slash do not matter."""
    p = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(p.rlike(f"(^|/)({VENDOR_DIRS})/"), "vendored")
        .when(p.rlike(SMALL_NAMES), "minified")
        .when(p.rlike(f"(^|/)({TOOL_DIRS})/") | p.rlike(TOOL_NAMES), "tool")
    )


def not_handwritten(files: DataFrame, bodies: DataFrame, contained: float = CONTAINED, least_lines: int = LEAST_LINES, repository: str | None = None, spread_share: float = SPREAD_SHARE, repositories: int = REPOSITORIES) -> DataFrame:
    """(file_path, kind) of the distinct paths whose file is not hand-written; kind is vendored, tool, minified or data.

    files: file_path, body_hash (plain, null if unknown), any rows; bodies: body_hash, bytes. A path that has several
    contents is judged by each. A file whose path tells nothing and whose content is null, empty or missing is taken for
    hand-written. Null paths are left out, bytes that are no UTF-8 are read with replacement, whole contents are read,
    repeated rows count once, extra columns are ignored and empty tables give no rows.

    A content is a copy if ``contained`` of its lines, and ``least_lines``, stand in one third-party content, however many
    contents hold them. Contents of which too few lines stand in any are left out first. A copy's rarest lines are so many
    that one of them must stand in the original, so the search by them loses none. A content is third-party, too, if
    ``spread_share`` of its runs of three lines, and ``least_lines``, each stand in ``repositories`` repositories: those
    named by the column ``repository`` of files, else the folders at the top of the paths. Either test is off if its share
    is above 1.
    """
    from brindle.workspace import Workspace

    ws = Workspace(files.sparkSession, "handwritten")
    owner = tree_root(F.col("file_path")) if repository is None else F.col(repository).cast("string")
    placed = files.select("file_path", "body_hash", owner.alias("repository")).filter("file_path is not null").distinct()
    f = placed.select("file_path", "body_hash").distinct()
    wanted = f.filter("body_hash is not null").select("body_hash").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            out: list[tuple[str, str | None, list[int], list[int]]] = []
            for h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    out.append((h, *inspect(raw)))
            cols = list(zip(*out)) if out else [()] * 4
            types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["body_hash", "said", "lines", "runs"])

    contents = bodies.select("body_hash", "bytes").filter("body_hash is not null and octet_length(bytes) > 0").join(wanted, "body_hash", "left_semi").mapInArrow(run, "body_hash string, said string, lines array<bigint>, runs array<bigint>").dropDuplicates(["body_hash"])
    contents = ws.write(contents, "contents")
    judged = f.join(contents.select("body_hash", "said", F.lit(True).alias("there")), "body_hash", "left").withColumn("kind", F.coalesce(path_kind(F.col("file_path")), "said"))

    # One content may lie at several paths; it is third-party if it is so at any of them.
    by_content = judged.filter("body_hash is not null and there").groupBy("body_hash").agg(F.max(F.coalesce(F.col("kind") == "vendored", F.lit(False))).alias("third"), F.min(F.col("kind").isNull()).alias("open"))
    by_content = by_content.filter("third or open").join(contents.select("body_hash", "lines"), "body_hash")
    source = by_content.filter("third").select(F.col("body_hash").alias("source"), F.explode("lines").alias("line"))
    w = Window.partitionBy("line").orderBy("source")
    near = source.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= NEAR).groupBy("line").agg(F.collect_list("source").alias("near"))
    held = near.join(source.groupBy("line").agg(F.count(F.lit(1)).alias("held")), "line")
    least = F.greatest(F.lit(least_lines), F.ceil(F.size("lines") * contained - 1e-9))
    opened = by_content.filter("open").withColumn("least", least).filter(F.size("lines") >= F.col("least"))
    hits = opened.select("body_hash", "least", F.size("lines").alias("total"), F.explode("lines").alias("line")).join(held, "line")
    mine = hits.groupBy("body_hash", "least", "total").agg(F.array_sort(F.collect_list(F.struct("held", "line", "near"))).alias("hits")).filter(F.size("hits") >= F.col("least"))
    mine = ws.write(mine, "mine")
    # Shared lines counted over a few originals of each line: too low at worst.
    soon = mine.select("body_hash", "least", F.explode("hits.near").alias("near")).select("body_hash", "least", F.explode("near").alias("source")).groupBy("body_hash", "least", "source").agg(F.count(F.lit(1)).alias("n"))
    soon = ws.write(soon.filter("n >= least").select("body_hash").distinct(), "soon")
    rest = mine.join(soon, "body_hash", "left_anti").withColumn("has", F.col("hits.line"))
    rarest = rest.select("body_hash", F.explode(F.slice("hits.line", F.lit(1), F.size("hits") - F.col("least") + 1)).alias("line"))
    pairs = rarest.join(source, "line").select("body_hash", "source").distinct()
    both = pairs.join(rest.select("body_hash", "least", "has"), "body_hash").join(by_content.filter("third").select(F.col("body_hash").alias("source"), "lines"), "source")
    copies = soon.unionByName(both.filter(F.size(F.array_intersect("has", "lines")) >= F.col("least")).select("body_hash")).distinct()
    shared = spread_out(contents.select("body_hash", "runs"), placed.filter("body_hash is not null").select("body_hash", "repository"), spread_share, repositories, least_lines)
    copied = judged.filter("kind is null").join(copies.unionByName(shared).distinct(), "body_hash", "left_semi").select("file_path", F.lit("vendored").alias("kind"))
    return judged.filter("kind is not null").select("file_path", "kind").unionByName(copied).groupBy("file_path").agg(F.max("kind").alias("kind"))
