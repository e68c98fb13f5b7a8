"""Source trees as DataFrames: files with wanted extensions, without what ignore rules and built-in names leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories never indexed, and name endings of artefacts.
SKIP_DIRS = [
    ".git", "__pycache__", ".venv", ".venv-embed", "venv", ".tox", ".mypy_cache", ".pytest_cache", "site-packages", "node_modules", "dist", "coverage", ".next",
    ".nuxt", "target", "vendor", "build", "out", "bin", "obj", ".gradle", ".idea", "cmake-build-debug", "cmake-build-release",
]
SKIP_NAMES = r"\.min\.(js|jsx|ts|tsx|css)$|\.(pyc|pyo|class|o|obj|a|so|dylib|dll|exe)$"
#: Extensions of each language.
LANGUAGES = {
    "Python": ["py"], "TypeScript": ["ts", "tsx"], "JavaScript": ["js", "jsx", "mjs", "cjs"], "Rust": ["rs"], "Go": ["go"],
    "Java": ["java"], "C": ["c", "h"], "Cpp": ["cc", "cpp", "cxx", "hpp", "hh", "hxx"], "CSharp": ["cs"],
}


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(path.rlike(rf"\.({'|'.join(ends)})$"), name).otherwise(out)
    return out


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def kept(path: Column) -> Column:
    """Whether no directory on the path is one that is never indexed, and the name is no artefact's."""
    dirs = "|".join(re.escape(d) for d in SKIP_DIRS)
    p = F.lower(path)
    return ~p.rlike(rf"(^|/)({dirs})/") & ~p.rlike(SKIP_NAMES)


def ignore_pattern(rule: str, base: str = "") -> tuple[bool, str] | None:
    """(negated, regular expression over relative paths) of a line of an ignore file in the directory ``base``."""
    line = rule.rstrip("\r\n").strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    directory, line = line.endswith("/"), line.strip("/") if line.endswith("/") else line
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    head = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return negated, f"^{head}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if directory else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches the path ignores it."""
    out = F.lit(False)
    for negated, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def ignore_rules(spark: SparkSession, root: str, name: str = ".gitignore", depth: int = 32) -> list[tuple[bool, str]]:
    """The rules of all ignore files under root, outer ones first, so that the innermost rule that matches counts.

    Readers of files skip hidden names, so the files are looked for level by level; only they and their lines are fetched.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = re.sub(r"^\w+:(//)?", "", root.rstrip("/"))
    out: list[tuple[bool, str]] = []
    for k in range(depth):
        level = root.rstrip("/") + "/*" * k
        if k and not fs.globStatus(path(level)):
            break
        for found in sorted((f.getPath() for f in fs.globStatus(path(f"{level}/{name}")) or ()), key=str):
            stream = fs.open(found)
            lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
            folder = re.sub(r"^\w+:(//)?", "", str(found.toString()))[len(base) :].strip("/").rpartition("/")[0]
            out += [p for line in lines if (p := ignore_pattern(line, folder))]
    return out


def read_tree(spark: SparkSession, root: str, rules: list[str] = (), ignore_files: bool = True) -> DataFrame:
    """(path, language, content, size, modified) of the source files under root; content is UTF-8 text.

    Ignore rules are those of the tree's own ignore files and then the given lines; names, rules and extensions are plain
    predicates on the path column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^\w+:(//)?", "")
    rel = F.regexp_replace(F.col("path"), r"^\w+:(//)?", "")
    df = files.withColumn("rel", normal_path(F.ltrim(F.replace(rel, base, F.lit("")), F.lit("/"))))
    patterns = (ignore_rules(spark, root) if ignore_files else []) + [p for p in map(ignore_pattern, rules) if p]
    df = df.filter(kept(F.col("rel")) & ~ignored(F.col("rel"), patterns)).withColumn("language", language_of(F.col("rel"))).filter("language IS NOT NULL")
    return df.select(F.col("rel").alias("path"), "language", F.decode(F.col("content"), "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): created, modified or deleted between two listings (path, modified)."""
    a, b = before.select("path", F.col("modified").alias("m0")), now.select("path", F.col("modified").alias("m1"))
    j = a.join(b, "path", "full")
    return j.select("path", F.when(F.col("m0").isNull(), "created").when(F.col("m1").isNull(), "deleted").when(F.col("m0") != F.col("m1"), "modified").alias("change")).filter("change IS NOT NULL")
