"""Column expressions for bodies of symbols, texts to embed, and the ids of what is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.scoring import stable_id


def body_snippet(content: Column, start_line: Column, end_line: Column) -> Column:
    """The lines of a symbol: those of its span if it has several, else its line and the indented or empty ones below it.

    Lines count from 1 and end in LF or CRLF. An unknown span (0 or null), null content and a start beyond the end give ''.
    """
    lines = F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")
    n = F.size(lines)
    whole = F.slice(lines, start_line, F.least(end_line, n) - start_line + 1)
    rest = F.slice(lines, start_line + 1, n - start_line)
    stop = F.array_position(F.transform(rest, lambda x: (x != "") & ~x.rlike(r"^[ \t]")), F.lit(True)).cast("int")
    block = F.concat(F.slice(lines, start_line, F.lit(1)), F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(n - start_line)))
    known = content.isNotNull() & (start_line > 0) & (start_line <= n)
    return F.when(known, F.array_join(F.when(end_line > start_line, whole).otherwise(block), "\n")).otherwise("")


def embed_text(qualified_name: Column, file_path: Column, snippet: Column) -> Column:
    """What is embedded for a body: with its symbol's name and path above it, if it has one."""
    return F.when(qualified_name.isNull(), snippet).otherwise(F.concat(qualified_name, F.lit("\n"), file_path, F.lit("\n"), snippet))


def backoff_ms(failures: Column, cap_ms: int = 30_000) -> Column:
    """How long to wait after so many failures in a row: 250 ms, doubled for each up to ten, and no longer than the cap."""
    return F.least(250 * F.pow(F.lit(2), F.least(failures, F.lit(10))), F.lit(cap_ms)).cast("bigint")


def identity_id(path: Column, identity_key: Column) -> Column:
    return stable_id(F.lit("id"), path, identity_key)


def file_identity(path: Column) -> Column:
    return stable_id(F.lit("file"), path)


def revision_id(branch: Column, path: Column, identity_key: Column) -> Column:
    """The id of a symbol's stable slot on a branch."""
    return stable_id(F.lit("rev"), branch.cast("string"), path, identity_key)


def content_revision_id(branch: Column, identity: Column, body_hash: Column) -> Column:
    """The id of a revision by its content: the same body gives the same revision."""
    return stable_id(F.lit("revgen"), branch.cast("string"), identity, body_hash)


def edge_id(tag: Column, path: Column, source: Column, label: Column, line: Column, col: Column) -> Column:
    return stable_id(F.lit("edge"), tag, path, source, label, line.cast("string"), col.cast("string"))


def body_slot(path: Column, identity_key: Column) -> Column:
    """Where a symbol's body is kept, whatever the body is."""
    return stable_id(F.lit("bh"), path, identity_key)


def allocation_key(path: Column, key: Column) -> Column:
    """What must be unique for a new identity: its place, not its body, as equal stubs in two files are two symbols."""
    return stable_id(F.lit("cas"), path, key)


def chunk_id(identity: Column, revision: Column, no: Column) -> Column:
    return stable_id(F.lit("chunk"), identity, revision, no.cast("string"))
