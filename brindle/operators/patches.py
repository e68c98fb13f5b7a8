"""Edits of files before they are confirmed: unified diffs, and what becomes of their revisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def is_unified_diff(text: str) -> bool:
    return any(_HUNK.match(line) for line in text.splitlines())


def apply_patch(before: str, patch: str) -> str:
    """The text after a unified diff, or the patch itself if it is a whole text. Lines that do not fit raise ValueError."""
    if not is_unified_diff(patch):
        return patch
    old, out, at = before.splitlines(keepends=True), [], 0
    lines = patch.splitlines()
    i = 0
    while i < len(lines):
        m = _HUNK.match(lines[i])
        i += 1
        if not m:
            continue
        start = int(m[1]) - (1 if m[2] != "0" else 0)
        if start < at or start > len(old):
            raise ValueError("hunks overlap or lie beyond the end")
        out += old[at:start]
        at = start
        left, right = int(m[2] or 1), int(m[4] or 1)
        while (left or right) and i < len(lines):
            mark, text = (lines[i][:1] or " "), lines[i][1:]
            i += 1
            if mark == "\\":
                continue
            if mark in " -":
                if at >= len(old) or old[at].rstrip("\r\n") != text:
                    raise ValueError(f"line {at + 1} does not fit the patch")
                if mark == " ":
                    out.append(old[at])
                    right -= 1
                at += 1
                left -= 1
            elif mark == "+":
                out.append(text + "\n")
                right -= 1
            else:
                raise ValueError(f"unexpected line in hunk: {lines[i - 1]!r}")
    return "".join(out + old[at:])


#: A path that leaves its root, or is none.
_OUTSIDE = re.compile(r"^$|^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\.\.([/\\\\]|$)")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(patch_id, path, before, after, error): edits of files, those of one path in the order of seq, each on top of the last.

    files: path, content; edits: patch_id, path, text (a unified diff or a whole text), seq. A file that is not there is
    empty and its ``before`` null. An edit that does not fit, has no text or whose path lies outside the root has an error,
    and no after; later ones go on from what was there. ``before`` is what a revert restores.
    """
    fields = "patch_id string, path string, before string, after string, error string"

    def run(key: tuple, have: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        now = have["content"].iloc[0] if len(have) else None
        out = []
        for r in todo.sort_values("seq", kind="stable").itertuples():
            after, error = None, None
            if _OUTSIDE.search(key[0] or ""):
                error = "path outside the root"
            elif not isinstance(r.text, str):
                error = "no text"
            else:
                try:
                    after = apply_patch(now or "", r.text)
                except ValueError as e:
                    error = str(e)
            out.append((r.patch_id, key[0], now, after, error))
            now = now if error else after
        return pd.DataFrame(out, columns=["patch_id", "path", "before", "after", "error"])

    e = edits.select(F.col("patch_id").cast("string").alias("patch_id"), "path", "text", "seq").groupBy("path")
    return files.select("path", "content").dropDuplicates(["path"]).groupBy("path").cogroup(e).applyInPandas(run, fields)


def reverted(patches: DataFrame, ids: DataFrame) -> DataFrame:
    """(patch_id, path, action, content): patches to take back: restore (with what was there before) or superseded by a later one.

    patches: patch_id, path, before, seq of the applied edits; ids: patch_id. A file that was not there before is removed.
    """
    last = patches.groupBy("path").agg(F.max("seq").alias("last"))
    p = patches.join(ids.select("patch_id").distinct(), "patch_id", "left_semi").join(last, "path")
    action = F.when(F.col("seq") < F.col("last"), "superseded").when(F.col("before").isNull(), "remove").otherwise("restore")
    return p.select("patch_id", "path", action.alias("action"), F.when(F.col("seq") == F.col("last"), F.col("before")).alias("content"))


def settle(revisions: DataFrame, paths: DataFrame, confirm: bool, now_ms: int) -> DataFrame:
    """Speculative revisions of the given paths become Active, or Tombstone with the time; all others stay."""
    mine = F.coalesce("settled", F.lit(False)) & (F.col("status") == "Speculative")
    r = revisions.join(paths.select(F.col("path").alias("file_path")).distinct().withColumn("settled", F.lit(True)), "file_path", "left")
    status = F.when(mine, "Active" if confirm else "Tombstone").otherwise(F.col("status"))
    time = F.when(mine & F.lit(not confirm), F.lit(now_ms)).otherwise(F.col("tombstoned_at_ms"))
    return r.withColumn("tombstoned_at_ms", time.cast("bigint")).withColumn("status", status).select(*revisions.columns)


def orphan_tokens(tokens: DataFrame, patches: DataFrame) -> DataFrame:
    """Tokens whose patch does not exist."""
    return tokens.join(patches.select("patch_id"), "patch_id", "left_anti")


def invariant_violations(patches: DataFrame, leases: DataFrame, revisions: DataFrame) -> DataFrame:
    """(check, key): patches without a lease, leases without a patch, and speculative revisions of paths without a patch."""
    a = patches.join(leases.select("path"), "path", "left_anti").select(F.lit("patch_without_lease").alias("check"), F.col("path").alias("key"))
    b = leases.join(patches.select("path"), "path", "left_anti").select(F.lit("lease_without_patch").alias("check"), F.col("path").alias("key"))
    s = revisions.filter("status = 'Speculative'").select(F.col("file_path").alias("path")).distinct()
    c = s.join(patches.select("path"), "path", "left_anti").select(F.lit("speculative_without_patch").alias("check"), F.col("path").alias("key"))
    return a.unionByName(b).unionByName(c)
