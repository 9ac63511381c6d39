"""Unified diffs: segmentation by windows, strict parsing, canonical text, paths, hunk repair."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.functions import paths
from strandwork.functions.text import redact
from strandwork.operators.extract import lines

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"

# ---- relational form ----------------------------------------------------------------


def segments(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., line_no, line, file_no, hunk_no, kind): kind is header, hunk, ' ', '-', '+', '\\\\' or other.

    A line that starts with '--- ' opens a file only if '+++ ' and '@@ ' follow, so deleted
    lines that look like headers stay lines.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    df = lines(df, text, *keys)
    one, two = F.lead("line", 1).over(order), F.lead("line", 2).over(order)
    opens = F.col("line").startswith("--- ") & F.coalesce(one.startswith("+++ "), F.lit(False)) & F.coalesce(two.startswith("@@ "), F.lit(False))
    df = df.withColumn("__opens", opens)
    df = df.withColumn("__plus", F.coalesce(F.lag("__opens").over(order), F.lit(False))).withColumn("__hunk", F.col("line").rlike(HUNK))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("file_no", F.sum(F.col("__opens").cast("int")).over(so_far))
    within = Window.partitionBy(*keys, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("hunk_no", F.sum(F.col("__hunk").cast("int")).over(within))
    mark = F.left("line", F.lit(1))
    kind = F.when(F.col("__opens") | F.col("__plus"), "header").when(F.col("__hunk"), "hunk").when((F.col("hunk_no") > 0) & (F.col("line") == ""), " ").when((F.col("hunk_no") > 0) & mark.isin(" ", "-", "+", "\\"), mark).otherwise("other")
    return df.select(*keys, "line_no", "line", F.col("file_no").cast("long").alias("file_no"), F.col("hunk_no").cast("long").alias("hunk_no"), kind.alias("kind"))


def hunk_counts(segmented: DataFrame, *keys: str) -> DataFrame:
    """(keys..., file_no, hunk_no, starts, declared and actual line counts of both sides, matches)."""
    head = F.max(F.when(F.col("kind") == "hunk", F.col("line")))
    part = lambda i: F.regexp_extract("head", HUNK, i)
    count = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(1))
    by = segmented.where("hunk_no > 0").groupBy(*keys, "file_no", "hunk_no").agg(
        head.alias("head"), F.count_if(F.col("kind").isin(" ", "-")).alias("old_actual"), F.count_if(F.col("kind").isin(" ", "+")).alias("new_actual"),
        F.count_if(F.col("kind") == "+").alias("additions"), F.count_if(F.col("kind") == "-").alias("deletions"),
    )
    out = by.select(*keys, "file_no", "hunk_no", part(1).cast("int").alias("old_start"), count(2).alias("old_declared"), "old_actual", part(3).cast("int").alias("new_start"), count(4).alias("new_declared"), "new_actual", "additions", "deletions")
    return out.withColumn("matches", (F.col("old_declared") == F.col("old_actual")) & (F.col("new_declared") == F.col("new_actual")))


def ordered_hunks(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., file_no, ordered): whether each hunk of a file starts after the one before ends."""
    before = F.lag(F.col("old_start") + F.col("old_actual")).over(Window.partitionBy(*keys, "file_no").orderBy("hunk_no"))
    df = counts.withColumn("__ok", F.coalesce(F.col("old_start") >= before, F.lit(True)))
    return df.groupBy(*keys, "file_no").agg(F.bool_and("__ok").alias("ordered"))


def patch_paths(segmented: DataFrame, *keys: str) -> DataFrame:
    """(keys..., path): distinct paths of file headers, side prefixes off, /dev/null out."""
    head = segmented.where("kind = 'header'").select(*keys, F.coalesce(F.when(F.col("line").startswith("--- "), paths.header_path(F.col("line"), "--- ")), paths.header_path(F.col("line"), "+++ ")).alias("path"))
    return head.where("path <> '/dev/null'").select(*keys, F.regexp_replace("path", "^[ab]/", "").alias("path")).distinct()


def safe_files(files: DataFrame, *keys: str) -> DataFrame:
    """(keys..., pos, path, body) of diffs' files(keys..., path, body): ignored ones left out, bodies redacted, last a note how many are missing."""
    hidden = paths.is_ignored(F.col("path"))
    kept = files.where(~hidden).select(*keys, "path", redact(F.col("body")).alias("body"))
    kept = kept.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("path"))).cast("int"))
    note = files.groupBy(*keys).agg(F.count_if(hidden).alias("n"), F.count_if(~hidden).alias("k")).where("n > 0")
    note = note.select(*keys, (F.col("k") + 1).cast("int").alias("pos"), F.concat(F.col("n").cast("string"), F.lit(" omitted")).alias("path"), F.lit(None).cast("string").alias("body"))
    return kept.select(*keys, "pos", "path", "body").union(note)


def unique_start(source: Column, needle: Column) -> Column:
    """Index (from 0) at which a line sequence stands in another exactly once; null otherwise."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(source) - F.size(needle), F.lit(0))), lambda i: F.slice(source, i + 1, F.size(needle)) == needle)
    return F.when((F.size(needle) > 0) & (F.size(at) == 1), F.get(at, F.lit(0)))


# ---- strict form --------------------------------------------------------------------


class DiffError(ValueError):
    """What is wrong with a diff, and in which line (from 1)."""

    def __init__(self, what: str, line_no: int):
        super().__init__(f"line {line_no}: {what}")
        self.line_no = line_no


@dataclass(frozen=True)
class Hunk:
    old_start: int
    old_count: int
    new_start: int
    new_count: int
    section: str
    body: tuple[tuple[str, str], ...]  # (kind, text); kind '\\' for the no-newline mark

    def side(self, kinds: str) -> list[str]:
        return [text for kind, text in self.body if kind in kinds]

    @property
    def actual(self) -> tuple[int, int]:
        return len(self.side(" -")), len(self.side(" +"))

    def render(self) -> list[str]:
        old, new = self.actual
        return [f"@@ -{self.old_start},{old} +{self.new_start},{new} @@{self.section}", *[kind + text for kind, text in self.body]]


@dataclass
class FilePatch:
    old_path: str
    new_path: str
    headers: list[str] = field(default_factory=list)
    hunks: list[Hunk] = field(default_factory=list)


_META = re.compile(r"(old mode|new mode|deleted file mode|new file mode|rename from|rename to|copy from|copy to|similarity index|dissimilarity index|index) ?(.*)")


def _is_boundary(rows: list[str], i: int) -> bool:
    return rows[i].startswith("diff --git ") or (rows[i].startswith("--- ") and rows[i + 1 : i + 2] and rows[i + 1].startswith("+++ ") and bool(rows[i + 2 : i + 3]) and rows[i + 2].startswith("@@ "))


def _header(row: str, mark: str, line_no: int) -> str:
    path = row[len(mark) :].split("\t")[0].strip().replace("\\", "/")
    if not path:
        raise DiffError(f"{mark.strip()} names no path", line_no)
    return path


def git_paths(row: str) -> tuple[str, str]:
    """The two paths of a diff --git line, shell quotes resolved."""
    try:
        parts = shlex.split(row.removeprefix("diff --git "))
    except ValueError:
        parts = []
    if len(parts) != 2:
        raise ValueError("a diff --git line names two paths")
    return parts[0], parts[1]


_TOKEN = r"""(?:"(?:[^"\\\\]|\\\\.)*"|'[^']*'|[^\\s"'\\\\]|\\\\.)+""".replace("\\\\", "\\")


def git_path_pair(row: Column) -> Column:
    """The two paths of diff --git lines as an array, shell quotes resolved; null if there aren't two."""
    rest = F.regexp_replace(row, "^diff --git ", "")
    bare = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r'"((?:[^"\\]|\\.)*)"', "$1"), r"'([^']*)'", "$1"), r"\\(.)", "$1")
    found = F.transform(F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0)), bare)
    return F.when(row.startswith("diff --git ") & rest.rlike(rf"^\s*{_TOKEN}\s+{_TOKEN}\s*$"), found)


def _moved(headers: list[str]) -> tuple[str, str] | None:
    """Paths of a rename or copy: both ends or an error, never both kinds."""
    ends = {m[1]: m[2] for h in headers if (m := _META.match(h)) and m[1].split()[0] in ("rename", "copy")}
    if not ends:
        return None
    for kind in ("rename", "copy"):
        if set(ends) == {f"{kind} from", f"{kind} to"}:
            return ends[f"{kind} from"], ends[f"{kind} to"]
    raise ValueError("rename or copy metadata is incomplete or mixed")


def parse(text: str) -> list[FilePatch]:
    """File patches of a diff; DiffError names the first line that breaks the form."""
    rows = text.splitlines()
    files: list[FilePatch] = []
    i = 0
    while i < len(rows):
        if not rows[i].strip():
            i += 1
            continue
        if not _is_boundary(rows, i) and not rows[i].startswith("--- "):
            raise DiffError("text outside a file section", i + 1)
        patch = FilePatch("", "")
        began = i
        if rows[i].startswith("diff --git "):
            try:
                patch.old_path, patch.new_path = git_paths(rows[i])
            except ValueError as e:
                raise DiffError(str(e), i + 1) from e
            patch.headers.append(rows[i])
            i += 1
            while i < len(rows) and _META.match(rows[i]):
                patch.headers.append(rows[i])
                i += 1
            try:
                moved = _moved(patch.headers)
            except ValueError as e:
                raise DiffError(str(e), began + 1) from e
            if moved:
                patch.old_path, patch.new_path = f"a/{moved[0]}", f"b/{moved[1]}"
        if i < len(rows) and rows[i].startswith("--- "):
            if i + 1 >= len(rows) or not rows[i + 1].startswith("+++ "):
                raise DiffError("--- is not followed by +++", i + 1)
            patch.old_path, patch.new_path = _header(rows[i], "--- ", i + 1), _header(rows[i + 1], "+++ ", i + 2)
            i += 2
            while i < len(rows) and rows[i].startswith("@@ "):
                i, hunk = _hunk(rows, i)
                patch.hunks.append(hunk)
            if not patch.hunks:
                raise DiffError("a file section without hunks", i)
        elif not any(_META.match(h) for h in patch.headers[1:]):
            raise DiffError("a file section without hunks or metadata", began + 1)
        files.append(patch)
    if not files:
        raise DiffError("no file section", 1)
    return files


def _hunk(rows: list[str], i: int) -> tuple[int, Hunk]:
    m = re.match(HUNK, rows[i])
    if not m:
        raise DiffError("a hunk header of another form", i + 1)
    body, at = [], i + 1
    while at < len(rows) and not rows[at].startswith("@@ ") and not _is_boundary(rows, at):
        row = rows[at]
        if row.startswith("--- ") and rows[at + 1 : at + 2] and rows[at + 1].startswith("+++ "):
            raise DiffError("file headers without a hunk", at + 1)
        if row and row[0] not in " -+\\":
            raise DiffError("a hunk line without a mark", at + 1)
        body.append((row[:1] or " ", row[1:]))
        at += 1
    while body and body[-1] == (" ", "") and not rows[at - 1]:
        body.pop()
        at -= 1
    if not any(kind in "+-" for kind, _ in body):
        raise DiffError("a hunk without changes", i + 1)
    numbers = [int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)]
    end = at
    while end < len(rows) and not rows[end].strip():
        end += 1
    return end, Hunk(*numbers, rows[i][m.end() :], tuple(body))


def serialize(files: list[FilePatch]) -> str:
    """Canonical text: one side prefix, counts recomputed."""

    def side(path: str, mark: str) -> str:
        return path if path == "/dev/null" else f"{mark}/{re.sub('^[ab]/', '', path)}"

    rows: list[str] = []
    for f in files:
        rows += f.headers
        if f.hunks:
            rows += [f"--- {side(f.old_path, 'a')}", f"+++ {side(f.new_path, 'b')}"]
            rows += [row for h in f.hunks for row in h.render()]
    return "\n".join(rows) + "\n"


def mismatches(files: list[FilePatch]) -> list[str]:
    return [f"{f.new_path} hunk {i}: {h.old_count},{h.new_count} declared, {h.actual[0]},{h.actual[1]} found" for f in files for i, h in enumerate(f.hunks, 1) if (h.old_count, h.new_count) != h.actual]


def canonicalize(text: str) -> tuple[str, list[str]]:
    files = parse(text)
    return serialize(files), mismatches(files)


PARSED = "canonical string, mismatches array<string>, files int, hunks int, error string, error_line int"


def _parsed_row(text: str | None) -> tuple:
    try:
        files = parse(text or "")
    except DiffError as e:
        return None, [], 0, 0, str(e), e.line_no
    return serialize(files), mismatches(files), len(files), sum(len(f.hunks) for f in files), None, None


def parsed(body: Column) -> Column:
    """Canonical text and counts of each diff, or the error and its line."""

    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in bodies:
            yield pd.DataFrame([_parsed_row(x) for x in s], columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"error_line": "Int64"})

    return F.pandas_udf(run, PARSED)(body)


# ---- hunk repair against current source ----------------------------------------------


def _starts(source: list[str], needle: list[str]) -> list[int]:
    return [i for i in range(len(source) - len(needle) + 1) if needle and source[i : i + len(needle)] == needle]


def nonblank_spans(source: list[str], needle: list[str]) -> list[tuple[int, int]]:
    """(start, end) in source of every match of the needle when blank lines don't count."""
    at = [i for i, x in enumerate(source) if x.strip()]
    full, wanted = [source[i].rstrip() for i in at], [x.rstrip() for x in needle if x.strip()]
    return [(at[i], at[i + len(wanted) - 1] + 1) for i in _starts(full, wanted)]


def blank_gap(source: list[str], before: str, after: str) -> tuple[int, int] | None:
    """The one gap of blank lines between two anchors, None if there is none or more than one."""
    gaps = []
    for i, x in enumerate(source):
        if x.rstrip() != before.rstrip():
            continue
        j = i + 1
        while j < len(source) and not source[j].strip():
            j += 1
        if j < len(source) and source[j].rstrip() == after.rstrip():
            gaps.append((i + 1, j))
    return gaps[0] if len(gaps) == 1 else None


def surrounded(source: list[str], hunk: Hunk, start: int, end: int) -> Hunk:
    """The hunk's changes with the source's own lines as context; start and end bound its old side in source."""
    core = list(hunk.body)
    head = next((i for i, (k, _) in enumerate(core) if k != " "), 0)
    tail = next((i for i, (k, _) in enumerate(reversed(core)) if k not in " \\"), 0)
    first, last = start + head, end - sum(1 for k, _ in core[len(core) - tail :] if k == " ")
    lo, hi = max(0, first - config.HUNK_CONTEXT), min(len(source), last + config.HUNK_CONTEXT)
    body = (*[(" ", x) for x in source[lo:first]], *core[head : len(core) - tail], *[(" ", x) for x in source[last:hi]])
    old = sum(k in " -" for k, _ in body)
    new = sum(k in " +" for k, _ in body)
    shift = hunk.new_start - hunk.old_start
    return replace(hunk, old_start=lo + 1, old_count=old, new_start=max(lo + 1 + shift, 1), new_count=new, body=tuple(body))


def reanchored(source: list[str], hunk: Hunk) -> Hunk | None:
    """The hunk where its old side stands now: as declared, else at its only place, exact or but for blank lines; None if unclear."""
    old = hunk.side(" -")
    at = hunk.old_start - 1
    if old and source[at : at + len(old)] == old:
        return surrounded(source, hunk, at, at + len(old))
    exact = _starts(source, old)
    if len(exact) == 1:
        return surrounded(source, hunk, exact[0], exact[0] + len(old))
    if not exact:
        spans = nonblank_spans(source, old)
        if len(spans) == 1:
            lo, hi = spans[0]
            marks = iter([k for k, x in hunk.body if k in " -" and x.strip()])
            kept = [(next(marks) if x.strip() else " ", x) for x in source[lo:hi]]
            added = [b for b in hunk.body if b[0] == "+"]
            first = next((i for i, (k, _) in enumerate(kept) if k == "-"), None)
            if first is not None:
                last = max(i for i, (k, _) in enumerate(kept) if k == "-") + 1
                return surrounded(source, replace(hunk, body=(*kept[:last], *added, *kept[last:])), lo, hi)
        context = hunk.side(" ")
        if not hunk.side("-") and len(context) == 2 and (gap := blank_gap(source, *context)):
            body = ((" ", context[0]), *[b for b in hunk.body if b[0] == "+"], *[(" ", x) for x in source[gap[0] : gap[1]]], (" ", context[1]))
            return surrounded(source, replace(hunk, body=body), gap[0] - 1, gap[1] + 1)
    return None


def repaired(text: str, sources: dict[str, str]) -> str:
    """A diff with every hunk re-anchored in its current source; one that stays unclear, or would leave its order, is kept as it is."""
    files = parse(text)
    for f in files:
        content = sources.get(re.sub("^[ab]/", "", f.old_path))
        if content is None:
            continue
        rows = content.splitlines()
        fresh = [reanchored(rows, h) or h for h in f.hunks]
        ends = [0, *[h.old_start + h.actual[0] for h in fresh]]
        if all(h.old_start >= end for h, end in zip(fresh, ends, strict=False)):
            f.hunks = fresh
    return serialize(files)


def repair(body: Column, sources: Column) -> Column:
    """Each diff repaired against its current sources, a map of paths to texts: those that the diff names, joined to its row."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, maps in batches:
            yield pd.Series([repaired(b, dict(m or {})) for b, m in zip(bodies, maps, strict=True)])

    return F.pandas_udf(run, "string")(body, sources)
