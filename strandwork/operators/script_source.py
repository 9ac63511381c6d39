"""Spans of JavaScript and TypeScript declarations by balanced delimiters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


DEFINITIONS = "path string, name string, kind string, start_line int, end_line int, line_count int, text string"
_START = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|function|enum|type|const|let|var)\s+\*?\s*([A-Za-z_$][\w$]*)", re.M)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def skip_quiet(text: str, i: int) -> int:
    """The index after a string, template or comment that starts at i; i itself if none does."""
    c = text[i]
    if c in "\"'`":
        j = i + 1
        while j < len(text) and text[j] != c:
            if c == "`" and text.startswith("${", j):
                j = (balanced_end(text, j + 1) or len(text)) - 1
            elif c != "`" and text[j] == "\n":
                return j
            j += 2 if text[j] == "\\" else 1
        return min(j + 1, len(text))
    if text.startswith("//", i):
        end = text.find("\n", i)
        return len(text) if end < 0 else end
    if text.startswith("/*", i):
        end = text.find("*/", i + 2)
        return len(text) if end < 0 else end + 2
    return i


def balanced_end(text: str, start: int) -> int | None:
    """The index after the delimiter that closes the one at start; None if it stays open."""
    open_, i = [], start
    while i < len(text):
        after = skip_quiet(text, i)
        if after > i:
            i = after
            continue
        c = text[i]
        if c in _CLOSE:
            open_.append(_CLOSE[c])
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                return i + 1
        i += 1
    return None


def declaration_end(text: str, start: int, kind: str) -> int | None:
    """The index after a declaration whose keyword and name end at start: its body, or for values its closing semicolon or line."""
    i = start
    while i < len(text):
        after = skip_quiet(text, i)
        if after > i:
            i = after
            continue
        c = text[i]
        if c == "{" and kind in ("class", "interface", "enum", "function"):
            return balanced_end(text, i)
        if c in _CLOSE:
            end = balanced_end(text, i)
            if end is None:
                return None
            i = end
            if kind not in ("class", "interface", "enum", "function") and c == "{" and not re.match(r"[ \t]*[.,|&+*/?:=([-]", text[i:]):
                return i + 1 if text[i : i + 1] == ";" else i
            continue
        if c == ";":
            return i + 1
        if c == "\n" and kind in ("const", "let", "var", "type") and not re.match(r"\s*(?:=>|[.?:|&+*/=]|$)", text[i + 1 :]) and not re.search(r"(?:=>|[=(,|&?:+*/{\[])\s*$", text[start:i]):
            return i
        i += 1
    return len(text) if kind in ("const", "let", "var", "type") else None


def definitions_of(text: str) -> list[tuple[str, str, int, int, int, str]]:
    """(name, kind, start, end, lines, text) of declarations; values count only if they hold an arrow function or function."""
    out = []
    for m in _START.finditer(text):
        kind = m[1]
        end = declaration_end(text, m.end(), kind)
        if end is None:
            continue
        body = text[m.start() : end]
        if kind in ("const", "let", "var"):
            if not re.search(r"=>|=\s*(?:async\s+)?function\b", body):
                continue
            kind = "function"
        start = text.count("\n", 0, m.start()) + 1
        out.append((m[2], kind, start, start + body.rstrip("\n").count("\n"), body.rstrip("\n").count("\n") + 1, body))
    return out


def definitions(files: DataFrame) -> DataFrame:
    """Declarations of every file(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *d) for p, c in zip(batch["path"], batch["content"], strict=True) for d in definitions_of(c or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEFINITIONS.split(", ")])

    return files.select("path", "content").mapInPandas(run, DEFINITIONS)
