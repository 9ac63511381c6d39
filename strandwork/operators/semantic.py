"""The analyser protocol: an injected client describes files, its answers are validated, failures kept as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork import config
from strandwork.operators.json_objects import _object

ANALYSIS = "path string, status string, reason string, summary string, tags array<string>, important_symbols array<string>, attempts int"
#: Failures that a second, stricter request may mend, and that are remembered as they would come again.
FORMAT_FAILURES = ("empty_response", "invalid_json", "schema_validation_error")


class Client(Protocol):
    """Answers a prompt with text; raises TimeoutError or OSError where it can't."""

    model: str
    version: int

    def ask(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Analysis:
    status: str
    reason: str | None = None
    summary: str | None = None
    tags: tuple[str, ...] = ()
    important_symbols: tuple[str, ...] = ()
    attempts: int = 1


def is_eligible(size: Column, symbols: Column) -> Column:
    return size.between(1, config.ELIGIBLE_BYTES) & (F.size(symbols) >= 1)


def prompt(path: str, names: list[str], text: str) -> str:
    known = json.dumps({"path": path, "symbols": names[: config.MAX_SYMBOLS]}, ensure_ascii=False)
    return f"Describe this file as one JSON object with summary, tags and important_symbols.\n{known}\n\n{text}"


def _bounded(value: object, limit: int, chars: int) -> tuple[str, ...]:
    values = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    seen: dict[str, str] = {}
    for v in values:
        clean = " ".join(v.split())[:chars] if isinstance(v, str) else ""
        if clean:
            seen.setdefault(clean.lower(), clean)
    return tuple(list(seen.values())[:limit])


def validate(answer: str | None) -> Analysis:
    """An answer as an analysis, or the reason why it is none."""
    if not answer or not answer.strip():
        return Analysis("failed", "empty_response")
    body = _object(answer)
    if body is None:
        return Analysis("failed", "invalid_json")
    value = json.loads(body)
    if not isinstance(value.get("summary"), str) or not value["summary"].strip():
        return Analysis("failed", "schema_validation_error")
    return Analysis("complete", None, value["summary"].strip()[: config.SUMMARY_CHARS], _bounded(value.get("tags"), config.TAGS, config.TAG_CHARS), _bounded(value.get("important_symbols"), config.IMPORTANT_SYMBOLS, config.SYMBOL_CHARS))


def analyse_one(client: Client, path: str, names: list[str], text: str) -> Analysis:
    """One request, and one more only where the form of the answer failed; names are kept to those of the file."""
    asked, attempts = prompt(path, names, text), 0
    while True:
        attempts += 1
        try:
            found = validate(client.ask(asked))
        except TimeoutError:
            return Analysis("failed", "timeout", attempts=attempts)
        except Exception as e:  # noqa: BLE001  a client may fail in any way; the row says how
            return Analysis("failed", f"unexpected_exception: {type(e).__name__}", attempts=attempts)
        if found.status == "complete" or found.reason not in FORMAT_FAILURES or attempts == 2:
            kept = tuple(s for s in found.important_symbols if s in set(names))
            return Analysis(found.status, found.reason, found.summary, found.tags, kept, attempts)
        asked += "\n\nReturn the JSON object and nothing else."


def analyse(files: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """Analyses of files(path, names, text); a client is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for path, names, text in zip(batch["path"], batch["names"], batch["text"], strict=True):
                a = analyse_one(client, path, list(names), text)
                rows.append((path, a.status, a.reason, a.summary, list(a.tags), list(a.important_symbols), a.attempts))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANALYSIS.split(", ")])

    return files.select("path", "names", "text").mapInPandas(run, ANALYSIS)
