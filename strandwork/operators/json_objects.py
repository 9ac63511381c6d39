"""JSON in model responses: validation, fenced and embedded objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork import config
from strandwork.functions.text import bounded_strings


def validated(body: Column) -> Column:
    """(status, summary, tags, important_symbols) of a response: complete or the reason why not; scalars become arrays of one."""
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    whole = F.get_json_object(body, "$")
    is_object = F.ltrim(body).startswith("{")
    summary = F.get_json_object(body, "$.summary")

    def strings(name: str) -> Column:
        value = F.get_json_object(body, f"$.{name}")
        as_list = F.from_json(value, "array<string>")
        return F.coalesce(F.when(F.ltrim(value).startswith("["), as_list).when(F.trim(value) != "", F.array(value)), F.array().cast("array<string>"))

    status = F.when(blank, "empty_response").when(whole.isNull(), "invalid_json").when(~is_object | summary.isNull(), "schema_validation_error").otherwise("complete")
    return F.struct(
        status.alias("status"), F.left(summary, F.lit(config.SUMMARY_CHARS)).alias("summary"),
        bounded_strings(strings("tags"), config.TAGS, config.TAG_CHARS).alias("tags"), bounded_strings(strings("important_symbols"), config.IMPORTANT_SYMBOLS).alias("important_symbols"),
    )


def tolerant_object(body: Column) -> Column:
    """The text from the first { to the last }, whatever stands around it, if it is a JSON object; else null."""
    found = F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def complete_objects(text: str) -> list[str]:
    """Every outermost balanced {...} of a text; braces in strings don't count."""
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def _object(text: str | None) -> str | None:
    """The one JSON object of a text: as it stands, fenced, or embedded; None if there is none or more than one."""
    if not text or not text.strip():
        return None
    plain = text.strip()
    if plain.startswith("```") and plain.endswith("```"):
        plain = plain[3:-3].removeprefix("json").strip()
    options = [plain] if plain.startswith("{") else []
    inside = complete_objects(plain)
    options += inside if len(inside) == 1 else []
    for x in options:
        try:
            if isinstance(json.loads(x), dict):
                return x
        except ValueError:
            continue
    return None


def load_object(body: Column) -> Column:
    """The one JSON object of each text, null without."""

    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in bodies:
            yield s.map(_object)

    return F.pandas_udf(run, "string")(body)
