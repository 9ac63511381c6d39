"""Scalar text expressions: words, stems, roles, surfaces, redaction, clipping. All are Column to Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork import config

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9_]+"
PLAIN_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"


def array_of(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def fold(x: Column) -> Column:
    """Lower case with sharp s spelled out, as case folding does."""
    return F.lower(F.replace(x, F.lit("ß"), F.lit("ss")))


def long_words(x: Column, pattern: str = WORD, least: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= least)


def task_words(task: Column, stop: Iterable[str] = config.STOP_WORDS, synonyms: Mapping[str, Iterable[str]] = config.SYNONYMS) -> Column:
    """Distinct lower-cased words of three letters or more, without stop words, with the synonyms of each."""
    words = F.array_distinct(F.transform(long_words(task), F.lower))
    words = F.array_except(words, array_of(stop))
    if not synonyms:
        return words
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), array_of(v))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array().cast("array<string>"))))
    return F.array_union(words, more)


def _stems(w: Column) -> Column:
    """The word and every form that a suffix rule makes of it."""
    n, drop = F.length(w), lambda k: F.left(w, F.length(w) - k)
    return F.array_compact(F.array(
        w,
        F.when(w.endswith("ies") & (n > 5), F.concat(drop(3), F.lit("y"))),
        F.when(w.endswith("ing") & (n > 5), drop(3)),
        F.when(w.endswith("ed") & (n > 4), drop(2)),
        F.when(w.endswith("s") & (n > 4), drop(1)),
    ))


def stemmed(words: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(words, _stems)))


def surface_tokens(x: Column) -> Column:
    """Distinct folded words, underscores apart, and their stems."""
    return stemmed(F.transform(long_words(F.replace(x, F.lit("_"), F.lit(" ")), PLAIN_WORD), fold))


def raw_tokens(x: Column) -> Column:
    """Distinct folded words with camel case and underscores split."""
    parts = F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.transform(long_words(parts, PLAIN_WORD), fold))


def tokens(x: Column) -> Column:
    return stemmed(raw_tokens(x))


def surface_roles(found: Column, roles: Mapping[str, Iterable[str]] = config.ROLE_TERMS) -> Column:
    """Sorted roles one of whose terms is among the tokens."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(found, array_of(terms)), F.lit(role)) for role, terms in sorted(roles.items())]))


def term_matches(term: Column, token: Column) -> Column:
    """Equal, or both of four letters or more and one a prefix of the other."""
    return (term == token) | ((F.least(F.length(term), F.length(token)) >= 4) & (F.startswith(term, token) | F.startswith(token, term)))


def matching_terms(terms: Column, found: Column) -> Column:
    return F.filter(terms, lambda t: F.exists(found, lambda w: term_matches(t, w)))


def text_matching_terms(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(F.lower(text), t))


def task_surfaces(task: Column, actions: Iterable[str] = config.ACTION_WORDS, limit: int = config.MAX_SURFACES) -> Column:
    """Clauses of a task in order, distinct: bullets dropped; cut at semicolons, lines, sentence ends and before actions."""
    verbs = "|".join(actions)
    plain = F.regexp_replace(task, r"(?m)^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]+", "")
    plain = F.regexp_replace(plain, rf"(?i),[ \t]+({verbs})\b", "\n$1")
    plain = F.regexp_replace(plain, rf"(?i)\b(?:and|och)[ \t]+({verbs})\b", "\n$1")
    parts = F.transform(F.split(plain, r";|\n+|[.!?]+[ \t\n]+"), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, limit)


def is_complex(task: Column, surfaces: Column, roles: Mapping[str, Iterable[str]] = config.ROLE_TERMS) -> Column:
    found = F.array_distinct(F.flatten(F.transform(surfaces, lambda s: surface_roles(surface_tokens(s), roles))))
    return (F.size(surfaces) >= config.COMPLEX_SURFACES) | (F.length(task) >= config.COMPLEX_CHARS) | (F.size(found) >= config.COMPLEX_ROLES)


def domain_terms(task: Column, roles: Mapping[str, Iterable[str]] = config.ROLE_TERMS, actions: Iterable[str] = config.ACTION_WORDS) -> Column:
    """Raw tokens of four letters or more that are no action, stop or role word but of the domain."""
    known = [*actions, *config.STOP_WORDS, *(t for role, terms in roles.items() if role != "domain" for t in terms)]
    return F.array_except(F.filter(raw_tokens(task), lambda w: F.length(w) >= 4), array_of(known))


def requirement_roles(found: Column, roles: Mapping[str, Iterable[str]] = config.ROLE_TERMS) -> Column:
    """Roles by prefix matching; domain if there is none."""
    hit = F.array_compact(F.array(*[F.when(F.size(matching_terms(array_of(terms), found)) > 0, F.lit(role)) for role, terms in sorted(roles.items())]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("domain")))


def requirement_terms(requirement: Column, fallback: Column) -> Column:
    """Domain terms, else the raw tokens, else the task's."""
    own, raw = domain_terms(requirement), raw_tokens(requirement)
    return F.when(F.size(own) > 0, own).when(F.size(raw) > 0, raw).otherwise(fallback)


def is_support_only(requirement: Column) -> Column:
    """Whether a requirement only constrains: what not to change, what to inspect or to follow."""
    return requirement.rlike(r"(?i)\b(?:do not|don't|never|without) (?:change|changing|modify|modifying|touch|touching)\b|\binspect first\b|\bfollow\b.*\bpatterns?\b")


#: Shapes of secrets and what replaces them, in this order.
_ASSIGNED = r"\b(?:password|passwd|api[_-]?key|secret|token|access[_-]?token|refresh[_-]?token|client[_-]?secret)\b\s*"
REDACTIONS = (
    (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED SECRET]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED SECRET]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED SECRET]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED SECRET]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED SECRET]"),
    (rf"(?i)({_ASSIGNED}[:=]\s*[\"'])[^\"'\r\n]{{6,}}([\"'])", r"\1[REDACTED]\2"),
    (rf"(?i)({_ASSIGNED}=\s*)[^\s,;#\r\n]{{8,}}", r"\1[REDACTED]"),
    (r"(?i)(Authorization\s*:\s*Bearer\s+)[A-Za-z0-9._~+/=-]{8,}", r"\1[REDACTED]"),
)


#: What a text must hold, lower-cased, for any shape to fit; no replacement brings these where a shape could start.
_SIGNS = ("-----begin", "sk-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "akia", "eyj", "passw", "api", "secret", "token", "authorization")


def redact(text: Column) -> Column:
    """Each shape replaced in turn; a later shape sees what an earlier one left. Texts without any sign of a secret skip the chain."""
    low, out = F.lower(text), text
    sign = F.lit(False)
    for x in _SIGNS:
        sign = sign | F.contains(low, F.lit(x))
    for shape, by in REDACTIONS:
        out = F.regexp_replace(out, shape, by.replace(r"\1", "$1").replace(r"\2", "$2"))
    return F.when(sign, out).otherwise(text)


def redact_sql(column: str) -> str:
    """The same chain as DuckDB SQL."""
    for shape, by in REDACTIONS:
        flags = "g" + ("i" if "(?i)" in shape else "") + ("s" if "(?s)" in shape else "")
        plain = shape.replace("(?i)", "").replace("(?s)", "").replace("'", "''")
        column = f"regexp_replace({column}, '{plain}', '{by}', '{flags}')"
    return column


def keep_tail(text: Column, limit: int = config.REPORT_CHARS, marker: str = "[earlier output dropped]\n") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.lit(marker), F.right(text, F.lit(limit)))).otherwise(text)


def indented(text: Column, empty: str = "    (no output)") -> Column:
    lines = F.transform(F.split(F.rtrim(text), "\n"), lambda x: F.concat(F.lit("    "), x))
    return F.when(F.trim(text) == "", F.lit(empty)).otherwise(F.array_join(lines, "\n"))


def bounded_strings(values: Column, limit: int, chars: int = config.SYMBOL_CHARS) -> Column:
    """White space collapsed, clipped, distinct without regard to case in order, at most limit."""
    clean = F.filter(F.transform(values, lambda x: F.left(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(chars))), lambda x: x != "")
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, limit)


def mentions(text: Column, symbol: str) -> Column:
    """Whether the whole identifier stands in the text."""
    import re

    return text.rlike(rf"(?<![A-Za-z0-9_$]){re.escape(symbol)}(?![A-Za-z0-9_$])")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def positive_int(x: Column, default: int) -> Column:
    return F.coalesce(F.nullif(F.greatest(x.try_cast("int"), F.lit(0)), F.lit(0)), F.lit(default))


def context_budget(required: Column, base: int = config.SOFT_BUDGET, hard: int = config.HARD_BUDGET, reserve: int = config.ELASTIC_RESERVE) -> Column:
    return F.when(required <= base, F.lit(base)).otherwise(F.least(F.lit(hard), F.greatest(F.lit(base), required + reserve)))


def hunk_context(source_lines: Column, removed: Column) -> Column:
    return F.least(F.lit(config.HUNK_CONTEXT), F.greatest(F.lit(0), source_lines - removed))


def clipped_or_null(x: Column, limit: int = 500) -> Column:
    return F.nullif(F.left(F.trim(x), F.lit(limit)), F.lit(""))
