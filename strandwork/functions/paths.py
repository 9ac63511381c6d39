"""Predicates and forms of paths, diff headers and fenced text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork import config
from strandwork.functions.text import array_of


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; empty if the only dot leads."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]+)?$", 1)


def in_excluded_directory(path: Column) -> Column:
    """Whether any part of the path is an excluded directory name."""
    return F.exists(F.split(F.lower(path), "/"), lambda p: F.array_contains(array_of(config.EXCLUDED_DIRECTORIES), p) | p.endswith(".egg-info"))


def is_pruned_name(name: str) -> bool:
    """Whether a folder of this name is never entered."""
    return name.lower() in config.EXCLUDED_DIRECTORIES or name.lower().endswith(".egg-info")


def is_secret(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == ".env") | name.startswith(".env.") | name.isin(*config.SECRET_NAMES) | suffix(path).isin(*config.SECRET_SUFFIXES)


def is_outside(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")


def is_ignored(path: Column) -> Column:
    return is_outside(path) | in_excluded_directory(path) | is_secret(path)


def under(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def is_indexable(path: Column, workspace: str = ".workspace") -> Column:
    return ~is_ignored(path) & ~under(path, workspace) & suffix(path).isin(*config.INDEXED_SUFFIXES)


def is_source(path: Column) -> Column:
    return F.lower(file_name(path)).isin(*config.PROJECT_FILES) | suffix(path).isin(*config.SOURCE_SUFFIXES)


def is_test(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.startswith("test_") | name.rlike(r"(?:_test\.py|\.(?:test|spec)\.(?:ts|js))$")


def header_path(line: Column, prefix: str) -> Column:
    """Path of a diff header line: up to a tab, slashes forward; null if there is none."""
    rest = F.split_part(F.substr(line, F.lit(len(prefix) + 1)), F.lit("\t"), F.lit(1))
    return F.nullif(F.trim(F.replace(rest, F.lit("\\"), F.lit("/"))), F.lit(""))


def is_unsafe_patch_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return path.isNull() | (path == "") | is_outside(path) | F.array_contains(parts, ".git")


def without_fence(text: Column) -> Column:
    """Blank edge lines and one pair of triple backticks (bare, diff or patch) taken off."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")
    return F.regexp_replace(plain, r"(?s)^```(?:diff|patch)?[ \t]*\n(.*?)\n?```[ \t]*$", "$1")


def normalized_patch(text: Column) -> Column:
    plain = without_fence(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    return F.when(plain.endswith("\n"), plain).otherwise(F.concat(plain, F.lit("\n")))


def repository_key(name: Column, path: Column) -> Column:
    return F.concat_ws("-", name, F.left(F.sha2(F.lower(path), 256), F.lit(8)))


def file_tokens(task: Column) -> Column:
    """Tokens of a task that look like files, punctuation trimmed, distinct in order."""
    found = F.regexp_extract_all(task, F.lit(r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.btrim(F.replace(x, F.lit("\\"), F.lit("/")), F.lit("`'\".,:;()[]{}"))))
