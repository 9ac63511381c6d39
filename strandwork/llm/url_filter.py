"""URL allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Largest pickled trie that is broadcast; larger rule sets go through an equi-join.
MAX_BROADCAST_BYTES = 64 << 20
VERDICT = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; host labels and the path prefix are compared as written (host lower-cased)."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    children: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)  # path node only: unfinished last segment -> (name, verdict)
    paths: _Node | None = None  # host node only
    bare: tuple | None = None  # host node only: a rule without a path


def split_url(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` and the path up to the query or fragment; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(ASCII_LOWER), path


class RuleTrie:
    """Longest match: more host labels first, then the longer path; of equal rules block wins."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for r in rules:
            node = self.root
            for label in reversed(r.host.translate(ASCII_LOWER).split(".")):
                node = node.children.setdefault(label, _Node())
            if not r.path:
                node.bare = self._stronger(node.bare, r)
                continue
            if not r.path.startswith("/"):
                raise ValueError(f"a rule's path starts with a slash: {r}")
            node.paths = node.paths or _Node()
            *whole, last = r.path[1:].split("/")
            at = node.paths
            for segment in whole:
                at = at.children.setdefault(segment, _Node())
            at.ends[last] = self._stronger(at.ends.get(last), r)

    @staticmethod
    def _stronger(old: tuple | None, r: Rule) -> tuple:
        return old if old and old[1] == "block" else (r.name, r.verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule, or None."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            best = node.bare or best
            if node.paths is not None and path[:1] == "/":
                best = self._match_path(node.paths, path[1:].split("/")) or best
        return best

    @staticmethod
    def _match_path(node: _Node, segments: list[str]) -> tuple | None:
        best = None
        for segment in segments:
            if node.ends:
                top = min(len(segment), max(map(len, node.ends)))
                best = next((node.ends[segment[:n]] for n in range(top, -1, -1) if segment[:n] in node.ends), best)
            node = node.children.get(segment)
            if node is None:
                break
        return best


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict added; columns of those names are replaced.

    A null url or one without ``://`` has empty host and path and gets the default
    verdict with a null rule; so does every url that no rule fits. Repeated rows are
    judged each. Rules up to MAX_BROADCAST_BYTES are broadcast as a trie, more are joined.
    """
    rules = list(rules)
    trie = RuleTrie(rules)
    if len(pickle.dumps(trie)) > MAX_BROADCAST_BYTES:
        return judge_urls_by_join(df, rules, url, default)
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf(VERDICT)
    def judged(urls: pd.Series) -> pd.DataFrame:
        trie, rows = shared.value, []
        for u in urls:
            host, path = split_url(u if isinstance(u, str) else None)
            rule, verdict = trie.match(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    names = ["host", "path", "rule", "verdict"]
    return df.withColumn("__judged", judged(F.col(url))).withColumns({n: F.col(f"__judged.{n}") for n in names}).drop("__judged")


def judge_urls_by_join(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """The same result for rule sets that are too large to broadcast: url host suffixes meet rule hosts in a join."""
    spark = df.sparkSession
    rows = [(r.host.translate(ASCII_LOWER), r.path, r.name, r.verdict) for r in rules]
    table = spark.createDataFrame(rows, "r_host string, r_path string, r_name string, r_verdict string")
    u = F.coalesce(F.col("__url"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.regexp_replace(u.substr(at + 3, F.length(u)), r"[?#][\s\S]*$", "")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = (
        df.select(F.col(url).alias("__url")).distinct().withColumn("__rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("__rest", r"/[\s\S]*$", 0)).drop("__rest")
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), (F.col("r_verdict") == "block").cast("int"), "r_name", "r_verdict")
    best = (
        parts.select("__url", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host")
        .where(F.expr("startswith(path, r_path)")).groupBy(F.col("__url").alias("__of")).agg(F.max(rank).alias("__best"))
    )
    judged = parts.join(best, F.col("__url").eqNullSafe(F.col("__of")), "left").select(
        "__url", "host", "path", F.col("__best.r_name").alias("rule"), F.coalesce("__best.r_verdict", F.lit(default)).alias("verdict")
    )
    kept = df.drop("host", "path", "rule", "verdict")
    return kept.join(judged, kept[url].eqNullSafe(F.col("__url")), "left").drop("__url")
