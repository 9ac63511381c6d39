"""Files, version control and stored maps as tables; atomic text and JSON sinks; settings."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import paths

MAP_VERSION = 3
MAP = "version int, files map<string, struct<hash: string, language: string, summary: string, tags: array<string>, imports: array<string>, dependencies: array<string>, symbols: array<struct<name: string, qualified_name: string, kind: string, definition_name: string>>>>"
Run = Callable[[list[str]], str]


def list_files(spark: SparkSession, root: str, pruned: Callable[[str], bool] = paths.is_pruned_name) -> list[tuple[str, str]]:
    """(path under root, full path) of all files, folders that are pruned by name never entered; sorted."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found, folders = fs.makeQualified(top).toString().rstrip("/"), [], [top]
    while folders:
        for status in fs.listStatus(folders.pop()):
            full = fs.makeQualified(status.getPath()).toString()
            if not status.isDirectory():
                found.append((full[len(base) + 1 :], full))
            elif not pruned(status.getPath().getName()):
                folders.append(status.getPath())
    return sorted(found)


def scan(spark: SparkSession, root: str, wanted: Callable[[Column], Column] = paths.is_indexable) -> DataFrame:
    """(path, content, hash, size) of wanted files under root; text and hash come from one read, bytes that aren't UTF-8 are replaced.

    Folders are pruned before descent and paths are judged before any content is read. Spark's
    readers pass over names with a leading _ or dot, so the driver hands those few files in.
    """
    every = spark.createDataFrame(list_files(spark, root), "path string, full string")
    rows = [(r["path"], r["full"]) for r in every.where(wanted(F.col("path"))).collect()]  # names, as version control lists them
    hidden = lambda p: p.rsplit("/", 1)[-1].startswith(("_", "."))
    plain = [full for p, full in rows if not hidden(p)]
    raw = "path string, content binary, length long"
    df = spark.createDataFrame([], raw)
    if plain:
        base = rows[0][1][: -len(rows[0][0])]
        found = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in plain])
        df = found.select(F.substring("path", len(base) + 1, 1 << 30).alias("path"), "content", "length")
    if len(plain) < len(rows):
        df = df.union(spark.createDataFrame([(p, body := _read(spark, full), len(body)) for p, full in rows if hidden(p)], raw))
    return df.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


def _read(spark: SparkSession, full: str) -> bytearray:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(full)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def git(repo: str) -> Run:
    """Runs git in a repository on the driver; a failure raises with what git says."""

    def run(args: list[str]) -> str:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
        return done.stdout.decode(errors="replace")

    return run


def nul_rows(outputs: DataFrame, out: str, *keys: str) -> DataFrame:
    """(keys..., path) of NUL-separated outputs."""
    return outputs.select(*keys, F.explode(F.split(out, "\x00")).alias("path")).where("path <> ''")


def nul_separated(spark: SparkSession, output: str) -> DataFrame:
    """(path) of NUL-separated output."""
    return nul_rows(spark.createDataFrame([(output,)], "out string"), "out")


def changed_files(spark: SparkSession, run: Run, ignored: Callable[[Column], Column] = paths.is_ignored) -> DataFrame:
    """(path) of unstaged, staged and untracked files, ignored ones left out."""
    outputs = [run(["diff", "--name-only", "--no-renames", "-z"]), run(["diff", "--name-only", "--no-renames", "-z", "--cached"]), run(["ls-files", "--others", "--exclude-standard", "-z"])]
    rows = nul_separated(spark, outputs[0])
    for o in outputs[1:]:
        rows = rows.union(nul_separated(spark, o))
    return rows.distinct().where(~ignored(F.col("path")))


def index_scope(scanned: DataFrame, changed: DataFrame, *keys: str) -> DataFrame:
    """(keys..., path) of the scan and of what has changed, indexable."""
    return scanned.select(*keys, "path").union(changed.select(*keys, "path")).distinct().where(paths.is_indexable(F.col("path")))


def diff_text(run: Run, names: list[str], staged: bool = False) -> str:
    """The diff of the given paths; empty without any."""
    return run(["diff", *(["--cached"] if staged else []), "--", *names]) if names else ""


def write_text(path: str | Path, text: str) -> None:
    """Whole or not at all: written beside, flushed to disk, then renamed."""
    path = Path(path)
    beside = path.with_name(f".{path.name}.{os.getpid()}.part")
    try:
        with beside.open("w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        beside.replace(path)
    finally:
        beside.unlink(missing_ok=True)


def maps(stored: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys..., path, entry) of stored maps; bad JSON, another version or another shape give no rows."""
    parsed = stored.select(*keys, F.from_json(body, MAP).alias("m"))
    return parsed.where(F.col("m.version") == MAP_VERSION).select(*keys, F.explode("m.files").alias("path", "entry"))


def load_map(spark: SparkSession, text: str) -> DataFrame:
    """(path, entry) of one stored map."""
    return maps(spark.createDataFrame([(text,)], "body string"), "body")


def save_map(rows: DataFrame, path: str | Path) -> None:
    """(path, entry) rows as one JSON object with sorted keys. The map is one document by contract; larger indexes stay tables."""
    entries = {r["path"]: json.loads(r["body"]) for r in rows.select("path", F.to_json("entry").alias("body")).toLocalIterator()}
    write_text(path, json.dumps({"version": MAP_VERSION, "files": entries}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def without_workspace(rows: DataFrame, root: str) -> DataFrame:
    """Rows outside the tool's own folder."""
    return rows.where(~paths.under(F.col("path"), root))


def setting(name: str, environment: Mapping[str, str], dotenv: str = "") -> str | None:
    """A setting from the environment, else from the lines of a .env file."""
    if environment.get(name):
        return environment[name]
    for line in dotenv.splitlines():
        key, mark, value = line.strip().partition("=")
        if mark and not key.startswith("#") and key.strip() == name:
            return value.strip().strip("'\"") or None
    return None


def index_mode(explicit: str | None, legacy: str | None, model: str | None) -> str:
    """ai or static: as told, else by the legacy switch, else by whether there is a model."""
    if explicit and explicit.lower() in ("ai", "static"):
        return explicit.lower()
    if legacy is not None:
        return "ai" if legacy.strip().lower() in ("1", "true", "yes", "on") else "static"
    return "ai" if model else "static"


def command_profile(toml: str, profile: str) -> list[str] | None:
    """The test command of a profile: a string is split at spaces, a list of strings stays; anything else is an error."""
    found = tomllib.loads(toml).get("tests", {}).get(profile)
    if found is None:
        return None
    parts = found.split() if isinstance(found, str) else found
    if not isinstance(parts, list) or not parts or not all(isinstance(p, str) and p for p in parts):
        raise ValueError(f"tests.{profile} must be a command")
    return parts


#: Which command a file at the top of a repository stands for, the first that is there.
DETECTORS = (("package.json", "npm test"), ("pom.xml", "mvn test"), ("build.gradle", "gradle test"), ("build.gradle.kts", "gradle test"), ("pyproject.toml", "pytest"), ("setup.py", "pytest"), ("composer.json", "composer test"))


def test_command(files: DataFrame, *keys: str) -> DataFrame:
    """(keys..., command) that the files(keys..., path) of repositories suggest; no row if none does."""
    known = F.create_map(*[F.lit(x) for i, (path, command) in enumerate(DETECTORS) for x in (path, f"{i:02} {command}")])
    found = files.withColumn("__c", known[F.col("path")]).groupBy(*keys).agg(F.min("__c").alias("command"))
    return found.where("command IS NOT NULL").select(*keys, F.expr("substring(command, 4)").alias("command"))
