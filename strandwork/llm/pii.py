"""Personal data by fixed shapes and bootstrapped context, in DataFrame operations only.

Every text is scanned once. Matches of the fixed shapes are spans as they stand and the
seeds of the bootstrap; looser shapes give candidates. What stands before a match, its last
word or two, is a lexical pattern. Patterns and the values found behind them form a graph
that is scored in rounds: a pattern's confidence in a kind is the summed belief in its
values over that and the number of its values that can't be of the kind, a candidate's
belief the noisy-or of its patterns' confidences. Candidates that end with enough belief become spans of that kind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.support import whole_text, written

KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What a text must hold for a shape to be looked for, and the shape. They match what the
#: plain forms match, without their backtracking: an address's local part starts where its
#: run or the last match ends, a number where its run of digits starts, and of the runs of
#: digits with single separators only those of 16 to 19 digits.
SHAPES = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser shapes: something around an at sign, or a run of digits and separators.
CANDIDATE = r"[^\x20\x09-\x0D@]{1,64}(?:@|[(\[]at[)\]])[^\x20\x09-\x0D@]{1,64}|(?<![\w.+-])[+(]?[0-9][0-9().:\x20-]{5,40}[0-9](?!\w)"
#: Shapes that a candidate of each kind must have.
FITS = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"^[0-9]+[.:][0-9]+[.:][0-9]+[.:][0-9.:]+$",
    "card": r"^(?:[0-9][\x20-]?){12,19}$",
    "phone": r"^[+(]?(?:[0-9][\x20().-]*){7,15}$",
}
_BLOCK = 64


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; a pattern counts from confidence on if support values of the kind, seeds or believed, stand behind it; a value from belief on."""

    rounds: int = 3
    confidence: float = 0.8
    support: int = 3
    belief: float = 0.9
    context: int = 48


def _luhn(match: Column) -> Column:
    """Whether the digits of a match pass Luhn's check."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), ""), lambda d: d != "")
    doubled = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _keeps(kind: str) -> Callable[[Column], Column]:
    return lambda x: _holds(kind, x["value"])


def _before(piece: Column, context: int) -> Column:
    """The last two words before a match, lower-cased and with digits as 0."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.right(piece, F.lit(context)), r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", 0)), "[0-9]", "0")


def _found(df: DataFrame, name: str, text: str, shape: str, needed: Column, context: int) -> DataFrame:
    """df with an array of (start, end, left, value) of a shape's matches added; start and end in code points, end exclusive.

    A match starts after the pieces and matches before it; their lengths are summed in blocks.
    """
    p, m, n, s, b = (f"__{name}_{x}" for x in "pmnsb")
    df = df.withColumn(m, F.when(needed, F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0))))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(F.col(text), shape)))
    df = df.withColumn(n, F.transform(p, lambda x, i: F.length(x) + F.when(i > 0, F.length(F.get(F.col(m), i - 1))).otherwise(0)))
    total = lambda of, start, length: F.aggregate(F.slice(of, start, length), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(s, F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda k: total(F.col(n), k * _BLOCK + 1, F.lit(_BLOCK)))))
    df = df.withColumn(b, F.transform(s, lambda x, k: total(F.col(s), F.lit(1), k)))

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(F.col(b), block) + total(F.col(n), block * _BLOCK + 1, i - block * _BLOCK + 1)
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), _before(F.get(F.col(p), i), context).alias("left"), x.alias("value"))

    return df.withColumn(f"__{name}", F.when(F.size(p) > 0, F.transform(m, span))).drop(p, m, n, s, b)


def scan(docs: DataFrame, id_col: str, text: str, context: int) -> DataFrame:
    """(id, digest, base, fixed, loose): base are the fixed shapes' spans, fixed and loose their and the looser shape's matches with patterns and values."""
    t = F.col("__t")
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text)).alias("digest"), whole_text(text).alias("__t"))
    digit = t.rlike("[0-9]")
    df = df.withColumn("__digit", digit)
    for kind, (needed, shape) in SHAPES.items():
        df = _found(df, kind, "__t", shape, F.col("__digit") & t.contains(needed) if kind != "email" else t.contains(needed), context)
    df = _found(df, "loose", "__t", CANDIDATE, F.col("__digit") | t.contains("@") | t.rlike(r"[(\[]at[)\]]"), context).drop("__t", "__digit")
    with_kind = lambda k, arr: F.transform(arr, lambda x: F.struct(k.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["left"].alias("left"), x["value"].alias("value")))
    fixed = [F.coalesce(with_kind(F.lit(i), F.filter(f"__{kind}", _keeps(kind))), F.array()) for i, kind in enumerate(KINDS)]
    df = df.withColumn("fixed", F.concat(*fixed))
    df = df.withColumn("loose", F.coalesce(with_kind(F.lit(-1), F.col("__loose")), F.array()))
    base = F.array_sort(F.transform("fixed", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return df.select("id", "digest", base.alias("base"), "fixed", "loose")


def matches(scanned: DataFrame) -> DataFrame:
    """(id, digest, kind, start, end, left, value) of a written scan's fixed matches and of the candidates (kind -1) apart from them.

    Each row of the scan is swept from left to right, and back, so a text's matches are never compared in pairs.
    """
    each = scanned.where((F.size("fixed") > 0) | (F.size("loose") > 0)).withColumn("__row", F.monotonically_increasing_id())
    each = each.select("__row", "id", "digest", F.explode(F.concat("fixed", "loose")).alias("x")).select("__row", "id", "digest", "x.*")
    fixed = F.col("kind") >= 0
    # of matches that start together, candidates see all fixed ones
    sweep = Window.partitionBy("__row").orderBy("start", F.when(fixed, 0).otherwise(1))
    reached = F.max(F.when(fixed, F.col("end"))).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(fixed, F.col("start"))).over(Window.partitionBy("__row").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0))
    swept = each.withColumns({"reached": reached, "ahead": ahead})
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return swept.where(fixed | free).drop("__row", "reached", "ahead")


def _plausible(kind: str) -> Column:
    """Whether a candidate that fits the kind also passes its check, as far as other writings of it can."""
    if kind == "ip":
        return F.translate("value", ":", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\.?$")
    return _luhn(F.col("value")) if kind == "card" else F.lit(True)


def bootstrap(found: DataFrame, op: Bootstrap) -> DataFrame:
    """(value, kind) of candidate values that end with enough belief; found: (kind, left, value), kind -1 for candidates.

    Support is counted anew each round, from seeds and values believed by then, so these induce
    patterns of their own. A pattern's own share in a belief doesn't count for it. Unseen
    values that can be of the kind don't speak against a pattern; all others do.
    A value takes the kind it is believed in most, of equals the first listed.
    """
    word = F.regexp_extract("left", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    edges = found.where(F.trim("left") != "").select("kind", "value", F.explode(F.array_distinct(F.array(word, F.trim("left")))).alias("pattern")).distinct()
    edges = written(edges, "edges")
    values = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values"))
    fits = F.array_compact(F.array(*[F.when(F.col("value").rlike(FITS[k]), F.struct(F.lit(i).alias("kind"), _plausible(k).alias("able"))) for i, k in enumerate(KINDS)]))
    loose = edges.where("kind = -1").select("pattern", "value", F.explode(fits).alias("x")).select("pattern", "x.kind", "value", F.lit(0).alias("seed"), F.col("x.able").cast("int").alias("able"))
    seeds = edges.where("kind >= 0").select("pattern", "kind", "value", F.lit(1).alias("seed"), F.lit(1).alias("able"))
    both = seeds.union(loose).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"), F.max("able").alias("able"))
    both = written(both, "graph")
    patterns = both.groupBy("pattern", "kind").agg(F.sum("seed").alias("support"), F.sum("able").alias("able"), F.count(F.lit(1)).alias("reach"))
    patterns = patterns.where(F.col("reach") >= op.support).join(values, "pattern")  # others never count
    patterns = written(patterns.select("pattern", "kind", "support", (F.col("values") - F.col("able")).alias("against")), "patterns")
    open_ = written(both.where("seed = 0").join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select("pattern", "kind", "value", "able"), "candidates")
    sure = beliefs = None
    for _ in range(op.rounds):
        scored = patterns.withColumns({"more": F.lit(0), "extra": F.lit(0.0), "spared": F.lit(0.0)})
        if beliefs is not None:
            without = 1 - F.exp(F.col("rest") - F.coalesce(F.log1p(-F.col("sure")), F.lit(0.0)))
            gained = open_.join(beliefs, ["value", "kind"]).join(sure, ["pattern", "kind"], "left").withColumn("belief", without).where(F.col("belief") >= op.belief)
            gained = gained.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("more"), F.sum("belief").alias("extra"), F.sum(F.when(F.col("able") == 0, F.col("belief")).otherwise(0.0)).alias("spared"))
            scored = patterns.join(gained, ["pattern", "kind"], "left").fillna(0, ["more", "extra", "spared"])
        held = F.col("support") + F.col("extra")
        # one more value than seen keeps the confidence under 1
        scored = scored.where(F.col("support") + F.col("more") >= op.support).withColumn("sure", held / (held + F.col("against") - F.col("spared") + 1))
        sure = written(scored.where(F.col("sure") >= op.confidence).select("pattern", "kind", "sure"), "sure")
        beliefs = written(open_.join(sure, ["pattern", "kind"]).groupBy("value", "kind").agg(F.sum(F.log1p(-F.col("sure"))).alias("rest")), "beliefs")
    believed = beliefs.withColumn("belief", 1 - F.exp("rest")).where(F.col("belief") >= op.belief).groupBy("value").agg(F.min(F.struct(-F.col("belief"), "kind")).alias("best"))
    return believed.join(seeds.select("value").distinct(), "value", "left_anti").select("value", F.col("best.kind").alias("kind"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", op: Bootstrap = Bootstrap()) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row of docs.

    The counts and the digest are of the fixed shapes; spans and n_found also hold what the
    bootstrap found. Null texts count as empty: no spans, the digest of an empty string. Texts
    of any length are scanned whole. Rows that repeat give the same result each, with a null id
    or not; other columns of docs are not read. Without seeds, and so in an empty table,
    nothing is added.
    """
    scanned = written(scan(docs, id_col, text, op.context), "scan")
    found = written(matches(scanned), "matches")
    values = written(bootstrap(found.select("kind", "left", "value"), op), "values")
    spots = found.where("kind = -1").select("id", "digest", "start", "end", "value").join(values, "value")
    more = spots.groupBy("id", "digest").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = written(more.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "more"), "more")
    slim = scanned.select("id", "digest", "base")
    out = slim.join(more, slim["id"].eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    all_ = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return out.withColumn("all", all_).select(
        F.col("id").alias(id_col), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_found"),
    )
