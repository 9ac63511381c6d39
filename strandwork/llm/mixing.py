"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source shares p become weights in proportion to p**a. The exponent a is searched between 0
(all alike) and 1 (as found), by cutting the interval again and again: the largest at which
the weights reach the target entropy (half of what the found shares lack of the greatest one,
by default), or, if sources would repeat too often there, the
smallest that keeps to the repetition limit. Each cut sums over the sources where they are,
so their number is not bounded by a task. The weights are realised by block permutations:
each source is dealt into hashed blocks, every pass orders the blocks and the rows within
them anew, and the last pass stops where the source's token budget is used up. A row's
position is its own place in its source's quota, so by position all sources run through
side by side, at the rates of their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.support import whole_text, words_of, written

#: The interval of an exponent is cut into PARTS, CUTS times: to about 1e-12.
PARTS, CUTS = 64, 7
#: Documents of a block, on average, in sources of up to its square.
BLOCK = 1024


def _narrowed(bracket: tuple[float, float], holds: dict[float, bool], below: bool) -> tuple[float, float]:
    """The part of a bracket in which a condition changes that holds below the change, or else above it."""
    lo, hi = bracket
    for a in sorted(x for x in holds if lo <= x <= hi):
        if holds[a] == below:
            lo = a
        else:
            return lo, a
    return lo, hi


def temperature(sizes: DataFrame, entropy_share: float, max_repeats: float, budget_tokens: int | None, entropy_gap: float) -> tuple[float, float, float] | None:
    """(exponent, sum of p**exponent over the largest p, tokens of the largest source) for sizes(tokens) over 0; None without any.

    What reaches the driver in each cut is one row for each exponent tried.
    """
    classes = written(sizes.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "classes")
    k, top, least = classes.agg(F.sum("n"), F.max("tokens"), F.min("tokens")).first()
    if not k:
        return None
    least = math.log(least / top)
    log = F.log(F.col("tokens") / F.lit(top))

    def sums(tried: list[float]) -> dict[float, tuple[float, float]]:
        each = classes.select("n", log.alias("x"), F.explode(F.array(*map(F.lit, tried))).alias("a"))
        each = each.groupBy("a").agg(F.sum(F.col("n") * F.exp(F.col("a") * F.col("x"))).alias("s"), F.sum(F.col("n") * F.col("x") * F.exp(F.col("a") * F.col("x"))).alias("m"))
        return {r["a"]: (r["s"], r["m"]) for r in each.collect()}  # a row for each exponent tried

    total, weighted = sums([1.0])[1.0]
    as_found = math.log(total) - weighted / total
    even = max(math.log(k) * entropy_share, as_found + entropy_gap * (math.log(k) - as_found))

    def mixed_enough(a: float, s: float, m: float) -> bool:
        return math.log(s) - a * m / s >= even - 1e-12

    def within(a: float, s: float, m: float) -> bool:
        """Whether the smallest source, which repeats most, keeps to the limit."""
        return math.exp((a - 1) * least) * (1.0 if budget_tokens is None else budget_tokens / (s * top)) <= max_repeats * (1 + 1e-12)

    by_entropy, by_limit = (0.0, 1.0), (0.0, 1.0)
    for _ in range(CUTS):
        tried = sorted({lo + (hi - lo) * i / PARTS for lo, hi in (by_entropy, by_limit) for i in range(PARTS + 1)})
        found = sums(tried)
        by_entropy = _narrowed(by_entropy, {a: mixed_enough(a, *x) for a, x in found.items()}, True)
        by_limit = _narrowed(by_limit, {a: within(a, *x) for a, x in found.items()}, False)
    exponent = round(max(by_entropy[0], by_limit[1]), 12)
    return exponent, sums([exponent])[exponent][0], top


def source_weights(sizes: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, budget_tokens: int | None = None, entropy_gap: float = 0.5) -> DataFrame:
    """(source, tokens, weight, repeats, quota, exponent) of sizes(source, tokens), which has one row a source.

    The target entropy is entropy_share of that of equal weights, and at least so much more than
    the found shares have that entropy_gap of what they lack is made up, so unequal sources are
    always evened out to some degree. Without a budget it is the least at which every source is
    passed through once: the largest source repeats once, none more than max_repeats times. With
    one, quotas are the weights' shares of it;
    a budget over max_repeats times all tokens ends there, for every source alike. Sources
    without tokens get no row.
    """
    full = sizes.where("tokens > 0")
    found = temperature(full.select("tokens"), entropy_share, max_repeats, budget_tokens, entropy_gap)
    exponent, total, top = found or (1.0, 1.0, 1)
    passes = 1.0 if budget_tokens is None else budget_tokens / (total * top)
    log = F.log(F.col("tokens") / F.lit(top))
    repeats = F.round(F.least(F.exp((exponent - 1) * log) * passes, F.lit(float(max_repeats))), 12)
    each = full.select("source", "tokens", (F.exp(exponent * log) / total).alias("weight"), repeats.alias("repeats"), F.lit(exponent).alias("exponent"))
    return each.withColumn("quota", F.floor(F.col("tokens") * F.col("repeats")).cast("long"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *,
    entropy_share: float = 0.95, entropy_gap: float = 0.5, max_repeats: float = 4.0, budget_tokens: int | None = None, seed: int = 0,
) -> DataFrame:
    """One row for each document and pass: (id, digest, source, n_tokens, epoch, block, position).

    position (0 to 1) is the row's place in its source's quota: the tokens that the source
    puts before it over all that it may put, and no two rows of a source share one. Ordering
    all rows by position, then source, mixes the sources by weight throughout. Tokens are
    words; texts of any length are read whole. A null source is a source of its own. Rows
    that repeat id, text and source are one unit with the sum of their tokens; documents
    without words cost nothing and come once with every pass, those of a source without any
    words in one pass. Columns of docs other than those three are not read. An empty table
    gives an empty plan.
    """
    t = whole_text(text)
    units = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("digest"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.size(words_of(t)).cast("long").alias("n"))
    units = written(units.groupBy("id", "digest", "source").agg(F.sum("n").alias("n_tokens")), "units")
    sizes = units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    # neither a source's blocks nor a block's rows grow faster than the root of its rows
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("rows") / F.greatest(F.lit(float(BLOCK)), F.sqrt("rows")))), "sizes")
    weights = source_weights(sizes.select("source", "tokens"), entropy_share, max_repeats, budget_tokens, entropy_gap)
    # a source without words has no weight: one pass, in which each of its documents counts as one token
    wordless = F.col("tokens") == 0
    quotas = sizes.join(weights.select("source", "quota"), "source", "left").withColumn("wordless", wordless)
    quotas = quotas.withColumns({"tokens": F.when(wordless, F.col("rows")).otherwise(F.col("tokens")), "quota": F.when(wordless, F.col("rows")).otherwise(F.col("quota"))})
    quotas = written(quotas.drop("rows"), "quotas")

    dealt = units.join(quotas, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "digest"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("cost", F.when(F.col("wordless"), F.lit(1).cast("long")).otherwise(F.col("n_tokens")))
    dealt = written(dealt.select("id", "digest", "source", "n_tokens", "cost", "block", "blocks", "tokens", "quota"), "dealt")
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("tokens")))
    blocks = dealt.groupBy("source", "block", "tokens", "quota", "blocks").agg(F.sum("cost").alias("size"))
    blocks = blocks.where("quota > 0").withColumn("epoch", F.explode(epochs))
    in_pass = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block")
    before = F.sum("size").over(in_pass.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)) + F.col("epoch") * F.col("tokens"))
    blocks = blocks.withColumn("turn", F.col("epoch") * F.col("blocks") + F.row_number().over(in_pass)).withColumn("turns", F.floor((F.col("quota") - 1) / F.col("tokens") + 1) * F.col("blocks") + 2)
    blocks = written(blocks.where("before < quota").select("source", "block", "epoch", "before", "turn", "turns", "quota"), "blocks")

    rows = dealt.select("id", "digest", "source", "n_tokens", "cost", "block").join(blocks, ["source", "block"])
    # documents that cost nothing go first in a block, so that its last row has a token
    in_block = Window.partitionBy("source", "epoch", "block").orderBy(F.col("cost") > 0, F.xxhash64(F.lit(seed), "epoch", "id", "digest"), "id", "digest")
    rows = rows.withColumns({"place": F.col("before") + F.sum("cost").over(in_block) - F.col("cost"), "nth": F.row_number().over(in_block), "of": F.count(F.lit(1)).over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # a fraction of one token that grows from row to row keeps rows apart that cost nothing
    apart = (F.col("turn") + F.col("nth") / (F.col("of") + 1)) / F.col("turns")
    rows = rows.where("place + cost <= quota").withColumn("position", (F.col("place") + apart) / F.col("quota"))
    return rows.select("id", "digest", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", "position")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row once for every pass that takes it, and epoch, block and position added; see mix_plan."""
    plan = mix_plan(docs, id_col, text, source, **options)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("id", "digest", "source")], "epoch", "block", "position")
    kept = docs.drop("epoch", "block", "position").withColumn("__of", F.xxhash64(whole_text(text)))
    same = kept[id_col].eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__digest")) & (F.coalesce(kept[source].cast("string"), F.lit("")) == F.col("__source"))
    return kept.join(plan, same).drop("__id", "__digest", "__source", "__of")
