"""Ranges of lines that hold each other, found by sweeping over them in order.

Ranges are dealt by their keys and a slice of `width` lines. What a slice must know of the
others is one number for each of them, so a key with any share of the rows is spread over its
slices: rows are shuffled once, and the sweep over slices sees only their summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.operators.settle import settled

WIDTH = 4096


def _slice(line: str | Column, width: int) -> Column:
    return F.floor((F.col(line) if isinstance(line, str) else line) / width)


def _same(keys: tuple[str, ...] | list[str]) -> Column:
    """Rows and the summary of their slice, null keys included."""
    same = F.col("__slice").eqNullSafe(F.col("__s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same


def without_containers(ranges: DataFrame, *keys: str, width: int = WIDTH) -> DataFrame:
    """ranges(keys..., name, start, end) but those that hold a smaller range of the same keys whole.

    A range holds one that starts later and ends no later, or starts with it and ends before it:
    the least end of what follows in the sweep decides. Equal ranges don't hold each other.
    Null keys are keys of their own; ranges without a start or an end hold nothing and stay.
    """
    cut = ranges.withColumn("__slice", _slice("start", width))
    ends = cut.groupBy(*keys, "__slice").agg(F.min("end").alias("__least"))
    later = Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), F.min("__least").over(later).alias("__beyond"))
    met = cut.join(ends, _same(keys), "left")
    own = Window.partitionBy(*keys, "__slice").orderBy(F.desc("start"))  # from the end on, so that the least end is a running one
    behind = F.min("end").over(own.rangeBetween(Window.unboundedPreceding, -1))
    beside = F.min("end").over(Window.partitionBy(*keys, "__slice", "start"))
    met = met.withColumns({"__behind": behind, "__beside": beside})
    holds = (F.least("__behind", "__beyond") <= F.col("end")) | (F.col("__beside") < F.col("end"))
    return met.where(~F.coalesce(holds, F.lit(False))).select(*ranges.columns)


def running(rows: DataFrame, keys: list[str], line: str, order: list[Column], values: dict[str, tuple[str, str]], width: int = WIDTH) -> DataFrame:
    """rows with running values in the order of line, then of order, within keys; rows of one line are in one slice.

    values: name to (kind, column): sum adds up a number over the rows before and at a row, min is
    the least of them, last takes the last value that isn't null.
    """
    cut = rows.withColumn("__slice", _slice(line, width))
    inside = Window.partitionBy(*keys, "__slice").orderBy(line, *order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(F.col(line), *order)
    folds = {"sum": F.sum, "min": F.min}
    total = {n: folds[kind](c) if kind in folds else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)) for n, (kind, c) in values.items()}
    sums = cut.groupBy(*keys, "__slice").agg(*[x.alias(f"__{n}") for n, x in total.items()])
    carry = {f"__{n}": (folds[kind](f"__{n}") if kind in folds else F.last(f"__{n}", ignorenulls=True)).over(before) for n, (kind, _) in values.items()}
    sums = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), *[x.alias(n) for n, x in carry.items()])
    met = cut.join(sums, _same(keys))
    own = {n: (folds[kind](c) if kind in folds else F.last(c, ignorenulls=True)).over(inside) for n, (kind, c) in values.items()}
    join = {"sum": lambda x, c: F.coalesce(c, F.lit(0)) + x, "min": lambda x, c: F.least(x, c), "last": lambda x, c: F.coalesce(x, c)}
    done = {n: join[values[n][0]](x, F.col(f"__{n}")) for n, x in own.items()}
    return met.select(*rows.columns, *[x.alias(n) for n, x in done.items()])


def last_before(lines: DataFrame, marks: DataFrame, *keys: str, line: str = "line_no", value: str = "name", width: int = WIDTH) -> DataFrame:
    """lines(keys..., line, ...) with the line and value of the last of marks(keys..., line, value) at or before each, by one sweep over both.

    Of marks on one line the greatest value counts. Lines before the first mark have nulls.
    """
    marks = marks.groupBy(*keys, F.col(line).alias(line)).agg(F.max(value).alias("__v"))
    columns = [c for c in lines.columns if c not in (*keys, line)]
    own = lines.select(*keys, line, F.lit(1).alias("__ask"), F.struct(*columns).alias("__row") if columns else F.lit(0).alias("__row"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"))
    found = marks.select(*keys, line, F.lit(0).alias("__ask"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), "__v")
    both = own.unionByName(found).withColumn("__at", F.when(F.col("__ask") == 0, F.struct(line, "__v")))
    swept = running(both, list(keys), line, [F.col("__ask")], {"__last": ("last", "__at")}, width)
    out = swept.where("__ask = 1")
    return out.select(*keys, line, *[F.col(f"__row.{c}").alias(c) for c in columns], F.col(f"__last.{line}").alias(f"{value}_line"), F.col("__last.__v").alias(value))


def enclosing(ranges: DataFrame, *keys: str, width: int = WIDTH) -> DataFrame:
    """ranges(keys..., name, start, end) with depth and the name of the innermost range that holds each; ranges must nest.

    A running sum of openings and closings is a range's depth; the range that holds it is the
    last one a level higher that opened before it. Equal ranges nest in the order of their names.
    A range without a start or an end holds nothing and lies in none (depth 0).

    Ranges are shuffled once, to the slice of their start, and openings and closings are made of
    them there; only one that ends in another slice goes to that too. What is open when a slice
    begins comes as a row of it. Only ranges that end in another slice can hold one of another,
    so a second sweep is over these and over what has no holder in its own slice.
    """
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    first, last = _slice("start", width), _slice(F.col("end") + 1, width)
    both = F.when(whole & (first != last), F.array(first, last)).otherwise(F.array(first))
    cut = ranges.select(*keys, "name", "start", "end", F.explode(both).alias("__slice"))
    opens, closes = whole & F.col("__slice").eqNullSafe(first), whole & F.col("__slice").eqNullSafe(last)
    sums = cut.groupBy(*keys, "__slice").agg(F.sum(opens.cast("long") - closes.cast("long")).alias("__step"))
    carry = F.sum("__step").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    empty = [F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in ("name", "start", "end")]
    carried = sums.select(*keys, *empty, "__slice", carry.alias("__carry")).where("__carry <> 0")
    dealt = cut.withColumn("__carry", F.lit(None).cast("long")).unionByName(carried).repartition(*keys, "__slice")

    event = lambda at, step, tie, own: F.struct(at.cast("long").alias("at"), step.cast("long").alias("step"), tie.cast("long").alias("tie"), F.lit(own).alias("own"))
    opening, closing = event(F.col("start"), F.when(whole, 1).otherwise(0), -F.col("end"), True), event(F.col("end") + 1, F.lit(-1), F.col("end"), False)
    none = F.lit(None)
    events = F.when(F.col("__carry").isNotNull(), F.array(event(none, F.col("__carry"), none, False))).otherwise(F.array_compact(F.array(F.when(opens | ~whole, opening), F.when(closes, closing))))
    sweep = Window.partitionBy(*keys, "__slice").orderBy("x.at", "x.step", "x.tie", "name").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("x", F.explode(events)).withColumn("__open", F.sum("x.step").over(sweep)).where("x.own")
    found = found.withColumn("depth", F.when(whole, F.col("__open") - 1).otherwise(0).cast("int")).select(*keys, "__slice", "name", "start", "end", "depth", F.col("x.tie").alias("__tie"))

    order, holder = [F.col("__tie"), F.col("name"), F.col("__ask")], F.struct("name")
    side = lambda level, ask, held: F.struct(level.alias("level"), F.lit(ask).alias("ask"), held.alias("held"))
    sides = F.array(side(F.col("depth"), 0, F.when(F.lit(False), holder)), F.when(whole, side(F.col("depth") + 1, 1, holder)))
    met = found.withColumn("x", F.explode(F.array_compact(sides))).withColumns({"__level": F.col("x.level"), "__ask": F.col("x.ask")})
    inside = F.last("x.held", ignorenulls=True).over(Window.partitionBy(*keys, "__slice", "__level").orderBy("start", *order).rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("__inside", inside).where("__ask = 0")
    lost = whole & (F.col("depth") > 0) & F.col("__inside").isNull()
    out = [*keys, "name", "start", "end", "depth"]
    left = settled(met.where(lost | (whole & (first != last))).select(*out, "__tie", lost.alias("__lost"), (first != last).alias("__wide")))
    asks = left.where("__lost").withColumns({"__level": F.col("depth"), "__ask": F.lit(0), "__holder": F.when(F.lit(False), holder)})
    offers = left.where("__wide").withColumns({"__level": F.col("depth") + 1, "__ask": F.lit(1), "__holder": holder})
    late = running(asks.unionByName(offers), [*keys, "__level"], "start", order, {"__inside": ("last", "__holder")}, width).where("__ask = 0")
    own = met.where(~lost).withColumn("__inside", F.when(F.col("depth") > 0, F.col("__inside")))
    return own.select(*out, "__inside").unionByName(late.select(*out, "__inside")).select(*out, F.col("__inside.name").alias("inside"))
