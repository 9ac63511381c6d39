"""Balanced brackets in texts, quoting and comments aside, by a lexer's transition table.

A text is cut into its significant characters and the gaps between them; the lexer's state,
the depth and the open span are folded over them where the text lies, a piece at a time. Texts
are spread over tasks as they are read; nothing is shuffled and no text meets another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a piece, whose spans are listed apart.
PIECE = 256
#: Classes of tokens: one significant character each, or a gap of any others.
CLASSES = ('"', "'", "`", "\\", "/", "*", "\n", "open", "close", "gap")
#: States: code, code behind a slash, three kinds of strings and each behind a backslash, comments to the line's end, block comments and those behind a star.
STATES = ("code", "slash", "double", "double\\", "single", "single\\", "template", "template\\", "line", "block", "block*")
_QUOTES = {'"': "double", "'": "single", "`": "template"}


@dataclass(frozen=True)
class Lexer:
    """quotes: characters that open and close strings; comments: whether // and /* */ are comments; opens and closes: the brackets counted."""

    quotes: str = "\"'`"
    comments: bool = True
    opens: str = "{"
    closes: str = "}"

    def next(self, state: str, kind: str) -> str:
        """The state after a token."""
        base = state.rstrip("\\")
        if base in _QUOTES.values():
            if state.endswith("\\"):
                return base
            return base + "\\" if kind == "\\" else "code" if _QUOTES.get(kind) == base else base
        if state == "line":
            return "code" if kind == "\n" else "line"
        if state in ("block", "block*"):
            return "code" if state == "block*" and kind == "/" else "block*" if kind == "*" else "block"
        if kind in self.quotes:
            return _QUOTES[kind]
        if state == "slash" and kind in "/*":
            return "line" if kind == "/" else "block"
        return "slash" if self.comments and kind == "/" else "code"

    def table(self) -> list[list[int]]:
        """For each class of token the state after it, by the state before."""
        return [[STATES.index(self.next(s, k)) for s in STATES] for k in CLASSES]


SCRIPT, JSON = Lexer(), Lexer('"', False)


def spans(texts: DataFrame, text: str, *keys: str, op: Lexer = SCRIPT) -> DataFrame:
    """(keys..., start, end): the outermost balanced spans of brackets, in characters from 1, both ends included.

    Brackets in strings and comments don't count; a closing one without its opening one counts
    for nothing, and a span that is never closed isn't returned. Null texts have no span.
    """
    special = "".join(f"\\{c}" for c in "\"'`\\/*" + op.opens + op.closes) + "\n"
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{special}]|[^{special}]+"), F.lit(0))
    classes = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES[:7]) for x in (c, i)], *[F.lit(x) for c in op.opens for x in (c, 7)], *[F.lit(x) for c in op.closes for x in (c, 8)])
    after = F.array(*[F.array(*map(F.lit, row)) for row in op.table()])
    token = lambda t: F.struct(F.coalesce(classes[F.left(t, F.lit(1))], F.lit(9)).alias("kind"), F.char_length(t).cast("long").alias("n"))
    piece = lambda f, i: F.transform(F.sequence(i * PIECE, F.least(i * PIECE + PIECE, F.size(f)) - 1), lambda j: token(F.get(f, j)))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def at(a: Column, out: Column) -> Column:
        return F.struct(*[a[c].alias(c) for c in ("at", "state", "depth", "start")], out.alias("out"))

    def read(a: Column, t: Column) -> Column:
        code = a["state"] <= 1
        opens, closes = code & (t["kind"] == 7), code & (t["kind"] == 8) & (a["depth"] > 0)
        whole = F.struct(a["start"].alias("start"), a["at"].alias("end"))
        return F.struct(
            (a["at"] + t["n"]).alias("at"), F.get(F.get(after, t["kind"]), a["state"]).alias("state"), F.when(opens, a["depth"] + 1).when(closes, a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            F.when(opens & (a["depth"] == 0), a["at"]).otherwise(a["start"]).alias("start"), F.when(closes & (a["depth"] == 1), F.concat(a["out"], F.array(whole))).otherwise(a["out"]).alias("out"),
        )

    first = F.struct(F.lit(1).cast("long").alias("at"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("start"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("out"))
    numbers = lambda f: F.sequence(F.lit(0), F.floor((F.size(f) - 1) / PIECE).cast("int"))
    # a piece's spans are a list of their own, so that no long list is copied for each of its members
    folded = lambda f: F.when(F.size(f) > 0, F.aggregate(numbers(f), first, lambda a, i: F.aggregate(piece(f, i), at(a, none), read, lambda b: at(b, F.concat(a["out"], F.array(b["out"])))), lambda a: F.flatten(a["out"])))
    every = F.get(F.transform(F.array(found), folded), F.lit(0))  # the list of tokens is made once and named
    # outer: an inner one would have its list computed again for a filter on its size
    return texts.select(*keys, F.explode_outer(every).alias("x")).where("x IS NOT NULL").select(*keys, "x.start", "x.end")
