import numpy as np
import pytest

from strandwork.operators import balanced


def plain(text, op):
    """Outermost spans by one walk over the characters."""
    state, stack, start, out, i = None, 0, None, [], 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state in ('"', "'", "`"):
            if c == "\\":
                i += 1
            elif c == state:
                state = None
        elif state == "line":
            state = None if c == "\n" else state
        elif state == "block":
            if two == "*/":
                state, i = None, i + 1
        elif c in op.quotes:
            state = c
        elif op.comments and two in ("//", "/*"):
            state, i = ("line" if two == "//" else "block"), i + 1
        elif c in op.opens:
            stack += 1
            start = i + 1 if stack == 1 else start
        elif c in op.closes and stack:
            stack -= 1
            if not stack:
                out.append((start, i + 1))
        i += 1
    return out


@pytest.mark.parametrize("piece", [3, 256])
@pytest.mark.parametrize("op", [balanced.SCRIPT, balanced.JSON, balanced.Lexer("'", True, "([{", ")]}")])
def test_spans_are_those_of_a_plain_walk(spark, monkeypatch, piece, op):
    monkeypatch.setattr(balanced, "PIECE", piece)
    rng = np.random.default_rng(piece)
    letters = list("{}{}{}\"'`\\/*\n ab(]é")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(250)] + [
        "", None, "}}{a}{", "/* { */{}", "a // {\n{b}", '{"}": 1}{', "{'\\'}'}", "`{${x}}`{y}", "/*/{}*/{}", "{" * 30 + "}" * 30, "//{}", "{/**/}", "{a}" * 40,
    ]
    got: dict = {}
    for r in balanced.spans(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "body", "id", op=op).collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(t or "", op), t


def test_the_lexer_composes():
    for op in (balanced.SCRIPT, balanced.JSON):
        table = op.table()
        assert len(table) == len(balanced.CLASSES) and all(len(r) == len(balanced.STATES) for r in table)
    assert balanced.SCRIPT.next("slash", "*") == "block" and balanced.JSON.next("code", "/") == "code" and balanced.SCRIPT.next("double\\", '"') == "double"


def test_spans_are_found_where_the_texts_lie(spark):
    found = balanced.spans(spark.range(3).selectExpr("id", "'{a} {{b}} {' AS body"), "body", "id", op=balanced.JSON)
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "Exchange" not in text and "Join" not in text  # summaries of every text were once joined back, by way of the driver
    assert sorted(map(tuple, found.collect())) == [(i, *x) for i in range(3) for x in ((1, 3), (5, 9))]


def test_a_long_text_is_read_once(spark):
    n = 10_000
    found = balanced.spans(spark.range(1).selectExpr("id", f"repeat('{{a \"}}\" }} ', {n}) AS body"), "body", "id", op=balanced.JSON).selectExpr("count(*) AS n", "sum(end - start) AS size", "max(end) AS last")
    assert tuple(found.collect()[0]) == (n, 7 * n, 9 * n - 1)
