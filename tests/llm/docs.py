"""Small document tables with the awkward cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = " ".join(["Word0", *[f"word{i}" for i in range(1, 57)], "other", "word58", "word59"])


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


ROWS = [
    doc(1, BASE), doc(2, BASE.upper(), source="b"), doc(3, NEAR, source=None), doc(4, None), doc(5, ""), doc(6, " \n\t "), doc(7, LONG, lang=None),
    doc(8, LONG + " tail", source="c"), doc(9, "one two three"), doc(10, "ONE two  three"), doc(11, "one two"), doc(12, "Ünï çødé ß 🙂 end"),
    doc(None, BASE), doc(13, "solo text " * 40), doc(13, "solo text " * 40),
]


def clashing(df):
    """df with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    taken = ["id", "label", "kept", "score", "rule", "host", "path", "n_lines", "epoch", "item", "digest", "key", "block", "t"]
    return df.withColumns({c: F.lit("x") for c in taken if c not in df.columns})
