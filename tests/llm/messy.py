"""Awkward rows of documents."""

LONG = "word " * 30_000 + "x" * 50_000 + " " * 3_000 + "end"
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "The quick brown fox jumps over the lazy dog again and again."),
    (5, "The quick brown fox jumps over the lazy dog again and again."), (6, "The quick brown fox jumps over the lazy dog again and again."),
    (7, LONG), (8, LONG), (None, "No key but a text of some words here."), (None, None), (9, "123 456 !!! ---"), (10, "Ünïcödé 日本語 🙂 \x00\x1c\x85 mixed"),
    (5, "Another text under a repeated key, wholly different from the others."), (11, "x" * 70_000),
]
#: Names that operators use inside.
EXTRA = ["key", "node", "bucket", "n", "sig", "digest", "root", "part", "kind", "body", "ids", "t", "score", "rejected", "k1", "k2", "found", "host", "path", "rule", "train", "out"]


def documents(spark, extra=False, rows=ROWS):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'z' AS `{c}`" for c in EXTRA)) if extra else df


def both(spark, run, order):
    """Rows of run() over the messy documents, with extra columns or without, and that empty input gives empty output."""
    a, b = (sorted(map(str, run(documents(spark, x)).collect())) for x in (False, True))
    assert a == b
    empty = run(documents(spark, True).limit(0))
    assert empty.count() == 0
    return sorted(run(documents(spark)).collect(), key=order)
