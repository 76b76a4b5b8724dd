"""Rows that every operator has to bear."""

LONG = "lorem ipsum dolor sit amet " * 4000

# (doc_id, text): nulls, empty and blank texts, repeats, ties, very long, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One TWO three four"), (7, LONG), (8, LONG),
    (9, "a b c d e f g h i j k l m n o p"), (9, "a b c d e f g h i j k l m n o p"), (10, "Éa über ñandú 日本語 текст"),
    (11, "x" * 30000), (None, "no id at all"), (None, None), (-5, "a b c d e f g h i j k l m n o q"), (12, "<|endoftext|> mid <|startoftext|>"),
]

COLUMNS = "doc_id long, text string, lang string, source string, row string, curve long, key binary, base int, score string, `odd.name` int"


def odd_documents(spark, rows=None):
    """A table with clashing extra columns, some of them null."""
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 2 else "s", "r", n, b"k", None, "x", n) for n, (i, t) in enumerate(rows)], COLUMNS)
