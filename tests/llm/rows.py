"""Small document tables with the odd cases every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, size string"
NONE: list = []


def documents(spark, rows):
    """rows: (doc_id, text[, source]); two more columns have names that operators could use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", None if r[1] is None else len(r[1]), "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(words):
    """Null, empty and blank texts, a very long one, repeated rows, null ids and sources."""
    long = " ".join(words[i % len(words)] + str(i % 97) for i in range(6000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "no id here", None), (7, "Füße größer 中文 éé", None)]
