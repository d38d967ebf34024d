"""Documents that every operator must take: nulls, empty, long, tied and repeated rows, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, sha string, row string, score double, key string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))


def docs(spark, rows=None):
    if rows is None:
        rows = [(1, "One two three four five six seven."), (2, "One two three four five six seven."), (2, "One two three four five six seven."),
                (3, None), (4, ""), (5, "   \n\t "), (None, "no id here at all"), (None, None), (6, LONG), (7, LONG + " end"),
                (8, "ÄÖ ß 漢字 😀 ▁ <|endoftext|> don't stop"), (9, "x"), (9, "another text under the same id")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (3, 4) else "src0", None, 7, "s", "r", 0.5, "k") for i, t in rows], DOCS)


def empty(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
