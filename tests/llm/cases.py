"""Small tables with every odd case: nulls, empty and very long texts, repeated rows, clashing column names."""

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
COPY = " ".join(f"tok{i}" for i in range(80))
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, words int, quality int, mix int, key int, "
          "spans int, id int, `__parts` int, label int, `a.b` int")


def rows():
    base = [
        (1, None, "en", "src0"), (2, "", "en", "src0"), (3, " \t\n ", None, "src1"), (4, "one two", "de", None),
        (5, LONG, "en", "src0"), (6, COPY, "fr", "src2"), (7, COPY, "fr", "src2"), (7, COPY, "fr", "src2"),
        (8, COPY + " end", "fr", "src2"), (None, COPY, "en", "src3"), (9, "mail a@b.co now", None, None),
        (10, "Thing is. " * 40, "en", "src0"), (11, " ".join(f"Clean{i} text," for i in range(60)) + ".", "en", "src4"),
    ]
    return [(*r, len(r[1] or ""), *[n] * 9) for n, r in enumerate(base)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
