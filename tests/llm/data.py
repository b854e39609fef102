"""Small hard inputs that several tests share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

NASTY = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one", "en", "b", 3),
    (5, "one two three four five six seven eight nine ten", "en", "b", 48),
    (6, "one two three four five six seven eight nine ten", "de", "é", 48),
    (7, "ONE two three four five six seven\neight nine ten", "en", "b", 48),
    (8, "naïve café — it's 42% off!!\n\n<tag> & 'quotes'  end\n", "fr", "", 50),
    (9, " ".join(f"w{i % 97}x{i % 31}" for i in range(6000)), "en", "b", 40000),
    (9, "a second text with the same number", "en", "b", 34),
    (9, "a second text with the same number", "en", "b", 34),
    (None, "a text without a number", "en", "b", 23),
]


def nasty(spark):
    """Rows with nulls, ties, repeats, a long text, and extra columns whose names the operators use themselves."""
    rows = [(*r, "x", 1) for r in NASTY]
    return spark.createDataFrame(rows, DOCS + ", key string, n int")


def nothing(spark):
    return spark.createDataFrame([], DOCS)
