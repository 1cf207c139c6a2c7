"""Small tables of documents with the cases that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words int, score string"


def documents(spark, rows):
    """Rows of (doc_id, text, source); the extra columns clash with operators' own names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, "x") for i, t, s in rows], SCHEMA)


WORDS = "the of and to in is that for with on this from her his they one two three four five six seven eight nine ten".split()


def prose(seed: int, n: int = 80) -> str:
    out = []
    for k in range(n):
        seed = (seed * 1103515245 + 12345 + k) % 2**31
        out.append(WORDS[seed % len(WORDS)] + WORDS[seed // 31 % len(WORDS)])
        if k % 11 == 10:
            out[-1] += "."
    return " ".join(out)


def edge_rows():
    return [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (None, "null id " + prose(1), "b"), (5, prose(2), "a"), (5, prose(2), "a"), (6, "é中😀 " * 30, None), (7, prose(3, 12000), "a"), (8, "ha " * 300, "a")]
