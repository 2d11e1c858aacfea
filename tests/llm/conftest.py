import random

import pytest

#: Columns whose names the operators also use inside.
CLASH = "row string, id bigint, k string, n bigint, start int, component string, size string, taken string, turns string, gone string, stats string, score string, target string, label string, ok string, src string, words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    r = random.Random(4)
    words = ["the", "of", "And", "rain", "über", "señor", "café", "data", "x1", "42", "\U0001f600"]
    text = lambda n: " ".join(r.choice(words) + (".\n" if r.random() < 0.1 else "") for _ in range(n))
    same = text(60)
    rows = [(1, same, "en", "a", 5), (2, same, "en", "a", 5), (2, same, "en", "a", 5), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "de", "b", 3), (6, text(30_000), "en", "a", 1), (None, same, "en", "a", 7), (None, None, None, None, None), (7, same + " more words here", "fr", None, 8), (8, "12345 !!! ---", "de", "b", 2), (9, "\x00nul \ud7ff end", "de", "b", 2)]
    rows += [(i, text(r.randint(1, 80)), r.choice(["en", "de"]), r.choice(["a", "b", "c", None]), i) for i in range(20, 60)]
    extra = [(None, 1, "k", 1, 1, None, "s", "t", "u", "g", "st", "sc", "ta", "l", "o", "sr", "w")] * len(rows)
    return spark.createDataFrame([a + b for a, b in zip(rows, extra, strict=True)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH)


@pytest.fixture(scope="session")
def no_docs(odd_docs, spark):
    return spark.createDataFrame([], odd_docs.schema)
