"""The edge table of the operator tests, and fixtures of it to import."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, score string"


def edge_rows():
    """NULLs in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns named like results."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base, long = prose(60), prose(200), prose(60_000)
    near = base.split()
    near[100] = "changed"
    texts = [
        None, "", " \t\n\r\x0b\x0c ", "one", "One two THREE.", base, base, " ".join(near), base.upper(),
        prose(30) + " " + passage + " " + prose(40), prose(80) + "\n" + passage, passage, long, "a " * 500,
        "same line\nsame line\nsame line\n" + prose(60), "été naïve Ünïcode 日本語 ŁÓDŹ ßtraße x " * 12,
        "It's <b>### $$$ %% |</b> don't we'll 123 4567\n\n\n   tabs\tand  spaces   " * 9,
        "\U0001f600 emoji \U0001f600 <|endoftext|> end", "x" * 5000, prose(120), prose(120),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], None, "old", "old", "old")
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[19], (None, base, "en", None, 1, None, None, None),
             (None, prose(70), None, "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from weblytics.llm.common import store

    return store(spark.createDataFrame(edge_rows(), SCHEMA), "edge")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
