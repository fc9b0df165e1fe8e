import pytest


@pytest.fixture(scope="session")
def labelled(spark):
    """Documents with clean, junk and toxic texts, and their labels."""
    import random

    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud", "light", "tree", "house", "water", "sky", "road"]
    docs, labels = [], []
    for i in range(900):
        text = " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.randrange(60, 160))) + "."
        quality, toxic = 1, 0
        if i % 6 == 0:
            text, quality = " ".join(w + "###" for w in text.split()), 0
        elif i % 6 == 1:
            text, quality = " ".join([r.choice(words)] * 90), 0
        if i % 8 == 3:
            text, toxic = text + f" you zargo{r.randrange(30)} idiot", 1
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, quality, toxic))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and a column with a clashing name."""
    rows = [
        (1, None, "x"), (2, "", None), (3, " \n\t ", "x"), (None, "no id here at all", "x"), (4, "same words in a row " * 4000, "x"), (5, "twice twice", "x"), (5, "twice twice", "x"),
        (6, "é😀 naïve ÜBER", "x"), (7, "a\u0000b c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string")
