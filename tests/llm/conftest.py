import random

import pytest

LINE = "Licensed under the Apache License, Version 2.0."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, repeats within a text, odd characters, empty and long texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices(["an", "er", "th", "é", "ou", "in", "ß", "st"], k=rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = text(60), text(150)
    texts = [text(rng.randint(1, 200)) for _ in range(40)]
    texts += [base, base, base.replace(base.split()[70], "XX"), base + " the end", base.upper()]
    texts += [text(30) + " " + passage + " " + text(20) for _ in range(5)] + [passage, passage + " " + passage]
    texts += ["a " * 500, "\n".join([LINE] * 5), f"CC  BY x\n{LINE}\nall rights reserved", "", None, None, " \t\n", "x", "one two three four", "one two three four", "\x00\x1c odd space 中文 🙂 K", text(9000)]
    rows = [(i, t, ["en", "de", None][i % 3], "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, a doc_id with two texts, and columns whose names the operators use inside."""
    rows = [(1, "a b c d e f " * 20, "en"), (1, "a b c d e f " * 20, "en"), (None, "q w e r t y " * 20, None), (None, None, None), (2, "first text here", "en"), (2, "second text there now", "en")]
    rows = [(*r, "k", 1, 2, 3.0, "m") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, content int, node int, score double, model string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
