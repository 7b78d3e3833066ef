"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp double, key string, h int"


def rows_of(texts, start=0):
    return [(start + i, t, "en" if i % 3 else None, ["b", "a", None, "é"][i % 4], len(t) if t is not None else None, "x", 1.5, None, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    sentence = lambda n: " ".join(r.choices(words, k=n))
    shared = sentence(30)
    texts = [None, "", " ", "\n\t", "one", "it's  a\ttest 123", "<|endoftext|> x", "日本語のテキスト です", "😀😀 emoji", "a" * 3000, shared, shared, sentence(20) + " " + shared + " " + sentence(20), shared + " tail", sentence(4000), "x y z " * 40]
    texts += [sentence(r.randint(1, 60)) for _ in range(40)]
    rows = rows_of(texts)
    rows += [rows[10], rows[20], (None, shared, None, None, None, "x", None, None, None), (None, "loose end", "en", "a", 9, "x", None, None, None), (3, "another text of a used id", "en", "a", 5, "x", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
