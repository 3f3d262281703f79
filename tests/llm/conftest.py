import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "van") for b in ("ra", "di", "sol", "") for c in ("na", "ve", "s", "rum")]


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def make_text():
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark, make_text):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators'."""

    def build(extra=()):
        base = [(i, make_text(i, 120), ["en", "de"][i % 2], f"s{i % 3}", 1) for i in range(12)]
        base += [(20, None, "en", "s0", None), (21, "", "en", "s1", 0), (None, make_text(99, 60), "en", "s0", 1), (22, "   \n\t ", None, None, 5), (23, make_text(5, 40_000), "en", "s0", 1)]
        base += [base[3], base[3]]
        rows = [(*r, 7, 8, 9, "x", "y") for r in [*base, *extra]]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root long, node long, a long, n string, keys string")

    return build


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents().where("false")
