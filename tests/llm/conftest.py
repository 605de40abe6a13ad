import random

import pytest

AWKWARD = "doc_id long, text string, source string, spans string, fp int, __k1 string, __row long, n_words string, row string"


def prose(rng, n):
    return " ".join(rng.choice("the of and red blue stone river walks under over light dark north south idiot clown".split()) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with working columns."""
    rng = random.Random(5)
    long_ = prose(rng, 30_000)
    passage = prose(rng, 60)
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "One  two", long_, passage, passage + "\n" + prose(rng, 20), prose(rng, 20) + " " + passage, "x y z " * 50, "ÀÉ ß İ 中文 😀 a\x00b", "a b c d", "line\nline\n\nline", "<|im_end|> & $ %"]
    texts += [prose(rng, rng.randrange(5, 80)) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}", "s", i, "k", i, "w", "r") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[20], (None, texts[21], None, None, None, None, None, None, None), (None, "alone " * 12, None, None, None, None, None, None, None), (3, "another text under a used id", "s0", "s", 1, "k", 1, "w", "r")]
    near = texts[22].split()
    rows.append((900, " ".join([*near[:-1], "changed"]), "s1", "s", 1, "k", 1, "w", "r"))
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)


def multiset(rows):
    return sorted(rows, key=repr)
