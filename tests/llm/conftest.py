"""Small corpora with the awkward cases that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, fp long, k int, score double, shard int"


def words(r, n):
    return " ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, copies, columns whose names operators use inside."""
    r = random.Random(3)
    long = "\n".join(words(r, 12) for _ in range(3000))
    shared = words(r, 60)
    texts = [
        None, "", " ", "\n\n", "a", "é", "one two", "Hello, World! 3", long, long, shared, shared, words(r, 20) + " " + shared + " " + words(r, 20), "x" * 5000, "ab " * 700, "🙂🙂 日本語 text",
        "mail me: ann.lee@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1", "DUP!! DUP!! DUP!! DUP!!", "NUL \x00 byte and tab\tend", *[words(r, 40) for _ in range(10)],
    ]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None if t is None else len(t), "z", 1, 2, 0.5, 9) for i, t in enumerate(texts)]
    rows += [rows[10], rows[16], (None, "no id here at all", "de", None, 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
