import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = [
    (1, "The cat sat on the mat. It was a quiet day, and nothing else happened.\nThe end."),
    (2, "The cat sat on the mat. It was a quiet day, and nothing else happened.\nThe end."),
    (3, None),
    (4, ""),
    (5, "x" * 5000),
    (6, LONG),
    (7, "Write to ann.lee@mail.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111, host 10.0.0.255."),
    (8, "▁ literal marker, naïve café 日本語 \U0001f600\tand\r\nlines"),
    (8, "▁ literal marker, naïve café 日本語 \U0001f600\tand\r\nlines"),
    (None, "a row without an id"),
    (9, "   \n\t "),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "src0" if (i or 0) % 2 else None, len(t or ""), 1.5, "clash") for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
