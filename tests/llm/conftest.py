import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = ("words", "block", "slot", "fp", "rank", "kept", "key", "line", "row", "part", "label", "count", "n")


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text) with clashing extra columns."""

    def build(rows, sources=None):
        made = [(i, t, "en", sources[k] if sources else f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(made, DOCS)
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])

    return build


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeats, one very long text, characters beyond the first plane."""
    rng = random.Random(3)
    long = prose(rng, 20_000)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (5, "One two"), (6, prose(rng, 60)), (7, prose(rng, 60)),
        (8, long), (9, long), (None, "a null id of a text"), (None, None), (10, "\U0001f600 é ñ ß  x 字"), (11, "a\nb\n\na\n" * 30),
    ]
