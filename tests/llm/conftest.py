import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, t string, fp int, shard string"


def awkward(words=("the", "Tide", "turns", "ÉTÉ", "niño", "a1", "token", "Rain", "fell"), seed=3):
    """Rows with nulls, empty and very long texts, ties and repeated rows; extra columns have clashing names."""
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "Two words", " ".join(r.choices(words, k=30_000))]
    texts += [" ".join(r.choices(words, k=r.randrange(3, 60))) for _ in range(30)]
    texts += [texts[10]] * 3 + [texts[11] + " extra", "\n".join(texts[12:16]), "\n".join(texts[12:16])]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "r", "i", "t", i, None) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id at all", None, None, 12, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rough(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
