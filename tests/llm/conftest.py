import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, columns with clashing names."""
    r = random.Random(7)
    words = [f"wörd{i}" for i in range(400)]
    base = " ".join(r.choice(words) for _ in range(300))
    near = base.split()
    near[40] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "One  TWO"), (9, "1 2 %% 3"), (None, base), (None, None)]
    rows += [(20, " ".join(r.choice(words) for _ in range(9000)))]
    rows += [(30, "tie tie tie tie tie tie tie tie " * 40), (31, "x" * 3000), (32, "abc" * 500)]
    rows += [(40, "same row again"), (40, "same row again")]
    rows += [(50 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 120)))) for i in range(30)]
    full = [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), "clash", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA + ", key string, bin int").withColumnsRenamed({"bin": "place"})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
