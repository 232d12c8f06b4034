import random

import pytest

WORDS = [f"w{i}" for i in range(400)] + ["the", "license", "Été", "straße", "x_1", "don't"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, size long"


def awkward(n_plain: int = 60, seed: int = 3):
    """Rows with nulls, empty and very long texts, ties, repeats, near copies, and columns whose names the operators use."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_plain):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None]), f"s{rng.randint(0, 3)}", 1, "a", 0.5, 9))
    base = [rng.choice(WORDS) for _ in range(150)]
    for k in range(8):
        near = list(base)
        near[rng.randrange(150)] = f"changed{k}"
        rows.append((100 + k, " ".join(near), "en", "s0", 1, "a", 0.5, 9))
    rows += [(200, " ".join(base), "en", "s0", 1, "a", 0.5, 9)] * 2
    rows += [(300, None, "en", None, None, None, None, None), (301, "", None, "s1", 0, "", 0.0, 0), (302, "!!! ...", "fr", "", 1, "", 0.0, 0), (None, "no id here at all", "en", "s2", 1, "", 0.0, 0)]
    rows += [(303, "long " * 40_000 + "Licensed under the Apache License, Version 2.0.", "en", "s1", 1, "", 0.0, 0), (304, "one", "fr", "s9", 1, "", 0.0, 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
