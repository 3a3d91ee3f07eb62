import random

import pytest

WORDS = "the of and to in der die und das nicht le la les des que el los una por para alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def prose(rng):
    """prose(n): n random words."""
    return lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def documents(spark):
    """documents(rows, **more): rows (doc_id, text) with columns whose names clash with those the operators use inside."""
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, cls string, block int, row int, score string, rank int"):
        names = [part.split()[0] for part in schema.split(",")]
        full = [tuple(dict(zip(("doc_id", "text", "lang", "source"), r)).get(n) for n in names) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
