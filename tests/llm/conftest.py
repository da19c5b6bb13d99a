import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names operators use inside
CLASHES = ["size", "hash", "target", "taken", "h", "rep", "node", "digest", "kept", "lang_pred", "score", "row", "part", "queue", "n", "sig", "__hash", "__copies", "__source", "seen"]


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""
    from pyspark.sql import functions as F

    def build(rows, clash=True, parts=3):
        full = [(r + (None,) * 4)[:4] + (len(r[1] or ""),) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(parts)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df

    return build


@pytest.fixture
def words():
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(pool, k=n))
