import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark):
    """The smallest documents as (doc_id, text), in order."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text) for r in rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank, short, long and repeated texts, repeated ids, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    plain = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "short"), (5, plain), (6, plain), (6, plain), (7, "short"), (None, plain), (None, None), (8, long), (9, long),
             (10, "don't mail a@b.cd\n\ndon't call +1 (988) 555-2485"), (2**62 + 1, "é ü 中文 \x00 end")]
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), 0, "x", 1.0) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, row string, score double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
