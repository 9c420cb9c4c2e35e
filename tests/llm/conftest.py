import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """The texts with columns whose names clash with those that operators make."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), f"h{i}", i * 10) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, rep long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
