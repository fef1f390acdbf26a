import pytest

from llm_fixtures import DOCS, ODD


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated rows, and columns whose names clash with results."""
    rows = [(*r, 7, "x", True) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", n_tokens long, label string, kept boolean")
