import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture()
def make_docs(spark):
    """Documents with clashing extra columns; rows are (doc_id, text)."""

    def make(rows):
        full = [(i, t, "en", "src", len(t or ""), 1, "x", "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, g int, id string, th string")

    return make
