import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with an extra column whose names clash with inner ones."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x", 1) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, component string, score int")
    return make
