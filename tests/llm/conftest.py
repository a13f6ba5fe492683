from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(*rows):
        full = [(*row, None, None)[:4] for row in rows]
        full = [(*row, None if row[1] is None else len(row[1])) for row in full]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
