from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; the inputs of the tests have them all as further columns.
CLASHING = ["tok", "sig", "h", "n", "start", "end", "key", "block", "component_id", "kept", "ids", "at", "t", "w", "digest", "__id", "score"]


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) tuples, with clashing columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return make
