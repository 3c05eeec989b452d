"""The pipeline as a query, and what it leaves behind."""

from __future__ import annotations

import corpus_pipeline
from fleetlake import session


def test_run_leaves_one_table(spark, sf_dir):
    since = session.mark()
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert result.count() > 0
    assert session.mark() - since == 1  # the table that the last stage reads
    session.release(spark, since)
