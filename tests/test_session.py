"""Scratch tables in the shared folder."""

from __future__ import annotations

import os

from fleetlake import session


def test_release_deletes_what_was_made(spark):
    since = session.mark()
    first, second = session.scratch(spark, "a"), session.scratch(spark, "b")
    for path in (first, second):
        spark.range(3).write.parquet(path)
    session.release(spark, since, keep=(second,))
    assert not os.path.exists(first) and os.path.exists(second)
    session.release(spark, since)
    assert not os.path.exists(second) and session.mark() == since


def test_paths_get_the_default_scheme(spark, tmp_path):
    assert session.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert session.qualified(spark, "file:///a/b").startswith("file:/")
