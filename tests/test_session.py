"""Stored steps."""

import glob
import tempfile
import time

from postflow.session import CLEAN_UP, materialise


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """pipeline: the disk holds the shuffles of one step, not those of all before it."""
    local = spark.conf.get("spark.local.dir", tempfile.gettempdir())

    def files():
        return set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))

    df = spark.range(100_000).selectExpr("id % 1000 AS k", "id").repartition(3, "k")
    before, kept = files(), spark.conf.get(CLEAN_UP, "false")
    stored = materialise(df, "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEAN_UP, "false") == kept
    assert stored.count() == df.count() == 100_000
