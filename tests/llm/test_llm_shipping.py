"""Every operator and every stage runs where workers have no copy of the package."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = entry.SMOKE_DIR

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone
import __spark_entry__ as entry
from postflow.session import build_session
spark = build_session(master="local[4]", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("OFF")


def missing(batches):
    import importlib.util

    import pyarrow as pa

    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("postflow") is None])], ["gone"])


assert spark.range(1).mapInArrow(missing, "gone boolean").first()["gone"], "the workers have the package"
for name, build in entry.queries().items():
    if name == "pipeline" or name.startswith("op"):
        try:
            print("ran", name, len(build(spark, {folder!r}).collect()) > 0)
        except Exception as error:
            print("failed", name, str(error)[-1500:])
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, folder=FOLDER)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op")]
    assert [line for line in done.stdout.splitlines() if not line.startswith("ran ")] == [], done.stderr[-2000:]
    assert [line for line in done.stdout.splitlines()] == [f"ran {n} True" for n in names]
