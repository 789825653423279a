"""The Python steps run where this package is not installed."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from postflow.operators.tokens import clean_text, map_text
from postflow.session import build_session
spark = build_session(master="local[1]", spark__sql__shuffle__partitions="1")
df = spark.createDataFrame([(1, "cats liked")], "id int, text string")
print(clean_text(df).first().stem_tokens, map_text(df, lambda s: s.str.upper()).first().text)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "['cat', 'like'] CATS LIKED" in done.stdout, done.stderr[-2000:]
