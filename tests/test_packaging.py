"""The package works when the session starts in another folder."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from trialspan.session import session
from trialspan.operators.neighbours import knn_join
s = session("local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
df = s.createDataFrame([(i, float(i), float(i % 3)) for i in range(20)], "id long, a double, b double")
import inspect, trialspan.operators.neighbours as n
print("ROWS", n.knn_join(n.vectors(df, "id", ["a", "b"]), n.vectors(df, "id", ["a", "b"]), 2).count())
"""


def test_started_elsewhere(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r})\n" + CODE  # the driver alone knows the folder
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 40" in got.stdout, got.stderr[-2000:]
