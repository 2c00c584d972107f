"""Python workers that cannot import the package still run its folds."""
import os
import subprocess
import sys

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from coverlens.session import local_session
spark = local_session(4)
for name in ("R2_limiter", "R3_sessions_stream"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0
print("done")
"""


def test_started_from_another_folder(sf, tmp_path):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(path=path, sf=sf)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=240)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
