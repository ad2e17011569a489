"""A local session whose configuration names no shared folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from strom.session import checkpoint_root, cut_lineage, local_session
spark = local_session("1", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
root = checkpoint_root(spark)
assert root == checkpoint_root(spark)
assert cut_lineage(spark.range(5)).count() == 5
print("written below", root)
"""


def test_intermediates_of_a_session_without_the_setting(tmp_path):
    # in a process of its own, as the setting of this one may come from the machine's defaults
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0 and "written below" in run.stdout, run.stderr[-2000:]
