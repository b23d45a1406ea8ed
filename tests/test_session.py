import os
import subprocess
import sys
import tempfile

import pytest

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
assert not spark.conf.get("spark.checkpoint.dir", None)
from pagecurate.session import ensure_checkpoint_dir
from pagecurate.operators.ordering import global_index
root = ensure_checkpoint_dir(spark)
assert spark.sparkContext.getCheckpointDir() is not None
rows = global_index(spark.range(20), ["id"], "i").collect()
assert sorted(r.i for r in rows) == list(range(20))
print("OK", root)
"""


def test_unset_checkpoint_dir_is_an_error_outside_local_masters():
    from pagecurate import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_unset_checkpoint_dir_gets_a_scratch_folder():
    conf_dir = tempfile.mkdtemp(prefix="pc-emptyconf-")   # no spark-defaults.conf
    env = dict(os.environ, SPARK_CONF_DIR=conf_dir)
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK" in out.stdout
