"""Every registered query on a session that this repository did not build, from
another folder and without the package on the Python path of the workers."""

import os
import subprocess
import sys

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
before = dict(spark.sparkContext.getConf().getAll())
print("entry", m.entry(spark).count())
for name, query in sorted(m.queries().items()):
    if name == "pipeline" or name.startswith("op"):
        continue
    try:
        print("ran", name, query(spark, sys.argv[2]).count(), flush=True)
    except Exception as e:
        print("FAILED", name, type(e).__name__, str(e)[:300], flush=True)
print("constraints", spark.conf.get("spark.sql.constraintPropagation.enabled"))
"""


def test_all_queries_run_on_a_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "SPARK_HOME")}
    env["PYSPARK_PYTHON"] = sys.executable
    got = subprocess.run([sys.executable, "-c", SCRIPT, ENTRY, "/root/testdata/sf0.001"], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=1500)
    lines = got.stdout.splitlines()
    assert not [x for x in lines if x.startswith("FAILED")] and got.returncode == 0, got.stdout[-2000:] + got.stderr[-2000:]
    assert sum(x.startswith("ran ") for x in lines) >= 75
    assert "constraints true" in lines  # the caller's optimiser settings are left alone
