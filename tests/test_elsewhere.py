import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_file", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert not spark.conf.get("spark.checkpoint.dir", None)
for name in ("knn_graph", "frontier", "cosine_pairs", "score_batches", "bootstrap_ci_cells", "greedy_walk_lazy"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_tasks_run_from_any_folder(tmp_path):
    """Executors that do not have the package on their path still run its task functions, and a local session whose
    configuration names no checkpoint folder gets one of its own."""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run([sys.executable, "-c", CODE.format(path=os.path.join(ROOT, "__spark_entry__.py"))],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("True") == 6
