"""Python workers of a cluster find the package although they start elsewhere and nothing tells them where it is."""

import importlib.util
import os
import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.executor.memory", "900m").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + os.getcwd() + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
from weftline import session
assert not session.workers_find_package()
got = __spark_entry__.queries()[{name!r}](spark, "/root/testdata/sf0.001")
print("ROWS", got.count(), session.ship(spark) == session.ship(spark))
os._exit(0)
"""


def on_a_cluster(folder: Path, name: str) -> str:
    """Runs a query in executors that start in folders of their own, without this repository in their path."""
    home = folder / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(folder / "local")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), name=name)], cwd=folder, env=env, capture_output=True, text=True, timeout=280)
    return done.stdout + done.stderr


def test_workers_get_the_package(tmp_path):
    said = on_a_cluster(tmp_path, "fetch_per_row")
    assert re.search(r"ROWS [1-9]\d* True", said), said[-3000:]
