import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from rowdelta import sinks, sources
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sinks.write_arrow_folder(spark.range(5), "f.arrow")
print("rows", sources.read(spark, "f.arrow", "arrow").df.count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO).replace('"f.arrow"', repr(str(tmp_path / "f.arrow")))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in out.stdout, out.stderr[-2000:]
