"""The operators on a session without any setting: the folder of their tables is their own then."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").getOrCreate()
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
from talkledger.llm import queries, simhash
from talkledger.llm.common import shared_dir
assert shared_dir(spark) == shared_dir(spark)
docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, None)], "doc_id long, text string")
assert {r["doc_id"]: r["component_id"] for r in simhash.report(docs).collect()} == {1: 1, 2: 1, 3: 3}
assert queries.QUERIES["op11_maxscore_search"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": HERE}
    done = subprocess.run([sys.executable, "-c", SCRIPT, HERE], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]
