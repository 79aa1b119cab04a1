import os
import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
from lodeworks.scratch import discard, release_scratch, scratch_dir, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
root = scratch_dir(spark)
assert root == scratch_dir(spark) and root.startswith("file:///")
df = stored(spark.range(5), "five")
assert df.count() == 5
empty = stored(spark.range(0).selectExpr("id", "id as p"), "none", ["p"])
assert empty.count() == 0 and empty.columns == ["id", "p"]
discard(df)
release_scratch(spark)
import os
assert not [x for x in os.listdir(root.removeprefix("file://")) if not x.startswith(".")]
print("fine")
"""


def test_own_folder_only_where_none_is_set(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, capture_output=True, text=True, timeout=120, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]


def test_entry_works_without_the_training_operators(tmp_path):
    """The driver removes them: the rest must import and keep its queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lodeworks", tmp_path / "lodeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys() and 'bm25_topk' in q and not any(x.startswith('op') for x in q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert run.returncode == 0 and int(run.stdout) > 40, run.stderr[-2000:]
