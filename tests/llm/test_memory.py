import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: MB of the one Python worker of a session of its own, at first and after each operator.
SCRIPT = """
import json, os, sys, tempfile
import pyarrow as pa
from pyspark.sql import SparkSession
from loomgraph.llm import near, substrings

folder = tempfile.mkdtemp(dir=sys.argv[1])
conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{folder}", "spark.local.dir": folder}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()

def resident(batches):
    list(batches)
    with open("/proc/self/status") as f:
        kb = next(int(x.split()[1]) for x in f if x.startswith("RssAnon"))
    yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([kb // 1000])], ["pid", "mb"])

def now():
    return [tuple(r) for r in spark.range(0, 1, 1, 1).mapInArrow(resident, "pid long, mb long").collect()]

docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(1)
told = [now(), now()]
for df in (near.of_texts(docs), substrings.repeats(docs)):
    df.write.format("noop").mode("overwrite").save()
    told.append(now())
print(json.dumps(told))
"""


def test_workers_give_back_what_tasks_took(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, check=True, timeout=300)
    told = json.loads(done.stdout.splitlines()[-1])
    assert len({pid for rows in told for pid, _ in rows}) == 1
    start, *after = (rows[0][1] for rows in told[1:])
    assert max(after) < start + 60, told
