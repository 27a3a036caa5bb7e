"""Executors that are killed while operators run: results stay the same."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

SCRIPT = '''
import json, os, signal, subprocess, sys, threading, time
from pyspark.sql import SparkSession, functions as F

folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,1,800]")
    .config("spark.executor.memory", "800m").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.session.timeZone", "UTC").config("spark.task.maxFailures", "8").config("spark.deploy.maxExecutorRetries", "-1").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
from gleanery.llm import line_dedup, mixing, ngram_join

def executors():
    out = subprocess.run(["ps", "-eo", "pid,cmd"], capture_output=True, text=True).stdout.splitlines()
    app = spark.sparkContext.applicationId
    return sorted(int(x.split()[0]) for x in out if "CoarseGrainedExecutorBackend" in x and app in x)

base = spark.read.parquet(f"{folder}/documents")
jobs = {
    "op7": lambda: line_dedup.line_counts(base.repartition(5)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)),
    "op1": lambda: ngram_join.near_duplicates(base),
    "op6": lambda: mixing.mix(base).select("doc_id", "size", "taken"),
}
said = {}
for name, job in jobs.items():
    whole = sorted(map(str, job().collect()))
    killed = []
    stop = threading.Event()

    def kill():
        for wait in (0.6, 2.5, 4.0):
            if stop.wait(wait):
                return
            if now := executors():
                os.kill(now[0], signal.SIGKILL)
                killed.append(now[0])

    t = threading.Thread(target=kill)
    t.start()
    again = sorted(map(str, job().collect()))
    stop.set()
    t.join()
    said[name] = [len(whole), again == whole, len(killed)]
print("RESULT " + json.dumps(said))
spark.stop()
'''


@pytest.mark.skipif(sys.platform != "linux", reason="kills by process id")
def test_results_survive_lost_executors(spark, tmp_path):
    home, repo = tmp_path / "home", Path(__file__).resolve().parents[2]
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' folders go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    from tests.llm import data

    rows = [((i * 37) % 1009, t, "en", "ab"[i % 2], None) for i, t in enumerate(data.texts() * 4)] + [(2000 + i, data.prose(i, 200), "en", "c", None) for i in range(300)]
    spark.createDataFrame(rows, data.SCHEMA).repartition(6).write.parquet(str(tmp_path / "documents"))
    (tmp_path / "run.py").write_text(SCRIPT)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    line = next((x for x in out.stdout.splitlines() if x.startswith("RESULT ")), None)
    assert line, out.stderr[-2000:]
    for n, same, killed in json.loads(line.removeprefix("RESULT ")).values():
        assert n == len(rows) and same and killed
