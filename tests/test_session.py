"""Sessions and the shared folder, each in a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

FROZEN = """
from querylume.session import build_session
from querylume.operators.storage import frozen, numbered, shared_dir, thaw
spark = build_session("unset", cpus=2)
assert not spark.conf.get("spark.checkpoint.dir", None)
t = numbered(spark.range(10), "at", "id")
assert [r["id"] for r in t.orderBy("at").collect()] == list(range(10))
assert shared_dir(spark) == shared_dir(spark) and t._frozen_at.startswith(shared_dir(spark))
thaw(t)
"""
ELSEWHERE = """
import sys; sys.path.insert(0, {repo!r})
from querylume.session import build_session
from querylume.operators import graph
spark = build_session("elsewhere", cpus=2)
edges = spark.createDataFrame([("d", "a", "b")], "db_id string, u string, v string")
assert graph.all_shortest_paths(edges).count() == 2
"""
SUBMITTED = """
from querylume.session import build_session
spark = build_session("submitted", cpus=2)
assert spark.sparkContext.master == "local[3]" and spark.conf.get("spark.sql.shuffle.partitions") == "17"
assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
"""


def ran(code: str, tmp_path, *submit: str, path: str = str(REPO)) -> None:
    (tmp_path / "conf").mkdir()
    (tmp_path / "job.py").write_text(code)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": path}
    done = subprocess.run([*(submit or [sys.executable]), "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_shared_folder_without_checkpoint_dir(tmp_path):
    ran(FROZEN, tmp_path)


def test_workers_find_the_package_from_another_folder(tmp_path):
    ran(ELSEWHERE.format(repo=str(REPO)), tmp_path, path="")


def test_what_is_submitted_wins(tmp_path):
    import pyspark

    submit = Path(pyspark.__file__).parent / "bin/spark-submit"
    ran(SUBMITTED, tmp_path, str(submit), "--master", "local[3]", "--conf", "spark.sql.shuffle.partitions=17")
