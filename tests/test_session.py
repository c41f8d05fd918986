"""The package reaches workers that start elsewhere; scratch folders."""

import subprocess
import sys
from pathlib import Path

import pytest

from hazegrid import session

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from hazegrid.session import build_session
from hazegrid.operators.components import cluster_cells
spark = build_session("foreign", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
cells = spark.createDataFrame([(0, 0, True), (0, 1, True), (5, 5, True)], "row int, col int, mask boolean")
print(sorted(r["cluster_size"] for r in cluster_cells(cells, "mask").collect()))
"""


def test_workers_find_the_package_from_a_foreign_folder(tmp_path):
    (tmp_path / "job.py").write_text(SCRIPT)
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py", str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.strip().endswith("[1, 2, 2]"), done.stderr[-2000:]


def test_only_plain_local_mode_may_use_a_temporary_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        def __init__(self, master):
            self.master, self.applicationId = master, f"app-{master}"

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("local", "local[4]", "local[*]"):
        assert session.scratch_root(Session(master))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.scratch_root(Session(master))


def test_discard_removes_a_scratch_table(spark):
    kept = session.materialize(spark.range(3).toDF("x"), "probe")
    path = kept._scratch_path
    assert kept.count() == 3
    session.discard(kept)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def test_shuffle_files_go_with_their_job(spark):
    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    stored = session.materialize(spark.range(1000).repartition(3, "id"), "freed", keep_shuffles=False)
    assert files() <= before and stored.count() == 1000
    assert spark.conf.get(session.FREE_SHUFFLES, None) != "true"
    session.materialize(spark.range(1000).repartition(3, "id"), "kept")
    assert files() - before
