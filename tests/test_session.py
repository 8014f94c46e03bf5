"""Keeping results in the folder that is named, or in a local one that goes again."""

import subprocess
import sys
import textwrap
from pathlib import Path

from riskweave import session
from riskweave.session import cut, releasing, scratch_dir

ROOT = Path(__file__).resolve().parent.parent


def test_what_is_cut_in_a_block_is_removed_after_it(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))
    outside = cut(spark.range(3).selectExpr("id + 7 as outside"))
    with releasing():
        inside = cut(spark.range(5).selectExpr("id * 11 as inside"))
        assert inside.count() == 5 and len(list(tmp_path.iterdir())) == 2
    assert len(list(tmp_path.iterdir())) == 1 and outside.count() == 3


def test_scratch_folders_go_at_exit(tmp_path):
    code = f"""
        import sys; sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from riskweave.session import cut
        kept = cut(spark.range(3))
        print("FOLDER", kept.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0], kept.count())
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    folder, count = done.stdout.split("FOLDER ")[1].split()
    assert count == "3" and Path(folder).name.startswith("cut-") and not Path(folder).exists()


def test_scratch_folders_differ(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_named_folder_is_used(tmp_path):
    """In a process of its own: the folder is read from the session, the package from the driver only."""
    code = f"""
        import sys; sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
        from riskweave.config import RiskConfig
        from riskweave.operators.vectors import knn
        from riskweave.session import configure, cut, scratch_dir
        configure(spark)
        kept = cut(spark.range(10))
        assert kept.count() == 10 and not kept.is_cached and {str(tmp_path)!r} in kept.inputFiles()[0]
        assert scratch_dir(spark, "x").startswith({str(tmp_path)!r})
        rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(20)], "id string, embedding array<float>")
        a = sorted(map(tuple, knn(rows, rows, 2).collect()))
        b = sorted(map(tuple, knn(rows, rows, 2, RiskConfig(cut_vectors=4)).collect()))
        assert a == b and len(a) == 40
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert not any(tmp_path.glob("cut-*"))
