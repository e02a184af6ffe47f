"""The driver's entry points, with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()), e.HAS_LLM)"


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "value", "seq"] and df.count() > 0


def test_without_training_data(tmp_path):
    shutil.copytree(ROOT / "lamella", tmp_path / "lamella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    n, n_sql, subset, has = out.stdout.split()
    assert int(n) > 60 and int(n_sql) > 60 and subset == "True" and has == "False", out.stderr


def test_without_its_two_folders(tmp_path):
    """Only the subpackage and its tests are gone; the pipeline's module is still there."""
    skip = shutil.ignore_patterns("llm", "__pycache__", "test_entry.py")
    shutil.copytree(ROOT / "lamella", tmp_path / "lamella", ignore=skip)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    n, n_sql, subset, has = out.stdout.split()
    assert int(n) > 60 and int(n_sql) > 60 and subset == "True" and has == "False", out.stderr
    tests = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert tests.returncode == 0 and "error" not in tests.stdout.lower(), tests.stdout[-2000:]
