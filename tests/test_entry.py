"""The driver's entry file, with and without the training-data modules."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from parcelry.plans.oracles import ORACLES
from parcelry.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def _counts(at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", _COUNT], cwd=at, env=env, capture_output=True, text=True)


def _copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/parcelry", tmp_path / "parcelry", ignore=shutil.ignore_patterns("__pycache__"))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_training_data_modules_can_be_taken_out(tmp_path, with_pipeline):
    _copy(tmp_path)
    shutil.rmtree(tmp_path / "parcelry" / "llm", ignore_errors=True)
    if not with_pipeline and (tmp_path / "corpus_pipeline.py").exists():
        os.remove(tmp_path / "corpus_pipeline.py")
    done = _counts(tmp_path)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/parcelry/llm"), reason="taken out")
def test_a_fault_inside_them_shows(tmp_path):
    _copy(tmp_path)
    with open(tmp_path / "parcelry" / "llm" / "queries.py", "a") as f:
        f.write("\nimport parcelry.llm.not_there\n")
    assert "not_there" in _counts(tmp_path).stderr
