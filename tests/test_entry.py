"""The driver's entry, with and without the training-data subpackage."""

import importlib
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from skyloom.sources import staging

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("skyloom/llm",), ("skyloom/llm", "corpus_pipeline.py")])
def test_engine_queries_survive_without_the_subpackage(tmp_path, gone):
    shutil.copytree(os.path.join(ROOT, "skyloom"), tmp_path / "skyloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() or name.endswith("llm") else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'hotspot_cells' in q and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert importlib.import_module("skyloom.plans.catalog").queries().keys() <= __spark_entry__.queries().keys()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://head:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_folder(Session())
