"""Without the corpus subpackage, with or without the pipeline's module, all other queries are there."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(len(q), any(n.startswith('op1_') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_corpus_subpackage(tmp_path, also):
    from geomart.plans import catalog, catalog_models, catalog_more, catalog_rules, catalog_sources  # noqa: F401

    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *also))
    told = subprocess.run([sys.executable, "-c", COUNT], cwd=tree, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True)
    assert told.stdout.split() == [str(len(catalog.QUERIES | catalog.WITHOUT_SQL)), "False"]


def test_an_error_of_the_core_is_told(monkeypatch):
    import __spark_entry__

    def broken(name):
        raise ModuleNotFoundError("no", name="geomart.functions.nowhere")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
