"""The entry module, with and without the parts that can be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

TOP = Path(__spark_entry__.__file__).parent


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_training_data_operators(tmp_path):
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    shutil.copytree(TOP / "recollect", tmp_path / "recollect", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_the_rest_passes_without_them(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(TOP / name, tmp_path)
    for name in ("recollect", "tests"):
        shutil.copytree(TOP / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_rules.py", "tests/test_entry.py", "-k", "not without", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    shutil.copytree(TOP / "recollect", tmp_path / "recollect", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert "a_module_that_is_missing" in run.stderr


def test_nothing_imports_the_training_data_operators():
    for path in (TOP / "recollect").rglob("*.py"):
        if "llm" not in path.relative_to(TOP).parts:
            assert "llm" not in path.read_text()
