"""The library without the training-data folders: the entry point still imports and registers the main queries."""
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    shutil.rmtree(copy / "noticeboard" / "llm")
    shutil.rmtree(copy / "tests" / "llm")
    assert (copy / "corpus_pipeline.py").exists()
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert 'pipeline' not in q and not any(n.startswith('op') for n in q), sorted(q); "
            "assert 'keyword_search' in q and set(e.oracle_sql()) <= set(q); print(len(q))")
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.strip()) > 40
