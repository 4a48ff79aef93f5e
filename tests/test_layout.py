"""The package stands without its corpus part, and reaches executors that do not have it on their path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(ROOT)!r})\n{code}"], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)


def test_core_does_not_import_the_corpus_part(tmp_path):
    got = run("import quarry.catalog, quarry.streaming.progressive, quarry.sources.files; print(any(m.startswith('quarry.llm') for m in sys.modules))", tmp_path)
    assert got.stdout.strip() == "False", got.stderr


def test_python_functions_run_from_any_folder(tmp_path, sf_dir):
    code = f"""
from quarry.session import build
from quarry import catalog
spark = build("local[2]", spark__sql__shuffle__partitions=2)
print("rows", catalog.QUERIES["max_similarity_to_labelled"](spark, {sf_dir!r}).count(), catalog.QUERIES["op_one_hot"](spark, {sf_dir!r}).count())
"""
    got = run(code, tmp_path)
    assert "rows 444 59" in got.stdout, got.stderr[-2000:]
