"""The driver may take the training-data operators away; everything else must stand."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def copy(tmp_path):
    folder = tmp_path / "repo"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    return folder


def test_entry_without_the_subpackage(tmp_path):
    out = run(copy(tmp_path), "import __spark_entry__ as e; q = e.queries(); assert 't2_canonical' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q); print(len(q))")
    assert out.returncode == 0, out.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    folder = copy(tmp_path)
    (folder / "runlake" / "llm").mkdir()
    (folder / "runlake" / "llm" / "__init__.py").write_text("")
    (folder / "runlake" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    out = run(folder, "import __spark_entry__")
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr


def test_nothing_else_imports_it():
    for top, _, names in os.walk(os.path.join(ROOT, "runlake")):
        if os.path.basename(top) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(top, name), encoding="utf-8").read()
                    assert "runlake.llm" not in text and "corpus_pipeline" not in text
