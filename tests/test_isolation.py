"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("spanloom", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    if (tmp_path / "spanloom/llm").exists():
        shutil.rmtree(tmp_path / "spanloom/llm")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "spanloom")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "spanloom.llm" not in text.read(), f
