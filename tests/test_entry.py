"""The driver's contract, with and without the parts that may be missing."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_other_parts():
    """What is left imports and lists its queries when the operators' subpackage and the pipeline cannot be imported."""
    code = """
import re, sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('tessera.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and not any(re.match('op[0-9]+_', n) or n == 'pipeline' for n in names), list(names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_missing_library_is_an_error():
    """Queries do not vanish because a library that they need is not there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'ahocorasick':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from importlib.util import find_spec
try:
    names = e.queries()
except ModuleNotFoundError as x:
    assert x.name == 'ahocorasick'
else:
    assert 'pipeline' not in names and None in (find_spec('corpus_pipeline'), find_spec('tessera.llm'))
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_rest_without_the_operators_folders(tmp_path):
    """On a copy without the operators' folders, with and without the pipeline, the entry lists the other queries."""
    leave = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=leave)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_entry.py", "-k", "missing_library or nothing_imports", "tests/test_covers.py"], cwd=copy, check=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_nothing_imports_the_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text()
