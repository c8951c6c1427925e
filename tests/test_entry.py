"""The driver's entry works with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def probe(at: str) -> list[int]:
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=at, env=os.environ | {"PYTHONPATH": at}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [int(x) for x in out.stdout.split()]


def test_without_the_optional_subpackage(tmp_path):
    at = str(tmp_path / "copy")
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    engine, optional = probe(at)
    assert engine > 150 and optional == 0
    pipeline = os.path.join(at, "corpus_pipeline.py")
    if os.path.exists(pipeline):
        os.remove(pipeline)
        assert probe(at) == [engine, 0]


def test_whole_repository():
    engine, optional = probe(ROOT)
    assert optional in (0, 14) and engine > 150
