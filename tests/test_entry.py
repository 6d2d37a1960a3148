"""The entry module without a session, and without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def said(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr[-800:]
    return [int(x) for x in out.stdout.split()[-2:]]


def test_names_are_known_before_a_session_starts():
    queries, sql = said(ROOT)
    assert queries >= sql > 100


def test_own_queries_stand_alone(tmp_path):
    shutil.copytree(f"{ROOT}/docfacts", tmp_path / "docfacts", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    queries, sql = said(tmp_path)
    assert queries == sql > 100  # every one of them has SQL
