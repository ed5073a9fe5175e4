"""The warehouse stands alone: with the training-data folders deleted, every other query loads and runs."""

from __future__ import annotations

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
PROGRAM = """
import __spark_entry__ as entry
from strata.registry import QUERIES
from strata.session import build_session

found = entry.queries()
assert len(found) >= 122 and not [n for n in found if n.startswith("op") or n == "pipeline"], sorted(found)
assert set(entry.oracle_sql()) <= set(found)
spark = build_session("local[2]", 4)
print("rows", found["q1_sales_by_company"](spark, "/root/testdata/sf0.001").count())
"""


def test_the_rest_runs_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "strata", copy / "strata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    assert not (copy / "strata" / "llm").exists()
    out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, capture_output=True, text=True, timeout=300,
                         env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0 and "rows 25" in out.stdout, out.stderr[-2000:]


def test_nothing_outside_imports_the_training_data_package():
    named = [p for p in (ROOT / "strata").rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
    assert named == []
