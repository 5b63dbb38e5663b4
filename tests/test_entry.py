"""The entry module, whole and on a copy without the llm folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names_of(folder: str) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return said.stdout.split()


def test_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    whole = names_of(ROOT)
    for folders in (["ledgerloom/llm", "tests/llm"], ["corpus_pipeline.py"]):
        for f in folders:
            path = copy / f
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        left = names_of(str(copy))
        assert left == [n for n in whole if not n.startswith("op") and n != "pipeline"]
    collected = subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "ledgerloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in (f for f in files if f.endswith(".py")):
            assert "llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name


@pytest.mark.parametrize("name", ["memory_upsert", "normalise_cascade", "category_map"])
def test_costly_columns_are_written_out(spark, name):
    """Conditions on types and evidence reach a table of them, not the events, over which they would compute them anew."""
    from ledgerloom.plans import queries as Q

    files = Q.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]
