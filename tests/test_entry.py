"""The registered queries with the text subpackage, and without it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("llm", "leftovers")])
def test_entry_without_the_text_subpackage(tmp_path, left_out):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if "corpus_pipeline.py" not in left_out and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/gaugeline", tmp_path / "gaugeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if "leftovers" in left_out:
        (tmp_path / "gaugeline" / "llm" / "__pycache__").mkdir(parents=True)
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr
    from gaugeline.queries.catalog import QUERIES

    assert run.stdout.split() == sorted(QUERIES)


def test_every_operator_is_registered_once():
    pytest.importorskip("gaugeline.llm.queries")
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, len(numbers) + 1)) and "pipeline" in entry.queries()
