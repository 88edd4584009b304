"""The entry points without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1_') for q in e.queries()))"


def ask(folder: Path, code: str = CODE) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


@pytest.mark.parametrize("gone", [["lexsieve/llm", "corpus_pipeline.py"], ["lexsieve/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, gone):
    from lexsieve.plans.catalog import QUERIES

    names = shutil.ignore_patterns("__pycache__")
    shutil.copytree(ROOT / "lexsieve", tmp_path / "lexsieve", ignore=lambda d, n: {*names(d, n), *(x for x in n if f"lexsieve/{x}" in gone)})
    for file in ROOT.glob("*.py"):
        if file.name not in gone:
            shutil.copy(file, tmp_path)
    assert ask(tmp_path) == f"{len(QUERIES)} {len(QUERIES)} False"


def test_entry_without_a_library_of_the_optional_part():
    from lexsieve.plans.catalog import QUERIES

    code = "import sys; sys.modules['zstandard'] = None; " + CODE
    assert ask(ROOT, code) == f"{len(QUERIES)} {len(QUERIES)} False"
