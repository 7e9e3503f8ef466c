"""The driver's contract holds with and without the removable part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("quillmill/llm",), ("quillmill/llm", "corpus_pipeline.py"), ()])
def test_queries_without_the_removable_part(tmp_path, gone):
    for name in ("quillmill", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"],
        cwd=tmp_path, capture_output=True, text=True, check=True,
    ).stdout.split()
    assert "flagship_chat_records" in told
    if gone:
        assert not any(x.startswith("op") or x == "pipeline" for x in told)
