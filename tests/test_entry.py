"""The driver contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_the_subpackage(tmp_path):
    for name in ("textloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for child in (ROOT / "textloom").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (tmp_path / "textloom" / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "textloom.llm" not in path.read_text()
