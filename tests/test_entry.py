"""The entry module, with and without the optional subpackage or what it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


def counted(folder: Path, code: str = COUNT) -> list[str]:
    said = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_without_the_optional_subpackage(tmp_path, kept):
    """The folders gone, with or without the pipeline's file; tests outside its folder still find all they import."""
    shutil.copytree(ROOT / "matchlake", tmp_path / "matchlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    n, pipeline, sql = counted(tmp_path)
    assert int(n) > 200 and pipeline == "False" and int(sql) > 150
    said = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout


def test_without_what_the_optional_subpackage_needs():
    hidden = "import sys; sys.modules['public_tokenizers'] = None; " + COUNT
    n, pipeline, _ = counted(ROOT, hidden)
    assert int(n) > 200 and pipeline == "False"
