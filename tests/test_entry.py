"""The driver's entry with parts of the repository left out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; names = e.queries(); print(len(names), 'pipeline' in names, any(n.startswith('op1_') for n in names), set(e.oracle_sql()) <= set(names))"


def asked(folder) -> list[str]:
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in paths if p and Path(p).resolve() != ROOT)}
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "stilus", tmp_path / "stilus", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    return tmp_path


def test_without_the_llm_folder_and_the_pipeline(copy):
    whole = asked(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    no_pipeline = asked(copy)
    shutil.rmtree(copy / "stilus" / "llm", ignore_errors=True)
    own = asked(copy)
    assert own[1:] == ["False", "False", "True"] and int(own[0]) > 70 and no_pipeline[1] == "False" and no_pipeline[2] == whole[2]


def test_broken_imports_are_not_hidden(copy):
    llm = copy / "stilus" / "llm"
    if llm.exists():
        (llm / "queries.py").write_text("import a_module_that_is_not_there")
        with pytest.raises(subprocess.CalledProcessError):
            asked(copy)
