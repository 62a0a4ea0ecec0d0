"""The engine stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = "import __spark_entry__ as e; q = e.queries(); assert 'and_or_precedence' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    (tmp_path / "r/slateql/llm/__pycache__").mkdir(parents=True)  # what a deletion may leave
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(REPO, "slateql")):
        if "llm" not in folder.split(os.sep):
            for name in files:
                if name.endswith(".py"):
                    assert "slateql.llm" not in open(os.path.join(folder, name)).read(), name
