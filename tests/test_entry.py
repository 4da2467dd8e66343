"""The registry, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r["scope"] for r in rows} == {"plain", "best_eval"}


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len([n for n in __spark_entry__.queries() if n[0] == "q"]) == 46


def test_without_the_corpus_operators():
    code = "import sys; sys.modules['bandframe.llm'] = None; import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    names = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    assert len(names) == 46 and all(n[0] == "q" for n in names)


def test_nothing_else_imports_them():
    for path in (REPO / "bandframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "bandframe.llm" not in path.read_text()
