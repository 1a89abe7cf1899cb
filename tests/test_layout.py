"""The package must work without its corpus subpackage."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "gradus").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*llm", p.read_text(), re.M), p


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
    assert e.entry(spark).count() > 0
