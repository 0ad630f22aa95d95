"""What the entry point offers of this subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).resolve().parent


def test_one_query_an_operator():
    names = list(entry.queries())
    assert all(len([x for x in names if re.match(rf"op{n}_", x)]) == 1 for n in range(1, 14)) and "pipeline" in names


def test_entry_works_without_the_subpackage():
    code = ("import sys; sys.modules['skyquill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert e.queries() and not e.LLM_QUERIES and 'pipeline' not in e.queries()")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in [*(REPO / "skyquill").rglob("*.py"), REPO / "bench.py", REPO / "check.py"]:
        assert "llm" in path.parts or "skyquill.llm" not in path.read_text()
