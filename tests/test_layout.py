"""The library stands without its training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import sys
GONE = set(sys.argv[1:])
class Without:
    def find_spec(self, name, path=None, target=None):
        if any(name == g or name.startswith(g + ".") for g in GONE):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Without())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and "pipeline" not in e.queries()
assert not [n for n in e.queries() if n.startswith("op")]
"""


@pytest.mark.parametrize("gone", [("corpus_pipeline", "kilnbase.llm"), ("regex",)])
def test_entry_imports_without_the_subpackage_or_what_it_needs(gone):
    subprocess.run([sys.executable, "-c", PROBE, *gone], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "kilnbase")):
        if os.path.basename(top) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(top, name)) as f:
                    assert "llm import" not in (text := f.read()) and "from kilnbase.llm" not in text, name
