import subprocess
import sys
from pathlib import Path

from quernwork.llm import registry

ROOT = Path(__file__).resolve().parents[2]


def test_every_problem_has_queries():
    names = registry.queries()
    for n in (2, 3, 4, 5, 6, 7, 9):
        assert f"p{n}_found" in names
    assert "p8_shares" in names and set(registry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    hits = [p for p in ROOT.glob("quernwork/**/*.py") if "llm" not in p.relative_to(ROOT).parts and "quernwork.llm" in p.read_text()]
    assert not hits


def test_entry_can_be_imported_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, check=True)
