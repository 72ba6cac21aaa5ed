import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_is_there_where_the_optional_part_cannot_be_imported(monkeypatch):
    import importlib

    def fails(name, real=importlib.import_module):
        if name.startswith("corpusloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
        return real(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fails)
    assert "search_count" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) < set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_part():
    code = "import sys, corpusloom.plans.queries, corpusloom.plans.engine, corpusloom.streaming.turns; sys.exit(any(m.startswith('corpusloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
